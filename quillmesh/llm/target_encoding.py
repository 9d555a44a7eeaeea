"""Time-ordered target encoding across folds: how often an id's earlier rows in other folds were hits, with shrinkage to a wider rate.

Rows are added up by sale, item and vendor (by sale, for the columns of a whole sale): these are the history, and they ask for it.
They are dealt by column, key and time slice and sorted by time. Each history row is then replicated to every other fold as
recipient, and running sums over time are kept for each recipient, so that a row's history is what its own fold has
received: nothing is taken away from a total. The sums a row gets end before its own time. Replicas are made after the
exchange, a batch at a time, so that the history crosses the network once and a task holds a batch and five sums.

Keys are exact: a wider value (kind, segment) goes by the least id that has it. A key of more than one in HOT_SHARE lines is
cut into time slices of `slice_seconds`; there are at most HOT_SHARE such keys in a column, whatever the input, so that list alone is
broadcast. What the slices before hold comes to a slice as one row for each recipient. A colder key is one slice.

Defined cases: lines without a sale, sales without a time and their lines are dropped; a sale with several rows counts once, with its
earliest time; an id with several rows in its dimension has its least value; null item and client ids become -1, a null vendor id stays
null and is a value of its own; ids that are in no dimension, and null values there, share one value; an empty history has the prior
rate; empty tables give no rows; the columns named are read and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

FOLDS, HOT_SHARE, SLICE_SECONDS = 5, 1000, 3600
#: Ids whose results are put together at once.
BLOCK = 1 << 16
#: Rate units, the prior of the widest rate, and how many rows the prior counts for.
UNIT, PRIOR, WEIGHT = 1_000_000, 500_000, 50
#: Stands for null or unknown; a time before all others.
NONE, BEFORE_ALL = -(1 << 62), -(1 << 62)
#: Encoded columns by number: those of a whole sale, then those of a line.
SALE_COLUMNS = ("every", "segment", "client")
LINE_COLUMNS = ("kind", "nation", "item", "vendor")
COLUMNS = SALE_COLUMNS + LINE_COLUMNS


def rate(n: Column, s: Column, prior: Column) -> Column:
    """(UNIT * s + WEIGHT * prior) / (n + WEIGHT), rounded down, in longs; the prior where n is 0."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", s * UNIT + prior * WEIGHT, n + WEIGHT))


def micros(column: str) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's zone."""
    since = f"(CAST({column} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01')"
    return F.expr(f"((extract(DAY FROM {since}) * 24L + extract(HOUR FROM {since})) * 60L + extract(MINUTE FROM {since})) * 60000000L + CAST(extract(SECOND FROM {since}) * 1000000 AS BIGINT)")


def value_keys(dimension: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): for each id the least id that has its value; null values are left out."""
    one = dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_v")).where(F.col("_v").isNotNull())
    least = one.groupBy("_v").agg(F.min(F.col(key).cast("long")).alias(name))
    return one.join(least, "_v").select(F.col(key), name)


def events(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """One row for each sale, item and vendor: its numbers of lines and hits, fold, time in microseconds, and the key of each column.

    Lines are added up before they meet their sale, so that a sale of very many equal lines moves few rows.
    """
    hit = F.coalesce(F.col("flag") == "returned", F.lit(False))
    item, client = F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id")
    own = lines.where(F.col("sale_id").isNotNull()).select("sale_id", item, "vendor_id", hit.alias("hit"))
    own = own.groupBy("sale_id", "item_id", "vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("s"))
    sold = sales.where(F.col("sale_id").isNotNull() & F.col("sold_at").isNotNull())
    sold = sold.select("sale_id", F.struct(micros("sold_at").alias("t"), client).alias("_s"))
    sold = sold.groupBy("sale_id").agg(F.min("_s").alias("_s")).select("sale_id", "_s.t", "_s.client_id")
    kinds = value_keys(items, "item_id", "kind", "kind")
    segments = value_keys(clients, "client_id", "segment", "segment")
    nations = vendors.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.min("nation_id").cast("long").alias("nation"))
    sold = sold.join(segments, "client_id", "left").withColumn("fold", (F.crc32(F.col("sale_id").cast("string").cast("binary")) % FOLDS).cast("int"))
    out = own.join(kinds, "item_id", "left").join(nations, "vendor_id", "left").join(sold, "sale_id")
    keys = {"every": F.lit(0).cast("long"), "client": F.col("client_id"), "item": F.col("item_id"), "vendor": F.coalesce(F.col("vendor_id").cast("long"), F.lit(NONE))}
    keys |= {c: F.coalesce(c, F.lit(NONE)) for c in ("segment", "kind", "nation")}
    return out.select("sale_id", "item_id", "vendor_id", "n", "s", "fold", "t", *[k.alias(c) for c, k in keys.items()])


def tall(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(col, key, fold, t, n, s, id): a row for each of the named columns."""
    pairs = F.array(*[F.struct(F.lit(COLUMNS.index(c)).alias("col"), F.col(c).alias("key")) for c in names])
    return rows.select(F.explode(pairs).alias("_p"), "fold", "t", "n", "s", "id").select("_p.col", "_p.key", "fold", "t", "n", "s", "id")


def starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; the first does."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(col, id, n, s) of the rows that ask, from rows sorted by (col, key, slice, t); a row without an id is a sum that its fold has received so far."""
    group = None  # of the row before: its group and time, the sums received up to it, and those before its time
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        col, key, part, fold, t, n, s = (b.column(c).to_numpy() for c in ("col", "key", "slice", "fold", "t", "n", "s"))
        asks = b.column("id").is_valid().to_numpy(zero_copy_only=False)
        recipient = (np.arange(FOLDS) != fold[:, None]) == asks[:, None]
        new_group = starts(col, key, part)
        new_time = new_group | starts(t)
        i = np.arange(len(col))
        group_at = np.maximum.accumulate(np.where(new_group, i, 0))
        time_at = np.maximum.accumulate(np.where(new_time, i, 0))
        received = np.stack([np.where(recipient, v[:, None], 0) for v in (n, s)])
        sums = np.concatenate([np.zeros((2, 1, FOLDS), np.int64), np.cumsum(received, axis=1)], axis=1)
        before = sums[:, time_at] - sums[:, group_at]  # this batch's own share
        first = group_at == 0
        if group == (col[0], key[0], part[0]):
            tied = first & (time_at == 0) & (t == at)
            before[:, first & ~tied] += total[:, None]
            before[:, tied] += total_before[:, None]
        else:
            total = np.zeros((2, FOLDS), np.int64)
            total_before = total
        end, begin = len(col) - 1, group_at[-1]
        if begin:
            total = np.zeros((2, FOLDS), np.int64)
        whole = total + sums[:, -1] - sums[:, begin]
        total_before = before[:, end].copy()
        total, group, at = whole, (col[end], key[end], part[end]), t[end]
        yield pa.RecordBatch.from_arrays([b.column("col").filter(asks), b.column("id").filter(asks), *[pa.array(v[i, fold][asks]) for v in before]], ["col", "id", "n", "s"])


def hot_keys(rows: DataFrame, total: int) -> DataFrame:
    """(col, key) of keys with more than one in HOT_SHARE of all lines: at most HOT_SHARE for each column, for broadcast."""
    return F.broadcast(rows.groupBy("col", "key").agg(F.sum("n").alias("_n")).where(F.col("_n") * HOT_SHARE > total).select("col", "key", F.lit(True).alias("_hot")))


def histories(rows: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(col, id, n, s) of every row (col, key, fold, t, n, s, id): the lines and hits of its key in other folds at earlier times."""
    total = rows.where(F.col("col") == 0).agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(rows, total)
    part = F.floor(F.col("t") / (slice_seconds * 1_000_000)).cast("long")
    zero = F.lit(0).cast("long")
    # what earlier slices of a hot key hold for each recipient; a slice where only the recipient has rows gets a sum too
    sums = rows.join(hot, ["col", "key"]).groupBy("col", "key", "fold", part.alias("slice")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    others = F.array_except(F.array(*map(F.lit, range(FOLDS))), F.array("fold"))
    mine = sums.select("col", "key", F.col("fold").alias("to"), "slice", zero.alias("n"), zero.alias("s"))
    theirs = sums.select("col", "key", F.explode(others).alias("to"), "slice", "n", "s")
    totals = mine.unionByName(theirs).groupBy("col", "key", "to", "slice").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    before = W.partitionBy("col", "key", "to").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("col", "key", F.col("to").alias("fold"), F.lit(BEFORE_ALL).alias("t"), F.coalesce(F.sum("n").over(before), zero).alias("n"), F.coalesce(F.sum("s").over(before), zero).alias("s"), F.lit(None).cast("long").alias("id"), "slice")
    sliced = rows.join(hot, ["col", "key"], "left").withColumn("slice", F.when(F.col("_hot"), part).otherwise(F.lit(BEFORE_ALL))).drop("_hot")
    met = sliced.unionByName(carried).repartition("col", "key", "slice").sortWithinPartitions("col", "key", "slice", "t")
    return met.mapInArrow(running, "col int, id long, n long, s long")


def put_together(names: tuple[str, ...]):
    """For cogroup: rows of a block of ids with <column>_n and <column>_s of each named column, from what was found for the block."""

    def put(rows: pa.Table, found: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        at = order[np.searchsorted(ids, found.column("id").to_numpy(), sorter=order)]
        col = found.column("col").to_numpy()
        rows = rows.drop_columns("block")
        for c in names:
            mine = col == COLUMNS.index(c)
            for v in ("n", "s"):
                out = np.zeros(len(ids), np.int64)
                out[at[mine]] = found.column(v).to_numpy()[mine]
                rows = rows.append_column(f"{c}_{v}", pa.array(out))
        return rows

    return put


def joined(rows: DataFrame, found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows (id, ...) with what was found for their ids, in blocks of BLOCK ids."""
    block = F.floor(F.col("id") / BLOCK).alias("block")
    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes] + [f"{c}_{v} long" for c in names for v in ("n", "s")])
    mine = found.where(F.col("col").isin([COLUMNS.index(c) for c in names])).select("col", "id", "n", "s", block)
    return rows.select("*", block).groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(put_together(names), schema)


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(sale_id, item_id, vendor_id, n_lines, n_returned) with <column>_n and <column>_rate of all seven columns."""
    base = written(events(lines, sales, items, vendors, clients).withColumn("id", F.monotonically_increasing_id()), "events")
    by_sale = base.groupBy("sale_id", "fold", "t", *SALE_COLUMNS).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_sale = written(by_sale.withColumn("id", F.monotonically_increasing_id()), "sales")
    found = written(histories(tall(by_sale, SALE_COLUMNS).unionByName(tall(base, LINE_COLUMNS)), slice_seconds), "running")
    out = joined(base.select("id", "sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned")), found, LINE_COLUMNS)
    out = out.drop("id").join(joined(by_sale.select("id", "sale_id"), found, SALE_COLUMNS).drop("id"), "sale_id")
    priors = {"every": F.lit(PRIOR).cast("long")} | {c: F.col("every_rate") for c in ("kind", "nation", "segment")} | {"item": F.col("kind_rate"), "vendor": F.col("nation_rate"), "client": F.col("segment_rate")}
    for c, prior in priors.items():
        out = out.withColumn(f"{c}_rate", rate(F.col(f"{c}_n"), F.col(f"{c}_s"), prior))
    return out.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", *[f"{c}_{x}" for c in COLUMNS for x in ("n", "rate")])
