"""Line dedup over all documents, with built-in functions only.

Lines are reduced to 128-bit hashes; the hashes are range-partitioned by (hash, document) and sorted by document and
position, so that the first occurrence of a key in each document streams by without a group in memory, and a key that a
third of all lines share is spread over many ranges. Each range counts its keys, the counts are added, and the verdict on a key
is joined back by key and range, so that no common key meets in one task. What comes back is a run-length coded keep bitmap
for each document; texts move once, when a caller applies the bitmaps.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one document, judged row by row, and
rows alike in doc_id and text get the same bitmap; rows with a null doc_id are counted as no document and lose the lines
that others lose; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLANKS, ascii_lower, cut, text_key

MIN_DOCS, MIN_CHARS = 5, 40


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row_key, pos) of every line whose key has min_chars code points or more."""
    lines = docs.select("doc_id", text_key().alias("row_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    keyed = lines.select("doc_id", "row_key", "pos", key.alias("line")).where(F.length("line") >= min_chars)
    keyed = keyed.select("doc_id", "row_key", "pos", ascii_lower(F.col("line")).alias("key"))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_key", "pos")


def ranged(postings: DataFrame) -> DataFrame:
    """postings with their range, and whether they are the first of their key in their document; dealt once, into a checkpoint."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without an id spread by their text
    keys = ["h1", "h2", "doc_id", "apart"]
    p = postings.withColumn("apart", F.when(F.col("doc_id").isNull(), F.col("row_key"))).repartitionByRange(n, *keys).sortWithinPartitions(*keys, "pos")
    first = F.row_number().over(W.partitionBy(*keys).orderBy("pos")) == 1
    return cut(p.select("h1", "h2", "doc_id", "row_key", "pos", (first & F.col("doc_id").isNotNull()).alias("is_first"), F.spark_partition_id().alias("range")))


def frequent_keys(placed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, range, keeper) of keys in min_docs documents or more, a row for each range that holds the key; keeper is the largest doc_id that does."""
    by_range = placed.groupBy("h1", "h2", "range").agg(F.count_if("is_first").alias("n"), F.max("doc_id").alias("last"))
    whole = by_range.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("last").alias("keeper")).where(F.col("n_docs") >= min_docs)
    return by_range.select("h1", "h2", "range").join(whole.select("h1", "h2", "keeper"), ["h1", "h2"])


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, keep_first, keep_runs): one row for each distinct doc_id and text.

    keep_runs holds the lengths of runs of kept and dropped lines in turn; keep_first tells what the first run is.
    """
    placed = ranged(line_postings(docs, min_chars))
    frequent = frequent_keys(placed, min_docs)
    dropped = (
        placed.join(frequent, ["h1", "h2", "range"])
        .where(F.coalesce(F.col("doc_id") != F.col("keeper"), F.lit(True)))
        .groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    )
    rows = docs.select("doc_id", text_key().alias("row_key"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")).distinct()
    d = dropped.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "drops")
    joined = rows.join(d, rows.doc_id.eqNullSafe(d._doc) & (rows.row_key == d._key), "left")
    drops = F.coalesce(F.col("drops"), F.array().cast("array<int>"))
    # runs: bounds are where the state changes, i.e. at p for a drop whose predecessor stays, at p+1 for one whose successor stays
    at = F.col("drops")
    starts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    ends = F.transform(F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) != p + 1, F.lit(True))), lambda p: p + 1)
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), starts, ends, F.array(F.col("n_lines").cast("int")))))
    runs = F.zip_with(F.slice(bounds, 2, F.size(bounds) - 1), F.slice(bounds, 1, F.size(bounds) - 1), lambda b, a: b - a)
    return joined.select(
        "doc_id",
        "row_key",
        "n_lines",
        F.size(drops).cast("long").alias("n_dropped"),
        (F.size(drops) == 0).__or__(~F.array_contains(drops, 0)).alias("keep_first"),
        F.when(F.size(drops) == 0, F.array(F.col("n_lines").cast("int"))).otherwise(runs).alias("keep_runs"),
    )


def kept_text(text: Column, keep_first: Column, keep_runs: Column) -> Column:
    """The kept lines, joined by line feeds."""
    flags = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat((i % 2 == 0) == keep_first, n)))
    whole = keep_first & (F.size(keep_runs) == 1)
    chosen = F.filter(F.zip_with(lines_of(text), flags, lambda x, k: F.when(k, x)), lambda x: x.isNotNull())
    return F.when(whole, F.coalesce(text, F.lit(""))).otherwise(F.array_join(chosen, "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs, each row as the struct _row, with its n_lines, n_dropped and kept_text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_d"), text_key().alias("_k"))
    b = bitmaps
    joined = rows.join(b, F.col("_d").eqNullSafe(b.doc_id) & (F.col("_k") == b.row_key))
    return joined.select("_row", "n_lines", "n_dropped", kept_text(F.col("_row.text"), F.col("keep_first"), F.col("keep_runs")).alias("kept_text"))
