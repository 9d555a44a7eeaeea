"""Sharding, target encoding and turn repair against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import queries, sharding, target_encoding, turn_repair

# --- turns ---------------------------------------------------------------------------------------------------------------


def brute_repair(turns):
    """The cheapest of all edits of (role, text) in order, by (cost, audit): a search over all ways with up to three insertions at a place."""
    seen, faults = set(), []
    for role, text in turns:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = None

    def go(i, state, cost, audit, out, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and state in ("", "a"):
            found = (cost, audit, tuple(out))
            best = min(best, found) if best else found
        if inserted < 3:
            for to in after[state]:
                if to != "s":
                    go(i, to, cost + 2, audit + "I", [*out, ("user:" if to == "u" else "assistant:")], inserted + 1)
        if i < len(turns):
            role, text = turns[i]
            go(i + 1, state, cost + 3, audit + "D", out, 0)
            if faults[i] in "-t":
                more = faults[i] == "t"
                for to in after[state]:
                    if role[:1] == to:
                        go(i + 1, to, cost + more, audit + "K", [*out, f"{role}:{text}"], 0)
                    if to != "s":
                        go(i + 1, to, cost + more + 2, audit + "R", [*out, ("user:" if to == "u" else "assistant:") + text], 0)

    best = (3 * len(turns), "D" * len(turns), ())
    go(0, "", 0, "", [], 0)
    cost, audit, out = best
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(), "illegal": illegal, **{n: faults.count(n[0]) for n in ("blank", "duplicate", "truncated")}}


def repaired(spark, rows, piece, fan=2):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS g", "1 AS cost", "'y' AS piece")
    fixed = turn_repair.repair(df, piece, fan)
    hashes = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(fixed.turns).collect()}
    return {r.conv_id: {**r.asDict(), "repaired_sha256": hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest())} for r in fixed.conversations.collect()}


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_repairs_against_all_edits(spark, piece):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 7)):
            text = rng.choice(["Yes.", "No!", "cut", "", " \n", "a?", "b.", "c.", "d.", None])
            rows.append((conv, rng.choice([None, turn, turn, turn * 2]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), text))
    rows += [(100, t, "user", "w.") for t in range(4)] + [(101, None, "", ""), (101, None, None, None)]
    got = repaired(spark, rows, piece)
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        want = brute_repair([x[2:] for x in sorted(turns)])
        known = {x[1] for x in turns if x[0]}
        want["gaps"] = max(known) - min(known) + 1 - len(known) if known else 0
        assert {k: got[conv][k] for k in want} == want, (conv, sorted(turns))


def test_a_long_conversation_is_repaired_in_pieces(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "user", "system"]), f"{i % 50}{rng.choice(['.', '', '!'])}") for i in range(600)]
    whole, cut = (repaired(spark, rows, p, f)[7] for p, f in ((1024, 64), (16, 4)))
    assert whole == cut and len(whole["audit"]) >= 600
    assert repaired(spark, rows[:0], 16) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if d == 1 else text.translate({ord(x): None for x in ".!?"}) if d == 2 else text
        want[c, t, "user" if d == 4 else role, text] += {0: 0, 3: 2}.get(d, 1)
    assert got == +want


# --- shards --------------------------------------------------------------------------------------------------------------


def test_draws_have_the_hypergeometric_law(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 0)
    n = 20_000
    own = np.bincount([sharding.hypergeometric(rng, 30, 20, 12) for _ in range(n)], minlength=13)
    theirs = np.bincount(rng.hypergeometric(30, 20, 12, size=20 * n), minlength=13) / 20
    assert ((own - theirs) ** 2 / np.maximum(theirs, 5)).sum() < 40
    edge = {sharding.hypergeometric(rng, g, b, s) for g, b, s in ((5, 0, 3), (0, 5, 3), (4, 4, 8), (3, 4, 0))}
    assert edge == {3, 0, 4}
    big = [sharding.hypergeometric(rng, 10**11, 7 * 10**11, 10**10) for _ in range(50)]
    assert abs(np.mean(big) - 1.25e9) < 6 * np.sqrt(1e10 * 7 / 64 / 50)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_rows_of_the_matrix_add_up(monkeypatch, limit):
    monkeypatch.setattr(sharding, "NUMPY_ROWS", limit)
    sizes = np.array([5, 0, 17, 1, 40, 3, 9])
    cells = sharding.cell_sizes(int(sizes.sum()), 4, 3)
    m = np.stack([sharding.matrix_row(sizes, cells, i, 11) for i in range(len(sizes))])
    assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == cells).all() and (m >= 0).all()
    assert sharding.shard_sizes(10, 4).tolist() == [3, 3, 2, 2] and sharding.cell_sizes(0, 4, 1).tolist() == [0] * 4


def test_shards_are_exact_uniform_and_repeatable(spark, make, odd, tmp_path):
    rows = [*odd, *[(i, f"text {i}", "s") for i in range(300)], *[(5, "copy")] * 150]
    docs = make(rows).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS `row`")
    found = sharding.sharded(docs, 8, cell_rows=20)
    got = found.select("shard", "slot", "row.doc_id", "row.text").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    path = str(tmp_path / "shards")
    sharding.write_shards(found, path)
    assert spark.read.parquet(path).groupBy("_shard").count().count() == 8
    assert sharding.sharded(docs.limit(0), 8).count() == 0
    one = spark.read.parquet(path)
    a, b = ([(r.shard, r.slot, r.x) for r in sharding.sharded(one, 3, seed, stored=True, cell_rows=50).select("shard", "slot", F.xxhash64("row").alias("x")).orderBy("shard", "slot").collect()] for seed in (1, 1))
    c = [(r.shard, r.slot, r.x) for r in sharding.sharded(one, 3, 2, stored=True, cell_rows=50).select("shard", "slot", F.xxhash64("row").alias("x")).orderBy("shard", "slot").collect()]
    assert a == b != c


def test_places_are_uniform(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(24).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    hits = np.zeros((24, 24))
    for seed in range(40):
        for r in sharding.sharded(df, 2, seed, stored=True, cell_rows=4).select(F.col("row.id").alias("id"), (F.col("shard") * 12 + F.col("slot")).alias("at")).collect():
            hits[r.id, r["at"]] += 1
    want = 40 / 24
    assert ((hits - want) ** 2 / want).sum() < 23 * 23 + 6 * np.sqrt(2 * 23 * 23)


# --- target encoding -----------------------------------------------------------------------------------------------------


def brute_encoding(lines, sales, items, vendors, clients):
    sold = {s: (t, -1 if c is None else c) for s, c, t in sales if t is not None and s is not None}
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    rows = []
    for sale, item, vendor, flag in lines:
        if sale in sold:
            t, client = sold[sale]
            item = -1 if item is None else item
            rows.append({"sale": sale, "item": item, "vendor": vendor, "client": client, "t": t, "hit": flag == "returned", "fold": zlib.crc32(str(sale).encode()) % 5, "every": 0, "kind": kind.get(item), "nation": nation.get(vendor), "segment": segment.get(client)})
    out = {}
    for r in rows:
        past = [x for x in rows if x["fold"] != r["fold"] and x["t"] < r["t"]]

        def rate(c, prior):
            same = [x for x in past if x[c] == r[c]]
            n, s = len(same), sum(x["hit"] for x in same)
            return n, (prior if n < 1 else (1000000 * s + 50 * prior) // (n + 50))

        g = rate("every", 500000)[1]
        ends = [x for c, w in (("item", "kind"), ("vendor", "nation"), ("client", "segment")) for x in rate(c, rate(w, g)[1])]
        own = [x for x in rows if (x["sale"], x["item"], x["vendor"]) == (r["sale"], r["item"], r["vendor"])]
        out[r["sale"], r["item"], r["vendor"]] = (len(own), sum(x["hit"] for x in own), *ends)
    return out


@pytest.mark.parametrize("slice_seconds", [50, 10**6])
@pytest.mark.parametrize("share", [2, 1000])
def test_encoding_against_brute_force(spark, monkeypatch, slice_seconds, share):
    monkeypatch.setattr(target_encoding, "HOT_SHARE", share)
    monkeypatch.setattr(target_encoding, "BLOCK", 64)
    rng = random.Random(9)
    pick = lambda n: min(rng.randrange(n), rng.randrange(n))
    sales = [(i, rng.choice([None, 1, 1, pick(9)]), None if i % 17 == 5 else rng.randrange(400)) for i in range(150)]
    lines = [(rng.choice([None, 3, rng.randrange(160)]), rng.choice([None, 2, pick(12)]), rng.choice([None, 4, pick(6)]), rng.choice(["returned", "kept", None])) for _ in range(420)]
    items, vendors, clients = [(i, rng.choice("ab") if i % 4 else None) for i in range(10)], [(i, rng.choice([1, 2, None])) for i in range(5)], [(i, rng.choice("xyz") if i else None) for i in range(7)]
    at = "timestamp_ntz'2024-03-10 01:00:00' + make_dt_interval(0, 0, 0, t * 15)"
    frame = lambda rows, schema, *more: spark.createDataFrame(rows, schema).selectExpr("*", *more, "1 AS n", "2 AS fold", "3 AS id")
    s = frame(sales, "sale_id long, client_id long, t int", f"{at} AS sold_at", "'q' AS flag").drop("t")
    frames = [frame(lines, "sale_id long, item_id long, vendor_id long, flag string"), s.unionByName(s.limit(3)), frame(items, "item_id long, kind string"), frame(vendors, "vendor_id long, nation_id int"), frame(clients, "client_id long, segment string")]
    got = {(r.sale_id, r.item_id, r.vendor_id): (r.n_lines, r.n_returned, r.item_n, r.item_rate, r.vendor_n, r.vendor_rate, r.client_n, r.client_rate) for r in target_encoding.encoded(*frames, slice_seconds).collect()}
    assert got == brute_encoding(lines, sales, items, vendors, clients)
    assert target_encoding.encoded(frames[0].limit(0), *frames[1:]).count() == 0


def test_running_sums_over_cut_batches(monkeypatch):
    """Rows of one time and group that lie in several batches."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted(((0, rng.randrange(2), 0, rng.randrange(5), rng.randrange(5), rng.randrange(1, 4), rng.randrange(2)) for _ in range(60)), key=lambda r: r[:3] + (r[4],))
    full = [(c, k, sl, f, t, n, s, i) for i, (c, k, sl, f, t, n, s) in enumerate(rows)]
    names = ["col", "key", "slice", "fold", "t", "n", "s", "id"]

    def run(size):
        parts = [full[i : i + size] for i in range(0, len(full), size)]
        batches = [pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in p], pa.int64()) for j, c in enumerate(names)}) for p in parts]
        return [(r["id"], r["n"], r["s"]) for b in target_encoding.running(iter(batches)) for r in b.to_pylist()]

    want = [(i, sum(x[5] for x in full if x[1] == k and x[3] != f and x[4] < t), sum(x[6] for x in full if x[1] == k and x[3] != f and x[4] < t)) for _, k, _, f, t, _, _, i in full]
    assert run(60) == run(1) == run(7) == run(13) == want


def test_new_queries_keep_their_contracts(spark):
    d = "/root/testdata/sf0.001"
    out = queries.op13_turn_repair(spark, d)
    assert out.count() == spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct().count()
    assert dict(queries.op12_sharding(spark, d).dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
