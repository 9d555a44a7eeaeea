"""Quality, near-duplicates, contamination and lines against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import decontaminate, line_dedup, quality, simhash

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- quality -------------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark, make):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = prose(rng, 60)
        rows.append((i, " ".join(w + "!!" for w in t.split()) if bad else t))
        labels.append((i, 0 if bad else 1, 0))
    docs, lab = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, lab)).join(lab, "doc_id")
    held = scored.where("held_out")
    assert held.count() > 40 and held.where("predicted <> quality").count() <= 1
    assert scored.where("score < 0 or score > 1").count() == 0


def test_ftrl_against_a_plain_loop():
    """The same updates written out one weight at a time, over rows of a few places."""
    import math

    rng = random.Random(21)
    rows = []
    for _ in range(40):
        places = sorted(rng.sample(range(15), rng.randrange(0, 5)))
        rows.append((np.array(places, np.int64), np.array([rng.random() for _ in places]), rng.randrange(2)))
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for places, values, label in rows:
            x = [*zip(places.tolist(), values.tolist(), strict=True), (16, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(quality.ftrl(rows, bits=4, epochs=3), [weight(i) for i in range(17)], atol=1e-6)
    assert any(weight(i) for i in range(16))


def test_features_against_a_plain_count():
    """Places and values of a text by hand: words that repeat the word before are one token, pairs of neighbours count too."""
    text = b"a b b !! c"
    h = [xxhash.xxh64_intdigest(t) for t in (b"a", b"b", quality.REPEAT, b"!!", b"c")]
    wrap = (1 << 64) - 1
    one = [x * 0xC2B2AE3D27D4EB4F & wrap for x in h]
    two = [(a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29)) & wrap) * 0xD6E8FEB86659FD93 & wrap for a, b in zip(h, h[1:], strict=False)]
    counts = defaultdict(int)
    for x in one + two:
        counts[x >> (64 - quality.BITS)] += 1
    places, values = quality.Hasher()(text)
    assert dict(zip(places.tolist(), values.tolist(), strict=True)) == {k: (v / 9) ** 0.5 for k, v in counts.items()}


def test_quality_odd_rows(spark, make, odd):
    docs = make(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == len(odd) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    conflicting = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert not quality.fit(docs, conflicting).any()
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
    assert quality.keep(docs, quality.fit(docs, none)).count() == 0


# --- near-duplicates -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [x for x in re.split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted(((str(rows[i][0]), f"{fps[i]:016x}", str(least[find(i)])) for i in range(len(rows))))


def test_simhash_against_brute_force(make):
    rng = random.Random(2)
    rows, texts = [], []
    for i in range(120):
        t = rng.choice(texts) if texts and rng.random() < 0.6 else prose(rng, 150)
        w = t.split()
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
        rows.append((1000 - i, texts[-1].upper() if i % 7 == 0 else texts[-1]))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(make(rows)).collect())
    assert got == brute_components(rows)
    assert len({g[2] for g in got}) < 120


def test_simhash_odd_rows(make, odd):
    rows = [*odd, (8, "A bb"), (9, "a BB")]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(make(rows)).collect())
    assert got == brute_components(rows)
    assert simhash.near_duplicates(make(rows).limit(0)).count() == 0


def test_links_of_split_shards(spark):
    """Shards beyond their bound are dealt out in parts; no component may break, chains over many hops included."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    x = base
    for _ in range(60):
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        fps.add(x)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)} | {rng.getrandbits(64) for _ in range(200)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.shard_links(df, shard=20)).collect()}
    roots = {v: found.get(v, v) for v in signed}
    edges = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert edges and all(roots[a] == roots[b] for a, b in edges)
    least = dict(zip(signed, signed, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert least == roots


def test_bk_tree_search():
    rng = random.Random(4)
    fps = np.array(sorted({rng.getrandbits(64) & 0xFFFF for _ in range(200)}), np.int64)
    found = {(n, int(q)) for n, hits in simhash.BKTree(fps).search(fps, 3) for q in hits}
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}


# --- contamination -------------------------------------------------------------------------------------------------------


def folded(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if x]


def brute_hits(text, bench):
    w, hit, items = folded(text), set(), set()
    for key, t in bench:
        b = folded(t) if key is not None else []
        wins = [b[i : i + 13] for i in range(len(b) - 12)] if len(b) >= 13 else ([b] if b else [])
        for x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    items.add(str(key))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_against_brute_force(spark, make, odd):
    rng = random.Random(5)
    bench = [(i, prose(rng, rng.choice([3, 13, 30]))) for i in range(12)] + [(100, None), (101, ""), (None, prose(rng, 20)), (5, "une É élève")]
    rows = list(odd)
    for i in range(60):
        t = prose(rng, 40)
        k, b = rng.choice(bench[:12])
        cut = b.split()[rng.randrange(3) :] if rng.random() < 0.5 else b.split()
        rows.append((100 + i, f"{t}, {'; '.join(cut).title()}. {prose(rng, rng.choice([0, 900]))} une, É!élève" if i % 2 else t))
    table = spark.createDataFrame(bench, "item_id long, text string")
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = sorted((str(d), *brute_hits(t, bench)) for d, t in rows)
    for block in (1_000_000, 7):
        got = decontaminate.verdicts(decontaminate.matches(make(rows), table, block_windows=block)).select("doc_id", *cols).collect()
        assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == expected
    assert any(e[-1] for e in expected) and not all(e[-1] for e in expected)
    clean = decontaminate.keep_clean(make(rows), table)
    assert clean.count() == sum(not e[-1] for e in expected) and clean.columns == make(rows).columns
    assert decontaminate.verdicts(decontaminate.matches(make(rows), table.limit(0))).where("n_hit > 0").count() == 0
    assert decontaminate.keep_clean(make(rows).limit(0), table).count() == 0


def test_proximity(spark, make):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x y z beta gamma delta"), (4, "beta gamma"), (5, "delta alpha"), (6, "gamma"), (7, "beta gamma delta")]
    bench = spark.createDataFrame([("k", "Alpha, beta gamma DELTA")], "item_id string, text string")
    for slop, near in ((0, set()), (2, {2}), (3, {2, 3})):
        got = {r.doc_id: (r.items, r.near) for r in decontaminate.matches(make(rows).coalesce(1), bench, slop=slop).collect()}
        assert {d for d, (x, _) in got.items() if x} == {1} and {d for d, (_, x) in got.items() if x} == near


def test_index_is_stored_and_whole(spark, make, odd):
    """Each word of each row stands at its place in the index, once."""
    rows = [*odd[:-1], (20, "a b a"), (21, "b, A")]
    index = decontaminate.build(make(rows).repartition(3), 2)
    starts = {r.shard: np.frombuffer(r.positions, np.int32) for r in index.where("term is null and positions is not null").collect()}
    where = {(r.shard, r.place): (r.doc_id, r.n_words) for r in index.where("place is not null").collect()}
    texts = defaultdict(dict)
    for r in index.where("term is not null").collect():
        at = np.frombuffer(r.positions, np.int32)
        assert r.n == len(at) and (np.diff(at) > 0).all()
        for x in at.tolist():
            doc = int(np.searchsorted(starts[r.shard], x, "right")) - 1
            texts[(r.shard, doc)][x - int(starts[r.shard][doc])] = bytes(r.term).decode()
    got = sorted((str(d), [texts[k][i] for i in range(n)]) for k, (d, n) in where.items())
    assert got == sorted((str(d), folded(t)) for d, t in rows)


# --- lines ---------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and d is not None:
                docs[key(x)].add(d)
    drop = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or d == drop[key(x)]]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def lines_of(docs):
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.h) for r in kept.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h")).collect())


def test_lines_against_brute_force(make, odd):
    rng = random.Random(6)
    common = [f"the Common line number {i} of all these documents" for i in range(6)] + ["short one", "É" * 40]
    rows = list(odd)
    for i in range(80):
        x = [rng.choice(common) if rng.random() < 0.3 else prose(rng, 12) for _ in range(rng.choice([1, 5, 20]))]
        rows.append((20 + rng.randrange(60), "\n".join(("  " + v.upper() + "\r" if rng.random() < 0.2 and v[0] != "É" else v) for v in x)))
    rows += [(None, common[0]), (None, common[0])]
    assert lines_of(make(rows)) == brute_lines(rows)
    assert sum(r[2] for r in brute_lines(rows)) > 50
    assert lines_of(make(rows).limit(0)) == []
