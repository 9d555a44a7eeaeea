import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import correlation, embedding, evaluation, graph, logistic, metrics, ranking, statistics, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_adjusted_rank_example(spark):
    """Scored k7, k4, k2, k1; k2 and k1 are true; k1 ranks 4, adjusted 3, best-true 3."""
    scores = spark.createDataFrame([("k7", "s", 0.9), ("k4", "s", 0.8), ("k2", "s", 0.7), ("k1", "s", 0.6)], "kinase_node_id string, site_node_id string, score double")
    trials = spark.createDataFrame([(1, "k1", "s"), (2, "k2", "s"), (3, "k9", "s")], "trial_index long, kinase_node_id string, site_node_id string")
    got = ranking.trial_ranks(scores, trials).select("trial_index", "held_out_kinase_rank", "adjusted_held_out_rank", "best_true_kinase_rank", "n_true_kinases_for_site")
    assert rows(got) == [(1, 4, 3, 3, 3), (2, 3, 3, 3, 3), (3, None, None, None, 3)]


def test_ties_by_id_and_null_last(spark):
    scores = spark.createDataFrame([("b", "s", 0.5), ("a", "s", 0.5), ("c", "s", None)], "kinase_node_id string, site_node_id string, score double")
    assert rows(ranking.rank_in_site(scores).select("kinase_node_id", "rank_in_site")) == [("a", 1), ("b", 2), ("c", 3)]


def test_overlay(spark):
    g = spark.createDataFrame([("a", "s", 0.9), ("b", "s", 0.2)], "kinase_node_id string, site_node_id string, score double")
    m = spark.createDataFrame([("a", "s", 0.1)], "kinase_node_id string, site_node_id string, score double")
    assert rows(ranking.overlay(g, m)) == [("a", "s", 0.1, 2), ("b", "s", 0.2, 1)]


def test_cliques_and_cap(spark):
    members = [("x", i) for i in "abc"] + [("y", "a")] + [("z", f"m{i:02d}") for i in range(51)] + [("x", "a"), ("x", None)]
    df = spark.createDataFrame(members, "g string, i string")
    assert rows(tables.clique_pairs(df, "g", "i", 50)) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_cliques_by_brute_force_in_tasks_by_size(spark, monkeypatch):
    """Pairs are dealt by their number, whatever the session says, and nothing hashes them; a group of one item more than the cap, with repeats, makes none."""
    monkeypatch.setattr(tables, "ROWS", 10)
    members = [(g, f"m{(g * 7 + k * k) % 13:02d}") for g in range(30) for k in range(g % 9)] + [(99, f"m{k % 6:02d}") for k in range(200)] + [(98, f"n{k % 5}") for k in range(200)]
    groups = {}
    for g, i in members:
        groups.setdefault(g, set()).add(i)
    want = sorted({(a, b) for s in groups.values() if 2 <= len(s) <= 5 for a in s for b in s if a < b})
    got = tables.clique_pairs(spark.createDataFrame(members, "g long, i string"), "g", "i", 5)
    assert rows(got) == want and got.rdd.getNumPartitions() > 4
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_merged_edges_in_tasks_by_size(spark, monkeypatch):
    """Edges are dealt by key before any is sorted; the earlier frame wins among equals, null confidence is lowest."""
    monkeypatch.setattr(tables, "ROWS", 10)
    a = spark.createDataFrame([(f"s{k % 20}", f"t{k % 7}", "r", k % 3, k) for k in range(100)], "source string, target string, relation string, confidence_score int, seq int")
    b = a.select("source", "target", "relation")
    got = graph.merge_edges([a, b, b])
    best = {}
    for k in range(100):
        key = (f"s{k % 20}", f"t{k % 7}", "r")
        best[key] = max(best.get(key, -1), k % 3)
    assert rows(got) == sorted((*k, v) for k, v in best.items()) and got.rdd.getNumPartitions() == 30


def test_argmax_merge(spark):
    e = spark.createDataFrame([("x", "y", "r", 3, 1), ("x", "y", "r", 9, 2), ("x", "y", "r", 9, 3), ("u", "v", "r", None, 4)], "source string, target string, relation string, confidence_score int, seq int")
    assert rows(graph.merge_edges([e])) == [("u", "v", "r", None), ("x", "y", "r", 9)]
    assert rows(tables.keep_best(e, ["source", "target", "relation"], "confidence_score", "seq").select("source", "seq")) == [("u", 4), ("x", 2)]


def test_mode_and_fallback(spark):
    m = spark.createDataFrame([("E1", "G1", 1), ("E1", "G2", 2), ("E1", "G2", 3), ("E2", "G3", 4), ("E2", "G4", 5)], "k string, v string, s int")
    assert rows(tables.most_common(m, ["k"], "v", "s").select("k", "v", "n_values")) == [("E1", "G2", 2), ("E2", "G3", 2)]
    df = spark.createDataFrame([("9606.ENSP1",), ("TP53",)], "id string")
    from quillmesh.functions import ids

    mapping = spark.createDataFrame([("ENSP1", "G")], "id string, gene string")
    assert rows(tables.lookup_with_fallback(df, "id", ids.peptide_alias(F.col("id")), mapping, "id", "gene", "out")) == [("9606.ENSP1", "G"), ("TP53", "TP53")]


def test_correlation_edges(spark):
    data = []
    for s in range(6):
        data += [("a", f"{s}", float(s)), ("b", f"{s}", 2.0 * s + (s == 3)), ("c", f"{s}", -float(s) + 0.1 * (s == 2)), ("k", f"{s}", 1.0)]
    data += [("short", f"{s}", float(s)) for s in range(5)]
    m = spark.createDataFrame(data, "entity string, sample string, value double")
    pairs = {(r.source, r.target): r.r for r in correlation.pairwise_pearson(m).collect()}
    assert pairs[("a", "k")] is None and not any("short" in p for p in pairs)
    x, y = np.arange(6.0), 2.0 * np.arange(6.0) + (np.arange(6) == 3)
    assert abs(pairs[("a", "b")] - np.corrcoef(x, y)[0, 1]) < 1e-12
    edges = correlation.correlation_edges(m, "p", "n", 0.0)
    assert {r.relation for r in edges.collect()} == {"p", "n"}
    assert correlation.correlation_edges(m.where("sample < '3'"), "p", "n", 0.0, min_common=2).count() == 0


def test_percentile(spark):
    p = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (1.0,)], "r double")
    row = correlation.thresholds(p).first()
    assert abs(row.pos - 0.58) < 1e-9 and row.neg is None


def test_negatives_categories_trials(spark):
    pos = spark.createDataFrame([("b", "s1"), ("c", "s1"), ("d", "s2")], "kinase_node_id string, site_node_id string")
    cands = spark.createDataFrame([(x,) for x in "abcdef"], "node_id string")
    assert rows(evaluation.ordered_negatives(pos.where("kinase_node_id = 'b'"), cands, 3)) == [("a", "s1"), ("c", "s1"), ("d", "s1")]
    assert rows(evaluation.freeze_multi(pos)) == [("b", "s1", 1), ("c", "s1", 2)]
    counts = spark.createDataFrame([(0,), (5,), (6,), (20,), (21,)], "n int")
    assert [r[0] for r in counts.select(evaluation.category(F.col("n"))).collect()] == ["poor", "poor", "average", "average", "rich"]
    with pytest.raises(ValueError):
        evaluation.ordered_negatives(pos, cands, 3, "other")


def test_walks_move_as_number_and_path(spark):
    """The first step of undirected walks moves none; later ones shuffle a walk's number and path alone."""
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("x", "x")], "source string, target string")
    nbrs = {"a": ["b", "c"], "b": ["a", "d"], "c": ["a"], "d": ["b"], "x": ["x"]}
    want = []
    for s in nbrs:
        for w in range(3):
            path = [s]
            for step in range(1, 5):
                near = nbrs[path[-1]]
                path.append(near[(31 * w + 17 * step + 42) % len(near)])
            want.append((s, w, path))
    assert rows(embedding.walks(e, 3, 5, directed=False, pick="arithmetic")) == sorted(want)
    assert "Join" not in embedding.walks(e, 3, 2, directed=False)._jdf.queryExecution().optimizedPlan().toString()
    ended = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert rows(embedding.walks(ended, 1, 5)) == [("a", 0, ["a", "b", "c"]), ("b", 0, ["b", "c"]), ("c", 0, ["c"])]


def test_negatives_from_blocks(spark, monkeypatch):
    """A site meets blocks of candidates, not one row for each candidate it takes; by brute force, over blocks and round the end."""
    monkeypatch.setattr(evaluation, "BLOCK", 4)
    names = [f"k{i:02d}" for i in range(30)]
    pos = {(names[(7 * s + j) % 30], f"s{s}") for s in range(12) for j in range(s % 5 * 4 + 1)}
    df = spark.createDataFrame(sorted(pos), "kinase_node_id string, site_node_id string")
    cands = spark.createDataFrame([(x,) for x in names], "node_id string")
    md5 = lambda x: hashlib.md5(f"42|{x}".encode()).hexdigest()
    ring = sorted(names, key=md5)
    for strategy in ("ordered_head", "hash"):
        want = []
        for s in sorted({s for _, s in pos}):
            start = int(md5(s)[:8], 16) % 30 if strategy == "hash" else 0
            order = ring[start:] + ring[:start] if strategy == "hash" else names
            want += [(k, s) for k in [k for k in order if (k, s) not in pos][:6]]
        assert rows(evaluation.ordered_negatives(df, cands, 6, strategy)) == sorted(want)


def test_denominators(spark):
    r = spark.createDataFrame([(1,), (30,), (None,)], "r int").agg(metrics.hit_rate_ranked("r", 20), metrics.hit_rate_all("r", 20)).first()
    assert r[0] == 0.5 and abs(r[1] - 1 / 3) < 1e-12


def test_bh(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.04), ("d", 0.5)], "k string, p double")
    got = [r[2] for r in rows(statistics.benjamini_hochberg(p, "p", "k"))]
    assert np.allclose(got, [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_ks(spark):
    a, b = (spark.createDataFrame([("k", v) for v in vs], "k string, v int") for vs in ([1, 2, 2], [2, 3]))
    assert statistics.ks_statistic(a, b, "k", "v").first().ks_statistic == 0.5


def test_ksea_formula(spark):
    fc = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate([1, 2, 3, 4, 8])], "site_node_id string, fc double")
    sets = spark.createDataFrame([("K:a", f"s{i}") for i in (2, 3, 4)] + [("K:b", "s0")], "kinase_node_id string, site_node_id string")
    r = statistics.ksea(fc, sets, exact=True).collect()
    v = np.array([1, 2, 3, 4, 8.0])
    assert len(r) == 1 and abs(r[0].ksea_score - (5 - v.mean()) * np.sqrt(3) / v.std(ddof=1)) < 1e-12


def test_walk_stops_at_sink(spark):
    e = spark.createDataFrame([("a", "b")], "source string, target string")
    assert rows(embedding.walks(e, 1, 5)) == [("a", 0, ["a", "b"]), ("b", 0, ["b"])]
    long = embedding.walks(e, 1, 5, directed=False, p=0.5, q=2.0)
    assert rows(long) == [("a", 0, list("ababa")), ("b", 0, list("babab"))]


def test_spectral_eigenvectors(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("a", "c")]
    e = spark.createDataFrame(pairs, "source string, target string")
    v = {r.node_id: r.vec for r in embedding.SpectralEmbedding(2).fit(e).collect()}
    names = sorted(v)
    a = np.zeros((5, 5))
    for s, t in pairs:
        a[names.index(s), names.index(t)] = a[names.index(t), names.index(s)] = 1
    d = np.diag(1 / np.sqrt(a.sum(1)))
    lap = np.eye(5) - d @ a @ d
    x = np.array([v[n] for n in names])
    values = np.linalg.eigvalsh(lap)[1:3]
    for i in range(2):
        assert np.abs(lap @ x[:, i] - values[i] * x[:, i]).max() < 1e-8


def test_refits_match_full_fits():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(120, 4)), np.ones((120, 1))])
    y = (x[:, 0] + rng.normal(size=120) > 0.3).astype(float)
    w = logistic.newton(x, y)
    masked = np.flatnonzero(y == 1)[:5]
    got = logistic.refits(x, y, w, np.linalg.inv(logistic.hessian(x, y, w)), np.append(masked, -1))
    for i, m in enumerate(masked):
        keep = np.arange(120) != m
        assert np.abs(got[:, i] - logistic.newton(x[keep], y[keep])).max() < 1e-6
    assert np.abs(got[:, -1] - w).max() < 1e-8


def test_graph_build(spark):
    r = spark.createDataFrame([("akt1", "gsk3b", "Ser9", "human"), ("akt1", "x", "S1;T2", "human"), ("akt1", "x", "S1", "mouse"), (None, "x", "S1", "human"), ("akt1", "x", "K1", "Human")], "e string, g string, s string, o string")
    nodes, edges = graph.enzyme_site_graph(r, "e", "g", "s", organisms=["o"])
    assert rows(edges) == [("PROTEIN:AKT1", "SITE:GSK3B-S9", "phosphorylates"), ("PROTEIN:GSK3B", "SITE:GSK3B-S9", "has_site")]
    reasons = rows(graph.parse_counts(r, graph.parse_reason(F.col("e"), F.col("g"), F.col("s"), [F.col("o")])))
    assert dict(reasons) == {"missing": 1, "multi_site": 2, "nonhuman": 1, "ok": 1}
    assert rows(graph.embedding_edges(edges)) == [("PROTEIN:GSK3B", "SITE:GSK3B-S9")]


def test_numbers_of_wide_tables_are_one_to_n(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("hash(id) AS a", "id AS b", "id * 2 AS c", "uuid() AS d")
    got = tables.numbered(df, ["a", "b"], "i")
    assert tuple(got.agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.count("i")).first()) == (1, n, n, n)
    w = tables.W.orderBy("i")
    assert got.where("i % 1000 < 2").withColumn("before", F.lag(F.struct("a", "b")).over(w)).where("before >= struct(a, b)").count() == 0


def test_negatives_by_hash_and_single_kinase_sites(spark):
    pos = spark.createDataFrame([("k0", "s0"), ("k1", "s0"), ("k2", "s1")], "kinase_node_id string, site_node_id string")
    cands = spark.createDataFrame([(f"k{i}",) for i in range(9)], "node_id string")
    for strategy, per_site in (("hash", 4), ("hash", 50), ("ordered_head", 4)):
        got = [tuple(r) for r in evaluation.ordered_negatives(pos, cands, per_site, strategy).collect()]
        assert len(got) == len(set(got)) == min(per_site, 7) + min(per_site, 8)
        assert not {("k0", "s0"), ("k1", "s0"), ("k2", "s1")} & set(got)
    assert [tuple(r) for r in evaluation.freeze_multi(pos).select("trial_index", "kinase_node_id").orderBy("trial_index").collect()] == [(1, "k0"), (2, "k1")]


def test_biased_pick_is_linear_and_weighted():
    import pyarrow as pa

    pick = embedding.biased_pick(0.5, 2.0)
    nbrs = [["a", "b", "c"], None, ["x"], ["a", "b"]]
    back, known = ["a", None, None, None], [["b", "z"], [], None, []]
    # weights of the first: a is the node before (2), b a neighbour of it (1), c neither (0.5)
    got = {u: pick(pa.array(nbrs, pa.list_(pa.string())), pa.array(back, pa.string()), pa.array(known, pa.list_(pa.string())), pa.array([u] * 4)).to_pylist() for u in (0.0, 0.5, 0.6, 0.85, 0.9, 0.999)}
    assert [got[u][0] for u in got] == ["a", "a", "b", "b", "c", "c"]
    assert all(v[1] is None and v[2] == "x" for v in got.values()) and got[0.0][3] == "a" and got[0.6][3] == "b"


def test_exact_two_sample_p():
    from itertools import combinations

    for n, m in ((3, 3), (4, 4), (5, 5), (3, 5), (4, 6), (2, 7)):
        found = []
        for places in combinations(range(n + m), n):
            a = b = 0
            far = 0.0
            for i in range(n + m):
                a, b = (a + 1, b) if i in places else (a, b + 1)
                far = max(far, abs(a / n - b / m))
            found.append(far)
        d = np.array(sorted({round(x, 9) for x in found}))
        want = [sum(x >= y - 1e-6 for x in found) / len(found) for y in d]
        assert np.allclose(statistics.ks_exact(d, np.full(len(d), n), np.full(len(d), m)), want, rtol=1e-12, atol=0), (n, m)


def test_exact_p_of_mixed_batches_by_whole_numbers():
    from math import comb, lcm

    rng = np.random.default_rng(0)
    tests, want = [], []
    for n, m in rng.integers(1, 40, (150, 2)).tolist() + [[1, 1], [39, 39], [1, 39]]:
        h = int(rng.integers(1, lcm(n, m) + 1))
        inside: dict[tuple[int, int], int] = {}
        for i in range(n + 1):
            for j in range(m + 1):
                near = abs(i * (lcm(n, m) // n) - j * (lcm(n, m) // m)) < h
                inside[i, j] = (inside.get((i - 1, j), 0) + inside.get((i, j - 1), 0) if i or j else 1) if near else 0
        tests.append((h / lcm(n, m), n, m))
        want.append((comb(n + m, n) - inside[n, m]) / comb(n + m, n))
    d, n, m = (np.array(c) for c in zip(*tests, strict=True))
    assert np.allclose(statistics.ks_exact(d, n, m), want, rtol=1e-12, atol=0)  # the smallest is below 1e-15
    assert statistics.ks_exact(np.array([0.0]), np.array([3]), np.array([4])).tolist() == [1.0]
    assert not len(statistics.ks_exact(np.array([]), np.array([], np.int64), np.array([], np.int64)))
    n, k = 500, 300  # equal sizes: an alternating sum over reflections, whose first terms suffice
    far = 2 * sum((-1) ** (i + 1) * comb(2 * n, n - i * k) / comb(2 * n, n) for i in range(1, 4) if i * k <= n)
    assert np.allclose(statistics.ks_exact(np.array([k / n]), np.array([n]), np.array([n])), far, rtol=1e-10, atol=0)
    tables = statistics.ks_exact(np.array([0.6, 0.7]), np.array([10, 10]), np.array([10, 10]))  # as printed tables have them
    assert tables.round(4).tolist() == [0.0524, 0.0123]


def test_exact_p_is_the_default_and_ends_at_its_bound(spark, monkeypatch):
    ranks = [("K1", i, "a") for i in range(40)] + [("K1", i + 9, "b") for i in range(35)] + [("K2", i, "a") for i in range(30)] + [("K2", i, "b") for i in range(30)]
    r = spark.createDataFrame([(k, v, n) for k, v, n in ranks], "kinase_node_id string, rank_in_site long, n string")
    a, b = r.where("n = 'a'"), r.where("n = 'b'")
    got = {x.kinase_node_id: x for x in statistics.ks_test(a, b, ("a", "b")).collect()}
    plain = {x.kinase_node_id: x.p_value for x in statistics.ks_test(a, b, ("a", "b"), exact=False).collect()}
    one = statistics.ks_exact(np.array([got["K1"].ks_statistic]), np.array([40]), np.array([35]))[0]
    assert got["K1"].p_value == one and got["K2"].p_value == 1.0 and abs(plain["K1"] - one) > 1e-6
    monkeypatch.setattr(statistics, "EXACT", 32)  # K1 is over it
    bounded = {x.kinase_node_id: x.p_value for x in statistics.ks_test(a, b, ("a", "b")).collect()}
    assert bounded == {"K1": plain["K1"], "K2": 1.0}


def test_cluster_order_against_plain_agglomeration(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(23, 3))
    clusters = [(i, [i]) for i in range(23)]
    for k in range(22):
        dist = lambda a, b: np.mean([np.linalg.norm(x[i] - x[j]) for i in a for j in b])
        _, i, j = min((dist(clusters[i][1], clusters[j][1]), i, j) for i in range(len(clusters)) for j in range(i))
        a, b = sorted((clusters[i], clusters[j]))
        clusters = [c for n, c in enumerate(clusters) if n not in (i, j)] + [(23 + k, a[1] + b[1])]
    assert statistics.leaf_order(x) == clusters[0][1]
    df = spark.createDataFrame([(f"k{i:02d}", *map(float, r)) for i, r in enumerate(x)] + [("none", None, 1.0, 2.0)], "kinase string, a double, b double, c double")
    assert [int(r.kinase[1:]) for r in statistics.cluster_order(df, ["a", "b", "c"]).orderBy("place").collect()] == clusters[0][1]


@pytest.mark.parametrize("block", [3, 512])
def test_correlation_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(11, 15))
    v[rng.random(v.shape) < 0.3] = np.nan
    v[4] = 2.5
    m = spark.createDataFrame([(f"e{i:02d}", f"s{j}", None if np.isnan(v[i, j]) else float(v[i, j])) for i in range(11) for j in range(15)], "entity string, sample string, value double")
    got = {(r.source, r.target): (r.n_common, r.r) for r in correlation.pairwise_pearson(m, 6, block).collect()}
    for i in range(11):
        for j in range(i + 1, 11):
            both = ~np.isnan(v[i]) & ~np.isnan(v[j])
            if both.sum() >= 6:
                n, r = got.pop((f"e{i:02d}", f"e{j:02d}"))
                assert n == both.sum() and (r is None if 4 in (i, j) else abs(r - np.corrcoef(v[i][both], v[j][both])[0, 1]) < 1e-9)
    assert not got
    values = rng.uniform(-1, 1, 500).tolist() + [1.0, -1.0, 0.25, 0.25]
    r = spark.createDataFrame([(x,) for x in values], "r double")
    assert abs(correlation.thresholds(r).first().pos - np.percentile([x for x in values if x > 0], 80)) < 1e-12
    assert abs(correlation.thresholds(r).first().neg - np.percentile([x for x in values if x < 0], 20)) < 1e-12


def test_spectral_against_a_dense_solve(spark):
    rng = np.random.default_rng(6)
    n = 260
    pairs = sorted({tuple(sorted(rng.integers(0, n, 2).tolist())) for _ in range(900)} | {(i, i + 1) for i in range(n - 1)})
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in pairs] + [("n000", "n000")], "source string, target string")
    got = {r.node_id: r.vec for r in embedding.SpectralEmbedding(dimensions=6).fit(edges).collect()}
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    d = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigh(a * d[:, None] * d[None, :])[1][:, ::-1][:, 1:7]
    mine = np.array([got[f"n{i:03d}"] for i in range(n)])
    assert np.allclose(np.abs((want * mine).sum(0)), 1, atol=1e-5)  # the same vectors up to their signs


@pytest.mark.parametrize("block", [7, None])
def test_correlation_edges_store_no_pairs(spark, monkeypatch, block):
    """Thresholds and edges from passes over blocks are those of all pairs; ties, zeros and constant sides included."""
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(60, 9)), 1)
    v[rng.random(v.shape) < 0.1] = np.nan
    v[3], v[50] = 2.0, v[10]
    names = [f"e{i}" for i in range(60)]
    data = [(names[i], f"s{j}", float(v[i, j])) for i in range(60) for j in range(9) if not np.isnan(v[i, j])]
    m = spark.createDataFrame(data, "entity string, sample string, value double")
    pairs = correlation.pairwise_pearson(m, 6, block).toPandas()
    r = pairs.r.dropna()
    up, down = np.percentile(r[r > 0], 80), np.percentile(r[r < 0], 20)
    assert correlation.matrix_thresholds(correlation.Blocks.of(m, 6, block)) == pytest.approx((up, down), abs=1e-12)
    stored = []
    monkeypatch.setattr(correlation, "written", lambda df, name, w=correlation.written: stored.append(name) or w(df, name))
    got = {(e.source, e.target): (e.relation, e.weight) for e in correlation.correlation_edges(m, "p", "n").collect()}
    kept = pairs[((pairs.r > 0) & (pairs.r >= up - 1e-12)) | ((pairs.r < 0) & (pairs.r <= down + 1e-12))]
    assert set(got) == set(zip(kept.source, kept.target, strict=True)) and "correlations" not in stored
    assert all(s < t for s, t in got) and got[("e10", "e50")] == ("p", pytest.approx(1.0))


def test_mode_of_values_seen_at_once_is_the_least(spark):
    data = [(k, v, 1) for v in ("c", "b", "a") for k in range(200)]
    got = tables.most_common(spark.createDataFrame(data, "k int, v string, seq int"), ["k"], "v", "seq")
    assert rows(got) == [(k, "a", 3) for k in range(200)]


@pytest.mark.parametrize("directed", [True, False])
def test_biased_walks_carry_no_neighbours(spark, directed):
    """Step by step as the weights say, with triangles and loops; the plan's rows hold one name of the node before."""
    rng = np.random.default_rng(8)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (45, 2))})
    e = spark.createDataFrame(pairs, "source string, target string")
    got = embedding.walks(e, 3, 6, directed=directed, p=0.5, q=2.0)
    assert "back_nbrs" not in got._jdf.queryExecution().analyzed().toString()
    both = set(pairs) | (set() if directed else {(b, a) for a, b in pairs})
    nbrs = {n: sorted(b for a, b in both if a == n) for p in pairs for n in p}
    steps = spark.range(3).select(F.col("id").cast("int").alias("walk")).crossJoin(spark.createDataFrame([(n,) for n in nbrs], "start string"))
    shares = steps.select("start", "walk", *[embedding.uniform(42, F.col("start"), F.col("walk"), F.lit(s)).alias(f"u{s}") for s in range(1, 6)]).collect()
    want = {}
    for r in shares:
        path = [r.start]
        for s in range(1, 6):
            here, back = nbrs[path[-1]], path[-2] if len(path) > 1 else None
            if not here:
                break
            w = np.cumsum([1.0 if back is None else 2.0 if x == back else 1.0 if x in nbrs[back] else 0.5 for x in here])
            path.append(here[min(int(np.searchsorted(w, r[f"u{s}"] * w[-1], "right")), len(here) - 1)])
        want[r.start, r.walk] = path
    assert {(r.start, r.walk): r.path for r in got.collect()} == want

def test_spectral_of_two_sided_graphs(spark, monkeypatch):
    """Only vectors of the fewer nodes are iterated; two-sided graphs of both directions have the vectors of a dense solve."""
    rng = np.random.default_rng(8)
    few, many = 30, 200
    pairs = sorted({(int(rng.integers(0, few) ** 2 // few), j) for j in range(many) for _ in range(4)} | {(i, i) for i in range(few)})
    asked, leading = [], embedding.leading_vectors
    monkeypatch.setattr(embedding, "leading_vectors", lambda times, n, k, seed: asked.append(n) or leading(times, n, k, seed))
    a = np.zeros((few + many, few + many))
    for i, j in pairs:
        a[i, few + j] = a[few + j, i] = 1
    d = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigh(a * d[:, None] * d[None, :])[1][:, ::-1][:, 1:5]
    for turned in (False, True):
        edges = spark.createDataFrame([(f"q{j:03d}", f"p{i:03d}") if turned else (f"p{i:03d}", f"q{j:03d}") for i, j in pairs], "source string, target string")
        got = {r.node_id: r.vec for r in embedding.SpectralEmbedding(dimensions=4).fit(edges).collect()}
        mine = np.array([got[f"p{i:03d}"] for i in range(few)] + [got[f"q{j:03d}"] for j in range(many)])
        assert np.allclose(np.abs((want * mine).sum(0)), 1, atol=1e-5)
    assert asked == [few, few]


def test_skip_gram_learns_large_corpora_in_partitions(spark, monkeypatch):
    asked, word2vec = [], embedding.Word2Vec
    monkeypatch.setattr(embedding, "Word2Vec", lambda **k: asked.append(k["numPartitions"]) or word2vec(**k))
    edges = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(6) for j in range(6)], "source string, target string")
    fit = lambda: {r.node_id: r.vec for r in embedding.WalkEmbedding(dimensions=4, directed=False).fit(edges).collect()}
    assert len(fit()) == 12
    monkeypatch.setattr(embedding, "WORDS", 1_000)  # of 3,000
    got = fit()
    assert len(got) == 12 and all(len(v) == 4 and np.isfinite(v).all() for v in got.values())
    assert asked == [1, 3]


def test_biased_walks_meet_no_list_of_a_hub(spark, monkeypatch):
    """A hub's neighbours lie in several rows; walks over them, and over graphs with triangles and loops, go as the weights say."""
    monkeypatch.setattr(embedding, "CHUNK", 4)
    sides = [(f"h{i % 2}", f"x{i:02d}") for i in range(30)] + [(f"s{i % 5}", f"x{i:02d}") for i in range(30)]
    for pairs, directed in ((sides, False), ([*sides, ("h0", "h1"), ("h0", "h0"), ("x00", "s0"), ("x01", "x01"), ("s0", "h0")], False), ([*sides, ("x00", "h0"), ("x00", "s0"), ("s0", "h0"), ("h0", "s0"), ("x02", "x02")], True)):
        e = spark.createDataFrame(pairs, "source string, target string")
        assert embedding.stepping_stones(e, directed, True).agg(F.max(F.size("of"))).first()[0] == 4
        both = set(pairs) | (set() if directed else {(b, a) for a, b in pairs})
        nbrs = {n: sorted(b for a, b in both if a == n) for p in pairs for n in p}
        steps = spark.range(3).select(F.col("id").cast("int").alias("walk")).crossJoin(spark.createDataFrame([(n,) for n in nbrs], "start string"))
        want = {}
        for r in steps.select("start", "walk", *[embedding.uniform(42, F.col("start"), F.col("walk"), F.lit(s)).alias(f"u{s}") for s in range(1, 7)]).collect():
            path = [r.start]
            for s in range(1, 7):
                here, back = nbrs[path[-1]], path[-2] if len(path) > 1 else None
                if not here:
                    break
                w = np.cumsum([1.0 if back is None else 2.0 if x == back else 1.0 if x in nbrs[back] else 0.5 for x in here])
                path.append(here[min(int(np.searchsorted(w, r[f"u{s}"] * w[-1], "right")), len(here) - 1)])
            want[r.start, r.walk] = path
        assert {(r.start, r.walk): r.path for r in embedding.walks(e, 3, 7, directed=directed, p=0.5, q=2.0).collect()} == want


def test_spectral_restarts_keep_what_they_knew(spark, monkeypatch):
    """Close eigenvalues and a shallow basis: a restart goes on from what it kept, with fewer products than starting again takes."""
    n, k = 20_000, 5
    values = np.concatenate([[1.0, 0.99, 0.99], 0.9 - np.arange(n - 3) ** (2 / 3) * 1e-3])
    asked = []
    monkeypatch.setattr(embedding, "BASIS_BYTES", 8 * n * (k + embedding.GUARD) * 10)
    v = embedding.leading_vectors(lambda x: asked.append(1) or values[:, None] * x, n, k, 1)
    assert np.abs(values[:, None] * v - v * (values @ (v * v))).max() < 1e-6 and np.allclose(values @ (v * v), values[:k], atol=1e-10)
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-8 and len(asked) < 200


def test_spectral_matrix_in_pieces(spark, monkeypatch):
    """Images of a two-sided matrix are the same from one piece and from many, with hubs of more than 64 neighbours."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(rng.integers(0, 20) ** 2 // 20), j) for j in range(300) for _ in range(3)} | {(0, j) for j in range(200)} | {(i, i) for i in range(20)})
    a = np.zeros((20, 300))
    a[tuple(np.array(pairs).T)] = 1
    b = a / np.sqrt(a.sum(1))[:, None] / np.sqrt(a.sum(0))[None, :]
    x = rng.normal(size=(20, 7))
    few = spark.createDataFrame([(f"p{i:02d}", i) for i in range(20)], "node string, i long")
    edges = spark.createDataFrame([(f"p{i:02d}", f"q{j}") for i, j in pairs], "few string, many string")
    for entries in (1_000_000, 50):
        monkeypatch.setattr(embedding, "ENTRIES", entries)
        assert np.allclose(embedding.TwoSided(few, 20, edges).times(x), b @ (b.T @ x), atol=1e-12)


def test_skip_gram_of_large_vocabularies_leaves_the_driver(spark, monkeypatch):
    """Beyond VOCABULARY tasks learn: nodes of one cluster are nearer to each other than to others, runs agree, and Spark's skip-gram isn't asked."""
    monkeypatch.setattr(embedding, "VOCABULARY", 10)
    monkeypatch.setattr(embedding, "WORDS", 4_000)
    monkeypatch.setattr(embedding, "Word2Vec", None)
    edges = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(20) for j in range(20) if i % 2 == j % 2] + [("a0", "b1")], "source string, target string")
    fit = lambda: {r.node_id: np.array(r.vec) for r in embedding.WalkEmbedding(dimensions=8, directed=False, iterations=40).fit(edges).collect()}
    got, again = fit(), fit()
    assert len(got) == 40 and all(len(v) == 8 and (v == again[k]).all() for k, v in got.items())
    v = {k: x / np.linalg.norm(x) for k, x in got.items()}
    near = [v[a] @ v[b] for a in v for b in v if a < b and int(a[1:]) % 2 == int(b[1:]) % 2]
    far = [v[a] @ v[b] for a in v for b in v if int(a[1:]) % 2 < int(b[1:]) % 2]
    assert np.mean(near) > np.mean(far) + 0.3


def test_correlation_moves_few_copies_of_a_large_matrix():
    """Blocks, and so copies of the matrix in a pass, do not grow with the entities, and a block's values stay bounded."""
    assert [-(-n // correlation.block_size(n, 30)) for n in (1, 1_500, 90_000, 540_000)] == [1, 16, 32, 32]
    assert correlation.block_size(10_000_000, 30) * 30 * 8 <= correlation.BLOCK_BYTES
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9, 8))
    v[rng.random(v.shape) < 0.2] = np.nan
    v[4] = 1.5
    room: dict = {}
    for _ in range(2):  # the same from arrays used again
        n, r = correlation.moments(correlation.side(v[:5]), correlation.side(v[5:]), room)
        for i in range(5):
            for j in range(4):
                both = ~np.isnan(v[i]) & ~np.isnan(v[5 + j])
                assert n[i, j] == both.sum() and (np.isnan(r[i, j]) if i == 4 else abs(r[i, j] - np.corrcoef(v[i][both], v[5 + j][both])[0, 1]) < 1e-9)
    assert len(room) == 1


def test_thresholds_in_one_pass(spark, monkeypatch):
    """The counting pass keeps the values of guessed bins; where the guess is wrong or there is none, one more pass has them. The result is that of all pairs."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(240, 12))
    v[3], v[50] = 2.0, v[10]
    m = spark.createDataFrame([(f"e{i}", f"s{j:02d}", float(v[i, j])) for i in range(240) for j in range(12)], "entity string, sample string, value double")
    r = np.corrcoef(np.delete(v, 3, 0))[np.triu_indices(239, 1)]
    want = np.percentile(r[r > 0], 80), np.percentile(r[r < 0], 20)
    blocks, again = correlation.Blocks.of(m, 6), []
    monkeypatch.setattr(correlation, "values_in", lambda b, k, f=correlation.values_in: again.append(k) or f(b, k))
    right = sorted({int((w + 1) / 2 * correlation.BINS) + k for w in want for k in (-2, -1, 0, 1, 2)})
    for bins, passes in ((right, 0), ([3], 1), ([], 2), (None, 3)):
        with monkeypatch.context() as patch:
            if bins is not None:
                patch.setattr(correlation, "guessed", lambda counts, percentile, bins=bins: bins)
            assert correlation.matrix_thresholds(blocks) == pytest.approx(want, abs=1e-12) and len(again) == passes
    counts = spark.createDataFrame([(up, k, None, 100_000) for up in (True, False) for k in range(4096 * up, 4096 * up + 4000, 100)], "up boolean, bin int, r double, n long")
    assert correlation.guessed(counts, 80.0) == [700, 800, 7196, 7296]
