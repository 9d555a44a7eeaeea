"""Refits from the expansion, by exact passes and from scratch agree; sums don't hang on how rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import logistic


def problem(spark, n_k, n_s, width, seed, scale=1.0, every=9):
    rng = np.random.default_rng(seed)
    vec = {f"{kind}{i}": (scale * rng.normal(size=width)).tolist() for kind, n in (("k", n_k), ("s", n_s)) for i in range(n)}
    vectors = spark.createDataFrame(list(vec.items()), "node_id string, vec array<double>")
    pairs = [(f"k{i}", f"s{j}", int((i * 7 + j) % every == 0)) for i in range(n_k) for j in range(n_s)]
    feature = lambda k, s: logistic.pair_rows(np.array([vec[k]]), np.array(vec[s]))[0][:-1].tolist()
    rows = spark.createDataFrame([(k, s, y, feature(k, s)) for k, s, y in pairs], "kinase_node_id string, site_node_id string, label int, features array<double>")
    return vec, vectors, pairs, rows


def scratch(vec, pairs, own, names):
    """Scores of all candidates for a pair by a fit of all other rows."""
    left = [p for p in pairs if p[:2] != own or not p[2]]
    x = np.vstack([logistic.pair_rows(np.array([vec[k]]), np.array(vec[s])) for k, s, _ in left])
    w = logistic.newton(x, np.array([y for *_, y in left]))
    return {k: 1 / (1 + np.exp(-(logistic.pair_rows(np.array([vec[k]]), np.array(vec[own[1]]))[0] @ w))) for k in names}


@pytest.mark.parametrize("way", ["as it comes", "expansion", "passes", "passes in blocks"])
def test_refits_equal_fits_from_scratch(spark, monkeypatch, way):
    vec, vectors, pairs, rows = problem(spark, 6, 40, 2, 5, 0.2, 3)
    if way == "expansion":
        monkeypatch.setattr(logistic, "TOLERANCE", np.inf)
    elif way != "as it comes":
        monkeypatch.setattr(logistic, "CUBE_NUMBERS", 0)
    if way == "passes in blocks":
        monkeypatch.setattr(logistic, "BLOCK_NUMBERS", 100)
        monkeypatch.setattr(logistic, "GRADIENT_SLICE", 3)
    cands = vectors.where("node_id like 'k%'").select("node_id")
    tested = [(k, s) for k, s, y in pairs if y][::5] + [("k0", "s1")]  # the last is no positive
    trials = spark.createDataFrame([(i + 1, *p) for i, p in enumerate(tested)], "trial_index long, kinase_node_id string, site_node_id string")
    got = {(r.trial_index, r.kinase_node_id): r.score for r in logistic.masked_scores(rows.repartition(3), trials, cands, vectors).collect()}
    assert len(got) == 6 * len(tested)
    close = 1e-5 if way == "expansion" else 1e-7
    for i, own in enumerate(tested):
        for k, score in scratch(vec, pairs, own, [f"k{j}" for j in range(6)]).items():
            assert abs(got[i + 1, k] - score) < close


def test_the_bound_holds(spark):
    """Expanded refits are as near to exact ones as they say, over tables of several sizes."""
    for n, scale in ((60, 0.5), (400, 0.3), (3000, 0.3)):
        rng = np.random.default_rng(n)
        x = np.hstack([scale * rng.normal(size=(n, 4)), np.ones((n, 1))])
        y = (rng.random(n) < 1 / (1 + np.exp(-x @ rng.normal(size=5)))).astype(int)
        w = logistic.newton(x, y)
        data = logistic.DenseTable(x, y)
        sp, sn = logistic.weights_without_one(n, data.pos)
        p = 1 / (1 + np.exp(-(x @ w)))
        i, j = np.triu_indices(5)
        cube = (x[:, i] * x[:, j]).T @ (x * (np.where(y, sp, sn) * p * (1 - p) * (1 - 2 * p))[:, None])
        radius = np.sqrt((x**2).sum(axis=1).max())
        fit = logistic.Expansion(w, data.gradient(w[:, None], sp, sn)[:, 0], data.hessian(w, sp, sn) - np.eye(5), cube, sp, radius, 0.0)
        fit.far = float(np.sqrt(np.einsum("nd,nd->n", x @ fit.inverse, x).max()))
        own = x[y == 1][:20]
        out, _ = fit.refits(own)
        exact = logistic.masked_optima(lambda o, data=data, sp=sp, sn=sn: data.gradient(o, sp, sn), fit.g[:, None], w, fit.inverse, own, sp)
        delta = out - w[:, None]
        chance = lambda m: 1 / (1 + np.exp(-(x @ m)))
        assert (np.abs(chance(out) - chance(exact)).max(axis=0) <= fit.error(delta) + 1e-9).all()


def test_own_scores_are_those_among_all_candidates(spark):
    vec, vectors, pairs, rows = problem(spark, 4, 6, 2, 6, every=3)
    cands = vectors.where("node_id like 'k%' and node_id <> 'k3'").select("node_id")
    trials = spark.createDataFrame([(1, "k0", "s0"), (2, "k1", "s2"), (3, "k3", "s0"), (4, "k0", "s1"), (5, "k0", "none")], "trial_index long, kinase_node_id string, site_node_id string")
    own = {(r.trial_index, r.kinase_node_id): r.score for r in logistic.masked_scores(rows, trials, cands, vectors, own_only=True).collect()}
    every = {(r.trial_index, r.kinase_node_id): r.score for r in logistic.masked_scores(rows, trials, cands, vectors).collect()}
    assert own.keys() == {(1, "k0"), (2, "k1"), (4, "k0")}  # k3 is no candidate, one site has no vector
    assert max(abs(own[k] - every[k]) for k in own) < 1e-9 and len(every) == 3 * 4
    none = rows.limit(0)
    assert {r.score for r in logistic.masked_scores(none, trials, cands, vectors).collect()} == {0.5}


def test_sums_don_t_hang_on_the_dealing(spark, monkeypatch):
    _, vectors, _, rows = problem(spark, 5, 30, 2, 8)
    monkeypatch.setattr(logistic, "FAN", 2)
    w = np.linspace(-0.5, 0.5, 9)
    monkeypatch.setattr(logistic, "CUBE_SLICE", 30)
    one, many = (logistic.Passes(logistic.stored(rows.repartition(k)), 9) for k in (1, 7))
    for a, b in zip(one.bend(w), many.bend(w), strict=True):
        assert np.allclose(a, b)
    assert np.allclose(one.cube(w, 2.0, 1.0), many.cube(w, 2.0, 1.0)) and np.allclose(one.gradient(np.stack([w, 2 * w], 1), 2.0, 1.0), many.gradient(np.stack([w, 2 * w], 1), 2.0, 1.0))
    assert rows.where(F.col("label") == 1).count() == int(one.bend(w)[0][1])
