import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext

from quillmesh.operators import blocks, ranking


def test_one_block_of_candidates_is_met_by_many_tasks(spark):
    left = spark.range(600).selectExpr("concat('s', id) AS site_node_id", "array(double(id)) AS sv")
    right = spark.createDataFrame([(f"k{i}", [float(i)]) for i in range(3)], "node_id string, vec array<double>")

    def product(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
        n = a.num_rows * b.num_rows
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(np.repeat(a.column("site_node_id").to_pylist(), b.num_rows))], ["task", "site"])

    sizes = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as if tables were large
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = blocks.crossed(left, right, product, "task long, site string", left_size=10).collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert len(got) == 1800 and len({r.site for r in got}) == 600
    assert len({r.task for r in got}) > 1


@pytest.mark.parametrize("held_at_once", [2, 256])
def test_counts_of_held_out_kinases(monkeypatch, held_at_once):
    """Ties, scores that are missing, a kinase outside the block and categories without candidates."""
    monkeypatch.setattr(ranking, "HELD", held_at_once)
    names, kinds = [f"k{i}" for i in range(7)], ["poor", "rich", "poor", "poor", "rich", "poor", "poor"]
    scores = np.array([0.5, 0.7, np.nan, 0.5, 0.7, np.nan, 0.1])
    own = [("k0", "poor", 0.5), ("k2", "poor", np.nan), ("k3", "poor", 0.5), ("k4", "rich", 0.7), ("k5", "poor", np.nan), ("z", "rich", 0.5)]
    counter = ranking.Counter(pa.RecordBatch.from_pydict({"node_id": names, "category": kinds}))
    counter.add((1, "s"), scores, *(np.array([o[i] for o in own], object) for i in (0, 1)), np.array([o[2] for o in own]))
    got = counter.batch([("trial_index", pa.int64()), ("site_node_id", pa.string())]).to_pylist()

    def key(name, score):
        return (np.isnan(score), 0.0 if np.isnan(score) else -score, name)

    block = list(zip(names, kinds, scores, strict=True))
    for r, (name, kind, score) in zip(got, own, strict=True):
        above = [(n, k) for n, k, s in block if key(n, s) < key(name, score)]
        true_above = [(n, k) for n, k, s in own if key(n, s) < key(name, score)]
        assert (r["kinase_node_id"], r["trial_index"], r["site_node_id"], r["category"], r["n"]) == (name, 1, "s", kind, 7)
        assert (r["above"], r["within"]) == (len(above), sum(k == kind for _, k in above))
        assert (r["true_above"], r["true_within"]) == (len(true_above), sum(k == kind for _, k in true_above))
        assert r["top"] == {"none": False, "less": -0.7, "name": "k1"} and r["top_average"] is None
        assert r["top_poor"]["name"] == "k0" and r["top_rich"]["name"] == "k1"
