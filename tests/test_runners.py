from quillmesh.plans import runners


def test_leave_one_out_and_sweep(spark, tmp_path):
    nodes = [(f"PROTEIN:K{i}", "protein", 1, 0, "kinase") for i in range(4)] + [(f"SITE:G{j}-S{j}", "site", 0, 0, "site") for j in range(6)] + [(f"PROTEIN:G{j}", "protein", 0, 0, "protein") for j in range(6)]
    edges = [(f"PROTEIN:K{(j + d) % 4}", f"SITE:G{j}-S{j}", "phosphorylates") for j in range(6) for d in (0, 1)]
    edges += [(f"PROTEIN:G{j}", f"SITE:G{j}-S{j}", "has_site") for j in range(6)] + [(f"PROTEIN:K{i}", f"PROTEIN:G{i}", "ppi_high_confidence") for i in range(4)] + [("PROTEIN:K0", "PROTEIN:G5", "ppi_high_confidence"), ("PROTEIN:K1", "PROTEIN:G4", "ppi_high_confidence")]
    n = spark.createDataFrame(nodes, "node_id string, node_type string, is_kinase int, is_phosphatase int, protein_role string")
    e = spark.createDataFrame(edges, "source string, target string, relation string").persist()
    results, metrics = runners.leave_one_out(n, e, "generic", "spectral", "multi", 4)
    got = results.collect()
    assert len(got) == 12 and all(1 <= r.adjusted_held_out_rank <= r.held_out_kinase_rank <= 4 for r in got)
    assert {m.metric: m.value for m in metrics.collect()}["n_trials"] == 12.0
    ranks = runners.sweep(spark, n, e, str(tmp_path / "out"), ("generic",), ("spectral",), 4)
    assert ranks.count() == 24 and ranks.where("is_true_kinase").count() == 12
    assert runners.sweep_summary(runners.sweep(spark, n, e, str(tmp_path / "out"), ("generic",), ("spectral",), 4)).first().n_pairs == 24
