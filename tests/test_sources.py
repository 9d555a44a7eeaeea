import pytest
from pyspark.sql import types as T

from quillmesh.sources import readers, writers


def test_read_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    for name in ("a.csv", "b.tsv"):
        assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / name)).collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.pdf")
    df = spark.createDataFrame([("u", 1)], "a string, b int")
    writers.write_csv_gz(df, str(tmp_path / "out.csv.gz"))
    assert readers.read_table(spark, str(tmp_path / "out.csv.gz")).count() == 1
    assert writers.exists(spark, str(tmp_path / "out.csv.gz")) and not writers.exists(spark, str(tmp_path / "none"))


def test_sniff_and_lines(spark, tmp_path):
    (tmp_path / "s").write_text("# a,b,c\n\nx\ty,z\tw\n")
    assert readers.sniff_separator(spark, str(tmp_path / "s")) == "\t"
    (tmp_path / "g").write_text("P1 AKT1-S473 GSK3B_S9\n\nP2\tX:Y5\n")
    assert sorted(tuple(r) for r in readers.read_line_records(spark, str(tmp_path / "g")).collect()) == [("P1", "AKT1-S473"), ("P1", "GSK3B_S9"), ("P2", "X:Y5")]
    (tmp_path / "m").write_text("# no\nM\tA, B, C\n")
    assert sorted(tuple(r) for r in readers.read_line_records(spark, str(tmp_path / "m"), "tab_commas").collect()) == [("M", "A"), ("M", "B"), ("M", "C")]
    (tmp_path / "h").write_text("## c\na\tb\n")
    assert [tuple(r) for r in readers.read_headerless(spark, str(tmp_path / "h"), ["p", "q"]).collect()] == [("a", "b")]


def test_load_graph(spark):
    n = spark.createDataFrame([("a", "protein", "1", None, "kinase")], "node_id string, node_type string, is_kinase string, is_phosphatase string, protein_role string")
    e = spark.createDataFrame([("a", "b", "r", "x")], "source string, target string, relation string, weight string")
    nodes, edges = readers.load_graph(n, e)
    assert tuple(nodes.first()) == ("a", "protein", 1, 0, "kinase") and tuple(edges.first()) == ("a", "b", "r", None)
    with pytest.raises(ValueError):
        readers.load_graph(n.drop("node_type"), e)


def test_experiments(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    for name in ("one", "two"):
        writers.write_experiment(df, df, str(tmp_path), name)
    assert spark.read.parquet(f"{tmp_path}/results").where("experiment = 'two'").count() == 1


def test_sheet(spark, tmp_path):
    import zipfile

    cell = lambda r, v, kind="": f'<c r="{r}"{kind}><v>{v}</v></c>'
    rows = [[cell("A1", 0, ' t="s"')], [cell("A2", 1, ' t="s"'), cell("C2", 2, ' t="s"')], [cell("A3", 1.5), cell("C3", 0, ' t="s"')], ['<c r="C4" t="inlineStr"><is><t>in</t></is></c>']]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>title</t></si><si><r><t>x</t></r><r><t>1</t></r></si><si><t>y</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i + 1}">{"".join(r)}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>")
    got = readers.read_table(spark, str(tmp_path / "a.xlsx"), header="1")
    assert got.columns == ["x1", "y"] and sorted(map(tuple, got.collect()), key=str) == [("1.5", "title"), (None, "in")]


def test_stream_of_results(spark, tmp_path):
    from quillmesh.streaming import progress

    root = str(tmp_path / "runs")
    m = spark.createDataFrame([(1,)], "x int")
    rows = spark.createDataFrame([(1, "k", "s", 1), (2, "k", "t", 30), (3, "k", "u", None)], "trial_index long, true_kinase_node_id string, site_node_id string, adjusted_held_out_rank long")
    for name in ("one", "two"):
        writers.write_experiment(rows, m, root, name)
    q = progress.running_metrics(progress.follow(spark, root, 1)).writeStream.outputMode("complete").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.experiment, r.n_trials, r.mean_rank, round(r.top_1_accuracy, 6)) for r in spark.table("runs").orderBy("experiment").collect()] == [("one", 3, 15.5, 0.333333), ("two", 3, 15.5, 0.333333)]


def test_release_frees_checkpoints_too(spark):
    from pathlib import Path

    from quillmesh.operators.tables import numbered
    from quillmesh.sources import shared

    shared.release(spark)
    df = numbered(spark.range(10).selectExpr("id"), ["id"])
    table = shared.written(df, "some")
    made = [Path(p.removeprefix("file:")) for p in shared._written]
    assert table.count() == 10 and len(made) == 2 and all(p.exists() for p in made)
    assert shared.release(spark) == 2 and not any(p.exists() for p in made)


def test_discovery_scans_matching_files_only(spark, tmp_path):
    for name, ids in (("generic", [1, 2]), ("liver", [3])):
        spark.createDataFrame([(i,) for i in ids], "trial_index long").coalesce(1).write.parquet(f"{tmp_path}/experiment={name}")
    (tmp_path / "experiment=broken").mkdir()
    (tmp_path / "experiment=broken" / "part-0.parquet").write_bytes(b"no parquet")
    schema = T.StructType([T.StructField("trial_index", T.LongType())])
    found = readers.find_results(spark, str(tmp_path), "=generic", schema)
    got = found.collect()
    assert sorted(r.trial_index for r in got) == [1, 2] and all("experiment=generic" in r.path for r in got)
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.apply(0).metrics().apply("numFiles").value() == 1
    assert readers.find_results(spark, str(tmp_path), "=absent", schema).count() == 0
