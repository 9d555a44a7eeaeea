import math

from pyspark.sql import functions as F

from quillmesh.functions import ids, numeric


def values(spark, rows, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_site_normalising(spark):
    given = ["Ser298", "pS10", "T-308", " y15 ", "K20", None, ""]
    got = values(spark, given, ids.normalize_site(F.col("x")))
    assert [g[0] for g in got] == ["S298", "S10", "T308", "Y15", None, None, None]


def test_one_site(spark):
    assert [g[0] for g in values(spark, ["S10", "S10;T20", "", None], ids.has_one_site(F.col("x")))] == [True, False, False, False]


def test_parse_site_id(spark):
    s = ids.parse_site_node_id(F.col("x"))
    got = values(spark, ["SITE:A-B-S12", "SITE:A", "PROTEIN:A", "SITE:-S1"], s["gene"], s["site_label"])
    assert got == [("A-B", "S12"), (None, None), (None, None), (None, None)]


def test_tokens(spark):
    s = ids.parse_site_token(F.col("x"))
    got = values(spark, ["AKT1-S473", "akt1_Ser473", "AKT1:S-473", "AKT1 K5"], s["gene"], s["site_label"])
    assert got == [("AKT1", "S473")] * 3 + [(None, None)]


def test_alias_and_prefixes(spark):
    got = values(spark, ["9606.ENSP1", "TP53", "a.b"], ids.peptide_alias(F.col("x")), ids.clean_node_id(F.concat(F.lit("PROTEIN:a:"), F.col("x"))))
    assert got == [("ENSP1", "a:9606.ENSP1"), (None, "a:TP53"), (None, "a:a.b")]


def test_numbers(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], "a double, b double")
    got = df.select(numeric.fold_change(F.col("a"), F.col("b")), numeric.log2_ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(None, None), (2.0, 1.0), (0.0, -math.inf)]


def test_cosine_of_zero_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(numeric.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_pair_vector(spark):
    df = spark.createDataFrame([([1.0, -2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(numeric.pair_vector(F.col("a"), F.col("b"))).first()[0] == [1, -2, 3, 4, 2, 6, 3, -8]


def test_normal_tails(spark):
    z = [0.0, 0.5, -1.96, 3.0, 6.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    got = df.select(numeric.normal_tail(F.col("z")), numeric.normal_tail_exact(F.col("z"))).collect()
    for x, (fitted, exact) in zip(z, got, strict=True):
        true = 0.5 * math.erfc(abs(x) / math.sqrt(2))
        assert abs(fitted - true) < 2e-7 * true
        assert exact == true


def test_sites_beside_letters_of_two_capitals_and_rare_blanks(spark):
    """As in SQL: ß, ﬅ and ﬆ are no residues, ſ is one in any case, a vertical tab is no blank."""
    texts = ["ß5 q S12", "ﬅ5 q S12", "ﬆ5 q S12", "aſ5", "Sſ5", "ſ5 q S12", "S\x0b5", "ſer 5", "s\t5"]
    got = values(spark, texts, F.when(ids.has_one_site(F.col("x")), ids.normalize_site(F.col("x"))))
    assert [g[0] for g in got] == ["S12", "S12", "S12", "S5", "S5", None, None, "S5", "S5"]
