"""Evaluation sets: candidates, positives, trials, truth, negatives, categories; pair features and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..functions.numeric import pair_vector
from .graph import PHOSPHORYLATES
from .tables import numbered, seeded

POOR, AVERAGE = 5, 20
#: Candidates of a block, of which a site takes some.
BLOCK = 64


def candidates(nodes: DataFrame) -> DataFrame:
    """Kinases, by id."""
    return nodes.where("is_kinase = 1").dropDuplicates(["node_id"]).orderBy("node_id")


def sites(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'site'").select("node_id").distinct().orderBy("node_id")


def positive_edges(edges: DataFrame, nodes: DataFrame, relation: str = PHOSPHORYLATES) -> DataFrame:
    """Distinct labelled edges from a candidate to a known site."""
    e = edges.where(F.col("relation") == relation).select(F.col("source").alias("kinase_node_id"), F.col("target").alias("site_node_id"), "relation").distinct()
    k = nodes.where("is_kinase = 1").select(F.col("node_id").alias("kinase_node_id")).distinct()
    s = nodes.where("node_type = 'site'").select(F.col("node_id").alias("site_node_id")).distinct()
    return e.join(k, "kinase_node_id", "left_semi").join(s, "site_node_id", "left_semi")


def coverage(positives: DataFrame, n_candidates: int, n_sites: int) -> DataFrame:
    return positives.agg(F.count(F.lit(1)).alias("n_positive_edges"), F.countDistinct("site_node_id").alias("n_sites_covered"), F.countDistinct("kinase_node_id").alias("n_kinases_covered")).select("*", F.lit(n_candidates).alias("n_candidates"), F.lit(n_sites).alias("n_sites"))


def freeze_all(positives: DataFrame) -> DataFrame:
    """All positives, numbered by kinase and site."""
    return numbered(positives, ["kinase_node_id", "site_node_id"])


def freeze_multi(positives: DataFrame) -> DataFrame:
    """Positives whose site has more than one, numbered."""
    n = F.count(F.lit(1)).over(W.partitionBy("site_node_id"))
    return numbered(positives.withColumn("_n", n).where("_n > 1").drop("_n"), ["kinase_node_id", "site_node_id"])


def truth_map(positives: DataFrame) -> DataFrame:
    """(site_node_id, kinases) with distinct kinases in order."""
    return positives.groupBy("site_node_id").agg(F.array_sort(F.collect_set("kinase_node_id")).alias("kinases"))


def ordered_negatives(positives: DataFrame, cands: DataFrame, per_site: int = 50, strategy: str = "ordered_head", seed: int = 42) -> DataFrame:
    """(kinase_node_id, site_node_id): for each site with a positive, the first candidates that are none.

    ordered_head takes them by id; hash from a place that hangs on the site, round the candidates in a seeded order. Candidates are
    numbered and packed in blocks; which numbers a site takes is told by the numbers of its positives alone, so that a site meets the
    blocks it takes from, and rows are made where they meet. Blocks that many sites take from have copies, to which sites are dealt.
    """
    spark = positives.sparkSession
    c = cands.select(F.col("node_id").alias("kinase_node_id")).distinct()
    if strategy == "ordered_head":
        c = numbered(c, ["kinase_node_id"], "_i")
    elif strategy == "hash":
        c = numbered(c.withColumn("_h", seeded(seed, "kinase_node_id")), ["_h", "kinase_node_id"], "_i").drop("_h")
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    n = max(1, c.count())
    own = positives.select("site_node_id", "kinase_node_id").join(c, "kinase_node_id", "left").groupBy("site_node_id").agg(F.collect_set("_i").alias("_own"))
    most = F.lit(per_site).cast("long") + F.size("_own")
    tasks, n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK)
    if strategy == "ordered_head":
        numbers = F.sequence(F.lit(1).cast("long"), F.least(most, F.lit(n).cast("long")))
        copies = F.when(F.col("_block") * BLOCK < per_site, tasks).otherwise(1)  # later blocks are taken from by sites of many positives alone
    else:
        start = F.conv(F.substring(seeded(seed, "site_node_id"), 1, 8), 16, 10).cast("long")
        numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.least(most, F.lit(n).cast("long")) - 1), lambda s: (start + s) % n + 1)
        copies = F.lit(-(-tasks // n_blocks))
    block = lambda i: F.floor((i - 1) / BLOCK)
    taken = own.select("site_node_id", F.slice(F.array_except(numbers, "_own"), 1, per_site).alias("_taken"))
    met = taken.select("site_node_id", "_taken", F.explode(F.array_distinct(F.transform("_taken", block))).alias("_block"))
    places = F.transform(F.filter("_taken", lambda i: block(i) == F.col("_block")), lambda i: ((i - 1) % BLOCK).cast("short"))
    met = met.select("site_node_id", "_block", places.alias("_places"), F.pmod(F.xxhash64("site_node_id"), copies).cast("int").alias("_copy"))
    blocks = c.groupBy(block(F.col("_i")).alias("_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "kinase_node_id"))), lambda x: x["kinase_node_id"]).alias("_names"))
    blocks = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    return met.join(blocks, ["_block", "_copy"]).select(F.explode(F.transform("_places", lambda i: F.get("_names", i.cast("int")))).alias("kinase_node_id"), "site_node_id")


def category(count: Column) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n <= POOR, "poor").when(n <= AVERAGE, "average").otherwise("rich")


def substrate_counts(positives: DataFrame) -> DataFrame:
    return positives.groupBy("kinase_node_id").agg(F.countDistinct("site_node_id").alias("n_substrates"))


def categories(cands: DataFrame, counts: DataFrame) -> DataFrame:
    """(kinase_node_id, n_substrates, category) of every candidate."""
    c = cands.select(F.col("node_id").alias("kinase_node_id")).distinct().join(counts, "kinase_node_id", "left")
    return c.select("kinase_node_id", F.coalesce("n_substrates", F.lit(0)).alias("n_substrates"), category(F.col("n_substrates")).alias("category"))


def multi_kinase_sites(records: DataFrame, kinase: str, gene: str, site: str, seq: str) -> DataFrame:
    """Sites with more than one kinase: first gene, number of kinases, kinases and positions joined."""
    r = records.where(ids.has_no_separator(F.col(site)) & F.col(kinase).isNotNull() & F.col(gene).isNotNull())
    r = r.select(F.upper(F.trim(kinase)).alias("k"), F.upper(F.trim(gene)).alias("g"), ids.normalize_site_token(F.col(site)).alias("s"), F.trim(site).alias("raw"), F.col(seq).alias("seq"))
    out = r.groupBy("g", "s").agg(F.countDistinct("k").alias("n_kinases"), F.array_join(F.array_sort(F.collect_set("k")), ";").alias("kinases"), F.min_by("raw", "seq").alias("first_label"))
    return out.where("n_kinases > 1").select(F.concat_ws("-", "g", "s").alias("site"), "n_kinases", "kinases", "first_label")


def pair_features(pairs: DataFrame, vectors: DataFrame, source: str = "kinase_node_id", target: str = "site_node_id") -> DataFrame:
    """pairs with features; pairs that lack a vector are dropped."""
    a = vectors.select(F.col("node_id").alias(source), F.col("vec").alias("_a"))
    b = vectors.select(F.col("node_id").alias(target), F.col("vec").alias("_b"))
    return pairs.join(a, source).join(b, target).withColumn("features", pair_vector(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def training_pairs(positives: DataFrame, cands: DataFrame, per_site: int = 50, strategy: str = "ordered_head") -> DataFrame:
    """(kinase_node_id, site_node_id, label)."""
    pos = positives.select("kinase_node_id", "site_node_id").withColumn("label", F.lit(1))
    neg = ordered_negatives(positives, cands, per_site, strategy).withColumn("label", F.lit(0))
    return pos.unionByName(neg)


def training_rows(positives: DataFrame, cands: DataFrame, vectors: DataFrame, per_site: int = 50, strategy: str = "ordered_head") -> DataFrame:
    """(kinase_node_id, site_node_id, label, features)."""
    return pair_features(training_pairs(positives, cands, per_site, strategy), vectors)


def training_vectors(positives: DataFrame, cands: DataFrame, vectors: DataFrame, per_site: int = 50, strategy: str = "ordered_head") -> DataFrame:
    """(kinase_node_id, site_node_id, label, kv, sv): what features are made of, for those who make them in blocks."""
    of = lambda c, v: vectors.select(F.col("node_id").alias(c), F.col("vec").cast("array<double>").alias(v))
    return training_pairs(positives, cands, per_site, strategy).join(of("kinase_node_id", "kv"), "kinase_node_id").join(of("site_node_id", "sv"), "site_node_id")
