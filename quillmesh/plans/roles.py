"""How the given tables play the parts of a property graph: suppliers as enzymes, parts as sites, events as measurements, vectors as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import evaluation, graph, ranking

#: Networks, by where their slice of each vector starts.
SLICES = {"generic": 1, "control": 17, "cancer": 33, "liver_fc": 49}
WIDTH = 16
N_CANDIDATES = 50
CONTROL_DAYS = 15


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, node_id, whole): the first vectors are candidates, the others sites."""
    e = table(spark, d, "embeddings")
    n = F.col("vec_id").cast("string")
    name = F.when(F.col("vec_id") < N_CANDIDATES, F.concat(F.lit("PROTEIN:K"), F.lpad(n, 3, "0"))).otherwise(F.concat(F.lit("SITE:G"), n, F.lit("-S"), n))
    return e.select("vec_id", "label", name.alias("node_id"), F.col("embedding").cast("array<double>").alias("whole"))


def network_vectors(v: DataFrame, network: str) -> DataFrame:
    return v.select("node_id", F.slice("whole", SLICES[network], WIDTH).alias("vec"))


def split(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and sites."""
    return v.where(F.col("vec_id") < N_CANDIDATES).select("node_id"), v.where(F.col("vec_id") >= N_CANDIDATES).select("node_id")


def vector_positives(v: DataFrame) -> DataFrame:
    """A candidate and a site of one label."""
    k = v.where(F.col("vec_id") < N_CANDIDATES).select("label", F.col("node_id").alias("kinase_node_id"))
    s = v.where(F.col("vec_id") >= N_CANDIDATES).select("label", F.col("node_id").alias("site_node_id"))
    return k.join(s, "label").select("kinase_node_id", "site_node_id")


def vector_categories(spark: SparkSession, d: str, v: DataFrame) -> DataFrame:
    """Candidates by the number of orders of the customer with their number."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_substrates"))
    k = v.where(F.col("vec_id") < N_CANDIDATES).select("node_id", "vec_id")
    counts = k.join(orders, k.vec_id + 1 == orders.o_custkey).select(F.col("node_id").alias("kinase_node_id"), "n_substrates")
    return evaluation.categories(k, counts)


def _whole(v: DataFrame) -> DataFrame:
    return v.select("node_id", F.col("whole").alias("vec"))


def _slices(networks: list[str] | None) -> dict[str, tuple[int, int]]:
    return {n: (SLICES[n] - 1, SLICES[n] - 1 + WIDTH) for n in networks or SLICES}


def ranks(spark: SparkSession, d: str, networks: list[str] | None = None) -> DataFrame:
    """Cosine ranks of all pairs in each network, with truth."""
    v = vectors(spark, d)
    scores = ranking.network_scores(_whole(v), _slices(networks), *split(v))
    return ranking.with_truth(ranking.rank_in_site(scores, ["network"]), vector_positives(v))


def trials(spark: SparkSession, d: str, networks: list[str] | None = None) -> DataFrame:
    """Trial results of each network."""
    v = vectors(spark, d)
    frozen = evaluation.freeze_all(vector_positives(v))
    return ranking.held_out_ranks(_whole(v), _slices(networks), split(v)[0], frozen, vector_categories(spark, d, v))


def records(spark: SparkSession, d: str, flag: str | None = None) -> DataFrame:
    """(enzyme, gene, site, organism, seq) from line items and their parts, spelt as curated tables spell them."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    li = li if flag is None else li.where(F.col("l_returnflag") == flag)
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    residue = F.element_at(F.array(F.lit("Ser"), F.lit("T"), F.lit("Tyr")), (F.col("p_partkey") % 3 + 1).cast("int"))
    n = F.col("p_partkey").cast("string")
    site = F.when(F.col("p_size") % 10 == 0, F.concat(residue, F.lit("-"), n, F.lit("; S"), n)).when(F.col("p_size") % 10 == 1, F.concat(F.lit("K"), n)).otherwise(F.concat(residue, F.lit("-"), n))
    organism = F.when(F.col("p_size") % 7 == 0, "mouse").when(F.col("p_size") % 7 == 1, F.lit(None)).otherwise(" Human ")
    gene = F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    return j.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("enzyme"), gene.alias("gene"), site.alias("site"), organism.alias("organism"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("quantity"))


def part_sites(spark: SparkSession, d: str) -> DataFrame:
    """(partkey, gene, site_node_id) of every part."""
    p = table(spark, d, "part")
    gene = F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))
    residue = F.element_at(F.array(F.lit("S"), F.lit("T"), F.lit("Y")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("partkey"), gene.alias("gene"), ids.site_id(gene, F.concat(residue, F.col("p_partkey").cast("string"))).alias("site_node_id"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, relation): suppliers to parts by return flag, brands to parts."""
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    sites = part_sites(spark, d)
    relation = F.when(F.col("l_returnflag") == "A", graph.PHOSPHORYLATES).otherwise(graph.DEPHOSPHORYLATES)
    e = li.join(sites, li.l_partkey == sites.partkey).select(ids.protein_id(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("source"), F.col("site_node_id").alias("target"), relation.alias("relation"))
    h = sites.select(ids.protein_id(F.col("gene")).alias("source"), F.col("site_node_id").alias("target"), F.lit(graph.HAS_SITE).alias("relation"))
    return e.unionByName(h)


def supply_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of supply_edges with roles."""
    return nodes_of(supply_edges(spark, d))


def nodes_of(e: DataFrame) -> DataFrame:
    """Nodes of such edges with roles."""
    nodes = e.select(F.inline(F.array(F.struct(F.col("source").alias("node_id"), F.lit("protein").alias("node_type")), F.struct(F.col("target").alias("node_id"), F.lit("site").alias("node_type"))))).distinct()
    k, p = (e.where(F.col("relation") == r).select(F.col("source").alias("node_id")) for r in (graph.PHOSPHORYLATES, graph.DEPHOSPHORYLATES))
    return graph.with_roles(nodes, k, p)


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, entity, sample, cls, value): users' mean values by day; the first days are controls."""
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    start = ev.agg(F.min("day").alias("first_day"))
    ev = ev.crossJoin(F.broadcast(start))
    g = ev.groupBy("user_id", "day", "first_day").agg(F.avg("value").alias("value"))
    entity = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return g.select(F.col("user_id").alias("row_id"), entity.alias("entity"), F.col("day").cast("string").alias("sample"), F.when(F.datediff("day", "first_day") < CONTROL_DAYS, "control").otherwise("tumor").alias("cls"), "value")
