"""One query for each operator (or a family that makes sense only together), over whole tables. Doubles are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, numeric
from ..operators import correlation, embedding, evaluation, graph, logistic, metrics, ranking, statistics
from ..operators.tables import aligned, keep_best, lookup_with_fallback, most_common, renamed, sample_rows, union_all
from ..sources import readers, writers
from ..sources.shared import new_path, written
from . import roles
from .roles import SLICES, table

NETS = list(SLICES)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "decimal(20,0)") else F.col(f"`{c}`") for c, t in df.dtypes])


# --- ranking -----------------------------------------------------------------------------------------------------------


@query
def cosine_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roles.ranks(spark, d, ["generic"]).drop("network"))


@query
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of each site in the generic network."""
    v = roles.vectors(spark, d)
    return rounded(ranking.top_candidates(ranking.cosine_scores(roles.network_vectors(v, "generic"), *roles.split(v)), 5))


@query
def adjusted_heldout_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roles.trials(spark, d, ["generic"]).select("trial_index", "true_kinase_node_id", "site_node_id", "held_out_kinase_rank", "adjusted_held_out_rank", "n_true_kinases_for_site", "all_true_kinases_for_site", "top1_predicted_kinase", "top1_score", "num_candidate_kinases_scored"))


@query
def best_true_rank(spark: SparkSession, d: str) -> DataFrame:
    return roles.trials(spark, d).select("network", "site_node_id", "best_true_kinase_rank").distinct()


@query
def category_rank(spark: SparkSession, d: str) -> DataFrame:
    return roles.trials(spark, d, ["generic"]).select("trial_index", "held_out_kinase_category", "adjusted_held_out_rank_in_category", "top1_poor", "top1_average", "top1_rich")


@query
def two_tier_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Scores of one network, overlaid on true pairs by those of another."""
    v = roles.vectors(spark, d)
    c, s = roles.split(v)
    a, b = (ranking.cosine_scores(roles.network_vectors(v, n), c, s) for n in ("generic", "control"))
    masked = b.join(roles.vector_positives(v), ["kinase_node_id", "site_node_id"], "left_semi")
    return rounded(ranking.overlay(a, masked))


# --- records and ids ---------------------------------------------------------------------------------------------------


@query
def normalize_ids(spark: SparkSession, d: str) -> DataFrame:
    r = roles.records(spark, d).select("gene", "site").distinct()
    gene, label = ids.normalize_protein(F.col("gene")), ids.normalize_site(F.col("site"))
    return r.select("gene", "site", gene.alias("norm_gene"), label.alias("norm_site"), ids.protein_id(gene).alias("protein_id"), ids.site_id(gene, label).alias("site_id"), ids.normalize_site_token(F.col("site")).alias("site_token"), ids.single_site_label(F.col("site")).alias("single_label"))


@query
def parse_site_id(spark: SparkSession, d: str) -> DataFrame:
    s = roles.part_sites(spark, d).select("site_node_id", F.concat(F.col("gene"), F.lit("_"), F.element_at(F.split("site_node_id", "-"), -1)).alias("token"), ids.protein_id(F.col("gene")).alias("p"))
    parsed, tok = ids.parse_site_node_id(F.col("site_node_id")), ids.parse_site_token(F.col("token"))
    low, high = ids.canonical_pair(F.col("site_node_id"), F.col("p"))
    return s.select("site_node_id", parsed["gene"].alias("gene"), parsed["site_label"].alias("site_label"), tok["gene"].alias("token_gene"), tok["site_label"].alias("token_site"), ids.clean_node_id(F.col("p")).alias("clean"), ids.strip_prefix(F.col("p")).alias("stripped"), low.alias("low"), high.alias("high"), ids.peptide_alias(F.concat(F.lit("9606.ENSP"), F.col("gene"))).alias("alias"), ids.is_member(F.col("gene"), F.concat(F.lit("X;"), F.col("gene"))).alias("is_member"))


@query
def single_site_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(ids.has_one_site(F.col("text"))).select("doc_id", ids.normalize_site(F.col("text")).alias("site"))


@query
def parse_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    r = roles.records(spark, d)
    return graph.parse_counts(r, graph.parse_reason(F.col("enzyme"), F.col("gene"), F.col("site"), [F.col("organism")]))


@query
def human_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many records each form of the organism filter keeps."""
    r = roles.records(spark, d).withColumn("plain", F.trim("organism"))
    parts = {"exact": graph.human_exact(r, "plain"), "lower": graph.human_lower(r, "plain"), "part": r.where(graph.human_part(F.col("organism"))), "no_separator": r.where(ids.has_no_separator(F.col("site")))}
    return union_all(x.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, x in parts.items())


# --- graph -------------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, d: str, flag: str, relation: str) -> tuple[DataFrame, DataFrame]:
    return graph.enzyme_site_graph(roles.records(spark, d, flag), "enzyme", "gene", "site", relation, ["organism"])


@query
def enzyme_site_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "A", graph.PHOSPHORYLATES)[1]


@query
def merge_nodes_roles(spark: SparkSession, d: str) -> DataFrame:
    (n1, e1), (n2, e2) = _graph(spark, d, "A", graph.PHOSPHORYLATES), _graph(spark, d, "R", graph.DEPHOSPHORYLATES)
    k, p = (e.where(F.col("relation") == r).select(F.col("source").alias("node_id")) for e, r in ((e1, graph.PHOSPHORYLATES), (e2, graph.DEPHOSPHORYLATES)))
    return rounded(graph.default_metadata(graph.with_roles(graph.merge_nodes([n1, n2]), k, p)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, relation, confidence_score, seq): a supplier's part with the quantity as score."""
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("PROTEIN:S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("PART:"), F.col("l_partkey").cast("string")).alias("target"), F.lit("supplies").alias("relation"), numeric.to_count(F.col("l_quantity").cast("string")).alias("confidence_score"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))


@query
def merge_edges_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = _scored(spark, d)
    return rounded(keep_best(e, ["source", "target", "relation"], "confidence_score", "seq", e.count()))


@query
def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _scored(spark, d)
    return rounded(graph.merge_edges([e.where(F.col("confidence_score") <= 25), e.where(F.col("confidence_score") > 25), e.select("source", "target", F.lit("known").alias("relation"))]))


@query
def site_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Sites of parts and of suppliers in one label space, so that labels are shared."""
    a = roles.part_sites(spark, d).select("site_node_id")
    b = table(spark, d, "supplier").select(ids.site_id(F.lit("SUP"), F.concat(F.element_at(F.array(F.lit("S"), F.lit("T"), F.lit("Y")), (F.col("s_suppkey") % 3 + 1).cast("int")), F.col("s_suppkey").cast("string"))).alias("site_node_id"))
    nodes = a.unionByName(b).select(F.col("site_node_id").alias("node_id"), F.lit("site").alias("node_type"))
    return graph.site_collisions(nodes)


@query
def duplicate_sites(spark: SparkSession, d: str) -> DataFrame:
    nodes = roles.supply_edges(spark, d).select(F.col("target").alias("node_id"), F.lit("site").alias("node_type"))
    return graph.duplicate_sites(nodes)


@query
def pathway_clique_edges(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("PART:"), F.col("l_partkey").cast("string")).alias("item"))
    allowed = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("node_id"))
    return graph.pathway_edges(members, "grp", "item", graph.PROTEIN_PATHWAY, graph.PROTEIN_CAP, allowed)


@query
def pathway_token_edges(spark: SparkSession, d: str) -> DataFrame:
    """Site tokens of orders, parsed, and their cliques."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    s = roles.part_sites(spark, d)
    tokens = li.join(s, li.l_partkey == s.partkey).select(F.col("l_orderkey").alias("grp"), F.concat(F.lower("gene"), F.lit("_"), F.element_at(F.split("site_node_id", "-"), -1)).alias("token"))
    return graph.pathway_edges(graph.pathway_site_ids(tokens), "grp", "item", graph.SITE_PATHWAY, graph.SITE_CAP)


@query
def scored_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one order's consecutive lines; the first score of a pair stays."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    nxt = li.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("b"))
    p = li.join(nxt, (li.l_orderkey == nxt.o) & (li.l_linenumber == nxt.n)).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("b").cast("string")).alias("b"), F.col("l_quantity").cast("string").alias("score"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return rounded(graph.scored_interactions(p, "a", "b", "score", "seq", 10, upper=True))


@query
def id_map_mode(spark: SparkSession, d: str) -> DataFrame:
    """Each part's commonest supplier, the first seen of equals."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return most_common(li, ["l_partkey"], "l_suppkey", "seq")


@query
def mapped_edges_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Nations looked up by id, then by the id's alias, else left."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "9606.ENSP").otherwise("ENSP"), F.col("c_nationkey").cast("string")).alias("raw"))
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("ENSP"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("gene"))
    return lookup_with_fallback(c, "raw", ids.peptide_alias(F.col("raw")), n, "id", "gene", "gene").select("c_custkey", "raw", "gene")


@query
def coevolution_edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive parts of an order as coevolving sites, with genes mapped through aliases."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    nxt = li.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("q"))
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    residue = lambda c: F.concat(F.element_at(F.array(F.lit("S"), F.lit("T"), F.lit("Y")), (F.col(c) % 3 + 1).cast("int")), F.col(c).cast("string"))
    j = li.join(nxt, (li.l_orderkey == nxt.o) & (li.l_linenumber == nxt.n)).join(p, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "b1").drop("p_partkey").join(p, F.col("q") == F.col("p_partkey")).withColumnRenamed("p_brand", "b2")
    pairs = j.select(F.concat(F.lit("9606.ENSP"), F.substring_index("b1", "#", -1)).alias("protein1"), residue("l_partkey").alias("residue1"), F.concat(F.lit("ENSP"), F.substring_index("b2", "#", -1)).alias("protein2"), residue("q").alias("residue2"), F.lit("Homo sapiens").alias("species"), F.lit("Phosphorylation").alias("ptm1"), F.lit("phosphorylation").alias("ptm2"), (F.col("l_quantity") / 25).cast("int").cast("string").alias("evidence"))
    mapping = p.select(F.concat(F.lit("ENSP"), F.substring_index("p_brand", "#", -1)).alias("id"), F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("gene")).distinct()
    return graph.coevolution_edges(pairs, mapping)


@query
def network_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the generic network and of its embedding graph, counted by relation."""
    e = roles.supply_edges(spark, d)
    kept = graph.relations(e, graph.NETWORKS["generic"]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    plain = graph.embedding_edges(e, graph.NETWORKS["generic"]).agg(F.count(F.lit(1)).alias("n")).withColumn("relation", F.lit("embedding"))
    return kept.unionByName(plain)


@query
def without_triple(spark: SparkSession, d: str) -> DataFrame:
    e = roles.supply_edges(spark, d)
    return graph.without_triple(e, "PROTEIN:S1", "SITE:BRAND1-S3", graph.PHOSPHORYLATES).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    return roles.supply_edges(spark, d).groupBy("relation", "source").agg(F.countDistinct("target").alias("degree"))


# --- measurements ------------------------------------------------------------------------------------------------------


@query
def context_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = roles.measurements(spark, d).withColumn("mod", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("1xPhospho [S"), F.col("row_id").cast("string"), F.lit("]"))).otherwise("S1; T2"))
    return correlation.context_nodes(m, "entity", "mod", "value", 6)


@query
def fold_change_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.fold_change_matrix(roles.measurements(spark, d)))


@query
def log2_fold_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.log2_fold_change(roles.measurements(spark, d)))


@query
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.pairwise_pearson(correlation.abundance_matrix(roles.measurements(spark, d))))


@query
def corr_thresholds(spark: SparkSession, d: str) -> DataFrame:
    found = correlation.matrix_thresholds(correlation.Blocks.of(correlation.abundance_matrix(roles.measurements(spark, d))))
    return rounded(spark.createDataFrame([found], "pos double, neg double"))


@query
def corr_edges_raw(spark: SparkSession, d: str) -> DataFrame:
    m = correlation.abundance_matrix(roles.measurements(spark, d), "control")
    return rounded(correlation.correlation_edges(m, "site_control_corr_pos", "site_control_corr_neg"))


@query
def corr_edges_fc(spark: SparkSession, d: str) -> DataFrame:
    m = correlation.fold_change_matrix(roles.measurements(spark, d))
    return rounded(correlation.correlation_edges(m, "site_fc_corr_pos", "site_fc_corr_neg"))


@query
def corr_edges_cancer(spark: SparkSession, d: str) -> DataFrame:
    m = correlation.abundance_matrix(roles.measurements(spark, d), "tumor")
    return rounded(correlation.correlation_edges(m, "site_cancer_corr_pos", "site_cancer_corr_neg"))


@query
def corr_edges_protein(spark: SparkSession, d: str) -> DataFrame:
    """Ten users make a protein, whose rows are averaged."""
    m = roles.measurements(spark, d).withColumn("entity", F.concat(F.lit("PROTEIN:P"), F.floor(F.col("row_id") / 10).cast("string")))
    return rounded(correlation.correlation_edges(correlation.fold_change_matrix(m), "protein_fc_corr_pos", "protein_fc_corr_neg"))


@query
def sample_classes(spark: SparkSession, d: str) -> DataFrame:
    """Priorities that name a class by their end, and by any part."""
    o = table(spark, d, "orders").select(F.concat_ws(" ", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "Control").when(F.col("o_orderkey") % 3 == 1, "Sample 2").otherwise("Sample")).alias("name"))
    o = o.select("name", correlation.sample_class(F.col("name")).alias("by_end"), correlation.sample_class(F.col("name"), anywhere=True).alias("anywhere"))
    return o.groupBy("name", "by_end", "anywhere").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation sets ---------------------------------------------------------------------------------------------------


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.positive_edges(roles.supply_edges(spark, d), roles.supply_nodes(spark, d))


def _stored_positives(spark: SparkSession, d: str) -> DataFrame:
    """Positives for those who read them several times; their edges too are made once."""
    e = written(roles.supply_edges(spark, d), "edges")
    return written(evaluation.positive_edges(e, roles.nodes_of(e)).select("kinase_node_id", "site_node_id"), "positives")


@query
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.candidates(roles.supply_nodes(spark, d)))


@query
def positive_edges(spark: SparkSession, d: str) -> DataFrame:
    return _positives(spark, d)


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    p, n = _positives(spark, d), roles.supply_nodes(spark, d)
    return rounded(evaluation.coverage(p, evaluation.candidates(n).count(), evaluation.sites(n).count()))


@query
def freeze_all(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.freeze_all(_positives(spark, d))


@query
def freeze_multi(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.freeze_multi(_positives(spark, d))


@query
def sampled_trials(spark: SparkSession, d: str) -> DataFrame:
    """Ten trials, sampled by a seed."""
    return sample_rows(_positives(spark, d), 10, ["kinase_node_id", "site_node_id"])


@query
def truth_map(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.truth_map(_positives(spark, d))
    return t.select("site_node_id", F.array_join("kinases", ";").alias("kinases"))


@query
def ordered_negatives(spark: SparkSession, d: str) -> DataFrame:
    p = _stored_positives(spark, d)
    return evaluation.ordered_negatives(p, p.select(F.col("kinase_node_id").alias("node_id")).distinct(), 50)


@query
def hashed_negatives(spark: SparkSession, d: str) -> DataFrame:
    p = _stored_positives(spark, d)
    return evaluation.ordered_negatives(p, p.select(F.col("kinase_node_id").alias("node_id")).distinct(), 50, "hash")


@query
def substrate_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.substrate_counts(_positives(spark, d))


@query
def categories(spark: SparkSession, d: str) -> DataFrame:
    """Customers by their orders."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("kinase_node_id")).agg(F.count(F.lit(1)).alias("n_substrates"))
    return evaluation.categories(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("node_id")), o)


@query
def multi_kinase_sites(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.multi_kinase_sites(roles.records(spark, d), "enzyme", "gene", "site", "seq")


@query
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the four parts of each positive pair's features."""
    v = roles.vectors(spark, d)
    f = evaluation.pair_features(roles.vector_positives(v), roles.network_vectors(v, "generic"))
    part = lambda i: F.aggregate(F.slice("features", 1 + i * roles.WIDTH, roles.WIDTH), F.lit(0.0), lambda a, x: a + x)
    return rounded(f.select("kinase_node_id", "site_node_id", F.size("features").alias("n"), part(0).alias("sum_k"), part(1).alias("sum_s"), part(2).alias("sum_diff"), part(3).alias("sum_prod")))


@query
def training_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = roles.vectors(spark, d)
    rows = evaluation.training_rows(roles.vector_positives(v), roles.split(v)[0], roles.network_vectors(v, "generic"), 20)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.groupBy("site_node_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total")))


# --- metrics -----------------------------------------------------------------------------------------------------------


@query
def topk_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """Ranks beyond 40 count as missing, so that the two denominators differ."""
    r = roles.trials(spark, d).withColumn("r", F.when(F.col("adjusted_held_out_rank") <= 40, F.col("adjusted_held_out_rank")))
    return rounded(r.groupBy("network").agg(*[metrics.hit_rate_ranked("r", k).alias(f"top_{k}") for k in metrics.KS]))


@query
def topk_all(spark: SparkSession, d: str) -> DataFrame:
    r = roles.trials(spark, d).withColumn("r", F.when(F.col("adjusted_held_out_rank") <= 40, F.col("adjusted_held_out_rank")))
    return rounded(r.groupBy("network").agg(*[metrics.hit_rate_all("r", k).alias(f"top_{k}") for k in metrics.KS]))


@query
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(roles.trials(spark, d), ["network"]))


@query
def multi_truth_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(metrics.multi_truth(roles.trials(spark, d, ["generic"]))))


@query
def performance_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.performance(roles.trials(spark, d), ["network"]))


@query
def top1_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.frequency_by_network(roles.trials(spark, d), NETS))


@query
def frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.frequency(table(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"]))


@query
def per_kinase_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_kinase_topk(roles.trials(spark, d), NETS))


@query
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.category_breakdown(roles.trials(spark, d), ["network"]))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return roles.trials(spark, d, ["generic"]), roles.trials(spark, d, ["liver_fc"])


@query
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.compare_runs(*_two(spark, d))


@query
def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.comparison_summary(metrics.compare_runs(*_two(spark, d))))


@query
def ranking_shifts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest improvements and the twenty largest worsenings."""
    s = metrics.ranking_shifts(*_two(spark, d))
    up, down = metrics.extremes(s.where("improved"), "delta", 20, True, ["trial_index"]), metrics.extremes(s.where("not improved"), "delta", 20, False, ["trial_index"])
    return up.unionByName(down).select("trial_index", "site_node_id", "true_kinase_node_id", "rank_a", "rank_b", "delta", "improved")


@query
def kinase_shifts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.kinase_shifts(metrics.ranking_shifts(*_two(spark, d))))


@query
def phase_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The first two networks as one phase, the last two as another."""
    a = roles.trials(spark, d, ["generic", "control"])
    b = roles.trials(spark, d, ["cancer", "liver_fc"]).withColumn("network", F.when(F.col("network") == "cancer", "generic").otherwise("control"))
    return rounded(metrics.phase_comparison(a, b))


@query
def case_study(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.case_study(roles.trials(spark, d), "PROTEIN:K007", ["network"]))


@query
def top_mean_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.top_mean_ranks(roles.ranks(spark, d, ["generic"])))


@query
def inference_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.inference_summary(roles.ranks(spark, d, ["generic"]))


# --- statistics --------------------------------------------------------------------------------------------------------


def _fc(spark: SparkSession, d: str) -> DataFrame:
    return correlation.log2_fold_change(roles.measurements(spark, d)).select(F.col("entity").alias("site_node_id"), "fc")


def _sets(spark: SparkSession, d: str, flag: str) -> DataFrame:
    """Suppliers with the customers of their orders as users."""
    li, o = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.concat(F.lit("PROTEIN:S"), F.col("l_suppkey").cast("string")).alias("kinase_node_id"), F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("site_node_id")).distinct()


@query
def ksea_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.ksea(_fc(spark, d), _sets(spark, d, "A")))


@query
def ksea_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.ksea(_fc(spark, d), _sets(spark, d, "A"), exact=True))


@query
def ksea_three_way(spark: SparkSession, d: str) -> DataFrame:
    fc = _fc(spark, d)
    return rounded(statistics.ksea_three_way(*[statistics.ksea(fc, _sets(spark, d, f)) for f in ("A", "R", "N")]))


@query
def predicted_sets(spark: SparkSession, d: str) -> DataFrame:
    return statistics.predicted_sets(roles.ranks(spark, d, ["generic"]))


@query
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """Order totals' shares as p-values, adjusted for each status."""
    p = table(spark, d, "customer").select("c_custkey", "c_mktsegment", ((F.col("c_custkey") * 7919) % 1000 / 1000.0).alias("p"))
    return rounded(statistics.benjamini_hochberg(p, "p", "c_custkey", keys=["c_mktsegment"]))


@query
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    r = roles.ranks(spark, d, ["control", "liver_fc"])
    return rounded(statistics.ks_statistic(r.where("network = 'control'"), r.where("network = 'liver_fc'"), "kinase_node_id", "rank_in_site"))


@query
def ks_test(spark: SparkSession, d: str) -> DataFrame:
    r = roles.ranks(spark, d, ["control", "liver_fc"])
    return rounded(statistics.ks_test(r.where("network = 'control'"), r.where("network = 'liver_fc'"), ("control", "liver_fc"), exact=False))


@query
def ks_test_exact(spark: SparkSession, d: str) -> DataFrame:
    r = roles.ranks(spark, d, ["control", "liver_fc"])
    return rounded(statistics.ks_test(r.where("network = 'control'"), r.where("network = 'liver_fc'"), ("control", "liver_fc")))


@query
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the order of the clustering of their mean ranks."""
    return statistics.cluster_order(statistics.rank_tables(roles.ranks(spark, d), NETS), [f"mean_{n}" for n in NETS])


@query
def rank_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.rank_tables(roles.ranks(spark, d), NETS))


@query
def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.rank_deltas(statistics.rank_tables(roles.ranks(spark, d), NETS), "control", ["cancer", "liver_fc"]))


@query
def volcano_frame(spark: SparkSession, d: str) -> DataFrame:
    r = roles.ranks(spark, d, ["cancer", "control"])
    return rounded(statistics.volcano(statistics.ks_test(r.where("network = 'cancer'"), r.where("network = 'control'"), ("cancer", "control"), exact=False), ("cancer", "control")))


@query
def enrichment_vs_rank(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment of candidates' numbers as suppliers against their median rank."""
    scored = statistics.ksea(_fc(spark, d), _sets(spark, d, "A")).withColumn("kinase", F.concat(F.lit("K"), F.lpad(F.substring("kinase", 2, 9), 3, "0")))
    return rounded(statistics.enrichment_vs_rank(scored, roles.trials(spark, d, ["generic"])))


@query
def aligned_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean ranks by network, outer-aligned."""
    r = roles.ranks(spark, d)
    return rounded(aligned({n: r.where(F.col("network") == n).groupBy("kinase_node_id").agg(F.avg("rank_in_site").alias("m")) for n in NETS}, "kinase_node_id", "m"))


# --- embeddings and models ---------------------------------------------------------------------------------------------


@query
def deepwalk_walks(spark: SparkSession, d: str) -> DataFrame:
    """Walks over suppliers and parts with arithmetic picks, which SQL can follow."""
    e = _walk_edges(spark, d)
    return embedding.walks(e, pick="arithmetic", directed=False).select("start", F.col("walk").cast("long").alias("walk"), F.array_join("path", ">").alias("path"))


def _walk_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.embedding_edges(roles.supply_edges(spark, d), graph.NETWORKS["generic"])


@query
def biased_walks(spark: SparkSession, d: str) -> DataFrame:
    return embedding.walks(_walk_edges(spark, d), directed=False, p=0.5, q=2.0)


@query
def word2vec_embed(spark: SparkSession, d: str) -> DataFrame:
    return embedding.WalkEmbedding(directed=False).fit(_walk_edges(spark, d))


@query
def spectral_embed(spark: SparkSession, d: str) -> DataFrame:
    return embedding.SpectralEmbedding().fit(_walk_edges(spark, d))


@query
def concat_embed(spark: SparkSession, d: str) -> DataFrame:
    v = roles.vectors(spark, d)
    c = embedding.concatenated(roles.network_vectors(v, "generic"), roles.network_vectors(v, "control"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(c.select("node_id", F.size("vec").alias("n"), total.alias("total")))


@query
def logreg_rank(spark: SparkSession, d: str) -> DataFrame:
    v = roles.vectors(spark, d)
    c, s = roles.split(v)
    vec = roles.network_vectors(v, "generic")
    rows = evaluation.training_rows(roles.vector_positives(v), c, vec)
    return rounded(ranking.rank_in_site(logistic.global_scores(rows, c, s, vec)))


@query
def loo_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Every positive held out once."""
    v = roles.vectors(spark, d)
    pos = roles.vector_positives(v)
    return rounded(logistic.leave_one_out(pos, evaluation.freeze_all(pos), roles.split(v)[0], roles.network_vectors(v, "generic"), roles.vector_categories(spark, d, v)))


@query
def predict_all_two_tier(spark: SparkSession, d: str) -> DataFrame:
    v = roles.vectors(spark, d)
    c, s = roles.split(v)
    return rounded(logistic.predict_all(roles.vector_positives(v), c, s, roles.network_vectors(v, "generic")))


# --- sources and sinks: what is written is read again ------------------------------------------------------------------


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")


def _lines(spark: SparkSession, d: str, line: Column, first: list[str], name: str) -> str:
    """One text file of some first lines and then a line for each supplier."""
    path = new_path(spark, name)
    rows = _suppliers(spark, d).select(F.col("s_suppkey").alias("i"), line.alias("value")).unionByName(spark.createDataFrame([(i - len(first), x) for i, x in enumerate(first)], "i long, value string"))
    rows.coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return path


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "suppliers.csv.gz")
    writers.write_csv_gz(_suppliers(spark, d), path)
    return readers.read_table(spark, path)


@query
def headerless_scan(spark: SparkSession, d: str) -> DataFrame:
    """Four first lines and the comments are no rows; the first two columns are renamed by place."""
    path = _lines(spark, d, F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey"), ["one", "two\tx", "three", "four", "# five"], "headerless")
    return rename_columns(readers.rename_by_place(readers.read_headerless(spark, path, ["a", "b", "c"], skip=4), ["key", "fold_index"]))


def rename_columns(df: DataFrame) -> DataFrame:
    return renamed(df, {"fold_index": "trial_index", "absent": "other"})


@query
def line_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of both styles."""
    blanks = _lines(spark, d, F.concat_ws(" ", "s_nationkey", "s_name", F.concat(F.lit("K"), "s_suppkey")), [" "], "blanks")
    commas = _lines(spark, d, F.concat(F.col("s_nationkey").cast("string"), F.lit("\t"), F.col("s_name"), F.lit(", M"), "s_suppkey"), ["# a\tb", "no tab"], "commas")
    return readers.read_line_records(spark, blanks).unionByName(readers.read_line_records(spark, commas, "tab_commas"))


@query
def sniffed_separators(spark: SparkSession, d: str) -> DataFrame:
    tabs = _lines(spark, d, F.concat_ws("\t", "s_suppkey", "s_name"), ["# a,b,c", ""], "tabs")
    commas = _lines(spark, d, F.concat_ws(",", "s_suppkey", "s_name"), [], "commas")
    return spark.createDataFrame([("tabs", readers.sniff_separator(spark, tabs)), ("commas", readers.sniff_separator(spark, commas))], "name string, sep string")


@query
def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Edges by relation and nodes as text, checked and cast when read."""
    nodes, edges = new_path(spark, "nodes.csv.gz"), new_path(spark, "edges.parquet")
    writers.write_csv_gz(roles.supply_nodes(spark, d), nodes)
    writers.write_edges(roles.supply_edges(spark, d), edges)
    n, e = readers.load_graph(readers.read_table(spark, nodes), readers.read_table(spark, edges))
    ends = e.join(n.select(F.col("node_id").alias("source"), "protein_role"), "source")
    return rounded(ends.groupBy("relation", "protein_role").agg(F.count(F.lit(1)).alias("n")))


@query
def experiments(spark: SparkSession, d: str) -> DataFrame:
    """Two experiments in one table, found by a part of their path, with the test of what is done."""
    root = new_path(spark, "experiments")
    t = roles.trials(spark, d, ["generic"]).select("trial_index", "adjusted_held_out_rank", "best_true_kinase_rank", "held_out_kinase_rank", "n_true_kinases_for_site")
    for name, part in (("even", 0), ("odd", 1)):
        mine = t.where(F.col("trial_index") % 2 == part)
        writers.write_experiment(mine, metrics.summary(mine), root, name)
    done = spark.createDataFrame([(n, writers.exists(spark, f"{root}/{p}")) for n, p in (("even", "results"), ("odd", "none"))], "experiment string, done boolean")
    found = readers.find_results(spark, f"{root}/results", "experiment=").select(F.regexp_extract("path", "experiment=([a-z]+)", 1).alias("experiment"), "trial_index")
    counts = found.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.min("trial_index").alias("first"))
    return counts.join(done, "experiment", "left")


@query
def content_names(spark: SparkSession, d: str) -> DataFrame:
    """Equal content has one name, other content another."""
    a, b, c = (_lines(spark, d, x, [], "named") for x in (F.col("s_name"), F.col("s_name"), F.upper("s_name")))
    x, y, z = (writers.cached_name(p, spark) for p in (a, b, c))
    return spark.createDataFrame([(x == y, x == z, len(x))], "same boolean, other boolean, n long")


@query
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    """The text of a run's metrics, written and read again line by line."""
    path = new_path(spark, "summary.txt")
    m = metrics.performance(roles.trials(spark, d, ["generic"]), []).where("rank_kind = 'adjusted_held_out' and metric in ('n_trials', 'top_1_count', 'top_20_count')").orderBy("metric")
    writers.write_text(spark, metrics.summary_text(m, "Trials"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def formatted(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n"))
    return o.select("o_orderpriority", numeric.percent(F.round("share", 6)).alias("percent"), numeric.signed(F.col("n").cast("double") - 100, 0).alias("signed"))
