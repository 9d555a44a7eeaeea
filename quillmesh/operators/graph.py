"""Typed property graphs: building nodes and edges from records, merging, roles, checks, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .tables import clique_pairs, keep_best, keep_first, lookup_with_fallback, union_all

#: Relation vocabulary.
PHOSPHORYLATES, DEPHOSPHORYLATES, HAS_SITE = "phosphorylates", "dephosphorylates", "has_site"
SITE_PATHWAY, PROTEIN_PATHWAY, INTERACTS, COEVOLVES = "site_same_pathway", "protein_same_pathway", "ppi_high_confidence", "site_coevolution"
BASE_RELATIONS = frozenset({PHOSPHORYLATES, DEPHOSPHORYLATES, HAS_SITE, SITE_PATHWAY, PROTEIN_PATHWAY, INTERACTS, COEVOLVES})
CORRELATION = {kind: frozenset({f"site_{kind}_corr_pos", f"site_{kind}_corr_neg"}) for kind in ("control", "cancer", "fc")}
PROTEIN_CORRELATION = frozenset({"protein_fc_corr_pos", "protein_fc_corr_neg"})
ALL_RELATIONS = BASE_RELATIONS.union(*CORRELATION.values(), PROTEIN_CORRELATION)
#: Relations of each network.
NETWORKS = {"generic": BASE_RELATIONS, "control": BASE_RELATIONS | CORRELATION["control"], "cancer": BASE_RELATIONS | CORRELATION["cancer"], "liver_fc": BASE_RELATIONS | CORRELATION["fc"]}
SITE_CAP, PROTEIN_CAP = 50, 100


def human_exact(df: DataFrame, *columns: str) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.col(c) == "human")
    return df.where(cond)


def human_lower(df: DataFrame, *columns: str) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.lower(F.col(c)) == "human")
    return df.where(cond)


def human_part(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).contains("human"), F.lit(False))


def parse_reason(source: Column, gene: Column, site: Column, organisms: list[Column]) -> Column:
    """Why a record is dropped, or 'ok': missing, nonhuman, multi_site, parse."""
    missing = source.isNull() | gene.isNull() | site.isNull()
    for o in organisms:
        missing = missing | o.isNull()
    human = F.lit(True)
    for o in organisms:
        human = human & human_part(o)
    return F.when(missing, "missing").when(~human, "nonhuman").when(~ids.has_one_site(site), "multi_site").when(ids.normalize_site(site).isNull(), "parse").otherwise("ok")


def parse_counts(records: DataFrame, reason: Column) -> DataFrame:
    return records.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def enzyme_site_graph(records: DataFrame, enzyme: str, gene: str, site: str, relation: str = PHOSPHORYLATES, organisms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of records of an enzyme and a site of a protein: three nodes and two edges for each record that parses."""
    reason = parse_reason(F.col(enzyme), F.col(gene), F.col(site), [F.col(o) for o in organisms or []])
    parsed = records.where(reason == "ok").select(
        ids.protein_id(ids.normalize_protein(F.col(enzyme))).alias("e"),
        ids.protein_id(ids.normalize_protein(F.col(gene))).alias("p"),
        ids.site_id(ids.normalize_protein(F.col(gene)), ids.normalize_site(F.col(site))).alias("s"),
    )
    node = lambda c, kind: F.struct(F.col(c).alias("node_id"), F.lit(kind).alias("node_type"))
    edge = lambda a, b, r: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(r).alias("relation"))
    nodes = parsed.select(F.inline(F.array(node("e", "protein"), node("p", "protein"), node("s", "site")))).distinct()
    edges = parsed.select(F.inline(F.array(edge("p", "s", HAS_SITE), edge("e", "s", relation)))).distinct()
    return nodes, edges


def allowed_only(df: DataFrame, allowed: DataFrame | None, column: str, key: str = "node_id") -> DataFrame:
    """Rows whose id is allowed; the planner broadcasts the ids where their measured size permits."""
    return df if allowed is None else df.join(allowed.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def pathway_edges(members: DataFrame, group: str, item: str, relation: str, cap: int, allowed: DataFrame | None = None) -> DataFrame:
    return clique_pairs(allowed_only(members, allowed, item), group, item, cap).withColumn("relation", F.lit(relation))


def pathway_site_ids(records: DataFrame, group: str = "grp", token: str = "token") -> DataFrame:
    """(grp, item) of tokens that name a site."""
    parsed = ids.parse_site_token(F.col(token))
    return records.select(F.col(group).alias("grp"), ids.site_id(parsed["gene"], parsed["site_label"]).alias("item")).where("item is not null")


def scored_interactions(pairs: DataFrame, a: str, b: str, score: str, seq: str, min_score: int = 0, allowed: DataFrame | None = None, relation: str = INTERACTS, upper: bool = False) -> DataFrame:
    """Undirected edges in canonical order; of equal pairs the first by seq stays, the lower score of equal seq."""
    name = (lambda c: F.upper(F.col(c))) if upper else F.col
    low, high = ids.canonical_pair(ids.protein_id(name(a)), ids.protein_id(name(b)))
    from ..functions.numeric import to_count

    e = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(low.alias("source"), high.alias("target"), F.lit(relation).alias("relation"), to_count(F.col(score)).alias("confidence_score"), F.col(seq).alias("_seq"))
    e = e.where(F.col("confidence_score") >= min_score)
    e = allowed_only(allowed_only(e, allowed, "source"), allowed, "target")
    return keep_first(e, ["source", "target", "relation"], [F.col("_seq").asc(), F.col("confidence_score").asc()]).select("source", "target", "relation", "confidence_score")


def coevolution_edges(pairs: DataFrame, mapping: DataFrame, allowed: DataFrame | None = None, min_evidence: int = 1) -> DataFrame:
    """Pairs of sites (protein1, residue1, protein2, residue2, species, ptm1, ptm2, evidence) with ids mapped to genes."""
    from ..functions.numeric import to_number

    p = pairs.where((F.lower("ptm1") == "phosphorylation") & (F.lower("ptm2") == "phosphorylation") & (F.lower("species").contains("homo sapiens")))
    p = p.where(to_number(F.col("evidence")) >= min_evidence)
    for i in (1, 2):
        p = lookup_with_fallback(p, f"protein{i}", ids.peptide_alias(F.col(f"protein{i}")), mapping, "id", "gene", f"g{i}")
    site = [ids.site_id(ids.normalize_protein(F.col(f"g{i}")), ids.normalize_site(F.col(f"residue{i}"))) for i in (1, 2)]
    e = p.select(site[0].alias("a"), site[1].alias("b")).where("a is not null and b is not null and a <> b")
    low, high = ids.canonical_pair(F.col("a"), F.col("b"))
    e = e.select(low.alias("source"), high.alias("target")).distinct().withColumn("relation", F.lit(COEVOLVES))
    return allowed_only(allowed_only(e, allowed, "source"), allowed, "target")


def merge_nodes(frames: list[DataFrame]) -> DataFrame:
    """Distinct (node_id, node_type)."""
    return union_all(f.select("node_id", "node_type") for f in frames).distinct()


def merge_edges(frames: list[DataFrame]) -> DataFrame:
    """One edge for each (source, target, relation): that with the highest confidence, of equals that of the earlier frame and row.

    Frames may carry seq, their row order; otherwise a hash of their other columns decides, so that partitioning does not.
    """
    parts = []
    for i, f in enumerate(frames):
        f = f if "confidence_score" in f.columns else f.withColumn("confidence_score", F.lit(None).cast("int"))
        seq = F.col("seq").cast("long") if "seq" in f.columns else F.xxhash64(*[F.col(f"`{c}`") for c in sorted(f.columns)])
        parts.append(f.withColumn("_seq", F.struct(F.lit(i).alias("i"), seq.alias("s"))).drop("seq"))
    edges = union_all(parts)
    return keep_best(edges, ["source", "target", "relation"], "confidence_score", "_seq", edges.count()).drop("_seq")


def with_roles(nodes: DataFrame, kinases: DataFrame, phosphatases: DataFrame) -> DataFrame:
    """nodes with flags and role from two sets of node ids."""
    k, p = kinases.select("node_id").distinct().withColumn("_k", F.lit(1)), phosphatases.select("node_id").distinct().withColumn("_p", F.lit(1))
    n = nodes.join(k, "node_id", "left").join(p, "node_id", "left")
    protein = F.col("node_type") == "protein"
    n = n.select("node_id", "node_type", F.when(protein, F.coalesce("_k", F.lit(0))).otherwise(0).alias("is_kinase"), F.when(protein, F.coalesce("_p", F.lit(0))).otherwise(0).alias("is_phosphatase"))
    role = F.when(~protein, "site").when((F.col("is_kinase") == 1) & (F.col("is_phosphatase") == 1), "both").when(F.col("is_kinase") == 1, "kinase").when(F.col("is_phosphatase") == 1, "phosphatase").otherwise("protein")
    return n.withColumn("protein_role", role)


def default_metadata(nodes: DataFrame) -> DataFrame:
    """Absent or null flags become 0, a null role the node's type."""
    for c, kind in (("is_kinase", "int"), ("is_phosphatase", "int"), ("protein_role", "string")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    return nodes.withColumns({"is_kinase": F.coalesce("is_kinase", F.lit(0)), "is_phosphatase": F.coalesce("is_phosphatase", F.lit(0)), "protein_role": F.coalesce("protein_role", "node_type")})


def site_collisions(nodes: DataFrame) -> DataFrame:
    """Site labels that several proteins share, with how many."""
    sites = nodes.where("node_type = 'site'").select(ids.parse_site_node_id(F.col("node_id")).alias("s")).where("s is not null")
    return sites.groupBy(F.col("s.site_label").alias("site_label")).agg(F.countDistinct("s.gene").alias("n_proteins")).where("n_proteins > 1")


def duplicate_sites(nodes: DataFrame) -> DataFrame:
    """Sites that one protein lists more than once."""
    sites = nodes.where("node_type = 'site'").select(ids.parse_site_node_id(F.col("node_id")).alias("s")).where("s is not null")
    return sites.groupBy(F.col("s.gene").alias("gene"), F.col("s.site_label").alias("site_label")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relations(edges: DataFrame, allowed: frozenset[str] | None) -> DataFrame:
    """Edges of the allowed relations, all if None; the test reaches the scan, or the folders of partitioned tables."""
    return edges if allowed is None else edges.where(F.col("relation").isin(*sorted(allowed)))


def without_triple(edges: DataFrame, source: str, target: str, relation: str) -> DataFrame:
    return edges.where(~((F.col("source") == source) & (F.col("target") == target) & (F.col("relation") == relation)))


def embedding_edges(edges: DataFrame, allowed: frozenset[str] | None = None) -> DataFrame:
    """Distinct (source, target) of the allowed relations less the labelled one."""
    kept = relations(edges, allowed).where(F.col("relation") != PHOSPHORYLATES)
    return kept.select("source", "target").distinct()
