"""DuckDB SQL for the queries of this package. Pieces that several share are common table expressions with fixed names."""

from __future__ import annotations

_UP = "upper(trim({0}))"
_SITE = r"CASE WHEN regexp_extract(" + _UP + r", '(SER|THR|TYR|S|T|Y)[\s\-]*([0-9]+)', 2) <> '' THEN left(regexp_extract(" + _UP + r", '(SER|THR|TYR|S|T|Y)[\s\-]*([0-9]+)', 1), 1) || regexp_extract(" + _UP + r", '(SER|THR|TYR|S|T|Y)[\s\-]*([0-9]+)', 2) END"
_ONE = r"len(regexp_extract_all({0}, '(?i)(SER|THR|TYR|S|T|Y)[\s\-]*([0-9]+)')) = 1"

RECORDS = """rec AS (
  SELECT 's' || l_suppkey AS enzyme, ' ' || lower(replace(p_brand, '#', '')) AS gene,
    CASE WHEN p_size % 10 = 0 THEN ['Ser', 'T', 'Tyr'][p_partkey % 3 + 1] || '-' || p_partkey || '; S' || p_partkey
      WHEN p_size % 10 = 1 THEN 'K' || p_partkey ELSE ['Ser', 'T', 'Tyr'][p_partkey % 3 + 1] || '-' || p_partkey END AS site,
    CASE WHEN p_size % 7 = 0 THEN 'mouse' WHEN p_size % 7 = 1 THEN NULL ELSE ' Human ' END AS organism,
    l_orderkey * 100 + l_linenumber AS seq, l_quantity AS quantity, l_returnflag AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
REASON = f"""CASE WHEN enzyme IS NULL OR gene IS NULL OR site IS NULL OR organism IS NULL THEN 'missing'
  WHEN NOT contains(lower(trim(organism)), 'human') THEN 'nonhuman' WHEN NOT ({_ONE.format("site")}) THEN 'multi_site'
  WHEN {_SITE.format("site")} IS NULL THEN 'parse' ELSE 'ok' END"""
PARSED = f"""{RECORDS},
ok AS (SELECT flag, 'PROTEIN:' || upper(trim(enzyme)) AS e, 'PROTEIN:' || upper(trim(gene)) AS p, 'SITE:' || upper(trim(gene)) || '-' || {_SITE.format("site")} AS s FROM rec WHERE {REASON} = 'ok')"""
SITES = "ps AS (SELECT p_partkey AS partkey, upper(replace(p_brand, '#', '')) AS gene, 'SITE:' || upper(replace(p_brand, '#', '')) || '-' || ['S', 'T', 'Y'][p_partkey % 3 + 1] || p_partkey AS site_node_id FROM part)"
SUPPLY = f"""{SITES},
se AS (
  SELECT DISTINCT 'PROTEIN:S' || l_suppkey AS source, site_node_id AS target, CASE WHEN l_returnflag = 'A' THEN 'phosphorylates' ELSE 'dephosphorylates' END AS relation
  FROM lineitem JOIN ps ON l_partkey = partkey WHERE l_returnflag IN ('A', 'R')
  UNION ALL SELECT 'PROTEIN:' || gene, site_node_id, 'has_site' FROM ps),
sn AS (
  SELECT node_id, node_type, CASE WHEN node_type = 'protein' AND node_id IN (SELECT source FROM se WHERE relation = 'phosphorylates') THEN 1 ELSE 0 END AS is_kinase,
    CASE WHEN node_type = 'protein' AND node_id IN (SELECT source FROM se WHERE relation = 'dephosphorylates') THEN 1 ELSE 0 END AS is_phosphatase
  FROM (SELECT source AS node_id, 'protein' AS node_type FROM se UNION SELECT target, 'site' FROM se)),
pe AS (SELECT DISTINCT source AS kinase_node_id, target AS site_node_id, relation FROM se WHERE relation = 'phosphorylates')"""
ROLE = "CASE WHEN node_type <> 'protein' THEN 'site' WHEN is_kinase = 1 AND is_phosphatase = 1 THEN 'both' WHEN is_kinase = 1 THEN 'kinase' WHEN is_phosphatase = 1 THEN 'phosphatase' ELSE 'protein' END"
VECTORS = """v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    CASE WHEN vec_id < 50 THEN 'PROTEIN:K' || lpad(CAST(vec_id AS VARCHAR), 3, '0') ELSE 'SITE:G' || vec_id || '-S' || vec_id END AS node_id FROM embeddings),
nets AS (SELECT * FROM (VALUES ('generic', 1), ('control', 17), ('cancer', 33), ('liver_fc', 49)) t(network, o)),
pos AS (SELECT k.node_id AS kinase_node_id, s.node_id AS site_node_id FROM v k JOIN v s ON k.label = s.label WHERE k.vec_id < 50 AND s.vec_id >= 50),
sc AS (SELECT network, k.node_id AS kinase_node_id, s.node_id AS site_node_id, list_cosine_similarity(k.e[o:o + 15], s.e[o:o + 15]) AS score FROM v k, v s, nets WHERE k.vec_id < 50 AND s.vec_id >= 50),
rk AS (
  SELECT sc.*, p.kinase_node_id IS NOT NULL AS is_true_kinase, row_number() OVER (PARTITION BY network, sc.site_node_id ORDER BY score DESC NULLS LAST, sc.kinase_node_id) AS rank_in_site
  FROM sc LEFT JOIN pos p ON sc.kinase_node_id = p.kinase_node_id AND sc.site_node_id = p.site_node_id)"""
TRIALS = f"""{VECTORS},
cat AS (
  SELECT node_id AS kinase_node_id, CASE WHEN coalesce(n, 0) <= 5 THEN 'poor' WHEN coalesce(n, 0) <= 20 THEN 'average' ELSE 'rich' END AS category
  FROM v LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON vec_id + 1 = o_custkey WHERE vec_id < 50),
tr AS (SELECT *, row_number() OVER (ORDER BY kinase_node_id, site_node_id) AS trial_index FROM pos),
nt AS (SELECT site_node_id, count(DISTINCT kinase_node_id) AS n_true, string_agg(DISTINCT kinase_node_id, ';' ORDER BY kinase_node_id) AS all_true FROM pos GROUP BY 1),
full_rk AS (
  SELECT rk.*, category, rank_in_site - coalesce(sum(is_true_kinase::INT) OVER above, 0) AS adj, min(CASE WHEN is_true_kinase THEN rank_in_site END) OVER s AS best,
    first_value(rk.kinase_node_id) OVER o AS top1, first_value(score) OVER o AS top1_score, count(*) OVER s AS n_cand,
    row_number() OVER c - coalesce(sum(is_true_kinase::INT) OVER above_c, 0) AS adj_c,
    arg_min(rk.kinase_node_id, CASE WHEN category = 'poor' THEN rank_in_site END) OVER s AS top1_poor,
    arg_min(rk.kinase_node_id, CASE WHEN category = 'average' THEN rank_in_site END) OVER s AS top1_average,
    arg_min(rk.kinase_node_id, CASE WHEN category = 'rich' THEN rank_in_site END) OVER s AS top1_rich
  FROM rk JOIN cat USING (kinase_node_id)
  WINDOW s AS (PARTITION BY network, site_node_id), o AS (PARTITION BY network, site_node_id ORDER BY rank_in_site),
    above AS (PARTITION BY network, site_node_id ORDER BY rank_in_site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY network, site_node_id, category ORDER BY rank_in_site),
    above_c AS (PARTITION BY network, site_node_id, category ORDER BY rank_in_site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
res AS (
  SELECT network, trial_index, kinase_node_id AS true_kinase_node_id, f.site_node_id, rank_in_site AS held_out_kinase_rank, CAST(adj AS BIGINT) AS adjusted_held_out_rank, best AS best_true_kinase_rank,
    n_true AS n_true_kinases_for_site, all_true AS all_true_kinases_for_site, top1 AS top1_predicted_kinase, top1_score, n_cand AS num_candidate_kinases_scored,
    category AS held_out_kinase_category, CAST(adj_c AS BIGINT) AS adjusted_held_out_rank_in_category, top1_poor, top1_average, top1_rich
  FROM full_rk f JOIN tr USING (kinase_node_id, site_node_id) JOIN nt USING (site_node_id) WHERE is_true_kinase)"""
EVENTS = """m AS (
  SELECT user_id AS row_id, 'U' || user_id AS entity, CAST(CAST(ts AS DATE) AS VARCHAR) AS sample,
    CASE WHEN CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) < 15 THEN 'control' ELSE 'tumor' END AS cls, avg(value) AS value
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
ABUNDANCE = "mx AS (SELECT entity, sample, avg(value) AS value FROM m WHERE {0} AND row_id IN (SELECT row_id FROM m WHERE {0} GROUP BY 1 HAVING count(value) >= 6) GROUP BY 1, 2)"
FC = """mu AS (
  SELECT row_id, avg(value) FILTER (WHERE cls = 'control') AS mu FROM m GROUP BY 1
  HAVING count(value) FILTER (WHERE cls = 'control') >= 1 AND count(value) FILTER (WHERE cls = 'tumor') >= 6 AND avg(value) FILTER (WHERE cls = 'control') > 0),
mx AS (SELECT entity, sample, avg(value / mu) AS value FROM m JOIN mu USING (row_id) WHERE cls = 'tumor' GROUP BY 1, 2)"""
PAIRS = """pr AS (
  SELECT a.entity AS source, b.entity AS target, count(*) AS n_common, CASE WHEN isnan(corr(a.value, b.value)) THEN NULL ELSE corr(a.value, b.value) END AS r
  FROM mx a JOIN mx b ON a.sample = b.sample AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 6),
th AS (SELECT quantile_cont(r, 0.8) FILTER (WHERE r > 0) AS pos, quantile_cont(r, 0.2) FILTER (WHERE r < 0) AS neg FROM pr)"""
CORR_EDGES = "SELECT source, target, CASE WHEN r > 0 THEN '{0}_pos' ELSE '{0}_neg' END AS relation, round(r, 6) AS weight, n_common FROM pr, th WHERE (r > 0 AND r >= pos) OR (r < 0 AND r <= neg)"
LOG_FC = f"""{EVENTS},
lf AS (
  SELECT entity AS site_node_id, log2(avg(value) FILTER (WHERE cls = 'tumor') / avg(value) FILTER (WHERE cls = 'control')) AS fc FROM m GROUP BY row_id, entity
  HAVING count(value) FILTER (WHERE cls = 'tumor') >= 6 AND count(value) FILTER (WHERE cls = 'control') >= 6)"""

# The coefficients of functions.numeric.normal_tail.
_C = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_T = "(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)))"
_POLY = f"{_C[-1]!r}::DOUBLE"
for _x in reversed(_C[:-1]):
    _POLY = f"({_x!r}::DOUBLE + {_T} * {_POLY})"
TAIL = f"0.5::DOUBLE * {_T} * exp(-(abs(z) / sqrt(2.0::DOUBLE)) * (abs(z) / sqrt(2.0::DOUBLE)) + {_POLY})"


def _ksea(flag: str) -> str:
    """k<flag>: scores of the sets of one return flag, from lf."""
    f = flag
    return f"""g{f} AS (SELECT avg(fc) AS gm, stddev_samp(fc) AS sd FROM lf),
s{f} AS (SELECT DISTINCT 'PROTEIN:S' || l_suppkey AS kinase_node_id, 'U' || o_custkey AS site_node_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = '{f}'),
h{f} AS (SELECT kinase_node_id, count(*) AS n, avg(fc) AS ms FROM s{f} JOIN lf USING (site_node_id) GROUP BY 1 HAVING count(*) >= 3),
z{f} AS (SELECT *, (ms - gm) * sqrt(CAST(n AS DOUBLE)) / sd AS z FROM h{f}, g{f}),
q{f} AS (SELECT *, {TAIL} AS p FROM z{f}),
ix{f} AS (SELECT *, row_number() OVER (ORDER BY p, kinase_node_id) AS i, count(*) OVER () AS c FROM q{f}),
k{f} AS (
  SELECT kinase_node_id, substr(kinase_node_id, 9) AS kinase, n AS n_substrates_in_dataset, ms AS mean_substrate_fc, gm AS global_mean_fc, z AS ksea_score, p AS p_value,
    min(least(1.0::DOUBLE, p * c / i)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS adj_p_value FROM ix{f})"""


def _rates(denominator: str) -> str:
    cols = ", ".join(f"round({denominator.format(k)}, 6) AS top_{k}" for k in (1, 5, 10, 20))
    return f"WITH {TRIALS}, x AS (SELECT network, CASE WHEN adjusted_held_out_rank <= 40 THEN adjusted_held_out_rank END AS r FROM res) SELECT network, {cols} FROM x GROUP BY network"


_RANKS = {"held_out": "held_out_kinase_rank", "adjusted_held_out": "adjusted_held_out_rank", "best_true": "best_true_kinase_rank"}


def _summary(source: str, keys: str) -> str:
    parts = []
    for p, c in _RANKS.items():
        for k in (1, 5, 10, 20):
            parts.append((f"{p}_top_{k}_accuracy", f"coalesce(avg(CASE WHEN {c} IS NOT NULL THEN ({c} <= {k})::INT END), 0)"))
        parts += [(f"{p}_n_ranked", f"count({c})"), (f"{p}_n_missing_rank", f"count(*) - count({c})"), (f"{p}_mean_rank", f"avg({c})"), (f"{p}_median_rank", f"median({c})")]
    parts += [("n_trials", "count(*)"), ("mean_n_true_kinases_per_site", "avg(n_true_kinases_for_site)")]
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return "\nUNION ALL ".join(f"SELECT {lead}'{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM {source} {group}" for n, e in parts)


def _performance() -> str:
    out = []
    for p, c in _RANKS.items():
        parts = [("n_trials", "count(*)")]
        for k in (1, 5, 10, 20):
            parts += [(f"top_{k}_count", f"count(*) FILTER (WHERE {c} <= {k})"), (f"top_{k}_share", f"count(*) FILTER (WHERE {c} <= {k}) / CAST(count(*) AS DOUBLE)")]
        parts += [("mean_rank", f"avg({c})"), ("median_rank", f"median({c})")]
        out += [f"SELECT network, '{p}' AS rank_kind, '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM res GROUP BY network" for n, e in parts]
    return "\nUNION ALL ".join(out)


_NETS = ("generic", "control", "cancer", "liver_fc")


def _per(fmt: str) -> str:
    return ", ".join(fmt.format(n=n) for n in _NETS)


COMPARED = f"""{TRIALS},
cmp AS (
  SELECT a.trial_index, a.true_kinase_node_id, a.site_node_id, a.held_out_kinase_rank AS generic_held_out_rank, a.best_true_kinase_rank AS generic_best_true_rank, a.adjusted_held_out_rank AS generic_adjusted_rank, a.top1_predicted_kinase AS generic_top1,
    b.held_out_kinase_rank AS liver_held_out_rank, b.best_true_kinase_rank AS liver_best_true_rank, b.adjusted_held_out_rank AS liver_adjusted_rank, b.top1_predicted_kinase AS liver_top1,
    a.held_out_kinase_rank - b.held_out_kinase_rank AS held_out_rank_delta, a.best_true_kinase_rank - b.best_true_kinase_rank AS best_true_rank_delta,
    a.top1_predicted_kinase IS DISTINCT FROM b.top1_predicted_kinase AS top1_changed, b.held_out_kinase_rank < a.held_out_kinase_rank AS held_out_improved, b.best_true_kinase_rank < a.best_true_kinase_rank AS best_true_improved, a.held_out_kinase_rank = b.held_out_kinase_rank AS tied
  FROM res a JOIN res b USING (trial_index) WHERE a.network = 'generic' AND b.network = 'liver_fc'),
sh AS (SELECT trial_index, site_node_id, true_kinase_node_id, generic_adjusted_rank AS rank_a, liver_adjusted_rank AS rank_b, generic_adjusted_rank - liver_adjusted_rank AS delta, generic_adjusted_rank > liver_adjusted_rank AS improved FROM cmp)"""


def _ks(a: str, b: str) -> str:
    """ksd: distances between the rank distributions of two networks."""
    return f"""cnt AS (SELECT kinase_node_id, rank_in_site AS x, count(*) FILTER (WHERE network = '{a}') AS ca, count(*) FILTER (WHERE network = '{b}') AS cb FROM rk WHERE network IN ('{a}', '{b}') GROUP BY 1, 2),
cum AS (SELECT kinase_node_id, sum(ca) OVER u AS fa, sum(cb) OVER u AS fb, sum(ca) OVER w AS na, sum(cb) OVER w AS nb FROM cnt WINDOW u AS (PARTITION BY kinase_node_id ORDER BY x), w AS (PARTITION BY kinase_node_id)),
ksd AS (SELECT kinase_node_id, max(abs(fa / na - fb / nb)) AS d FROM cum GROUP BY 1),
st AS (SELECT network, kinase_node_id, count(*) AS n, avg(rank_in_site) AS mean, median(rank_in_site) AS med, stddev_pop(rank_in_site) AS sd FROM rk GROUP BY 1, 2 HAVING count(*) >= 30),
kj AS (
  SELECT kinase_node_id, substr(kinase_node_id, 9) AS kinase, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b, a.med AS med_a, b.med AS med_b, a.sd AS sd_a, b.sd AS sd_b, d, d * d * (CAST(a.n AS DOUBLE) * b.n / (a.n + b.n)) AS x2
  FROM st a JOIN st b USING (kinase_node_id) JOIN ksd USING (kinase_node_id) WHERE a.network = '{a}' AND b.network = '{b}'),
kp AS (SELECT *, CASE WHEN x2 < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * list_sum(list_transform(range(1, 21), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * x2))))) END AS p FROM kj),
ki AS (SELECT *, row_number() OVER (ORDER BY p, kinase_node_id) AS i, count(*) OVER () AS c FROM kp),
kt AS (SELECT *, min(least(1.0::DOUBLE, p * c / i)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS adj FROM ki)"""


_SUM = "list_sum({0})"
_KV, _SV = "k.e[1:16]", "s.e[1:16]"
PAIR_SUMS = f"""{_SUM.format(_KV)} AS sum_k, {_SUM.format(_SV)} AS sum_s, list_sum(list_transform(range(1, 17), lambda i: abs(k.e[i] - s.e[i]))) AS sum_diff, list_sum(list_transform(range(1, 17), lambda i: k.e[i] * s.e[i])) AS sum_prod"""

WALK_STEP = "nb.nbrs[(walk * 31 + (step + 1) * 17 + 42) % len(nb.nbrs) + 1]"

ORACLES: dict[str, str] = {
    "top_candidates": f"WITH {VECTORS} SELECT site_node_id, kinase_node_id, round(score, 6) AS score, rank_in_site FROM rk WHERE network = 'generic' AND rank_in_site <= 5",
    "cosine_rank": f"WITH {VECTORS} SELECT kinase_node_id, site_node_id, round(score, 6) AS score, rank_in_site, is_true_kinase FROM rk WHERE network = 'generic'",
    "adjusted_heldout_rank": f"WITH {TRIALS} SELECT trial_index, true_kinase_node_id, site_node_id, held_out_kinase_rank, adjusted_held_out_rank, n_true_kinases_for_site, all_true_kinases_for_site, top1_predicted_kinase, round(top1_score, 6) AS top1_score, num_candidate_kinases_scored FROM res WHERE network = 'generic'",
    "best_true_rank": f"WITH {TRIALS} SELECT DISTINCT network, site_node_id, best_true_kinase_rank FROM res",
    "category_rank": f"WITH {TRIALS} SELECT trial_index, held_out_kinase_category, adjusted_held_out_rank_in_category, top1_poor, top1_average, top1_rich FROM res WHERE network = 'generic'",
    "two_tier_overlay": f"""WITH {VECTORS}, ov AS (
      SELECT a.kinase_node_id, a.site_node_id, coalesce(CASE WHEN a.is_true_kinase THEN b.score END, a.score) AS score FROM rk a JOIN rk b USING (kinase_node_id, site_node_id) WHERE a.network = 'generic' AND b.network = 'control')
      SELECT kinase_node_id, site_node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY site_node_id ORDER BY score DESC NULLS LAST, kinase_node_id) AS rank_in_site FROM ov""",
    "normalize_ids": rf"""WITH {RECORDS}, x AS (SELECT DISTINCT gene, site FROM rec) SELECT gene, site, upper(trim(gene)) AS norm_gene, {_SITE.format("site")} AS norm_site, 'PROTEIN:' || upper(trim(gene)) AS protein_id,
      'SITE:' || upper(trim(gene)) || '-' || {_SITE.format("site")} AS site_id, upper(replace(replace(replace(trim(site), 'Ser', 'S'), 'Tyr', 'Y'), ' ', '')) AS site_token,
      CASE WHEN len(regexp_extract_all(site, '([STY])\s*([0-9]+)')) = 1 THEN regexp_extract(site, '([STY])\s*([0-9]+)', 1) || regexp_extract(site, '([STY])\s*([0-9]+)', 2) END AS single_label FROM x""",
    "parse_site_id": f"""WITH {SITES}, x AS (SELECT site_node_id, gene, substr(site_node_id, 7 + length(gene)) AS label FROM ps) SELECT site_node_id, gene, label AS site_label, gene AS token_gene, label AS token_site, gene AS clean, gene AS stripped,
      least(site_node_id, 'PROTEIN:' || gene) AS low, greatest(site_node_id, 'PROTEIN:' || gene) AS high, 'ENSP' || gene AS alias, list_contains(string_split('X;' || gene, ';'), gene) AS is_member FROM x""",
    "single_site_filter": f"SELECT doc_id, {_SITE.format('text')} AS site FROM documents WHERE {_ONE.format('text')}",
    "parse_reason_counts": f"WITH {RECORDS} SELECT {REASON} AS reason, count(*) AS n FROM rec GROUP BY 1",
    "human_filters": f"""WITH {RECORDS} SELECT 'exact' AS kind, count(*) FILTER (WHERE trim(organism) = 'human') AS n FROM rec UNION ALL SELECT 'lower', count(*) FILTER (WHERE lower(trim(organism)) = 'human') FROM rec
      UNION ALL SELECT 'part', count(*) FILTER (WHERE contains(lower(organism), 'human')) FROM rec UNION ALL SELECT 'no_separator', count(*) FILTER (WHERE NOT regexp_matches(site, '[;,/]') AND trim(site) <> '') FROM rec""",
    "enzyme_site_graph": f"WITH {PARSED} SELECT DISTINCT p AS source, s AS target, 'has_site' AS relation FROM ok WHERE flag = 'A' UNION SELECT DISTINCT e, s, 'phosphorylates' FROM ok WHERE flag = 'A'",
    "merge_nodes_roles": f"""WITH {PARSED}, n AS (SELECT e AS node_id, 'protein' AS node_type FROM ok WHERE flag IN ('A', 'R') UNION SELECT p, 'protein' FROM ok WHERE flag IN ('A', 'R') UNION SELECT s, 'site' FROM ok WHERE flag IN ('A', 'R')),
      f AS (SELECT *, CASE WHEN node_type = 'protein' AND node_id IN (SELECT e FROM ok WHERE flag = 'A') THEN 1 ELSE 0 END AS is_kinase, CASE WHEN node_type = 'protein' AND node_id IN (SELECT e FROM ok WHERE flag = 'R') THEN 1 ELSE 0 END AS is_phosphatase FROM n)
      SELECT node_id, node_type, CAST(is_kinase AS BIGINT) AS is_kinase, CAST(is_phosphatase AS BIGINT) AS is_phosphatase, {ROLE} AS protein_role FROM f""",
    "merge_edges_argmax": """WITH x AS (SELECT 'PROTEIN:S' || l_suppkey AS source, 'PART:' || l_partkey AS target, 'supplies' AS relation, CAST(l_quantity AS BIGINT) AS confidence_score, l_orderkey * 100 + l_linenumber AS seq FROM lineitem)
      SELECT source, target, relation, confidence_score, seq FROM x QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY confidence_score DESC, seq) = 1""",
    "merge_edges": """SELECT 'PROTEIN:S' || l_suppkey AS source, 'PART:' || l_partkey AS target, 'supplies' AS relation, max(CAST(l_quantity AS BIGINT)) AS confidence_score FROM lineitem GROUP BY 1, 2
      UNION ALL SELECT DISTINCT 'PROTEIN:S' || l_suppkey, 'PART:' || l_partkey, 'known', CAST(NULL AS BIGINT) FROM lineitem""",
    "site_collisions": f"""WITH {SITES}, x AS (SELECT substr(site_node_id, 7 + length(gene)) AS site_label, gene FROM ps UNION ALL SELECT ['S', 'T', 'Y'][s_suppkey % 3 + 1] || s_suppkey, 'SUP' FROM supplier)
      SELECT site_label, count(DISTINCT gene) AS n_proteins FROM x GROUP BY 1 HAVING count(DISTINCT gene) > 1""",
    "duplicate_sites": f"WITH {SUPPLY} SELECT split_part(substr(target, 6), '-', 1) AS gene, split_part(target, '-', 2) AS site_label, count(*) AS n FROM se GROUP BY 1, 2 HAVING count(*) > 1",
    "pathway_clique_edges": """WITH x AS (SELECT DISTINCT l_orderkey AS g, 'PART:' || l_partkey AS i FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10), ok AS (SELECT g FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)
      SELECT DISTINCT a.i AS source, b.i AS target, 'protein_same_pathway' AS relation FROM x a JOIN x b ON a.g = b.g AND a.i < b.i JOIN ok ON a.g = ok.g""",
    "pathway_token_edges": f"""WITH {SITES}, x AS (SELECT DISTINCT l_orderkey AS g, site_node_id AS i FROM lineitem JOIN ps ON l_partkey = partkey), ok AS (SELECT g FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
      SELECT DISTINCT a.i AS source, b.i AS target, 'site_same_pathway' AS relation FROM x a JOIN x b ON a.g = b.g AND a.i < b.i JOIN ok ON a.g = ok.g""",
    "scored_interactions": """WITH x AS (SELECT 'PROTEIN:S' || a.l_suppkey AS a, 'PROTEIN:S' || b.l_suppkey AS b, CAST(a.l_quantity AS BIGINT) AS s, a.l_orderkey * 100 + a.l_linenumber AS seq FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_suppkey <> b.l_suppkey AND a.l_quantity >= 10)
      SELECT least(a, b) AS source, greatest(a, b) AS target, 'ppi_high_confidence' AS relation, s AS confidence_score FROM x QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq, s) = 1""",
    "id_map_mode": """WITH x AS (SELECT l_partkey, l_suppkey, count(*) AS c, min(l_orderkey * 100 + l_linenumber) AS s FROM lineitem GROUP BY 1, 2)
      SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) AS n_values FROM x QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, s) = 1""",
    "mapped_edges_fallback": """SELECT c_custkey, raw, coalesce(n_name, raw) AS gene FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '9606.ENSP' ELSE 'ENSP' END || c_nationkey AS raw FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20""",
    "coevolution_edges": f"""WITH {SITES}, x AS (SELECT p.site_node_id AS a, q.site_node_id AS b FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber - 1 JOIN ps p ON l.l_partkey = p.partkey JOIN ps q ON r.l_partkey = q.partkey WHERE l.l_quantity >= 25)
      SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target, 'site_coevolution' AS relation FROM x WHERE a <> b""",
    "network_relations": f"WITH {SUPPLY} SELECT relation, count(*) AS n FROM se GROUP BY 1 UNION ALL SELECT 'embedding', count(*) FROM (SELECT DISTINCT source, target FROM se WHERE relation <> 'phosphorylates')",
    "without_triple": f"WITH {SUPPLY} SELECT source, count(*) AS n FROM se WHERE NOT (source = 'PROTEIN:S1' AND target = 'SITE:BRAND1-S3' AND relation = 'phosphorylates') GROUP BY 1",
    "degree_counts": f"WITH {SUPPLY} SELECT relation, source, count(DISTINCT target) AS degree FROM se GROUP BY 1, 2",
    "context_nodes": f"""WITH {EVENTS}, k AS (SELECT entity, row_id FROM m WHERE row_id % 2 = 0 GROUP BY 1, 2 HAVING count(value) >= 6)
      SELECT DISTINCT 'PROTEIN:' || entity AS node_id, 'protein' AS node_type FROM k UNION SELECT DISTINCT 'SITE:' || entity || '-S' || row_id, 'site' FROM k""",
    "fold_change_matrix": f"WITH {EVENTS}, {FC} SELECT entity, sample, round(value, 6) AS value FROM mx",
    "log2_fold_change": f"WITH {LOG_FC} SELECT site_node_id AS entity, round(fc, 6) AS fc FROM lf",
    "corr_pairs": f"WITH {EVENTS}, {ABUNDANCE.format('true')}, {PAIRS} SELECT source, target, n_common, round(r, 6) AS r FROM pr",
    "corr_thresholds": f"WITH {EVENTS}, {ABUNDANCE.format('true')}, {PAIRS} SELECT round(pos, 6) AS pos, round(neg, 6) AS neg FROM th",
    "corr_edges_raw": f"WITH {EVENTS}, {ABUNDANCE.format(chr(99) + 'ls = ' + chr(39) + 'control' + chr(39))}, {PAIRS} {CORR_EDGES.format('site_control_corr')}",
    "corr_edges_fc": f"WITH {EVENTS}, {FC}, {PAIRS} {CORR_EDGES.format('site_fc_corr')}",
    "candidates": f"WITH {SUPPLY} SELECT node_id, node_type, CAST(is_kinase AS BIGINT) AS is_kinase, CAST(is_phosphatase AS BIGINT) AS is_phosphatase, {ROLE} AS protein_role FROM sn WHERE is_kinase = 1",
    "positive_edges": f"WITH {SUPPLY} SELECT kinase_node_id, site_node_id, relation FROM pe",
    "coverage": f"""WITH {SUPPLY} SELECT count(*) AS n_positive_edges, count(DISTINCT site_node_id) AS n_sites_covered, count(DISTINCT kinase_node_id) AS n_kinases_covered,
      (SELECT count(*) FROM sn WHERE is_kinase = 1) AS n_candidates, (SELECT count(*) FROM sn WHERE node_type = 'site') AS n_sites FROM pe""",
    "freeze_all": f"WITH {SUPPLY} SELECT kinase_node_id, site_node_id, relation, row_number() OVER (ORDER BY kinase_node_id, site_node_id) AS trial_index FROM pe",
    "freeze_multi": f"WITH {SUPPLY}, x AS (SELECT *, count(*) OVER (PARTITION BY site_node_id) AS n FROM pe) SELECT kinase_node_id, site_node_id, relation, row_number() OVER (ORDER BY kinase_node_id, site_node_id) AS trial_index FROM x WHERE n > 1",
    "sampled_trials": f"WITH {SUPPLY} SELECT kinase_node_id, site_node_id, relation FROM pe ORDER BY md5('42|' || kinase_node_id || '|' || site_node_id), 1, 2 LIMIT 10",
    "truth_map": f"WITH {SUPPLY} SELECT site_node_id, string_agg(kinase_node_id, ';' ORDER BY kinase_node_id) AS kinases FROM pe GROUP BY 1",
    "ordered_negatives": f"""WITH {SUPPLY}, k AS (SELECT DISTINCT kinase_node_id FROM pe), s AS (SELECT DISTINCT site_node_id FROM pe)
      SELECT kinase_node_id, site_node_id FROM (SELECT k.kinase_node_id, s.site_node_id FROM k, s) ANTI JOIN pe USING (kinase_node_id, site_node_id) QUALIFY row_number() OVER (PARTITION BY site_node_id ORDER BY kinase_node_id) <= 50""",
    "hashed_negatives": f"""WITH {SUPPLY}, k AS (SELECT kinase_node_id, row_number() OVER (ORDER BY md5('42|' || kinase_node_id), 1) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT kinase_node_id FROM pe)),
      s AS (SELECT DISTINCT site_node_id, ('0x' || substr(md5('42|' || site_node_id), 1, 8))::BIGINT AS h FROM pe)
      SELECT kinase_node_id, site_node_id FROM (SELECT k.kinase_node_id, s.site_node_id, (i - h % n + n) % n AS step FROM k, s) ANTI JOIN pe USING (kinase_node_id, site_node_id) QUALIFY row_number() OVER (PARTITION BY site_node_id ORDER BY step) <= 50""",
    "substrate_counts": f"WITH {SUPPLY} SELECT kinase_node_id, count(DISTINCT site_node_id) AS n_substrates FROM pe GROUP BY 1",
    "categories": """SELECT CAST(c_custkey AS VARCHAR) AS kinase_node_id, coalesce(n, 0) AS n_substrates, CASE WHEN coalesce(n, 0) <= 5 THEN 'poor' WHEN n <= 20 THEN 'average' ELSE 'rich' END AS category
      FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "multi_kinase_sites": f"""WITH {RECORDS}, x AS (SELECT upper(trim(enzyme)) AS k, upper(trim(gene)) AS g, upper(replace(replace(replace(trim(site), 'Ser', 'S'), 'Tyr', 'Y'), ' ', '')) AS s, trim(site) AS raw, seq FROM rec WHERE NOT regexp_matches(site, '[;,/]'))
      SELECT g || '-' || s AS site, count(DISTINCT k) AS n_kinases, string_agg(DISTINCT k, ';' ORDER BY k) AS kinases, arg_min(raw, seq) AS first_label FROM x GROUP BY g, s HAVING count(DISTINCT k) > 1""",
    "pair_features": f"""WITH {VECTORS}, x AS (SELECT p.*, {PAIR_SUMS} FROM pos p JOIN v k ON k.node_id = p.kinase_node_id JOIN v s ON s.node_id = p.site_node_id)
      SELECT kinase_node_id, site_node_id, CAST(64 AS BIGINT) AS n, round(sum_k, 6) AS sum_k, round(sum_s, 6) AS sum_s, round(sum_diff, 6) AS sum_diff, round(sum_prod, 6) AS sum_prod FROM x""",
    "training_matrix": f"""WITH {VECTORS}, s0 AS (SELECT DISTINCT site_node_id FROM pos), k0 AS (SELECT node_id AS kinase_node_id FROM v WHERE vec_id < 50),
      ng AS (SELECT kinase_node_id, site_node_id FROM (SELECT * FROM k0, s0) ANTI JOIN pos USING (kinase_node_id, site_node_id) QUALIFY row_number() OVER (PARTITION BY site_node_id ORDER BY kinase_node_id) <= 20),
      al AS (SELECT kinase_node_id, site_node_id, 1 AS label FROM pos UNION ALL SELECT kinase_node_id, site_node_id, 0 FROM ng),
      x AS (SELECT al.*, {PAIR_SUMS} FROM al JOIN v k ON k.node_id = kinase_node_id JOIN v s ON s.node_id = site_node_id)
      SELECT site_node_id, CAST(label AS BIGINT) AS label, count(*) AS n, round(sum(sum_k + sum_s + sum_diff + sum_prod), 6) AS total FROM x GROUP BY 1, 2""",
    "topk_nonnull": _rates("coalesce(avg(CASE WHEN r IS NOT NULL THEN (r <= {0})::INT END), 0)"),
    "topk_all": _rates("count(*) FILTER (WHERE r <= {0}) / CAST(count(*) AS DOUBLE)"),
    "summary_metrics": f"WITH {TRIALS} {_summary('res', 'network')}",
    "multi_truth_metrics": f"WITH {TRIALS}, mt AS (SELECT * FROM res WHERE network = 'generic' AND n_true_kinases_for_site >= 2) {_summary('mt', '')}",
    "performance_table": f"WITH {TRIALS} {_performance()}",
    "top1_frequency": f"""WITH {TRIALS}, n AS (SELECT network, count(*) AS n FROM res GROUP BY 1), f AS (SELECT network, substr(top1_predicted_kinase, 9) AS kinase, count(*) AS c FROM res GROUP BY 1, 2)
      SELECT kinase, {_per("coalesce(max(CASE WHEN network = '{n}' THEN c END), 0) AS count_{n}")}, {_per("round(coalesce(max(CASE WHEN network = '{n}' THEN c / CAST(n AS DOUBLE) END), 0), 6) AS pct_{n}")} FROM f JOIN n USING (network) GROUP BY 1""",
    "frequency": "SELECT o_orderstatus, o_orderpriority AS value, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 6) AS pct FROM orders GROUP BY 1, 2",
    "per_kinase_topk": f"""WITH {TRIALS}, x AS (SELECT substr(true_kinase_node_id, 9) AS kinase,
      {_per("nullif(count(*) FILTER (WHERE network = '{n}'), 0) AS n_{n}")}, {", ".join(_per(f"round(count(*) FILTER (WHERE network = '{{n}}' AND adjusted_held_out_rank <= {k}) / CAST(nullif(count(*) FILTER (WHERE network = '{{n}}'), 0) AS DOUBLE), 6) AS top{k}_{{n}}") for k in (1, 5, 10))},
      {_per("round(median(adjusted_held_out_rank) FILTER (WHERE network = '{n}'), 6) AS median_{n}")} FROM res GROUP BY 1)
      SELECT *, greatest({_per("coalesce(n_{n}, 0)")}) AS max_n FROM x WHERE greatest({_per("coalesce(n_{n}, 0)")}) >= 5""",
    "category_breakdown": f"""WITH {TRIALS}, st AS (SELECT network, held_out_kinase_category, count(*) AS n, median(adjusted_held_out_rank) AS global_median, median(adjusted_held_out_rank_in_category) AS category_median,
        count(*) FILTER (WHERE adjusted_held_out_rank_in_category <= 1) / CAST(count(*) AS DOUBLE) AS category_top1, count(*) FILTER (WHERE adjusted_held_out_rank_in_category <= 5) / CAST(count(*) AS DOUBLE) AS category_top5 FROM res GROUP BY 1, 2),
      w AS (SELECT network, held_out_kinase_category, substr(CASE held_out_kinase_category WHEN 'poor' THEN top1_poor WHEN 'average' THEN top1_average ELSE top1_rich END, 9) AS winner, count(*) AS winner_count FROM res GROUP BY 1, 2, 3),
      b AS (SELECT * FROM w WHERE winner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY network, held_out_kinase_category ORDER BY winner_count DESC, winner) = 1)
      SELECT network, held_out_kinase_category, n, round(global_median, 6) AS global_median, round(category_median, 6) AS category_median, round(category_top1, 6) AS category_top1, round(category_top5, 6) AS category_top5, winner, winner_count FROM st LEFT JOIN b USING (network, held_out_kinase_category)""",
    "compare_runs": f"WITH {COMPARED} SELECT * FROM cmp",
    "comparison_summary": f"""WITH {COMPARED} SELECT count(*) AS n_trials, count(*) FILTER (WHERE top1_changed) AS n_top1_changed, count(*) FILTER (WHERE held_out_improved) AS n_improved, count(*) FILTER (WHERE NOT held_out_improved) AS n_worsened, count(*) FILTER (WHERE tied) AS n_tied,
      count(*) FILTER (WHERE best_true_improved) AS n_best_true_improved, round(avg(held_out_rank_delta), 6) AS mean_delta, round(avg(held_out_rank_delta) FILTER (WHERE held_out_improved), 6) AS mean_delta_improved, round(avg(held_out_rank_delta) FILTER (WHERE NOT held_out_improved), 6) AS mean_delta_worsened FROM cmp""",
    "ranking_shifts": f"""WITH {COMPARED} SELECT * FROM (SELECT * FROM sh WHERE improved ORDER BY delta DESC, trial_index LIMIT 20) UNION ALL SELECT * FROM (SELECT * FROM sh WHERE NOT improved ORDER BY delta, trial_index LIMIT 20)""",
    "kinase_shifts": f"""WITH {COMPARED} SELECT substr(true_kinase_node_id, 9) AS kinase, count(*) AS n_trials, round(avg(delta), 6) AS mean_delta, count(*) FILTER (WHERE improved) AS n_improved, round(count(*) FILTER (WHERE improved) / CAST(count(*) AS DOUBLE), 6) AS pct_improved FROM sh GROUP BY 1 HAVING count(*) >= 5""",
    "phase_comparison": f"""WITH {TRIALS}, x AS (SELECT CASE WHEN network IN ('generic', 'cancer') THEN 'generic' ELSE 'control' END AS net, CASE WHEN network IN ('generic', 'control') THEN 1 ELSE 2 END AS p, adjusted_held_out_rank AS r FROM res),
      y AS (SELECT net AS network, median(r) FILTER (WHERE p = 1) AS m1, avg(r) FILTER (WHERE p = 1) AS a1, count(*) FILTER (WHERE p = 1 AND r <= 20) / CAST(count(*) FILTER (WHERE p = 1) AS DOUBLE) AS t1, median(r) FILTER (WHERE p = 2) AS m2, avg(r) FILTER (WHERE p = 2) AS a2, count(*) FILTER (WHERE p = 2 AND r <= 20) / CAST(count(*) FILTER (WHERE p = 2) AS DOUBLE) AS t2 FROM x GROUP BY 1)
      SELECT network, round(m1, 6) AS median_1, round(a1, 6) AS mean_1, round(t1, 6) AS top20_1, round(m2, 6) AS median_2, round(a2, 6) AS mean_2, round(t2, 6) AS top20_2, round(m1 - m2, 6) AS delta_median, round((m1 - m2) * 100 / m1, 6) AS pct_improved FROM y""",
    "case_study": f"""WITH {TRIALS}, w AS (SELECT network, count(*) FILTER (WHERE top1_predicted_kinase = 'PROTEIN:K007') AS n_top1_anywhere FROM res GROUP BY 1)
      SELECT network, count(*) AS n, round(median(adjusted_held_out_rank), 6) AS median_rank, round(count(*) FILTER (WHERE adjusted_held_out_rank <= 1) / CAST(count(*) AS DOUBLE), 6) AS top1, round(count(*) FILTER (WHERE adjusted_held_out_rank <= 10) / CAST(count(*) AS DOUBLE), 6) AS top10,
        round(avg((adjusted_held_out_rank <= 20)::INT), 6) AS top20_ranked, any_value(n_top1_anywhere) AS n_top1_anywhere FROM res JOIN w USING (network) WHERE true_kinase_node_id = 'PROTEIN:K007' GROUP BY 1""",
    "top_mean_ranks": f"WITH {VECTORS} SELECT substr(kinase_node_id, 9) AS kinase, round(avg(rank_in_site), 6) AS mean_rank, round(median(rank_in_site), 6) AS median_rank, count(*) AS n FROM rk WHERE network = 'generic' GROUP BY 1 ORDER BY avg(rank_in_site), 1 LIMIT 20",
    "inference_summary": f"WITH {VECTORS} SELECT count(DISTINCT site_node_id) AS n_sites, count(*) AS n_pairs, count(*) FILTER (WHERE is_true_kinase) AS n_true_pairs FROM rk WHERE network = 'generic'",
    "ksea_scores": f"WITH {LOG_FC}, {_ksea('A')} SELECT kinase_node_id, kinase, n_substrates_in_dataset, round(mean_substrate_fc, 6) AS mean_substrate_fc, round(global_mean_fc, 6) AS global_mean_fc, round(ksea_score, 6) AS ksea_score, round(p_value, 6) AS p_value, round(adj_p_value, 6) AS adj_p_value FROM kA",
    "ksea_three_way": f"""WITH {LOG_FC}, {_ksea("A")}, {_ksea("R")}, {_ksea("N")} SELECT a.kinase, round(a.ksea_score, 6) AS score_psp, round(a.adj_p_value, 6) AS adj_p_psp, round(b.ksea_score, 6) AS score_generic, round(b.adj_p_value, 6) AS adj_p_generic,
      round(c.ksea_score, 6) AS score_liver, round(c.adj_p_value, 6) AS adj_p_liver, round(b.ksea_score - a.ksea_score, 6) AS delta_generic, round(c.ksea_score - a.ksea_score, 6) AS delta_liver FROM kA a JOIN kR b USING (kinase) JOIN kN c USING (kinase)""",
    "predicted_sets": f"WITH {VECTORS} SELECT kinase_node_id, site_node_id FROM rk WHERE network = 'generic' AND rank_in_site = 1",
    "bh_fdr": """WITH x AS (SELECT c_custkey, c_mktsegment, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000 AS p FROM customer), i AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM x)
      SELECT c_custkey, c_mktsegment, round(p, 6) AS p, round(min(least(1.0::DOUBLE, p * n / i)) OVER (PARTITION BY c_mktsegment ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 6) AS adj_p_value FROM i""",
    "ks_statistic": f"WITH {VECTORS}, {_ks('control', 'liver_fc')} SELECT kinase_node_id, round(d, 6) AS ks_statistic FROM ksd",
    "ks_test": f"""WITH {VECTORS}, {_ks("control", "liver_fc")} SELECT kinase_node_id, kinase, n_a AS n_control, n_b AS n_liver_fc, round(mean_a, 6) AS mean_rank_control, round(mean_b, 6) AS mean_rank_liver_fc, round(med_a, 6) AS median_rank_control, round(med_b, 6) AS median_rank_liver_fc,
      round(sd_a, 6) AS std_rank_control, round(sd_b, 6) AS std_rank_liver_fc, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, CASE WHEN med_b < med_a THEN 'better in liver_fc' ELSE 'better in control' END AS shift, sd_a > 1 OR sd_b > 1 AS informative, round(adj, 6) AS adj_p_value FROM kt""",
    "rank_mean_std": f"""WITH {VECTORS} SELECT substr(kinase_node_id, 9) AS kinase, {_per("round(avg(rank_in_site) FILTER (WHERE network = '{n}'), 6) AS mean_{n}")}, {_per("round(stddev_samp(rank_in_site) FILTER (WHERE network = '{n}'), 6) AS std_{n}")} FROM rk GROUP BY 1""",
    "rank_delta": f"""WITH {VECTORS}, x AS (SELECT substr(kinase_node_id, 9) AS kinase, {_per("avg(rank_in_site) FILTER (WHERE network = '{n}') AS mean_{n}")}, {_per("stddev_samp(rank_in_site) FILTER (WHERE network = '{n}') AS std_{n}")} FROM rk GROUP BY 1)
      SELECT kinase, round(mean_cancer - mean_control, 6) AS cancer_minus_control, round(mean_liver_fc - mean_control, 6) AS liver_fc_minus_control, coalesce(std_control > 1, false) OR coalesce(std_cancer > 1, false) OR coalesce(std_liver_fc > 1, false) AS informative FROM x""",
    "volcano_frame": f"""WITH {VECTORS}, {_ks("cancer", "control")} SELECT kinase, round(med_a - med_b, 6) AS delta, round(-log10(greatest(adj, 1e-300)), 6) AS neg_log_p, sd_a > 1 OR sd_b > 1 AS informative, round(-log10(greatest(adj, 1e-300)) * abs(med_a - med_b), 6) AS score FROM kt""",
    "enrichment_vs_rank": f"""WITH {TRIALS}, {LOG_FC}, {_ksea("A")}, x AS (SELECT 'K' || lpad(substr(kinase, 2), 3, '0') AS kinase, ksea_score, adj_p_value FROM kA), r AS (SELECT substr(true_kinase_node_id, 9) AS kinase, median(adjusted_held_out_rank) AS median_rank, count(*) AS n_trials FROM res WHERE network = 'generic' GROUP BY 1 HAVING count(*) >= 5)
      SELECT kinase, round(ksea_score, 6) AS ksea_score, round(adj_p_value, 6) AS adj_p_value, CASE WHEN adj_p_value < 0.001 THEN '***' WHEN adj_p_value < 0.01 THEN '**' ELSE '*' END AS stars, round(median_rank, 6) AS median_rank, n_trials FROM x JOIN r USING (kinase)""",
    "aligned_means": f"""WITH {VECTORS} SELECT kinase_node_id, {_per("round(avg(rank_in_site) FILTER (WHERE network = '{n}'), 6) AS {n}")} FROM rk GROUP BY 1""",
    "deepwalk_walks": f"""WITH RECURSIVE {SUPPLY}, ed AS (SELECT DISTINCT source, target FROM se WHERE relation <> 'phosphorylates'), un AS (SELECT source, target FROM ed UNION SELECT target, source FROM ed),
      nb AS (SELECT source AS node, list(target ORDER BY target) AS nbrs FROM un GROUP BY 1),
      wk AS (SELECT node AS start, CAST(walk AS BIGINT) AS walk, 0 AS step, node AS cur, node AS path FROM nb, range(25) t(walk)
        UNION ALL SELECT start, walk, step + 1, {WALK_STEP}, path || '>' || {WALK_STEP} FROM wk JOIN nb ON wk.cur = nb.node WHERE step < 9)
      SELECT start, walk, path FROM wk WHERE step = 9""",
    "concat_embed": f"WITH {VECTORS} SELECT node_id, CAST(32 AS BIGINT) AS n, round(list_sum(e[1:32]), 6) AS total FROM v",
    "corr_edges_cancer": f"WITH {EVENTS}, {ABUNDANCE.format(chr(99) + 'ls = ' + chr(39) + 'tumor' + chr(39))}, {PAIRS} {CORR_EDGES.format('site_cancer_corr')}",
    "corr_edges_protein": f"WITH {EVENTS.replace(chr(39) + 'U' + chr(39) + ' || user_id AS entity', chr(39) + 'PROTEIN:P' + chr(39) + ' || (user_id // 10) AS entity')}, {FC}, {PAIRS} {CORR_EDGES.format('protein_fc_corr')}",
    "sample_classes": """WITH x AS (SELECT o_orderstatus || ' ' || CASE o_orderkey % 3 WHEN 0 THEN 'Control' WHEN 1 THEN 'Sample 2' ELSE 'Sample' END AS name FROM orders)
      SELECT name, CASE WHEN name LIKE '%Control' THEN 'control' WHEN name LIKE '%Sample' THEN 'tumor' END AS by_end, CASE WHEN name LIKE '%Control%' THEN 'control' WHEN name LIKE '%Sample%' THEN 'tumor' END AS anywhere, count(*) AS n FROM x GROUP BY ALL""",
    "csv_round_trip": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
    "headerless_scan": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS trial_index FROM supplier",
    "line_records": """SELECT CAST(s_nationkey AS VARCHAR) AS grp, unnest([s_name, 'K' || s_suppkey]) AS token FROM supplier
      UNION ALL SELECT CAST(s_nationkey AS VARCHAR), unnest([s_name, 'M' || s_suppkey]) FROM supplier""",
    "sniffed_separators": "SELECT * FROM (VALUES ('tabs', chr(9)), ('commas', ',')) t(name, sep)",
    "graph_round_trip": f"WITH {SUPPLY} SELECT relation, {ROLE} AS protein_role, count(*) AS n FROM se JOIN sn ON se.source = sn.node_id GROUP BY 1, 2",
    "experiments": f"""WITH {TRIALS} SELECT CASE WHEN trial_index % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment, count(*) AS n, min(trial_index) AS first, trial_index % 2 = 0 AS done FROM res WHERE network = 'generic' GROUP BY 1, 4""",
    "content_names": "SELECT true AS same, upper(max(s_name)) = max(s_name) AND min(upper(s_name)) = min(s_name) AS other, CAST(10 AS BIGINT) AS n FROM supplier",
    "summary_report": f"""WITH {TRIALS}, x AS (SELECT count(*) AS n, count(*) FILTER (WHERE adjusted_held_out_rank <= 1) AS a, count(*) FILTER (WHERE adjusted_held_out_rank <= 20) AS b FROM res WHERE network = 'generic')
      SELECT unnest(['Trials', '======', 'n_trials: ' || n || '.0', 'top_1_count: ' || a || '.0', 'top_20_count: ' || b || '.0']) AS line FROM x""",
    "formatted": """WITH x AS (SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM orders GROUP BY 1)
      SELECT o_orderpriority, printf('%.1f%%', share * 100) AS percent, CASE WHEN n >= 100 THEN '+' ELSE '' END || format('{:,}', n - 100) AS signed FROM x""",
}
