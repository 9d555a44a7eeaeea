"""DuckDB SQL for the queries that SQL can express."""

#: Words and their number; \\s-like classes are spelt out, since the engines' own differ.
_SPLIT = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""
WITH docs AS (SELECT doc_id, source, CAST(len({_SPLIT.format("text")}) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM src),
lev AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(source_size) OVER o, 0) AS size_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM w WINDOW o AS (ORDER BY source_size / CAST(w AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, CAST(total - 3 * size_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE) AS level FROM lev),
fr AS (SELECT *, level * w <= CAST(3 * source_size AS DOUBLE) AS free FROM lv),
tg AS (SELECT source, source_size, CASE WHEN free THEN (SELECT arg_min(level, w_before) FROM fr WHERE free) * w ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM fr),
wh AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tg),
rs AS (SELECT *, target - CAST(whole * source_size AS DOUBLE) AS rest FROM wh),
sz AS (SELECT source, size, count(*) AS n FROM docs WHERE size > 0 GROUP BY source, size),
cs AS (
  SELECT source, size, CAST(coalesce(sum(size * n) OVER d, 0) AS DOUBLE) AS sure_mass,
    CAST(sum(CAST(size * size * n AS HUGEINT)) OVER (PARTITION BY source) - coalesce(sum(CAST(size * size * n AS HUGEINT)) OVER d, 0) AS DOUBLE) AS squares
  FROM sz WINDOW d AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rt AS (
  SELECT c.source, max(size) AS free_to, arg_max((rest - sure_mass) / squares, size) AS rate
  FROM cs c JOIN rs r ON c.source IS NOT DISTINCT FROM r.source WHERE (rest - sure_mass) / squares * size < 1 GROUP BY c.source),
dr AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest,
    CASE WHEN d.size > coalesce(t.free_to, 0) THEN 1.0::DOUBLE ELSE greatest(coalesce(t.rate, 0.0::DOUBLE), 0.0::DOUBLE) * d.size END AS p,
    (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM docs d JOIN rs r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN rt t ON d.source IS NOT DISTINCT FROM t.source),
rk AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p <= 0 THEN 1.0::DOUBLE ELSE (u / (1 - u)) / ((u / (1 - u)) + (p / (1 - p))) END AS rank FROM dr),
md AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) - size / 2.0::DOUBLE AS middle FROM rk)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) * size AS taken FROM md
"""

OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("text")} AS w FROM documents),
wins AS (SELECT r, doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS win FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(generate_series(i, i + 12)) AS p FROM wins JOIN firsts USING (win) WHERE first < doc_id)),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM docs)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

_TOKENS = r"list_filter(string_split_regex(translate({0}, '" + _UPPER + "', '" + _LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, len(w[i:i + 12]) AS n, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM wins),
starts AS (
  SELECT r, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lens WHERE len(w) >= n)),
hit AS (SELECT s.r, s.n, s.i, k.item FROM starts s JOIN wins k ON s.win = k.win AND s.n = k.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP8 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT r, doc_id, i, lines[i] AS line FROM (SELECT r, doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM docs)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM cut),
freq AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT c.*, f.k IS NOT NULL AND c.doc_id IS DISTINCT FROM f.keeper AS dropped FROM keyed c LEFT JOIN freq f ON c.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

ORACLES = {"op3_mixing": OP3, "op4_substring_dedup": OP4, "op7_decontaminate": OP7, "op8_line_dedup": OP8}

#: CRC32 of a text of ASCII characters, by its bits.
_CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS UBIGINT)), lambda c, x: "
    "list_reduce(range(8), lambda b, k: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(c, x)), 4294967295::UBIGINT))"
)


def _op11() -> str:
    """Sums over all earlier lines less those over the fold's own: not how the operator gets them."""
    keys = {"every": "0", "kind": "kind", "nation": "nation", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
    of = lambda c, v, k: (
        f"CAST(coalesce(sum({v}) OVER (PARTITION BY {k} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        f" - coalesce(sum({v}) OVER (PARTITION BY {k}, fold ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {c}_{v}"
    )
    sums = ", ".join(of(c, v, k) for c, k in keys.items() for v in "ns")
    rate = lambda c, p: f"CASE WHEN {c}_n < 1 THEN {p} ELSE (1000000 * {c}_s + 50 * {p}) // ({c}_n + 50) END AS {c}_rate"
    return f"""
WITH sold AS (SELECT sale_id, epoch_us(sold_at) AS t, coalesce(client_id, -1) AS client_id, {_CRC.format("CAST(sale_id AS VARCHAR)")} % 5 AS fold FROM sales WHERE sold_at IS NOT NULL),
rows AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, s.client_id, s.t, s.fold, i.kind, v.nation_id AS nation, c.segment,
    count(*) AS n, count(*) FILTER (WHERE l.flag = 'returned') AS s
  FROM sale_lines l JOIN sold s ON l.sale_id = s.sale_id LEFT JOIN items i ON i.item_id = coalesce(l.item_id, -1)
    LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = s.client_id
  GROUP BY ALL),
sums AS (SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned, {sums} FROM rows),
g AS (SELECT *, {rate("every", "500000")} FROM sums),
w AS (SELECT *, {rate("kind", "every_rate")}, {rate("nation", "every_rate")}, {rate("segment", "every_rate")} FROM g)
SELECT sale_id, item_id, vendor_id, n_lines, n_returned, item_n, {rate("item", "kind_rate")}, vendor_n, {rate("vendor", "nation_rate")}, client_n, {rate("client", "segment_rate")} FROM w
"""


ORACLES["op11_target_encoding"] = _op11()

#: States 0 to 3: nothing yet, after s, after u, after a. A layer is closed by one or two insertions.
OP13 = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM src WHERE d <> 0)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM dam),
mark AS (
  SELECT *, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN core[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    CASE WHEN i > 1 AND lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad
  FROM num),
arcs(f, t, r) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
ins(f, t, cost, audit, more) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'), (3, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'),
  (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:')),
moves AS (
  SELECT m.conv_id, m.i, e.f, e.t, e.cost, e.audit, e.more FROM mark m, LATERAL (
    SELECT s.f, s.f AS t, 3 AS cost, 'D' AS audit, NULL AS more FROM (SELECT DISTINCT f FROM ins) s
    UNION ALL SELECT a.f, a.t, CASE WHEN a.r = m.role[1] THEN 0 ELSE 2 END + CASE WHEN m.fault = 't' THEN 1 ELSE 0 END, CASE WHEN a.r = m.role[1] THEN 'K' ELSE 'R' END,
      CASE WHEN a.r = m.role[1] THEN m.role WHEN a.r = 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text
    FROM arcs a WHERE m.fault IN ('-', 't') AND (a.r = m.role[1] OR a.r <> 's')) e),
layers AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, ins.t AS state, CAST(cost AS BIGINT) AS cost, audit, CASE WHEN more = '' THEN CAST([] AS VARCHAR[]) ELSE [more] END AS out FROM (SELECT DISTINCT conv_id FROM num), ins WHERE f = 0
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.out FROM (
    SELECT l.conv_id, m.i, n.t AS state, min(struct_pack(cost := l.cost + m.cost + n.cost, audit := l.audit || m.audit || n.audit,
      out := l.out || CASE WHEN m.more IS NULL THEN CAST([] AS VARCHAR[]) ELSE [m.more] END || CASE WHEN n.more = '' THEN CAST([] AS VARCHAR[]) ELSE [n.more] END)) AS best
    FROM layers l JOIN moves m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i + 1 AND m.f = l.state JOIN ins n ON n.f = m.t
    GROUP BY l.conv_id, m.i, n.t)),
ends AS (
  SELECT l.conv_id, min(struct_pack(cost := cost, audit := audit, out := out)) AS best
  FROM layers l JOIN (SELECT conv_id, max(i) AS n FROM num GROUP BY conv_id) c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.n = l.i WHERE state IN (0, 3) GROUP BY l.conv_id),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, CAST(sum(bad) AS BIGINT) AS illegal
  FROM mark GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""
ORACLES["op13_turn_repair"] = OP13
