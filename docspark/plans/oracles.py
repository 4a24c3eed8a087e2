r"""DuckDB SQL that gives the rows of the queries.

Written from the definitions, by other means than the operators: lines are
unnested and counted with windows, where the operators fold arrays.
"""

from __future__ import annotations

_STRIP = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _core(source: str, keys: str = "id") -> str:
    """CTEs ending in `core`: keys, text and the five core codes of `source` (keys, text)."""
    on = " AND ".join(f"d.{k} = {{0}}.{k}" for k in keys.split(", "))
    return rf"""
src AS ({source}),
raw_lines AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM src),
vis AS (SELECT {keys}, ln, {_strip("line")} AS x FROM raw_lines),
shown AS (SELECT {keys}, ln, x, replace(lower({_strip("regexp_replace(x, '^#{1,6}\\s+', '')")}), 'ß', 'ss') AS v FROM vis WHERE x <> '' AND x NOT LIKE '<!--%'),
brk AS (SELECT {keys}, ln, CASE WHEN v = lag(v) OVER w AND length(v) >= 6 THEN 0 ELSE 1 END AS b FROM shown WINDOW w AS (PARTITION BY {keys} ORDER BY ln)),
grp AS (SELECT {keys}, sum(b) OVER (PARTITION BY {keys} ORDER BY ln ROWS UNBOUNDED PRECEDING) AS g FROM brk),
line_run AS (SELECT {keys}, max(n) AS longest FROM (SELECT {keys}, g, count(*) AS n FROM grp GROUP BY {keys}, g) GROUP BY {keys}),
wl AS (SELECT {keys}, ln, regexp_extract_all(x, '[a-zA-ZÀ-ỹĐđ0-9]+') AS ws FROM shown),
wx AS (SELECT {keys}, ln, replace(lower(unnest(ws)), 'ß', 'ss') AS w, generate_subscripts(ws, 1) AS k FROM wl WHERE len(ws) >= 8),
wb AS (SELECT {keys}, ln, k, CASE WHEN w = lag(w) OVER v THEN 0 ELSE 1 END AS b FROM wx WINDOW v AS (PARTITION BY {keys}, ln ORDER BY k)),
wg AS (SELECT {keys}, ln, sum(b) OVER (PARTITION BY {keys}, ln ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM wb),
word_run AS (SELECT {keys}, max(n) AS longest FROM (SELECT {keys}, ln, g, count(*) AS n FROM wg GROUP BY {keys}, ln, g) GROUP BY {keys}),
core AS (
  SELECT {", ".join(f"d.{k}" for k in keys.split(", "))}, d.text,
    {_strip("d.text")} = '' AS empty_page,
    len(regexp_extract_all(d.text, '```')) % 2 = 1 AS unclosed_code_blocks,
    coalesce(l.longest, 0) >= 4 AS repetition_loop,
    coalesce(w.longest, 0) >= 5 AS repeated_words,
    (length(d.text) - length(replace(d.text, '$', '')) - (length(d.text) - length(replace(d.text, '\$', ''))) // 2) % 2 = 1 AS unbalanced_math_delimiters
  FROM src d LEFT JOIN line_run l ON {on.format("l")} LEFT JOIN word_run w ON {on.format("w")}
),
codes AS (
  SELECT *, list_filter([CASE WHEN empty_page THEN 'empty_page' END, CASE WHEN repeated_words THEN 'repeated_words' END, CASE WHEN repetition_loop THEN 'repetition_loop' END,
    CASE WHEN unbalanced_math_delimiters THEN 'unbalanced_math_delimiters' END, CASE WHEN unclosed_code_blocks THEN 'unclosed_code_blocks' END], lambda c: c IS NOT NULL) AS errors,
    greatest(0, 100 - 100 * empty_page::INT - 50 * repetition_loop::INT - 25 * unclosed_code_blocks::INT - 20 * repeated_words::INT - 15 * unbalanced_math_delimiters::INT)::DOUBLE AS score
  FROM core
)"""


_DOCS = "SELECT doc_id, text FROM documents"
_REPORT = "score, (empty_page OR repetition_loop OR score < 80) AS should_retry, len(errors) = 0 AS passed, array_to_string(errors, ',') AS errors"
_BOXES = """
boxes AS (
  SELECT page, id, min(x).l AS l, min(x).t AS t, min(x).r AS r, min(x).b AS b, min(x).f AS f FROM (
    SELECT l_orderkey // 16 AS page, l_orderkey * 8 + l_linenumber AS id,
      {'l': (l_partkey * 37 % 800)::DOUBLE, 't': floor(l_extendedprice % 1200)::DOUBLE, 'r': (l_partkey * 37 % 800)::DOUBLE + l_quantity * 14 + 10,
       'b': floor(l_extendedprice % 1200)::DOUBLE + l_suppkey % 90 + 12, 'f': l_returnflag} AS x
    FROM lineitem) GROUP BY page, id
)"""
_CANDIDATES = """
c AS (
  SELECT page, line_idx, ['invalid_table_grid', 'truncated_line', 'possible_missing_printed_footer', 'unusual_word', 'mass_diacritic_loss', 'glued_characters'][k + 1] AS reason,
    ['critical', 'high', 'high', 'low', 'critical', 'high'][k + 1] AS severity, [0, 1, 1, 3, 0, 1][k + 1] AS rank
  FROM (SELECT l_orderkey AS page, l_linenumber::BIGINT AS line_idx, min(l_partkey) % 6 AS k FROM lineitem GROUP BY 1, 2)
)"""
_PIPES = """
t AS (
  SELECT o_custkey, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN ' | x |' ELSE ' |' END, chr(10) ORDER BY o_orderkey) AS body,
    bool_or(o_orderkey % 7 = 0) AS broken, count(*) AS n,
    string_agg('<tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN '</td><td>x</td></tr>' ELSE '</td></tr>' END, '' ORDER BY o_orderkey) AS cells
  FROM orders GROUP BY o_custkey
)"""
_RUNS = """
runs AS (
  SELECT event_type AS config, user_id % 97 <> 0 AS ok, CASE WHEN event_id % 501 = 0 THEN 1 ELSE 0 END AS oom, floor(coalesce(value, 0) * 100)::DOUBLE AS quality,
    coalesce(value, 0) AS vram, user_id % 3 AS retries, user_id % 2 AS timeouts, event_id % 4 + 1 AS run FROM events
)"""
#: Benchmark texts and their altered copies, case-folded and squeezed.
_ALTERED = r"""
t AS (SELECT item_id, text AS e, upper(replace(replace(replace(text, 'the', 'thé'), 'and', 'an d'), ' ', '  ')) AS a FROM benchmark),
n AS (SELECT item_id, trim(regexp_replace(replace(lower(e), 'ß', 'ss'), '\s+', ' ', 'g')) AS e, trim(regexp_replace(replace(lower(a), 'ß', 'ss'), '\s+', ' ', 'g')) AS a FROM t)"""


def _as_bytes(items: str) -> str:
    """A one-byte letter for each item, its place among `known`: DuckDB's distance counts bytes."""
    return f"array_to_string(list_transform({items}, lambda x: chr(list_position(known, x)::INT)), '')"


_FOLD = "replace(lower({}), 'ß', 'ss')"

_REGIONS = """
g AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY t, l, r, b) AS n FROM (
    SELECT o_custkey, (o_orderkey * 37 % 600)::DOUBLE AS l, (o_orderkey * 91 % 1100)::DOUBLE AS t, (o_orderkey * 37 % 600 + o_orderkey % 200 + 20)::DOUBLE AS r, (o_orderkey * 91 % 1100 + o_orderkey % 70 + 10)::DOUBLE AS b
    FROM orders WHERE o_orderkey % 3 = 0))"""
#: Word lists of the language profile (fixed values).
_VI = "['cua','va','la','trong','duoc','cho','voi','tu','den','mot','nhung','cac','nay','theo','tai','ve','khi','co']"
_VI_PHRASES = "['cua','va','la','trong','duoc','cho','voi','tu','den','mot','nhung','cac','nay','theo','tai','ve','khi','co','viet','nam','nguoi','nuoc','thanh','pho','du lich','phat trien','chuong trinh','hoat dong','thong tin','doanh nghiep','thi truong']"
_EN = "['the','and','is','are','of','to','in','for','with','from','this','that','was','were','by','on','as','an','be','or']"

ORACLES = {
    "q01_page_quality_report": f"WITH {_core(_DOCS, 'doc_id')} SELECT doc_id, {_REPORT} FROM codes",
    "q38_stream_pages": f"WITH {_core(_DOCS, 'doc_id')} SELECT doc_id, {_REPORT} FROM codes",
    "q03_repetition_runs": f"WITH {_core(_DOCS, 'doc_id')} SELECT doc_id, longest FROM line_run WHERE longest >= 4",
    "q04_repeated_words": f"WITH {_core(_DOCS, 'doc_id')} SELECT doc_id, longest FROM word_run WHERE longest >= 5",
    "q02_language_profile": rf"""
WITH a AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', '', 'gs'), '`[^`]*`', '', 'g'),
    '\$\$.*?\$\$|\$[^$\n]*\$', '', 'gs'), '!?\[([^\]]*)\]\([^)]+\)', '\1', 'g'), 'https?://\S+|\b\S+@\S+\.\S+\b', '', 'gi'), '<table\b.*?</table>', '', 'gsi') AS t FROM documents
), l AS (SELECT doc_id, {_strip("unnest(string_split(t, chr(10)))")} AS x FROM a),
p AS (SELECT doc_id, regexp_replace(x, '^#{{1,6}}\s+', '') AS x FROM l WHERE x <> '' AND x NOT LIKE '|%' AND x NOT LIKE '<!--%'),
g AS (
  SELECT doc_id, x FROM p WHERE len(regexp_extract_all(x, '\p{{L}}')) >= 60 AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 12
    AND x <> upper(x) AND len(regexp_extract_all(x, '\p{{Nd}}')) <= 0.2 * length(x)
), w AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format("x")}, '[a-zA-ZÀ-ỹĐđ]+')) AS w FROM g),
n AS (
  SELECT doc_id, count(*) FILTER (w IN ('cua','va','la','trong','duoc','cho','voi','tu','den','mot','nhung','cac','nay','theo','tai','ve','khi','co')
      OR regexp_matches(w, '[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]')) AS vi,
    count(*) FILTER (w IN ('the','and','is','are','of','to','in','for','with','from','this','that','was','were','by','on','as','an','be','or')) AS en
  FROM w GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN vi >= 3 AND en >= 3 THEN 'mixed_vi_en' WHEN vi >= 3 THEN 'vi' WHEN en >= 3 THEN 'en' ELSE 'unknown' END AS profile
FROM documents d LEFT JOIN n USING (doc_id)
""",
    "q05_unbalanced_math": r"""
SELECT doc_id, n AS n_delimiters FROM (
  SELECT doc_id, length(text) - length(replace(text, '$', '')) - (length(text) - length(replace(text, '\$', ''))) // 2 AS n FROM documents
) WHERE n % 2 = 1
""",
    "q06_glued_words": r"""
WITH m AS (SELECT doc_id, concat_ws(' ', text, lang || repeat('cuavalatrong', (doc_id % 9)::INT), 'x') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!?\[([^\]]*)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', '', 'gi') AS t FROM m),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_-]+')) AS w FROM c)
SELECT c.doc_id, coalesce(bool_or(regexp_full_match(w, '\p{L}{45,}') AND w = replace(lower(w), 'ß', 'ss') AND (length(w) >= 80 OR
  len(list_filter(['cua','va','la','trong','duoc','nhung','mot','cho','voi','viet','nam'], lambda s: contains(w, s))) >= 3)), false) AS glued
FROM c LEFT JOIN w USING (doc_id) GROUP BY c.doc_id
""",
    "q07_html_tag_balance": "SELECT page_id, "
    + ", ".join(rf"len(regexp_extract_all(html, '(?i)<{t}\b')) - len(regexp_extract_all(html, '(?i)</{t}\s*>')) AS open_{t}" for t in ("p", "b", "li", "a", "div", "article"))
    + " FROM pages",
    "q08_page_completeness": """
WITH p AS (SELECT conv_id, turn + 1 AS page, role FROM conversations), t AS (SELECT conv_id, max(page) AS total FROM p GROUP BY 1),
k AS (SELECT conv_id, page, count(*) AS n FROM p WHERE role <> 'assistant' GROUP BY 1, 2),
e AS (SELECT conv_id, unnest(range(1, total + 1)) AS page FROM t),
m AS (SELECT e.conv_id, string_agg(e.page::VARCHAR, ',' ORDER BY e.page) AS missing FROM e ANTI JOIN k ON e.conv_id = k.conv_id AND e.page = k.page GROUP BY 1),
d AS (SELECT conv_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS duplicate FROM k WHERE n > 1 GROUP BY 1)
SELECT c.conv_id, coalesce(missing, '') AS missing, coalesce(duplicate, '') AS duplicate,
  greatest(0, 100 - CASE WHEN missing IS NULL THEN 0 ELSE 100 END - CASE WHEN duplicate IS NULL THEN 0 ELSE 80 END)::DOUBLE AS score, missing IS NULL AND duplicate IS NULL AS passed
FROM (SELECT DISTINCT conv_id FROM k) c LEFT JOIN m USING (conv_id) LEFT JOIN d USING (conv_id)
""",
    "q09_document_assembly": f"""
SELECT conv_id, md5(coalesce(string_agg('<!-- Page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || x, chr(10) || chr(10) ORDER BY turn + 1, x) FILTER (x <> ''), '')) AS digest,
  count(*) AS n_pages, count(*) FILTER (x <> '') AS n_filled
FROM (SELECT conv_id, turn, {_strip("coalesce(text, '')")} AS x FROM conversations) GROUP BY conv_id
""",
    "q10_pipe_table_errors": f"WITH {_PIPES} SELECT o_custkey, CASE WHEN broken THEN 'malformed_markdown_table:1' ELSE '' END AS errors FROM t",
    "q11_table_continuation": """
WITH o AS (SELECT o_custkey, o_orderkey % 3 AS h, o_orderkey % 5 = 0 AS dash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT *, lag(h) OVER w AS ph, lag(dash) OVER w AS pdash FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY n))
SELECT o_custkey, n, CASE WHEN ph IS NULL THEN false WHEN h = 0 THEN ph = 0 WHEN h = 1 THEN true ELSE NOT pdash END AS continues FROM p
""",
    "q12_table_repair": f"""
WITH {_PIPES} SELECT o_custkey, 1::BIGINT AS first, n + 2 AS last, broken, md5(CASE WHEN broken
  THEN '<table><tr><th>key</th><th>status</th></tr>' || cells || '</table>' ELSE '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || body END) AS digest FROM t
""",
    "q13_heading_clamp": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
h AS (SELECT doc_id, ln, ln * ln % 6 + 1 AS level, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM l WHERE trim(line, ' ') <> '')
SELECT doc_id, ln, level, k + min(level - k) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS clamped FROM h
""",
    "q14_fence_parity": """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), 1) AS ln FROM documents WHERE text <> '')
SELECT doc_id, count(*) FILTER (ln % 4 = 0 OR (ln // 4) % 2 = 1) AS n_fenced, count(*) AS n_lines FROM l GROUP BY doc_id
""",
    "q15_page_artifacts": r"""
WITH d AS (
  SELECT conv_id, string_agg('<!-- Page ' || (turn + 1) || ' -->' || chr(10) || text || chr(10) || chr(10) ||
    CASE WHEN turn % 2 = 0 THEN '- ' || (turn + 1) || ' -' ELSE 'Page ' || (turn + 1) END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
), l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
m AS (SELECT *, regexp_full_match(line, '\s*<!--\s*Page\s+\d+\s*-->\s*')::INT AS mk, (trim(line, ' ') <> '')::INT AS sh FROM l),
p AS (SELECT *, sum(mk) OVER (PARTITION BY conv_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS page FROM m),
w AS (
  SELECT *, coalesce(sum(sh) OVER (PARTITION BY conv_id, page ORDER BY ln ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after,
    coalesce(sum(sh - mk) OVER (PARTITION BY conv_id, page ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p
)
SELECT conv_id, count(*) FILTER (mk = 0 AND (regexp_full_match(line, '\s*(?:trang\s+)?\d+\s*/\s*\d+\s*')
  OR (after <= 4 AND regexp_full_match(line, '(?i)\s*(?:trang|page)\s+\d{1,4}(?:\s*/\s*\d{1,4})?\s*'))
  OR ((after <= 4 OR (page > 0 AND before <= 2)) AND regexp_full_match(line, '\s*(?:[-–—~*•\s]+\d{1,4}[-–—~*•\s]+|\[\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*\]|(?:\*\*)?[-–—]?\s*\d{1,4}\s*[-–—]?(?:\*\*)?)\s*')))) AS n_artifacts,
  count(*) AS n_lines FROM w GROUP BY conv_id
""",
    "q16_stitch_pages": r"""
WITH c AS (SELECT conv_id, turn, substring(text, 1, length(text) // 2) || chr(10) || chr(10) || '<!-- Page 2 -->' || chr(10) || chr(10) || substring(text, length(text) // 2 + 1) AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(t, '([^\n.!?:;#\->`|*$\s](?:[^\n.!?:;#`|*$]*[^\n.!?:;#`|*$\s-])?)-?[^\S\n]*\n{1,3}\s*(<!--\s*(?i:page)\s+\d+\s*-->)\n{1,3}\s*(\p{Ll}[^\n]*)', '\1 \2 \3', 'g')) AS digest FROM c
""",
    "q17_column_merge": """
WITH o AS (SELECT o_custkey AS page, floor(o_totalprice % 900)::DOUBLE AS l, floor(o_totalprice % 900)::DOUBLE + o_orderkey % 50 + 20 AS r FROM orders),
m AS (SELECT *, max(r) OVER (PARTITION BY page ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS g FROM m),
s AS (SELECT page, g, min(l) AS left_edge, max(r) AS right_edge FROM i GROUP BY page, g),
x AS (SELECT *, (right_edge + lead(left_edge) OVER (PARTITION BY page ORDER BY g)) / 2 AS mid FROM s)
SELECT page, left_edge, right_edge, CASE WHEN mid - floor(mid) = 0.5 THEN floor(mid) + floor(mid)::BIGINT % 2 ELSE round(mid) END + 2 AS cut FROM x
""",
    "q18_reading_order": f"""
WITH {_BOXES}, f AS (SELECT *, (r - l) >= 0.65 * 1000 AS wide FROM boxes),
n AS (SELECT a.*, (SELECT count(*) FROM f o WHERE o.page = a.page AND o.wide AND o.b <= a.t) AS band FROM f a),
c AS (SELECT *, CASE WHEN wide THEN -1 ELSE floor(l / 180)::BIGINT END AS col FROM n)
SELECT page, id, band, col, row_number() OVER (PARTITION BY page ORDER BY band, col, t, l, id) AS place FROM c
""",
    "q19_overlap_anti_join": f"""
WITH {_BOXES}
SELECT page, id FROM boxes x WHERE f <> 'R' AND NOT EXISTS (
  SELECT 1 FROM boxes y WHERE y.page = x.page AND y.f = 'R'
    AND greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) >= least(0.35 * (x.r - x.l) * (x.b - x.t), 0.65 * (y.r - y.l) * (y.b - y.t)))
""",
    "q20_point_in_segment": f"""
WITH {_BOXES}, p AS (SELECT page, id, (l + r) / 2 AS x, (t + b) / 2 AS y FROM boxes WHERE f = 'A'),
d AS (
  SELECT p.page, p.id, s.id AS seg, greatest(s.l - x, x - s.r, 0) + greatest(s.t - y, y - s.b, 0) AS far, NOT (x BETWEEN s.l AND s.r AND y BETWEEN s.t AND s.b) AS outside
  FROM p LEFT JOIN boxes s ON s.page = p.page AND s.f = 'R'
)
SELECT page, id, coalesce(seg, -1) AS seg FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY outside, far, seg) AS n FROM d) WHERE n = 1
""",
    "q21_exact_dedup": """
SELECT doc_id, lang, digest FROM (SELECT doc_id, lang, sha256(text) AS digest, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""",
    "q22_cer": f"""
WITH {_ALTERED}, c AS (SELECT item_id, e, a, list_sort(list_distinct(string_split(e || a, ''))) AS known FROM n)
SELECT item_id, levenshtein({_as_bytes("string_split(e, '')")}, {_as_bytes("string_split(a, '')")}) / length(e) AS cer FROM c
""",
    "q23_wer": f"""
WITH {_ALTERED}, w AS (SELECT item_id, string_split(e, ' ') AS e, string_split(a, ' ') AS a FROM n), c AS (SELECT *, list_sort(list_distinct(list_concat(e, a))) AS known FROM w)
SELECT item_id, levenshtein({_as_bytes("e")}, {_as_bytes("a")}) / len(e) AS wer FROM c
""",
    "q24_number_f1": """
WITH e AS (SELECT l_orderkey, l_quantity::INT AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey, (l_partkey % 50 + 1)::INT AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_orderkey, sum(least(e.n, a.n)) AS hits FROM e JOIN a USING (l_orderkey, v) GROUP BY 1), s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN hits IS NULL THEN 0.0::DOUBLE ELSE 2 * (hits::DOUBLE / size) * (hits::DOUBLE / size) / (hits::DOUBLE / size + hits::DOUBLE / size) END AS f1 FROM s LEFT JOIN m USING (l_orderkey)
""",
    "q25_structure_f1": """
WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_partkey % 2 = 0) AS e, count(*) FILTER (l_partkey % 3 = 0) AS a FROM lineitem GROUP BY 1),
h AS (SELECT *, least(e, a) + least(n - e, n - a) AS hits FROM c)
SELECT l_orderkey, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE 2 * (hits::DOUBLE / n) * (hits::DOUBLE / n) / (hits::DOUBLE / n + hits::DOUBLE / n) END AS f1 FROM h
""",
    "q26_choose_best": rf"""
WITH {_core("SELECT doc_id, 1 AS attempt, text FROM documents UNION ALL SELECT doc_id, 2, replace(text, '$', '') FROM documents", "doc_id, attempt")},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY empty_page::INT + repetition_loop::INT, empty_page::INT + repetition_loop::INT, 100 - score, -length(regexp_replace(text, '[\s\x{{00A0}}]+', '', 'g')), attempt) AS n FROM codes)
SELECT doc_id, attempt::BIGINT AS attempt, array_to_string(errors, ',') AS errors FROM k WHERE n = 1
""",
    "q27_suspicious_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
m AS (SELECT doc_id, ln, ln % 7 = 0 OR ln % 11 = 0 AS cut, ln % 7 <> 0 AND ln % 11 <> 0 AND ln % 13 = 0 OR regexp_matches(regexp_replace(line, '[-–.]', ' ', 'g'), '\p{L}{45,}') AS glued FROM l)
SELECT doc_id, ln - 1 AS line_idx, array_to_string(list_filter([CASE WHEN glued THEN 'glued_characters' END, CASE WHEN cut THEN 'truncated_line' END], lambda c: c IS NOT NULL), ',') AS reasons, 'high' AS severity
FROM m WHERE cut OR glued
""",
    "q28_review_budget": f"""
WITH {_CANDIDATES}, a AS (SELECT *, reason <> 'possible_missing_printed_footer' AS other FROM c WHERE severity IN ('critical', 'high')),
b AS (SELECT *, row_number() OVER (PARTITION BY page, severity ORDER BY other, line_idx) AS n FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rank, other, line_idx) AS m FROM b WHERE n <= 2 OR NOT other)
SELECT page, line_idx, severity FROM d WHERE m <= 2
""",
    "q29_reread_escalation": f"""
WITH {_CANDIDATES}, t AS (SELECT *, reason NOT IN ('invalid_table_grid', 'possible_missing_printed_footer') AS body FROM c)
SELECT page, count(*) FILTER (body AND severity = 'critical') >= 3 OR count(*) FILTER (body AND severity IN ('critical', 'high')) >= 3
  OR (count(*) FILTER (body) >= 2 AND count(*) FILTER (body) >= 0.2 * 12) OR count(*) FILTER (body AND reason = 'mass_diacritic_loss') >= 2 AS reread
FROM t GROUP BY page
""",
    "q31_lexicon_build": r"""
WITH w AS (SELECT DISTINCT replace(lower(unnest(regexp_extract_all(lower(text), '[a-zA-ZÀ-ỹĐđ]+'))), 'ß', 'ss') AS w FROM documents),
g AS (SELECT strip_accents(replace(w, 'đ', 'd')) AS plain, list(w ORDER BY w) AS forms FROM w GROUP BY 1)
SELECT plain, array_to_string(forms, ',') AS forms FROM g WHERE len(list_filter(forms, lambda f: f <> plain)) > 0
""",
    "q33_blank_response": r"""
WITH c AS (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'The image provided is a blank page.' WHEN 1 THEN '(empty response)' || CASE WHEN conv_id % 2 = 0 THEN ' .' ELSE ' x' END ELSE text END AS t FROM conversations
), p AS (SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(t, '[*_`#>]', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS x FROM c)
SELECT conv_id, turn, x = '' OR trim(x, '()[]{} .:-') IN ('empty response', 'no response', 'no content') OR (length(x) <= 1200
  AND regexp_matches(x, '\b(?:blank page|page (?:is|appears to be) blank|nothing to transcribe)\b') AND regexp_matches(x, '\b(?:provided|uploaded|given|image|transcrib|markdown|instructions?)\b')) AS is_blank FROM p
""",
    "q34_bench_summary": f"""
WITH {_RUNS} SELECT config, bool_or(NOT ok OR oom > 0) AS disqualified, round_even(coalesce(avg(quality) FILTER (ok), 0), 4) AS quality_score_avg, max(vram) AS vram_mb_peak,
  sum(retries)::BIGINT AS retry_total, sum(timeouts)::BIGINT AS timeout_total, sum(oom)::BIGINT AS cuda_oom_total FROM runs GROUP BY config
""",
    "q35_json_reply": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 7 = 0 OR props IS NULL THEN -1 ELSE len(json_keys(props)) END::BIGINT AS n_keys FROM events",
    "q36_quality_rollup": f"""
WITH {_core("SELECT doc_id, text FROM documents", "doc_id")}
SELECT lang, coalesce(quality::VARCHAR, 'all') AS quality, count(*) AS pages, round(avg(score), 6) AS score, sum((len(errors) = 0)::INT)::BIGINT AS passed
FROM codes JOIN documents d USING (doc_id) JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)
""",
    "q39_cold_warm": f"WITH {_RUNS} SELECT config, round(avg(vram) FILTER (run = 1), 6) AS cold, round(avg(vram) FILTER (run > 1), 6) AS warm FROM runs GROUP BY config",
    "q41_progress_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q42_close_tables": """
SELECT o_orderkey, '<table><tr><td>' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '</td></tr>' ELSE '</td>' END || CASE WHEN o_orderkey % 3 = 0 THEN '</table>' ELSE '' END ||
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '</tr>' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '</table>' END END AS text FROM orders
""",
    "q43_fill_slots": """
WITH s AS (SELECT o_custkey AS page, o_orderkey AS slot, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0),
i AS (SELECT o_custkey AS page, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1)
SELECT page, k, coalesce(slot, -1) AS slot, coalesce(item, -1) AS item FROM s FULL JOIN i USING (page, k)
""",
    "q44_block_offsets": f"""
WITH c AS (SELECT conv_id, turn, length({_strip("text")}) AS n FROM conversations),
s AS (SELECT conv_id, turn, n, coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS md_start FROM c WHERE n > 0)
SELECT conv_id, turn, md_start, md_start + n AS md_end FROM s
""",
    "q45_unreferenced_assets": "SELECT o_custkey, 'p' || o_orderkey || '.png' AS name FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0",
    "q46_unaccented_words": r"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-zA-ZÀ-ỹĐđ]+')) AS w FROM documents)
SELECT lang, count(*) AS n, count(DISTINCT w) AS n_words, count(DISTINCT strip_accents(replace(w, 'đ', 'd'))) AS n_plain FROM w GROUP BY lang
""",
    "q37_finalise": """
SELECT o_orderkey, md5('# Order ' || o_orderkey || chr(10) || '## Status ' || o_orderstatus || chr(10) || chr(10) || 'The order was placed by customer ' || o_custkey || chr(10) || chr(10) || '- item goes on here' || chr(10) || chr(10) ||
    '![a](img/' || o_orderkey || '.png)' || chr(10) || chr(10) || 'End of this page is cut in a sen <!-- Page 2 --> tence of it.' || chr(10) || chr(10) ||
    CASE o_orderkey % 3 WHEN 1 THEN '<table><tr><th>key</th><th>status</th></tr><tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td><td>more</td></tr></table>'
      ELSE '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' END) AS digest,
  'headings: 1, headings_split: 1, paragraph_lines_joined: 2, list_lines_joined: 1' || CASE o_orderkey % 3 WHEN 1 THEN ', tables_repaired: 1' WHEN 2 THEN ', tables_converted: 1, html_tags_closed: 3' ELSE '' END
    || ', image_paths: 1, duplicate_images: 1, page_artifacts_removed: 1' AS report
FROM orders
""",
    "q40_full_gate": rf"""
WITH {_core(_DOCS, "doc_id")},
-- Blocks of one to six lines of prose that stand three times in a row. No document holds code, display mathematics or a table.
fit AS (SELECT doc_id, ln, CASE WHEN NOT regexp_matches(line, '^\s*(?:#{{1,6}}\s|[-+*]\s|\d+[.)]\s|>|```|~~~|<!--|<[/A-Za-z]|\||!\[|\$\$)') AND NOT regexp_matches(line, '^\s*[<!|]')
  AND len(regexp_extract_all(line, '\p{{L}}')) >= 15 AND length({_strip("line")}) >= 24 THEN {_FOLD.format(_strip("regexp_replace(line, '[\\s\\x{00A0}]+', ' ', 'g')"))} ELSE '' END AS x FROM raw_lines),
same AS (SELECT doc_id, ln, width, length(x) AS n, x <> '' AND x = lead(x, width) OVER v AND x = lead(x, 2 * width) OVER v AS hit
  FROM fit, (VALUES (1), (2), (3), (4), (5), (6)) t(width) WINDOW v AS (PARTITION BY doc_id, width ORDER BY ln)),
ahead AS (SELECT doc_id, width, k.k AS start, count(*) FILTER (hit) AS hits, sum(n) AS size FROM same, LATERAL (SELECT unnest(range(ln - width + 1, ln + 1)) AS k) k GROUP BY doc_id, width, k.k),
loops AS (SELECT DISTINCT doc_id FROM ahead WHERE hits = width AND size >= CASE WHEN width = 1 THEN 40 ELSE 70 END),
-- Sentences of running prose, and their points for lost marks.
bare AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', '', 'gs'), '`[^`]*`', '', 'g'),
    '\$\$.*?\$\$|\$[^$\n]*\$', '', 'gs'), '!?\[([^\]]*)\]\([^)]+\)', '\1', 'g'), 'https?://\S+|\b\S+@\S+\.\S+\b', '', 'gi'), '<table\b.*?</table>', '', 'gsi') AS t FROM documents
), paras AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array(t, '\n\s*\n'), 1) AS k FROM bare),
kept AS (SELECT doc_id, k, list_filter(list_transform(list_filter(list_transform(string_split(p, chr(10)), lambda y: {_strip("y")}), lambda y: y <> '' AND y NOT LIKE '|%' AND y NOT LIKE '<!--%'), lambda y: regexp_replace(y, '^#{{1,6}}\s+', '')),
  lambda y: length(y) >= 60 AND len(regexp_extract_all(y, '\p{{L}}')) >= 60 AND len(list_filter(regexp_split_to_array(y, '\s+'), lambda z: z <> '')) >= 12 AND y <> upper(y) AND len(regexp_extract_all(y, '\p{{Nd}}')) <= 0.2 * length(y)) AS ls FROM paras),
sents AS (SELECT doc_id, unnest(string_split(regexp_replace({_strip("array_to_string(ls, ' ')")}, '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM kept WHERE len(ls) > 0),
low AS (SELECT doc_id, s, {_FOLD.format("s")} AS l FROM sents WHERE {_strip("s")} <> ''),
split AS (SELECT doc_id, l, regexp_extract_all(l, '[a-zA-ZÀ-ỹĐđ]+') AS w, list_filter(regexp_split_to_array(s, '\s+'), lambda y: y <> '') AS parts FROM low),
signs AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda y: list_contains({_VI}, y))) AS hits, len(list_filter(list_distinct(w), lambda y: list_contains({_VI}, y))) AS kinds,
  list_sum(list_transform({_VI_PHRASES}, lambda y: (length(l) - length(replace(l, y, ''))) / length(y))) AS phrases, len(list_filter(w, lambda y: list_contains({_EN}, y))) AS english,
  len(regexp_extract_all(l, '[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]')) / greatest(len(regexp_extract_all(l, '\p{{L}}')), 1) AS marks,
  len(list_filter(parts, lambda y: regexp_matches(y, '\d|[_/@]'))) / greatest(len(parts), 1) AS technical FROM split),
points AS (SELECT doc_id, CASE WHEN n >= 8 AND hits >= 3 THEN 3 + 2 * (phrases >= 5 OR kinds >= 4)::INT + (n >= 18)::INT + 2 * (marks < 0.02)::INT - 3 * (technical >= 0.15)::INT - 4 * (english >= 4 AND english > hits)::INT ELSE 0 END AS p FROM signs),
loss AS (SELECT doc_id, count(*) FILTER (p >= 7) AS high, count(*) FILTER (p = 6) AS medium, count(*) AS segments FROM points GROUP BY doc_id),
-- Mathematics: single delimiters are those left once runs of them are another sign.
maths AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '\$\$+', chr(1), 'g'), '\$([^$\n\x01]+)\$', 1) AS i FROM documents),
long AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', '', 'gi'), '[\p{{L}}\p{{N}}_-]+')) AS w FROM documents),
glued AS (SELECT DISTINCT doc_id FROM long WHERE regexp_full_match(w, '\p{{L}}{{45,}}') AND w = {_FOLD.format("w")} AND (length(w) >= 80 OR len(list_filter(['cua','va','la','trong','duoc','nhung','mot','cho','voi','viet','nam'], lambda s: contains(w, s))) >= 3)),
ticks AS (SELECT DISTINCT doc_id FROM raw_lines WHERE NOT contains(line, '```') AND len(regexp_extract_all(regexp_replace(line, '``+', '', 'g'), '`')) % 2 = 1),
found AS (
  SELECT c.doc_id, list_filter([CASE WHEN empty_page THEN 'empty_page' END, CASE WHEN unclosed_code_blocks THEN 'unclosed_code_blocks' END, CASE WHEN k.doc_id IS NOT NULL THEN 'unclosed_inline_code' END,
      CASE WHEN repetition_loop OR o.doc_id IS NOT NULL THEN 'repetition_loop' END, CASE WHEN repeated_words THEN 'repeated_words' END, CASE WHEN g.doc_id IS NOT NULL THEN 'glued_words' END,
      CASE WHEN high > 0 THEN 'missing_vietnamese_diacritics' END, CASE WHEN unbalanced_math_delimiters THEN 'unbalanced_math_delimiters' END,
      CASE WHEN regexp_matches(c.text, '\${{1,2}}\s*[A-D]\.\s*\${{1,2}}') THEN 'answer_label_inside_math' END,
      CASE WHEN len(list_filter(i, lambda x: len(regexp_extract_all(x, '(?:^|\s)[A-D]\.\s')) >= 2)) > 0 THEN 'multiple_answers_inside_math' END,
      CASE WHEN len(list_filter(i, lambda x: len(regexp_extract_all(x, '[A-Za-zÀ-ỹĐđ]{{3,}}')) >= 6 AND len(regexp_extract_all(x, '[=+*/^_{{}}\\<>]')) <= 1)) > 0 THEN 'prose_inside_math' END,
      CASE WHEN len(list_filter(i, lambda x: regexp_matches(x, '^\s*(?:[A-D]\.|[.,;:!?-]+)\s*$'))) > 0 THEN 'non_math_math_block' END,
      CASE WHEN len(list_filter(i, lambda x: len(regexp_extract_all(x, '\{{')) <> len(regexp_extract_all(x, '\}}')))) > 0 THEN 'unbalanced_latex_braces' END,
      CASE WHEN len(list_filter(i, lambda x: regexp_matches(x, '\\(?:frac|sqrt)\s*$|\\frac\s*\{{[^{{}}]*\}}\s*$'))) > 0 THEN 'incomplete_latex_command' END,
      CASE WHEN regexp_matches(c.text, '\$\$[^$\n]+\$\$\S|\S\$\$[^$\n]+\$\$') THEN 'display_math_inline' END,
      CASE WHEN regexp_matches(c.text, '\${{1,2}}\s*\${{1,2}}') THEN 'adjacent_math_blocks' END,
      CASE WHEN regexp_matches(c.text, '(?i)(?:image|formula)_placeholder') THEN 'unresolved_placeholder' END], lambda x: x IS NOT NULL) AS e,
    CASE WHEN coalesce(high, 0) = 0 AND medium >= 2 AND medium >= 0.25 * greatest(segments, 1) THEN 'suspected_missing_vietnamese_diacritics' ELSE '' END AS warnings
  FROM core c JOIN maths m USING (doc_id) LEFT JOIN loss USING (doc_id) LEFT JOIN loops o ON o.doc_id = c.doc_id LEFT JOIN glued g ON g.doc_id = c.doc_id LEFT JOIN ticks k ON k.doc_id = c.doc_id
), weighed AS (
  SELECT *, list_transform(e, lambda x: CASE x WHEN 'empty_page' THEN 100 WHEN 'repetition_loop' THEN 50 WHEN 'unresolved_placeholder' THEN 35 WHEN 'unclosed_code_blocks' THEN 25 WHEN 'repeated_words' THEN 20
    WHEN 'unbalanced_latex_braces' THEN 15 WHEN 'incomplete_latex_command' THEN 15 WHEN 'unbalanced_math_delimiters' THEN 15 WHEN 'glued_words' THEN 5 ELSE 10 END) AS w FROM found
)
SELECT doc_id, greatest(0, 100 - coalesce(list_sum(w), 0))::DOUBLE AS score, coalesce(list_sum(w), 0) > 20 OR coalesce(list_max(w), 0) >= 30 OR list_contains(e, 'missing_vietnamese_diacritics') AS should_retry,
  len(e) = 0 AS passed, array_to_string(e, ',') AS errors, warnings FROM weighed
""",
    "q47_span_boxes": """
WITH o AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 10 AS at FROM orders)
SELECT r.o_custkey, r.o_orderkey, coalesce(s.o_orderkey, -1)::DOUBLE AS box
FROM o r LEFT JOIN o s ON s.o_custkey = r.o_custkey AND s.at % 20 = 0 AND r.at >= s.at AND r.at < s.at + 15 AND s.o_orderkey % 7 <> 0 AND s.o_orderkey % 5 <> 0
""",
    "q48_ranked_boxes": f"""
WITH {_REGIONS}, r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 3 <> 0),
c AS (SELECT o_custkey, count(*) AS m FROM g GROUP BY 1),
p AS (SELECT r.o_custkey, o_orderkey, round_even(k / greatest(n - 1, 1) * (m - 1), 0) + 1 AS at FROM r LEFT JOIN c USING (o_custkey))
SELECT p.o_custkey, o_orderkey, coalesce(g.l, -1.0)::DOUBLE AS l, coalesce(g.t, -1.0)::DOUBLE AS t FROM p LEFT JOIN g ON g.o_custkey = p.o_custkey AND g.n = p.at
""",
    "q49_review_boxes": f"""
WITH {_REGIONS}, c AS (SELECT o_custkey, o_orderkey, (o_orderkey * 53 % 600)::DOUBLE AS l, (o_orderkey * 29 % 1100)::DOUBLE AS t FROM orders WHERE o_orderkey % 3 <> 0),
d AS (SELECT c.o_custkey, o_orderkey, g.n, row_number() OVER (PARTITION BY c.o_custkey, o_orderkey ORDER BY abs(c.l - g.l) + abs(c.t - g.t) + abs(c.l + 50 - g.r) + abs(c.t + 20 - g.b), g.n) AS k FROM c JOIN g USING (o_custkey)),
b AS (SELECT d.o_custkey, o_orderkey, min(g.l) AS l, arg_min(g.t, g.n) AS t, max(g.r) AS r, arg_max(g.b, g.n) AS b FROM d JOIN g ON g.o_custkey = d.o_custkey AND g.n BETWEEN d.n - 1 AND d.n + 1 WHERE k = 1 GROUP BY 1, 2)
SELECT o_custkey, o_orderkey, greatest(l::BIGINT - 30, 0) AS l, greatest(t::BIGINT - 30, 0) AS t, least(r::BIGINT + 30, 800) AS r, least(b::BIGINT + 30, 1200) AS b FROM b
""",
    "q50_merge_column_blocks": """
WITH RECURSIVE o AS (
  SELECT o_custkey, row_number() OVER w AS k, (o_orderkey % 4 * 60)::DOUBLE AS l, (o_orderkey * 7 % 40 + row_number() OVER w * 30)::DOUBLE AS t, (o_orderkey % 4 * 60 + 400 + o_orderkey % 90)::DOUBLE AS r,
    (o_orderkey * 7 % 40 + row_number() OVER w * 30 + 25)::DOUBLE AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), m AS (
  SELECT o_custkey, k, 0::BIGINT AS n, l, t, r, b FROM o WHERE k = 1
  UNION ALL
  SELECT o.o_custkey, o.k, m.n + (NOT j)::BIGINT, CASE WHEN j THEN least(o.l, m.l) ELSE o.l END, CASE WHEN j THEN least(o.t, m.t) ELSE o.t END, CASE WHEN j THEN greatest(o.r, m.r) ELSE o.r END, CASE WHEN j THEN greatest(o.b, m.b) ELSE o.b END
  FROM m JOIN o ON o.o_custkey = m.o_custkey AND o.k = m.k + 1, LATERAL (SELECT abs(o.l - m.l) < 100 AND abs(o.r - m.r) < 100 AND o.t >= m.b - 20 AS j)
)
SELECT o_custkey, n, greatest(min(l) - 5, 0) AS l, greatest(min(t) - 5, 0) AS t, least(max(r) + 5, 1000) AS r, least(max(b) + 5, 800) AS b FROM m GROUP BY o_custkey, n
""",
    "q52_link_images": """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 = 0 AS own, list_filter(list_transform(range(o_orderkey % 6), lambda i: 'p' || i || '.png'), lambda p: NOT (o_orderkey % 4 = 0 AND p = 'p0.png')) AS f FROM orders),
i AS (SELECT * FROM o)
SELECT o_orderkey, coalesce('![one](' || f[1] || ')', '') || ' ' || coalesce('![two](' || f[3] || ')', '') || ' ' || coalesce('![Hình ảnh](' || f[4] || ')', '') || ' ' || coalesce('![Hình ảnh](' || f[2] || ')', '') || ' ' || o_orderkey
  || CASE WHEN own THEN ' ![own](p0.png)' ELSE '' END AS text, array_to_string(f[5:], ',') AS remaining FROM i
""",
    "q53_retained_blocks": """
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'text' END AS kind, o_orderkey % 5 AS l, o_orderkey % 7 AS t, o_orderkey % 3 AS r, o_orderkey % 2 AS b FROM orders)
SELECT o_custkey, o_orderkey, kind FROM o WHERE kind = 'text' OR EXISTS (SELECT 1 FROM o a WHERE a.o_custkey = o.o_custkey AND a.kind = 'image' AND a.o_orderkey % 3 = 0 AND (a.l, a.t, a.r, a.b) = (o.l, o.t, o.r, o.b))
""",
    "q54_unsound_pages": f"WITH {_CANDIDATES} SELECT page, line_idx, severity FROM c WHERE page % 3 <> 0 OR reason = 'possible_missing_printed_footer'",
    "q55_nearby_boxes": f"""
WITH {_CANDIDATES}, x AS (SELECT page, line_idx, line_idx % 5 <> 0 AS boxed, page % 50 AS l, line_idx * 40 % 130 AS t, page % 50 + line_idx * 5 + 1 AS r, line_idx * 40 % 130 + 20 AS b FROM c),
y AS (SELECT *, row_number() OVER w AS n, lag(line_idx) OVER w AS i, lag(boxed) OVER w AS pb, lag(l) OVER w AS pl, lag(t) OVER w AS pt, lag(r) OVER w AS pr, lag(b) OVER w AS pe FROM x WINDOW w AS (PARTITION BY page ORDER BY line_idx)),
z AS (SELECT *, n = 2 AND coalesce(CASE WHEN boxed AND pb THEN greatest(0, t - pe, pt - b) <= 80 AND least(r, pr) > greatest(l, pl) ELSE line_idx - i <= 2 END, false) AS joins FROM y)
SELECT page, line_idx, sum((NOT joins)::INT) OVER (PARTITION BY page ORDER BY line_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM z
""",
    "q56_against_truth": f"""
WITH {_ALTERED}, k AS (SELECT item_id, e, a, list_sort(list_distinct(string_split(e || a, ''))) AS known FROM n), c AS (SELECT item_id, levenshtein({_as_bytes("string_split(e, '')")}, {_as_bytes("string_split(a, '')")}) / length(e) AS cer FROM k),
w AS (SELECT item_id, string_split(e, ' ') AS e, string_split(a, ' ') AS a FROM n), v AS (SELECT *, list_sort(list_distinct(list_concat(e, a))) AS known FROM w)
SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN cer ELSE -1 END AS cer, CASE WHEN item_id % 3 <> 0 THEN levenshtein({_as_bytes("e")}, {_as_bytes("a")}) / len(e) ELSE -1 END AS wer FROM v JOIN c USING (item_id)
""",
    "q57_without_blank": f"SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND {_strip("text")} <> ''",
    "q58_fill_formulas": """
WITH o AS (SELECT *, ['$x$', '$' || o_orderkey || '$', '$z$'][:o_orderkey % 4] AS f FROM orders)
SELECT o_orderkey, 'a ' || coalesce(f[1], '') || ' b ' || coalesce(f[2], '') || ' ' || o_orderstatus || coalesce(chr(10) || chr(10) || f[3], chr(10)) AS text FROM o
""",
    "q59_insert_images": """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS blocks, o_orderkey % 4 AS paths, o_orderkey % 3 = 0 AS linked FROM orders),
i AS (SELECT o_orderkey, k, round_even(CASE WHEN 2 * k + 1 < blocks THEN (2 * k + 1) / blocks ELSE 1 END * 4, 0)::INT AS place FROM o, (VALUES (0), (1), (2)) v(k) WHERE k < paths AND NOT (k = 0 AND linked)),
p AS (
  SELECT o_orderkey, p AS place, 1 AS late, 0 AS k, 'p' || p || CASE WHEN p = 1 AND linked THEN ' ![x](i0.png)' ELSE '' END AS t FROM o, (VALUES (0), (1), (2), (3)) v(p)
  UNION ALL SELECT o_orderkey, place, 0, k, '![Hình ảnh](i' || k || '.png)' FROM i
), g AS (SELECT o_orderkey, string_agg(t, chr(10) || chr(10) ORDER BY place, late, k) AS t, bool_or(late = 0) AS any_image FROM p GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN any_image THEN t ELSE replace(t, chr(10) || chr(10) || 'p2', chr(10) || chr(10) || chr(10) || 'p2') END AS text FROM g
""",
    "q30_spelling_suggest": """
WITH w AS (
  SELECT o_orderkey, v[o_orderkey % 7 + 1] AS a, v[o_orderkey // 7 % 7 + 1] AS b, v[o_orderkey // 49 % 7 + 1] AS c, o_orderkey % 3 <> 1 AS near
  FROM orders, (SELECT ['the', 'and', 'of', 'der', 'und', 'The', 'AND'] AS v)
), p AS (SELECT o_orderkey, 0::BIGINT AS k, a AS l, b AS r FROM w WHERE near UNION ALL SELECT o_orderkey, 2, b, c FROM w),
m AS (SELECT * FROM (VALUES ('the', 'and', 'thé', 'ànd'), ('of', 'the', 'ôf', 'thé'), ('der', 'und', 'dér', 'ünd')) v(x, y, nx, ny))
SELECT o_orderkey, k AS "at", l AS "left", r AS "right", nx AS new_left, ny AS new_right FROM p JOIN m ON lower(l) = x AND lower(r) = y WHERE l <> upper(l) AND r <> upper(r)
""",
}
