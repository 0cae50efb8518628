"""DuckDB twins of the driver queries."""

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"
_HEAD = r"""
  (t <> '' AND strlen(t) <= 80 AND NOT ends_with(t, ',') AND NOT ends_with(t, ';') AND (
    regexp_matches(t, '(?i)^([0-9]+(\.[0-9]+)*\.?\s+\S|(chapter|section|part|appendix|article)\s+([0-9]+|[ivxlcdm]+|[a-z])\b)')
    OR (length(regexp_replace(t, '\P{L}', '', 'g')) >= 2 AND regexp_matches(regexp_replace(t, '\P{L}', '', 'g'), '^\p{Lu}+$') AND NOT ends_with(t, '.'))))
"""
_STRIP = r"regexp_replace(regexp_replace(@, '^[\s\p{Z}\x{85}]+', ''), '[\s\p{Z}\x{85}]+$', '')"
_WORDS = r"len(list_filter(regexp_split_to_array(@, '[\s\p{Z}\x{85}]+'), lambda w: w <> ''))"

_TREE = """
home AS (SELECT n_nationkey, n_regionkey FROM nation),
s AS (
  SELECT r_regionkey AS doc, 'r' || r_regionkey AS id, '' AS up, 0 AS ordinal, r_name AS title, 0 AS tok FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, 0 FROM nation
  UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, c_custkey::INT, c_name, (c_custkey % 97)::INT FROM customer JOIN home ON c_nationkey = n_nationkey
)"""
_TREE_ORDERS = _TREE.rstrip(")").rstrip() + """
  UNION ALL SELECT n_regionkey, 'o' || o_orderkey, 'c' || o_custkey, o_orderkey::INT, o_orderpriority, (o_orderkey % 211)::INT
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN home ON c_nationkey = n_nationkey
)"""
_VIEW = """, v AS (
  SELECT doc, id, up, ordinal, title, tok, 0 AS depth, [ordinal] AS path, [id] AS ids FROM s WHERE up = ''
  UNION ALL SELECT s.doc, s.id, s.up, s.ordinal, s.title, s.tok, v.depth + 1, list_append(v.path, s.ordinal), list_append(v.ids, s.id)
  FROM v JOIN s ON s.doc = v.doc AND s.up = v.id
)"""
_SECTIONS = """sec AS (
  SELECT l_orderkey AS doc, l_linenumber AS id, l_linenumber AS ps, l_linenumber + (l_quantity::INT % 3) AS pe, l_quantity::INT AS qty FROM lineitem
)"""
_SCORES = """sc AS (
  SELECT user_id % 50 AS query_id, event_id AS pos, event_type || '-' || (user_id % 7) AS id,
    CASE WHEN event_id % 4 > 0 THEN round(value / 1000, 3) END AS confidence FROM events
)"""

ORACLE: dict[str, str] = {
    "approx_tokens": f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest({_WORDS.replace('@', 'text')} * 13 // 10, strlen(text) // 4, 1) END::BIGINT AS tokens, strlen(text)::BIGINT AS n_bytes FROM documents",
    "fallback_summary": rf"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN strlen(text) > 240 THEN left(text, list_max(list_filter(range(60, 241), lambda k: strlen(left(text, k)) <= 240))) || '…' ELSE text END AS head FROM documents)
SELECT doc_id, CASE WHEN {_STRIP.replace('@', 'text')} = '' THEN source ELSE array_to_string(list_filter(regexp_split_to_array(head, '[\s\p{{Z}}\x{{85}}]+'), lambda w: w <> ''), ' ') END AS summary FROM d""",
    "text_headings": f"SELECT doc_id, pos::BIGINT AS pos, t AS heading FROM (SELECT *, {_STRIP.replace('@', 'line')} AS t FROM ({_LINES})) WHERE {_HEAD}",
    "text_sections": rf"""
WITH l AS (SELECT doc_id, pos, regexp_replace(line, '\r+$', '') AS line FROM ({_LINES})),
h AS (SELECT *, {_STRIP.replace('@', 'line')} AS t FROM l), k AS (SELECT *, {_HEAD} AS head FROM h),
q AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM k),
p AS (SELECT doc_id, seq, max(CASE WHEN head THEN 1 ELSE 0 END) AS level, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM q GROUP BY ALL)
SELECT doc_id, seq::BIGINT AS seq, level::BIGINT AS level, length({_STRIP.replace('@', 'body')})::BIGINT AS n_content FROM p""",
    "boilerplate_lines": rf"""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower(line) AS t FROM ({_LINES})) WHERE
  contains(t, 'hereby grants permission') OR contains(t, 'provided proper attribution is provided') OR contains(t, 'solely for use in journalistic')
  OR contains(t, 'all rights reserved') OR contains(t, 'is licensed under a creative commons') OR contains(t, 'licensed under cc by')
  OR contains(t, 'this work is licensed under') OR contains(t, 'permission to make digital or hard copies') OR contains(t, 'copyright held by the owner')
  OR contains(t, 'preprint. under review') OR contains(t, 'preprint submitted to') OR regexp_matches(trim(t), '^arxiv:[0-9]')
  OR ({_WORDS.replace('@', 't')} <= 4 AND (contains(t, 'scholarly works') OR contains(t, 'journalistic or') OR contains(t, 'or scholarly')))
GROUP BY doc_id""",
    "mojibake_titles": """
WITH c AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g') AS s FROM part),
n AS (SELECT p_partkey, length(replace(s, ' ', '')) AS n, len(list_filter(range(1, length(s)), lambda i: s[i] = s[i + 1] AND s[i] <> ' ')) AS d FROM c)
SELECT p_partkey, n < 4 OR d * 100 // n > 30 AS bad FROM n""",
    "letter_spacing": """
WITH s AS (SELECT n_nationkey, upper(array_to_string(string_split(n_name, ''), ' ')) AS s FROM nation)
SELECT n_nationkey, CASE WHEN length(replace(s, ' ', '')) >= 4 THEN array_to_string(list_transform(regexp_split_to_array(s, '\\s{2,}'), lambda g: replace(g, ' ', '')), ' ') ELSE s END AS joined FROM s""",
    "match_keys": r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || '  - ' || c_mktsegment), '[^a-z0-9 \t\n]', '', 'g'), '[ \t\n]+', ' ', 'g')) AS k FROM customer",
    "table_grids": r"SELECT n_regionkey, '| key | na\|me |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS grid FROM nation GROUP BY 1",
    "list_documents_page": """
SELECT o_orderkey AS id, o_orderpriority AS org_id, o_orderstatus AS status FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
    "count_sections_scoped": "SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1",
    "list_sections_scoped": f"WITH {_SECTIONS} SELECT doc AS document_id, id, ps AS page_start, pe AS page_end FROM sec JOIN orders ON doc = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'",
    "ingest_dedupe": """
WITH e AS (SELECT event_id AS id, user_id AS org_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS k, ts FROM events)
SELECT id, org_id, k AS idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY org_id, k ORDER BY ts, id) AS n FROM e) WHERE k IS NULL OR n = 1""",
    "upsert_latest": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS n, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events)
SELECT user_id AS id, event_type AS status, event_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM r WHERE n = 1""",
    "delete_cascade": "SELECT l_orderkey AS document_id, count(*) AS n, o_orderstatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL",
    "patch_status": "SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01') THEN 'L' ELSE o_orderstatus END AS status FROM orders",
    "tree_view": f"""
WITH RECURSIVE {_TREE_ORDERS}{_VIEW}
SELECT doc AS document_id, id, depth AS view_depth, array_to_string(path, '.') AS path, row_number() OVER (PARTITION BY doc ORDER BY path, id) AS preorder FROM v""",
    "tree_rollup": f"""
WITH RECURSIVE {_TREE_ORDERS}{_VIEW}
SELECT doc AS document_id, a AS id, sum(tok)::BIGINT AS tokens, count(*) AS sections FROM (SELECT doc, tok, unnest(ids) AS a FROM v) GROUP BY ALL""",
    "leaf_token_sum": f"WITH {_TREE_ORDERS} SELECT doc AS document_id, sum(tok)::BIGINT AS leaf_tokens, count(*) AS leaves FROM s WHERE NOT EXISTS (SELECT 1 FROM s k WHERE k.doc = s.doc AND k.up = s.id) GROUP BY 1",
    "tree_children": f"WITH {_TREE} SELECT doc AS document_id, up AS id, string_agg(id, ',' ORDER BY ordinal) AS children FROM s WHERE up <> '' GROUP BY ALL",
    "compact_tree": f"WITH {_TREE} SELECT doc AS document_id, id, tok AS token_count FROM s WHERE EXISTS (SELECT 1 FROM s k WHERE k.doc = s.doc AND k.up = s.id) OR tok >= 50",
    "llms_txt": """
SELECT n_regionkey AS document_id, '# ' || r_name || chr(10) || string_agg(chr(10) || '## ' || n_name || chr(10) || 'nation ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) AS llms_txt
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name""",
    "page_overlap": f"""
WITH {_SECTIONS}, r AS (SELECT o_orderkey AS doc, o_orderkey % 5 AS s, o_orderkey % 5 + o_custkey % 3 AS e FROM orders)
SELECT sec.doc AS document_id, id FROM sec JOIN r ON sec.doc = r.doc WHERE s > 0 AND e > 0 AND ps <= e AND s <= pe""",
    "heading_paths": f"""
WITH {_SECTIONS}, t AS (SELECT doc, id AS seq, qty % 3 AS depth, ps AS s, ps + qty % 5 AS e, 'Line ' || id AS path FROM sec),
m AS (SELECT sec.doc, sec.id, path, row_number() OVER (PARTITION BY sec.doc, sec.id ORDER BY (s <= ps AND pe <= e) DESC, depth DESC, least(pe, e) - greatest(ps, s) DESC, e - s, s, seq) AS n
  FROM sec JOIN t ON sec.doc = t.doc AND ps <= e AND s <= pe)
SELECT doc AS document_id, id, path FROM m WHERE n = 1""",
    "cited_top_k": """
WITH r AS (SELECT user_id AS query_id, event_id AS pos, (event_id % 9)::INT AS s, (event_id % 7)::INT AS e, round(value % 1, 2) AS c FROM events),
a AS (SELECT *, CASE WHEN s <= 0 THEN 1 ELSE s END AS s1 FROM r WHERE s > 0 OR e > 0), b AS (SELECT *, CASE WHEN e <= 0 THEN s1 ELSE e END AS e1 FROM a),
g AS (SELECT query_id, least(s1, e1) AS lo, least(greatest(s1, e1), 6) AS hi, max(c) AS c, min(pos) AS pos FROM b WHERE least(s1, e1) <= 6 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, pos) AS n FROM g)
SELECT query_id, lo AS start, hi AS "end", c AS confidence FROM n WHERE n <= 3""",
    "page_budget_clip": f"""
WITH a AS (SELECT *, coalesce(sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM ({_LINES})),
c AS (SELECT doc_id, CASE WHEN strlen(line) <= 500 - spot THEN length(line) ELSE list_max(list_filter(range(0, 501), lambda k: k <= length(line) AND strlen(left(line, k)) <= 500 - spot)) END AS n FROM a WHERE spot <= 500)
SELECT doc_id AS document_id, sum(n)::BIGINT AS n, count(*) AS used FROM c GROUP BY 1""",
    "propagate_pages": f"""
WITH RECURSIVE {_TREE}{_VIEW}, o AS (SELECT doc, nullif(tok % 13, 0) AS ps, nullif(tok % 13 + tok % 3, 0) AS pe, unnest(ids) AS a FROM v)
SELECT doc AS document_id, a AS id, coalesce(min(ps), 0) AS page_start, coalesce(max(pe), 0) AS page_end FROM o GROUP BY ALL""",
    "page_texts": f"WITH {_SECTIONS} SELECT doc AS document_id, ps AS page_number, string_agg('Line ' || id || chr(10) || qty, chr(10) ORDER BY id, qty::VARCHAR) AS text FROM sec GROUP BY ALL",
    "union_merge": f"WITH {_SCORES} SELECT query_id, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT query_id, id FROM sc) GROUP BY 1",
    "max_confidence": f"WITH {_SCORES} SELECT query_id, id, max(confidence) AS confidence FROM sc WHERE confidence IS NOT NULL GROUP BY ALL",
    "ordered_union": f"""
WITH {_SCORES}, f AS (SELECT query_id, id, min(struct_pack(a := pos % 3, b := pos)) AS f FROM sc GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank FROM f""",
    "rerank_top_k": f"""
WITH {_SCORES}, c AS (SELECT query_id, id, min(pos) AS pos FROM sc GROUP BY ALL),
g AS (SELECT query_id, id, arg_min(confidence, pos) AS score FROM sc WHERE confidence IS NOT NULL AND pos % 3 = 0 GROUP BY ALL),
r AS (SELECT query_id, id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score IS NOT NULL DESC, score DESC, pos) AS rank FROM c LEFT JOIN g USING (query_id, id))
SELECT * FROM r WHERE rank <= 5""",
    "abstain": f"WITH {_SCORES} SELECT pos % 500 AS query_id, coalesce(max(confidence) < 0.4, false) AS abstain FROM sc GROUP BY 1",
    "dedupe_questions": r"""
SELECT conv_id, least(count(DISTINCT lower(trim(text, ' ' || chr(10) || chr(9) || chr(13)))) FILTER (trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''), 5)::BIGINT AS n FROM conversations WHERE role = 'user' GROUP BY 1""",
    "trace_token": "SELECT l_orderkey, sha256(l_orderkey || chr(0) || '1' || chr(0) || 'm' || chr(0) || 'v1' || chr(0) || string_agg(l_partkey::VARCHAR, chr(0) ORDER BY l_partkey::VARCHAR)) AS token FROM lineitem GROUP BY 1",
    "cache_key": "SELECT o_orderkey, sha256(o_orderkey || chr(0) || o_orderpriority || chr(0) || 'auto' || chr(0) || o_orderstatus) AS key FROM orders",
    "outline_lines": f"WITH RECURSIVE {_TREE}{_VIEW} SELECT doc AS document_id, id, repeat('  ', depth) || '- [' || id || '] ' || title || ' — ' || tok || chr(10) AS line FROM v",
    "selection_prompt": f"""
WITH RECURSIVE {_TREE}{_VIEW}, o AS (SELECT doc, string_agg(repeat('  ', depth) || '- [' || id || '] ' || title || chr(10), '' ORDER BY path, id) AS t FROM v GROUP BY 1)
SELECT doc AS document_id, 'Document: x' || chr(10) || chr(10) || 'Sections:' || chr(10) || t || chr(10) || 'Question: which?' || chr(10) || chr(10)
  || 'Reply with one JSON object: {{"picks": [{{"id": "...", "confidence": 0.0}}]}}. Use only ids shown in brackets.' AS prompt FROM o""",
}
