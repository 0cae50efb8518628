"""DuckDB twins of the driver queries' second part."""

from foliant.plans.oracle import _HEAD, _LINES as _TEXT_LINES, _SCORES, _STRIP, _TREE, _TREE_ORDERS, _VIEW, _WORDS

_TYPES = "['Text/Markdown; charset=utf-8', ' text/html', 'application/PDF ;q=1', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/csv', 'image/png'][event_id % 6 + 1]"
_NAMES = "['a.MD', 'b.tar.markdown', 'c/d.txt', 'e.htm', 'x.y/f', 'g.PDF', 'h.docx'][event_id % 7 + 1]"
_SQUEEZE = r"array_to_string(list_filter(regexp_split_to_array(@, '[\s\p{Z}\x{85}]+'), lambda w: w <> ''), ' ')"
_EV = "e AS (SELECT event_id AS e, user_id AS u, event_type, round(value, 2) AS value FROM events)"
_LINES = """
ln AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_quantity::INT AS q,
  ['AIR', 'RAIL', 'SHIP', 'TRUCK', 'MAIL', 'RAIL X'][l_partkey % 6 + 1] AS mode, l_returnflag AS flag, l_partkey AS part FROM lineitem)"""
_TOC = _LINES + """,
f AS (SELECT doc::VARCHAR AS doc, n, q FROM ln),
k AS (SELECT doc, n, CASE WHEN n = 1 THEN 1 ELSE n + q % 4 END AS start_page, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS seq FROM f WHERE n = 1 OR q % 11 <> 0)"""
_NUMBERED = _LINES + """,
t AS (SELECT doc, n, CASE WHEN q % 5 = 0 THEN 0 ELSE n + q % 3 END AS s, CASE WHEN n = 1 AND q % 2 = 0 THEN 9 ELSE 0 END AS e, CASE WHEN q % 7 <> 0 THEN 'L' || n END AS title FROM ln)"""
_CITED = _LINES + """,
c AS (SELECT doc, n AS q, part % 4 + 1 AS s, part % 4 + 2 AS e FROM ln WHERE n <= 2)"""
_ROWS = _LINES + """,
r AS (SELECT (doc % 200)::VARCHAR AS doc, doc AS page, n, q, mode, flag, CASE WHEN n = 1 THEN 20.0 WHEN q % 9 = 0 THEN 15.0 ELSE 10.0 END AS s FROM ln)"""

_PARTS = rf"""
l AS (SELECT doc_id, pos, regexp_replace(line, '\r+$', '') AS line FROM ({_TEXT_LINES})),
h AS (SELECT *, {_STRIP.replace('@', 'line')} AS t FROM l), k AS (SELECT *, {_HEAD} AS head FROM h),
q AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM k),
p0 AS (SELECT doc_id, seq, max(CASE WHEN head THEN t END) AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM q GROUP BY ALL),
p1 AS (SELECT doc_id, seq, coalesce(heading, 'Introduction') AS title, heading IS NULL AS intro, regexp_replace({_STRIP.replace('@', 'body')}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS body, count(*) OVER (PARTITION BY doc_id) AS parts FROM p0),
p2 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1)::INT AS ordinal FROM p1 WHERE NOT (intro AND body = '' AND parts > 1)),
sc AS (SELECT *, doc_id::VARCHAR AS doc, 'sec_' || left(sha256(doc_id || '/' || ordinal), 32) AS id FROM p2)"""

ORACLE: dict[str, str] = {
    "text_tree": f"""
WITH {_PARTS}
SELECT id, doc AS document_id, NULL::VARCHAR AS parent_id, ordinal, 0 AS depth, title, CASE WHEN body = '' THEN '' ELSE 'documents/' || doc || '/sections/' || id || '.txt' END AS content_ref,
  (CASE WHEN body = '' THEN 0 ELSE greatest({_WORDS.replace('@', 'body')} * 13 // 10, strlen(body) // 4, 1) END)::INT AS token_count, NULL::INT AS page_start, NULL::INT AS page_end FROM sc""",
    "lexical_select": rf"""
WITH {_PARTS},
s1 AS (SELECT *, CASE WHEN strlen(body) > 240 THEN left(body, list_max(list_filter(range(60, 241), lambda k: strlen(left(body, k)) <= 240))) || '…' ELSE body END AS head FROM sc),
s2 AS (SELECT *, lower(title || ' ' || {_SQUEEZE.replace('@', 'head')}) AS said FROM s1),
s3 AS (SELECT *, len(list_intersect(['the', 'introduction', 'of', 'this', 'and', 'that'], regexp_extract_all(said, '[\p{{L}}\p{{N}}_]+'))) AS n FROM s2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, ordinal) AS place FROM s3 WHERE n > 0),
g AS (SELECT doc, list(id ORDER BY place) AS ids, string_agg(id, chr(0) ORDER BY id) AS sorted, round(max(n) / 6.0::DOUBLE, 4) AS confidence FROM r WHERE place <= 3 GROUP BY 1)
SELECT 'q1' AS query_id, doc_id::VARCHAR AS document_id, array_to_string(coalesce(ids, []), ',') AS section_ids, confidence, false AS abstained,
  sha256(doc_id || chr(0) || '1' || chr(0) || 'none' || chr(0) || 'v1' || chr(0) || coalesce(sorted, '')) AS trace_token FROM documents LEFT JOIN g ON doc = doc_id::VARCHAR""",
    "content_types": f"""
WITH e AS (SELECT event_id, {_TYPES} AS ct, {_NAMES} AS name FROM events), x AS (SELECT event_id, trim(lower(split_part(ct, ';', 1))) AS type, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS extension FROM e)
SELECT event_id, type, extension, CASE WHEN extension IN ('.md', '.markdown') THEN 'text/markdown' WHEN extension = '.txt' THEN 'text/plain' WHEN extension = '.htm' THEN 'text/html'
  WHEN extension = '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS guess,
  CASE type WHEN 'text/markdown' THEN 'markdown' WHEN 'text/html' THEN 'html' WHEN 'application/pdf' THEN 'pdf' WHEN 'text/csv' THEN 'text' WHEN 'image/png' THEN 'file' ELSE 'docx' END AS kind FROM x""",
    "page_table_grids": r"""
WITH w AS (SELECT n_regionkey, CASE WHEN max((n_nationkey % 3 = 0)::INT) = 1 THEN 3 ELSE 2 END AS w FROM nation GROUP BY 1),
l AS (SELECT n_regionkey, n_nationkey, w, '| ' || n_nationkey || ' | ' || n_name || CASE WHEN w = 2 THEN '' WHEN n_nationkey % 3 = 0 THEN ' | a&#124;b' ELSE ' | ' END || ' |' AS line FROM nation JOIN w USING (n_regionkey) WHERE n_nationkey % 3 < 2),
o AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM l)
SELECT n_regionkey, string_agg(line || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', w) ELSE '' END, chr(10) ORDER BY k) AS grid, count(*) AS n_rows FROM o GROUP BY 1""",
    "clean_texts": f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, text, list_filter(list_transform(lines, lambda x: {_SQUEEZE.replace('@', 'x')}), lambda x: x <> '') AS p, list_filter(list_transform(lines, lambda x: {_STRIP.replace('@', 'x')}), lambda x: x <> '') AS s FROM d)
SELECT doc_id, length(array_to_string(p, chr(10) || chr(10)))::BIGINT AS n_clean, coalesce(s[1], '') AS line, md5(lower({_SQUEEZE.replace('@', 'text')})) AS title_md5 FROM c""",
    "page_tokens": f"""
WITH {_LINES}, p AS (SELECT DISTINCT doc, 'p:' || n || CASE WHEN q % 2 = 1 THEN '-' || (n + 1) ELSE '' END AS id FROM ln)
SELECT doc, sha256(doc || chr(0) || '1-pages' || chr(0) || 'treewalk:m' || chr(0) || 'v1' || chr(0) || string_agg(id, chr(0) ORDER BY id)) AS token FROM p GROUP BY 1""",
    "keys_and_ids": """
WITH o AS (SELECT o_orderkey, 'sec_' || left(sha256(o_orderkey || '/' || o_custkey || '.2'), 32) AS section FROM orders)
SELECT o_orderkey, section, 'documents/' || o_orderkey || '/sections/' || section || '.txt' AS key, 'documents/' || o_orderkey || '/source.pdf' AS source FROM o""",
    "selection_replies": f"""
WITH {_EV} SELECT e AS event_id, CASE e % 4 WHEN 0 THEN 's' || u || ',t' WHEN 1 THEN 'a' || e || ',b' WHEN 3 THEN '' END AS ids,
  CASE WHEN e % 4 = 0 THEN least(1.0, greatest(0.0, round(value / 50, 3))) END AS first, e % 4 = 2 AS unread FROM e""",
    "section_actions": f"""
WITH {_EV} SELECT e AS event_id, ['outline', 'expand', 'done', NULL][e % 4 + 1] AS action, CASE e % 4 WHEN 0 THEN u WHEN 3 THEN NULL ELSE 0 END::BIGINT AS level,
  CASE e % 4 WHEN 1 THEN 's' || u WHEN 3 THEN NULL ELSE '' END AS id, CASE e % 4 WHEN 2 THEN 'a' || u || ',b' WHEN 3 THEN NULL ELSE '' END AS ids FROM e""",
    "page_actions": f"""
WITH {_EV} SELECT e AS event_id, ['get_pages', 'read', 'done'][e % 3 + 1] AS action, (CASE e % 3 WHEN 0 THEN e % 9 + 1 WHEN 1 THEN e % 5 + 2 ELSE 0 END)::BIGINT AS first,
  (CASE e % 3 WHEN 0 THEN e % 9 + 3 WHEN 1 THEN e % 5 + 2 ELSE 0 END)::BIGINT AS last, CASE WHEN e % 3 = 2 THEN 'x' || e ELSE '' END AS answer,
  CASE WHEN e % 3 = 2 THEN least(1.0, greatest(0.0, round(value / 100, 3))) ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN e % 3 = 2 THEN '1-' || (e % 7 + 1) || ',4-4,2-2' ELSE '' END AS cited FROM e""",
    "rerank_replies": f"""
WITH {_EV} SELECT e AS event_id, 'a' || e AS id, greatest(0.0, round(value - 50, 2))::DOUBLE AS score FROM e WHERE e % 5 > 0 UNION ALL SELECT e, 'b', 7.0::DOUBLE FROM e WHERE e % 5 > 0""",
    "plan_replies": f"""
WITH {_EV} SELECT e AS event_id, event_type AS intent, 'x' || u AS entities, e % 2 = 0 AS is_multi_hop, CASE WHEN e % 2 = 0 THEN 'who ' || e ELSE '' END AS subs FROM e""",
    "axes_replies": f"WITH {_EV} SELECT e AS event_id, 'a' || e || ',b,c,d' AS topics, '1' AS numbers, 'two words ' || event_type AS one_line, 'Who' || e || '?,What?' AS questions FROM e",
    "toc_replies": f"WITH {_EV} SELECT e AS event_id, '1.' || (e % 4) AS structure, 'T' || e AS title, (e % 30)::BIGINT AS page, 2::BIGINT AS depth, e % 3 = 0 AS yes FROM e",
    "toc_assemble": f"""
WITH {_TOC} SELECT doc AS document_id, seq::BIGINT AS toc_seq, CASE WHEN n > 1 THEN 0 END::BIGINT AS parent_seq, (n > 1)::BIGINT AS depth, CASE WHEN n = 1 THEN '1' ELSE '1.' || n END AS structure,
  'Line ' || n AS title, start_page::BIGINT AS start_page, 'toc_1' || CASE WHEN n > 1 THEN '_1.' || n ELSE '' END AS node_id FROM k""",
    "toc_end_pages": f"""
WITH {_TOC}, a AS (SELECT k.doc, k.seq, k.n, k.start_page, (SELECT arg_min(b.start_page, b.seq) FROM k b WHERE b.doc = k.doc AND k.n > 1 AND b.n > 1 AND b.seq > k.seq AND b.start_page > k.start_page) AS after FROM k),
z AS (SELECT *, coalesce(after - 1, 12) AS fin FROM a)
SELECT doc AS document_id, seq::BIGINT AS toc_seq, start_page::BIGINT AS start_page, (CASE WHEN fin >= start_page THEN fin ELSE 0 END)::BIGINT AS end_page FROM z""",
    "toc_ends": f"""
WITH {_NUMBERED}, x AS (SELECT *, (SELECT arg_min(b.s, b.n) FROM t b WHERE b.doc = t.doc AND t.n > 1 AND b.n > t.n AND b.s > 0) AS nxt FROM t),
o AS (SELECT doc, n, s, CASE WHEN e > 0 THEN e WHEN nxt IS NOT NULL THEN greatest(nxt - 1, s) END AS own FROM x), top AS (SELECT doc, coalesce(own, s) AS up FROM o WHERE n = 1)
SELECT doc AS document_id, n::BIGINT AS toc_seq, coalesce(own, CASE WHEN n > 1 AND up > 0 THEN up END, s)::BIGINT AS end_page FROM o JOIN top USING (doc)""",
    "toc_paths": f"WITH {_NUMBERED} SELECT t.doc AS document_id, t.n::BIGINT AS toc_seq, array_to_string(list_filter([CASE WHEN t.n > 1 THEN p.title END, t.title], lambda x: x IS NOT NULL), '/') AS path FROM t JOIN t p ON p.doc = t.doc AND p.n = 1",
    "citation_sources": f"""
WITH {_CITED}, o AS (SELECT doc, q FROM c WHERE s % 2 = 0)
SELECT DISTINCT doc AS document_id, q::BIGINT AS query_id, s::BIGINT AS start, (CASE WHEN s % 2 = 0 THEN e ELSE e + 1 END)::BIGINT AS "end" FROM c""",
    "citations": f"""
WITH {_CITED}, sec AS (SELECT doc, n AS id, n AS ps, n + q % 3 AS pe, q AS qty FROM ln), m AS (SELECT c.doc, c.q, c.s, c.e, sec.* EXCLUDE (doc) FROM c JOIN sec ON c.doc = sec.doc AND ps <= c.e AND c.s <= pe)
SELECT doc AS document_id, q::BIGINT AS query_id, s::BIGINT AS start, e::BIGINT AS "end", string_agg(id::VARCHAR, ',' ORDER BY ps, pe, id) AS ids,
  (list(CASE WHEN qty % 2 = 0 THEN 'Line ' || id END ORDER BY ps, pe, id))[1] AS path FROM m GROUP BY ALL""",
    "indexed_pages": f"""
WITH {_LINES}, p AS (SELECT doc, n, '<physical_index_' || n || '>' || chr(10) || mode || chr(10) || '</physical_index_' || n || '>' || chr(10) AS piece FROM ln),
s AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc ORDER BY n) AS upto FROM p)
SELECT doc AS document_id, string_agg(piece, '' ORDER BY n) AS text FROM s WHERE upto <= 200 GROUP BY 1""",
    "title_matches": f"""
WITH {_LINES} SELECT o_orderkey AS document_id, (CASE WHEN mode LIKE 'RAIL%' THEN o_custkey % 3 + 1 ELSE 0 END)::BIGINT AS start_page FROM orders LEFT JOIN ln ON doc = o_orderkey AND n = o_custkey % 3 + 1""",
    "known_ids": """
WITH h AS (SELECT DISTINCT event_id % 6 AS d, event_id % 17 AS i FROM events)
SELECT user_id % 40 AS query_id, event_id % 6 AS document_id, min(event_id) AS pos, 's' || (event_id % 29) AS id FROM events WHERE EXISTS (SELECT 1 FROM h WHERE d = event_id % 6 AND i = event_id % 29) GROUP BY 1, 2, 4""",
    "kept_confidences": f"""
WITH {_SCORES}, b AS (SELECT query_id, id, least(1.0, greatest(0.0, max(confidence) * 3)) AS c FROM sc WHERE confidence IS NOT NULL GROUP BY ALL), q AS (SELECT DISTINCT query_id FROM b)
SELECT q.query_id, id, c AS confidence FROM q LEFT JOIN b ON b.query_id = q.query_id AND id IN ('click-0', 'click-1', 'click-2', 'click-3')""",
    "composite_ids": "SELECT o_custkey, string_agg(DISTINCT o_custkey || ':' || o_orderstatus, ',' ORDER BY o_custkey || ':' || o_orderstatus) AS ids FROM orders GROUP BY 1",
    "usage_sum": """
SELECT event_type, sum(event_id)::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens, sum(event_id + user_id)::BIGINT AS total_tokens, sum((event_id % 8) / 8.0::DOUBLE) AS cost_usd, count(*) AS llm_calls, 25.0::DOUBLE AS hit_rate FROM events GROUP BY 1""",
    "fan_out": "SELECT user_id AS query_id, count(*) AS documents, count(*) FILTER (event_id % 3 = 0 AND user_id % 5 > 0) AS succeeded, count(*) FILTER (event_id % 3 = 0 AND user_id % 5 > 0) = 0 AS failed FROM events GROUP BY 1",
    "trimmed_lists": "SELECT c_custkey, c_name || ',' || c_mktsegment AS kept FROM customer",
    "response_rows": """
SELECT c_custkey, '{' || array_to_string(list_filter([CASE WHEN c_custkey <> 0 THEN '"id":' || c_custkey END, CASE WHEN c_custkey % 3 > 0 THEN '"size":' || (c_custkey % 3) END,
  CASE WHEN c_custkey % 2 = 0 THEN '"title":"' || c_mktsegment || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS json FROM customer""",
    "first_of_each": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
    "missing_summaries": "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1",
    "patch_summaries": """
WITH o AS (SELECT o_custkey, CASE WHEN count(*) > 10 THEN max(o_orderpriority) END AS s, min(o_orderstatus) AS q FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(s, c_name) AS summary, coalesce(q, c_mktsegment) AS candidate_questions FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "ingest_into_existing": """
WITH e AS (SELECT event_id AS id, user_id AS org_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS k, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY org_id, k ORDER BY ts, id) AS n FROM e WHERE id % 2 = 0)
SELECT id, org_id, k AS idempotency_key FROM n WHERE k IS NULL OR (n = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.id % 2 = 1 AND e.org_id = n.org_id AND e.k = n.k))""",
    "tree_totals": f"WITH {_TREE} SELECT doc AS document_id, count(*) AS sections, sum(tok)::BIGINT AS tokens, bool_or(tok % 2 > 0) AS has_pages FROM s GROUP BY 1",
    "merged_chains": f"""
WITH RECURSIVE {_TREE_ORDERS}{_VIEW}, k AS (SELECT doc, up AS id, count(*) AS kids FROM s GROUP BY ALL), m AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN k USING (doc, id))
SELECT m.doc AS document_id, m.id, CASE WHEN p.kids = 1 THEN p.up ELSE m.up END AS parent_id, CASE WHEN p.kids = 1 THEN p.title || ' > ' || m.title ELSE m.title END AS title,
  (m.tok + CASE WHEN p.kids = 1 THEN p.tok ELSE 0 END)::BIGINT AS token_count, (CASE WHEN p.kids = 1 THEN p.ordinal ELSE m.ordinal END)::BIGINT AS ordinal, (CASE WHEN p.kids = 1 THEN p.depth ELSE m.depth END)::BIGINT AS depth
FROM m LEFT JOIN m p ON p.doc = m.doc AND p.id = m.up WHERE m.kids <> 1""",
    "compact_depth": f"""
WITH RECURSIVE {_TREE}{_VIEW}, n AS (SELECT doc, ids[2] AS id, sum(tok) AS t FROM v WHERE depth >= 1 GROUP BY ALL)
SELECT doc AS document_id, id, tok::BIGINT AS token_count FROM v WHERE depth = 0 UNION ALL SELECT doc, id, t::BIGINT FROM n WHERE t >= 50""",
    "heading_levels": f"""
WITH {_ROWS}, h AS (SELECT doc, s, count(*) AS c FROM r GROUP BY ALL), u AS (SELECT doc, s, sum(c) OVER (PARTITION BY doc ORDER BY s) AS upto, sum(c) OVER (PARTITION BY doc) AS total FROM h),
m AS (SELECT doc, min(s) AS median FROM u WHERE upto >= total // 2 + 1 GROUP BY 1), l AS (SELECT h.doc, s, row_number() OVER (PARTITION BY h.doc ORDER BY s DESC) AS lv FROM h JOIN m ON m.doc = h.doc WHERE s > median * 1.2),
d AS (SELECT doc, max(lv) AS deepest FROM l GROUP BY 1)
SELECT r.doc AS document_id, page::BIGINT AS page, n::BIGINT AS row, coalesce(lv, CASE WHEN q % 6 = 0 AND r.s >= median THEN least(coalesce(deepest, 0) + 1, 6) + CASE WHEN q % 4 = 0 THEN 1 ELSE 0 END END, 0)::BIGINT AS level
FROM r JOIN m ON m.doc = r.doc LEFT JOIN d ON d.doc = r.doc LEFT JOIN l ON l.doc = r.doc AND l.s = r.s""",
    "page_parts": f"""
WITH {_ROWS}, t AS (SELECT doc, page, n, CASE WHEN q % 4 = 0 THEN '2.1 ' || mode ELSE mode || ' ' || flag END AS text, n = 1 AS head, sum((n = 1)::INT) OVER (PARTITION BY doc ORDER BY page, n) AS seq FROM r)
SELECT doc AS document_id, seq::BIGINT AS seq, max(head::INT)::BIGINT AS level, coalesce(max(CASE WHEN head THEN text END), '') AS title, md5(coalesce(string_agg(text, chr(10) ORDER BY page, n) FILTER (NOT head), '')) AS content_md5,
  min(page)::BIGINT AS page_start, max(page)::BIGINT AS page_end FROM t GROUP BY ALL""",
    "usable_pages": r"""
WITH p AS (SELECT (p_partkey % 15)::VARCHAR AS doc, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE regexp_replace(p_name, '(.)', '\1\1', 'g') END AS t FROM part),
c AS (SELECT doc, t, regexp_replace(lower(t), '[^a-z0-9]', ' ', 'g') AS s FROM p),
n AS (SELECT doc, t, length(replace(s, ' ', '')) AS n, len(list_filter(range(1, length(s)), lambda i: s[i] = s[i + 1] AND s[i] <> ' ')) AS d FROM c)
SELECT doc AS document_id FROM n WHERE strlen(trim(t)) >= 4 AND NOT coalesce(d * 100.0 / nullif(n, 0), 0) > 30 GROUP BY 1 HAVING count(*) >= 5""",
    "font_marks": "SELECT p_partkey, p_partkey % 5 IN (0, 2, 3) AS bold, floor((p_partkey % 97) / 7.0::DOUBLE * 2 + 0.5) / 2 AS size FROM part",
    "job_states": """
WITH e AS (SELECT event_id, event_id % 3 > 0 AS bad, user_id % 2 = 0 AS soft, event_id % 4 AS attempt, ts FROM events),
s AS (SELECT *, CASE WHEN NOT bad THEN 'ready' WHEN soft AND attempt < 3 THEN 'parsing' ELSE 'failed' END AS state FROM e)
SELECT event_id, state, CASE WHEN state = 'parsing' THEN floor(epoch(ts))::BIGINT + (2 ** (attempt + 1))::BIGINT END AS retry_at, CASE WHEN state = 'parsing' THEN attempt + 1 END::BIGINT AS next_attempt FROM s""",
    "selection_events": """
WITH e AS (SELECT user_id::VARCHAR AS q, event_id % 2 AS s, event_id AS p, 's' || event_id AS id FROM events), sl AS (SELECT DISTINCT q, s FROM e),
x AS (SELECT DISTINCT q, 'started' AS event, 0 AS r, -1 AS s, 0 AS p, NULL AS id FROM sl UNION ALL SELECT q, 'slice_started', 1, s, -1, NULL FROM sl UNION ALL SELECT q, 'section_selected', 1, s, p, id FROM e
  UNION ALL SELECT q, 'slice_completed', 1, s, 1 << 30, NULL FROM sl UNION ALL SELECT DISTINCT q, 'completed', 2, -1, 0, NULL FROM sl)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY r, s, p) - 1 AS seq, event,
  'event: ' || event || chr(10) || 'data: {"document_id":"d"' || CASE WHEN s >= 0 THEN ',"slice_no":' || s ELSE '' END || CASE WHEN id IS NOT NULL THEN ',"id":"' || id || '"' ELSE '' END || '}' || chr(10) || chr(10) AS text FROM x""",
    "live_cache": """
WITH k AS (SELECT user_id::VARCHAR AS key, max(ts) AS t FROM events GROUP BY 1) SELECT key FROM k WHERE t > (SELECT max(t) FROM k) - INTERVAL 3 DAY ORDER BY t DESC, key LIMIT 25""",
    "replayed": """
WITH top AS (SELECT max(o_orderkey) AS m FROM orders),
st AS (SELECT 't' || o_custkey AS token, arg_max(o_orderpriority, o_orderkey) AS query, max(o_orderkey) AS k FROM orders, top WHERE o_orderkey % 2 = 0 AND o_orderkey > m - greatest(m // 2, 1) GROUP BY 1),
a AS (SELECT DISTINCT 't' || o_custkey AS token, o_orderpriority AS query FROM orders)
SELECT a.token, a.query, (CASE WHEN st.token IS NULL THEN 404 WHEN st.query <> a.query THEN 409 ELSE 200 END)::BIGINT AS status, CASE WHEN st.query = a.query THEN k::VARCHAR END AS response FROM a LEFT JOIN st ON st.token = a.token""",
}
