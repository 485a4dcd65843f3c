"""The registered queries as SQL for DuckDB, by name; queries without an entry have no SQL form."""

from __future__ import annotations

END = "[.!?。！？…]+"
WS = r"^\s+|\s+$"

SENTENCES = f"""
  parts AS (SELECT doc_id, regexp_split_to_array(text, '{END}') AS p FROM documents),
  sentences AS (SELECT doc_id, i - 1 AS pos, regexp_replace(p[i], '{WS}', '', 'g') AS sentence
                FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
  good AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM sentences WHERE sentence <> ''),
  ranked AS (SELECT doc_id, sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) * 1000 AS INTEGER) AS sort_order
             FROM (SELECT doc_id, sentence, min(pos) AS pos FROM good GROUP BY ALL))"""


def folded(h: str) -> str:
    """abs of the signed number that the first 16 hex digits of h spell."""
    u = f"CAST(('0x' || substr({h}, 1, 16)) AS UBIGINT)"
    return f"CAST(least(CASE WHEN {u} >= 9223372036854775808::UBIGINT THEN 18446744073709551616::HUGEINT - {u}::HUGEINT ELSE {u}::HUGEINT END, 9223372036854775807::HUGEINT) AS BIGINT)"


def uuid(h: str) -> str:
    variant = f"lpad(lower(to_hex((CAST(('0x' || substr({h}, 17, 2)) AS INTEGER) & 63) | 128)), 2, '0')"
    return f"substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || {variant} || substr({h},19,2) || '-' || substr({h},21,12)"


KEYWORDS = """
  found AS (SELECT doc_id, unnest(k) AS keyword, unnest(range(len(k))) AS pos
            FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{2,}') AS k FROM documents)),
  firsts AS (SELECT doc_id, keyword, min(pos) AS pos FROM found WHERE length(keyword) >= 4 GROUP BY ALL),
  kept AS (SELECT doc_id, keyword FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 8)"""

ATOMS = f"""
  turns AS (SELECT conv_id, turn, role, list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{END}'), lambda x: regexp_replace(x, '{WS}', '', 'g')), lambda x: x <> '') AS s FROM conversations),
  atoms AS (SELECT conv_id, turn, role, CAST(i * 1000 AS INTEGER) AS sort_order, s[i] AS content, conv_id || '/' || turn AS l2_id
            FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM turns))"""


def cut_bytes(s: str, most: int) -> str:
    """The longest prefix of whole characters in `most` bytes: characters whose running bytes fit."""
    return f"CASE WHEN strlen({s}) <= {most} THEN {s} ELSE substr({s}, 1, (SELECT CAST(coalesce(max(n), 0) AS BIGINT) FROM (SELECT unnest(range(1, {most} + 1)) AS n) WHERE strlen(substr({s}, 1, n)) <= {most})) END"


def cosine(a: str, b: str) -> str:
    d = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})))"


#: SQL: the table of crc32, one number for each byte; and the crc32 of the bytes whose hex digits are {0}, with that table in the column `crcs`.
CRC_TABLE = "SELECT list(r ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS r FROM (SELECT unnest(range(256)) AS b))"
CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || substr({0}, 2 * k + 1, 2) AS BIGINT) FOR k IN range(length({0}) // 2)]), lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])))"

VECTORS = "q AS (SELECT embedding AS v, label AS l FROM embeddings ORDER BY vec_id LIMIT 1)"


def top(where: str, k: int) -> str:
    return f"SELECT vec_id, {cosine('embedding', 'v')} AS s FROM embeddings, q {where} ORDER BY s DESC, vec_id LIMIT {k}"


EACH = f"""asked AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
  scored AS (SELECT query_id, vec_id, {cosine('embedding', 'qv')} AS s FROM embeddings, asked),
  near AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)"""


def lexical(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""(SELECT doc_id, len(list_filter(list_concat(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)+')), lambda t: t IN ({listed}))) * 0.1::DOUBLE AS s FROM documents)"""


def fused(a: str, b: str, alpha: float, id_col: str, limit: str = "") -> str:
    return f"""d AS (SELECT *, row_number() OVER (ORDER BY s DESC, {id_col}) - 1 AS r FROM {a}),
  e AS (SELECT *, row_number() OVER (ORDER BY s DESC, {id_col}) - 1 AS r FROM {b}),
  f AS (SELECT coalesce(d.{id_col}, e.{id_col}) AS {id_col}, coalesce({alpha}::DOUBLE / (60 + d.r + 1), 0) + coalesce((1 - {alpha}::DOUBLE) / (60 + e.r + 1), 0) AS fu, coalesce(d.s, e.s) AS sc, d.r AS dr, e.r AS er FROM d FULL JOIN e ON d.{id_col} = e.{id_col})
  SELECT {id_col}, round(fu, 8) AS fused, round(sc, 6) AS score FROM f ORDER BY fu DESC, dr NULLS LAST, er NULLS LAST {limit}"""


def excerpt(s: str, most: int) -> str:
    """The rule of snippets, on text without white space at its ends."""
    full = f"regexp_replace({s}, '{WS}', '', 'g')"
    cut = f"substr({full}, 1, {most})"
    least = int(most * 0.4)
    sentence = f"regexp_extract({cut}, '(?s)^(.{{{least},}}[.?!。\\n])', 1)"
    space = f"regexp_extract({cut}, '(?s)^(.{{{least},}})\\s', 1)"
    bare = lambda x: f"nullif(regexp_replace({x}, '{WS}', '', 'g'), '')"
    return f"CASE WHEN length({full}) <= {most} THEN {full} ELSE coalesce({bare(sentence)}, {bare(space)}, {bare(cut)}) || '…' END"


HITS = f"""raw AS (SELECT CAST(conv_id AS VARCHAR) AS l1_id, conv_id || '/' || turn AS l2_id, CASE WHEN turn % 3 > 0 THEN conv_id || '#' || turn END AS l3_id, role AS title, text, CASE WHEN turn % 2 = 0 THEN turn / 4.0::DOUBLE END AS sc, conv_id AS project_id FROM conversations),
  hits AS (SELECT '' AS doc_id, project_id, '' AS doc_name, l1_id, l2_id, l3_id, coalesce(sc, 0) AS score, title, '' AS section_heading, {excerpt('text', 60)} AS snippet, '' AS source_path, '' AS breadcrumb FROM raw WHERE l3_id IS NOT NULL)"""

EDGES = r"""paths AS (SELECT page_id AS file, replace(regexp_replace(url, '^[a-z]+://', ''), '\', '/') AS p FROM pages),
  edges AS (SELECT DISTINCT 1::BIGINT AS project, coalesce(nullif(regexp_extract(p, '^(/*.*?)/+[^/]*$', 1), ''), '/') AS dir_path, file FROM paths)"""

SIBLINGS = EDGES + """,
  seeds AS (SELECT DISTINCT project, file FROM edges WHERE file % 100 = 0),
  dirs AS (SELECT DISTINCT e.project, e.dir_path FROM edges e SEMI JOIN seeds s ON e.project = s.project AND e.file = s.file),
  sib AS (SELECT DISTINCT e.project, e.file FROM edges e JOIN dirs d USING (project, dir_path) ANTI JOIN seeds s ON e.project = s.project AND e.file = s.file)"""

TABLES = """t_documents AS (SELECT CAST(n_nationkey AS VARCHAR) AS doc_key, CAST(n_regionkey AS BIGINT) AS project_id FROM nation),
  t_l1 AS (SELECT c_custkey AS l1_id, CAST(n_regionkey AS BIGINT) AS project_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
  t_l2 AS (SELECT o_custkey AS l1_id, o_orderkey AS l2_id FROM orders),
  t_l3 AS (SELECT l_orderkey AS l2_id, l_orderkey || '/' || l_linenumber AS l3_id FROM lineitem),
  g_l1 AS (SELECT * FROM t_l1 WHERE project_id = 2),
  g_l2 AS (SELECT * FROM t_l2 WHERE l1_id IN (SELECT l1_id FROM g_l1)),
  g_l3 AS (SELECT * FROM t_l3 WHERE l2_id IN (SELECT l2_id FROM g_l2))"""

REGION_MD = """sup AS (SELECT s_nationkey, string_agg(s_name || ' is here.', chr(10) ORDER BY s_suppkey) AS lines FROM supplier GROUP BY 1),
  body AS (SELECT n_regionkey, string_agg('## ' || n_name || chr(10) || coalesce(lines, '') || chr(10) || '### Notes' || chr(10) || 'none' || chr(10), '' ORDER BY n_nationkey) AS b FROM nation LEFT JOIN sup ON n_nationkey = s_nationkey GROUP BY 1),
  md AS (SELECT r_regionkey AS doc, 'intro of ' || r_name || chr(10) || '# ' || r_name || chr(10) || coalesce(b, '') AS content FROM region LEFT JOIN body ON r_regionkey = n_regionkey),
  lines AS (SELECT doc, i AS line_no, l[i] AS line FROM (SELECT doc, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc, string_split(content, chr(10)) AS l FROM md))),
  marked AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+.+$') AS h, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level, regexp_extract(line, '^#{1,6}\\s+(.+)$', 1) AS text FROM lines),
  numbered AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc ORDER BY line_no) - 1 AS sec FROM marked),
  heads AS (SELECT doc, line_no, level, text, CAST(sec AS BIGINT) AS sec FROM numbered WHERE h),
  up AS (SELECT a.doc, a.sec, b.level, arg_max(b.text, b.sec) AS text, max(b.sec) AS bsec FROM heads a JOIN heads b ON a.doc = b.doc AND b.sec < a.sec AND b.level < a.level GROUP BY 1, 2, 3),
  toc AS (SELECT h.doc, 's' || h.sec AS section_id, CAST(h.level AS INT) AS level, h.text, coalesce((SELECT string_agg(u.text, ' > ' ORDER BY u.level) || ' > ' FROM up u WHERE u.doc = h.doc AND u.sec = h.sec), '') || h.text AS path, 's' || (SELECT arg_max(u.bsec, u.level) FROM up u WHERE u.doc = h.doc AND u.sec = h.sec) AS parent_section_id, h.sec FROM heads h)""".replace("\\\\", "\\")

CODE = r"""sup AS (SELECT s_nationkey, string_agg('def ' || lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')) || '(x):' || chr(10) || '    return ' || s_suppkey || chr(10) || chr(10), '' ORDER BY s_suppkey) AS b FROM supplier GROUP BY 1),
  src AS (SELECT n_nationkey AS doc, 'import os' || chr(10) || chr(10) || coalesce(b, '') AS content FROM nation LEFT JOIN sup ON n_nationkey = s_nationkey),
  ls AS (SELECT doc, CAST(i AS INT) AS line_num, l[i] AS content FROM (SELECT doc, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS l FROM src))),
  typed AS (SELECT *, CASE WHEN trim(content) = '' THEN 'empty_line' WHEN regexp_matches(content, '^def\s+\w+\s*\(') THEN 'function_definition' ELSE 'expression_statement' END AS node_type FROM ls),
  code AS (SELECT *, node_type = 'function_definition' AS is_anchor, false AS is_block_start, CAST(CASE WHEN node_type = 'function_definition' THEN -1 ELSE coalesce(max(CASE WHEN node_type = 'function_definition' THEN line_num - 1 END) OVER (PARTITION BY doc ORDER BY line_num), -1) END AS INT) AS parent_idx FROM typed)"""

ORACLES: dict[str, str] = {
    "sentence_explode": f"WITH {SENTENCES} SELECT * FROM good",
    "sentence_dedup_rank": f"WITH {SENTENCES} SELECT doc_id, sort_order, sentence FROM ranked",
    "sentence_chain": f"WITH {SENTENCES} SELECT doc_id, sort_order, coalesce(lag(sort_order) OVER (PARTITION BY doc_id ORDER BY sort_order), -1) AS parent_order, sha256(sentence) AS content_hash FROM ranked",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "dup_documents": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "ingest_anti_join": "SELECT doc_id, source, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)",
    "section_hash": "SELECT conv_id, sha256(string_agg(l, chr(10) ORDER BY l)) AS l2_child_hash FROM (SELECT conv_id, 's' || turn || '||heading|' || role || '|' || sha256(text) AS l FROM conversations) GROUP BY 1",
    "project_merkle": "SELECT s_nationkey AS project_id, sha256(unhex(string_agg(lpad(hex(s_suppkey), 16, '0') || sha256(s_name), '' ORDER BY s_suppkey))) AS content_hash FROM supplier GROUP BY 1",
    "project_noop": "SELECT n_nationkey AS project_id, n_name = upper(n_name) AS already_up_to_date FROM nation",
    "keyword_ids": f"WITH {KEYWORDS}, h AS (SELECT *, sha256('kw:' || keyword) AS h FROM kept) SELECT doc_id, keyword, {folded('h')} AS keyword_id FROM h",
    "keyword_dictionary": f"WITH {KEYWORDS}, g AS (SELECT keyword, count(*) AS n, sha256('kw:' || keyword) AS h FROM kept GROUP BY keyword) SELECT {folded('h')} AS machine_id, keyword AS canonical_name, n AS documents FROM g",
    "project_ids": f"WITH p AS (SELECT '/data/./' || n_name || '//wiki/' AS raw, '/data/' || n_name || '/wiki' AS c FROM nation), h AS (SELECT raw, c, sha256('project:' || c) AS h, sha256(raw) AS r FROM p) SELECT c AS root_path, greatest({folded('h')}, 1) AS project_id, {uuid('r')} AS point_id, 'path:' || substr(r, 1, 16) AS job_key FROM h",
    "conv_hierarchy_context": f"WITH {ATOMS}, l1 AS (SELECT conv_id, count(*) AS sections FROM conversations GROUP BY 1) SELECT conv_id, turn, sort_order, (turn + 1) * 1000 AS section_order, sections, content, '[document: conversation ' || conv_id || '] > [section: turn ' || turn || ']' AS breadcrumb FROM atoms JOIN l1 USING (conv_id)",
    "title_left_join": f"WITH {ATOMS} SELECT c.conv_id, c.turn, c.role, a.content AS section_heading FROM conversations c LEFT JOIN atoms a ON a.conv_id = c.conv_id AND a.turn + 1 = c.turn AND a.sort_order = 1000 AND a.role = 'user'",
    "neighbor_window": f"WITH {ATOMS} SELECT a.l2_id, a.sort_order, a.content, string_agg(b.content, chr(10) || chr(10) ORDER BY b.sort_order) AS surrounding_context FROM atoms a JOIN atoms b ON a.l2_id = b.l2_id AND b.sort_order BETWEEN a.sort_order - 2000 AND a.sort_order + 2000 GROUP BY 1, 2, 3",
    "neighbor_range_join": f"WITH {ATOMS}, h AS (SELECT l2_id, sort_order FROM atoms QUALIFY row_number() OVER (PARTITION BY l2_id ORDER BY length(content) DESC, sort_order) = 1) SELECT h.l2_id AS l3_id, a.sort_order AS n_sort, a.content AS n_content FROM h JOIN atoms a ON a.l2_id = h.l2_id AND a.sort_order BETWEEN greatest(h.sort_order - 1500, 0) AND h.sort_order + 1500",
    "token_budget": f"WITH {ATOMS}, t AS (SELECT conv_id, turn, sort_order, greatest(1, 2 * sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY conv_id, turn ORDER BY sort_order)) AS used FROM atoms) SELECT c.conv_id, c.turn, CAST(count(t.sort_order) AS INT) AS sentences, CAST(count(t.sort_order) FILTER (used <= 40) AS INT) AS kept FROM conversations c LEFT JOIN t USING (conv_id, turn) GROUP BY 1, 2",
    "restore_conversation": f"WITH {ATOMS}, b AS (SELECT conv_id, turn, string_agg(content, ' ' ORDER BY sort_order) AS block FROM atoms GROUP BY 1, 2) SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS content FROM b GROUP BY 1",
    "restore_rows_by_type": f"WITH t AS (SELECT conv_id, turn, regexp_replace(text, '{WS}', '', 'g') AS x FROM conversations) SELECT conv_id, CAST(length(string_agg(x, chr(10) || chr(10) ORDER BY turn)) AS INT) AS md_chars, sha256(string_agg(x, chr(10) ORDER BY turn)) AS code_hash FROM t WHERE x <> '' GROUP BY 1",
    "l1_summary": f"WITH t AS (SELECT conv_id, turn, text, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations), k AS (SELECT * FROM t WHERE coalesce(before, 0) = 0 OR strlen('conversation ' || conv_id || ': ') + before - 1 <= 1200), j AS (SELECT conv_id, 'conversation ' || conv_id || ': ' || string_agg(text, ' ' ORDER BY turn) AS s FROM k GROUP BY conv_id), c AS (SELECT conv_id, {cut_bytes('s', 1200)} AS s FROM j) SELECT conv_id, regexp_replace(s, '{WS}', '', 'g') AS summary FROM c",
    "dense_topk": f"WITH {VECTORS}, t AS ({top('', 30)}) SELECT vec_id, round(s, 6) AS score FROM t",
    "dense_topk_filtered": f"WITH {VECTORS}, t AS ({top('WHERE label = l', 10)}) SELECT vec_id, round(s, 6) AS score FROM t",
    "dense_topk_batch": f"WITH {EACH} SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM near WHERE rank <= 5",
    "normalized_vectors": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS total, CAST(len(embedding) AS INT) AS dim FROM embeddings",
    "lexical_topk": f"SELECT doc_id, round(s, 6) AS score FROM {lexical(['the', 'and', 'this'])} WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 60",
    "rrf_fusion": f"WITH {VECTORS}, x AS ({top('', 30)}), y AS ({top('WHERE label = l', 20)}), {fused('x', 'y', 0.5, 'vec_id')}",
    "hybrid_search": f"WITH x AS (SELECT * FROM {lexical(['the'])} WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 30), y AS (SELECT * FROM {lexical(['to', 'of'])} WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 60), {fused('x', 'y', 0.6, 'doc_id', 'LIMIT 10')}",
    "rerank_lexical": f"WITH x AS (SELECT * FROM {lexical(['the', 'and', 'le'])} WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 60), r AS (SELECT doc_id, s, (SELECT count(DISTINCT t) FROM (SELECT unnest(list_concat(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)+'))) AS t) WHERE t IN ('the-of', 'and', 'le', 'un', 'der')) / 5.0::DOUBLE AS q FROM x JOIN documents USING (doc_id)) SELECT doc_id, round(s, 6) AS score, round(q, 6) AS rerank_score FROM r ORDER BY q DESC, doc_id LIMIT 5",
    "first_hit_per_section": "SELECT user_id || '/' || event_type AS l2_id, min(event_id) AS rank FROM events GROUP BY 1",
    "ir_metrics": f"WITH {EACH}, rel AS (SELECT query_id, vec_id FROM asked JOIN embeddings ON label = ql), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT near.query_id, rank FROM near JOIN rel USING (query_id, vec_id) WHERE rank <= 10), p AS (SELECT query_id, count(*) FILTER (rank <= 5) AS r5, count(*) FILTER (rank <= 3) AS r3, min(rank) AS f, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM h GROUP BY 1), m AS (SELECT coalesce(r5, 0) / n.n AS recall_5, coalesce(1.0::DOUBLE / f, 0) AS mrr_10, coalesce(dcg, 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i) WHERE i <= n.n) AS ndcg_10, coalesce(r3, 0) / 3 AS p_3 FROM n LEFT JOIN p USING (query_id)) SELECT round(avg(recall_5), 6) AS recall_5, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(p_3), 6) AS p_3 FROM m",
    "search_hits_summary": f"WITH {HITS} SELECT doc_id, doc_name, l3_id, score, title, snippet, source_path FROM hits",
    "search_hits_standard": f"WITH {HITS} SELECT * FROM hits",
    "search_hits_fields": f"""WITH {HITS} SELECT '{{"l3_id":"' || l3_id || '","score":' || CAST(score AS VARCHAR) || ',"project_id":' || project_id || '}}' AS json FROM hits""",
    "agent_hits": "SELECT source AS l1_id, lang AS l2_id, doc_id AS l3_id, source AS title, lang AS section_heading, substr(text, 1, 300) AS l2_summary, substr(text, 1, 500) AS snippet, substr(text, 1, 600) AS context, round(n_chars / 7.0::DOUBLE, 4) AS score FROM documents",
    "directory_edges": f"WITH {EDGES} SELECT * FROM edges",
    "sibling_pages": f"WITH {SIBLINGS} SELECT * FROM sib",
    "graph_expansion_capped": f"WITH {SIBLINGS} SELECT * FROM sib ORDER BY project, file LIMIT 3",
    "first_atom_per_document": "SELECT CAST(conv_id AS BIGINT) AS l1_id, conv_id || '/' || min(turn) || '#0' AS l3_id FROM conversations GROUP BY conv_id HAVING count(*) > 3",
    "mention_counts": f"WITH {KEYWORDS}, h AS (SELECT DISTINCT doc_id, sha256('kw:' || keyword) AS h FROM kept) SELECT {folded('h')} AS keyword_id, count(*) AS mentions FROM h GROUP BY 1",
    "project_tree_flat": "WITH p AS (SELECT 'r' || r_regionkey AS id, 'planet' AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation) SELECT id, parent_id, title, parent_id NOT IN (SELECT id FROM p) AS is_root FROM p",
    "scoped_counts": f"WITH {TABLES} SELECT 'documents' AS table_name, count(*) AS n FROM t_documents WHERE project_id = 2 UNION ALL SELECT 'l1', count(*) FROM g_l1 UNION ALL SELECT 'l2', count(*) FROM g_l2 UNION ALL SELECT 'l3', count(*) FROM g_l3",
    "scoped_reset_preview": f"WITH {TABLES} SELECT 'documents' AS table_name, count(*) AS n FROM t_documents WHERE project_id <> 2 UNION ALL SELECT 'l1', count(*) FROM t_l1 WHERE project_id <> 2 UNION ALL SELECT 'l2', (SELECT count(*) FROM t_l2) - (SELECT count(*) FROM g_l2) UNION ALL SELECT 'l3', (SELECT count(*) FROM t_l3) - (SELECT count(*) FROM g_l3)",
    "latest_revision": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    "head_revision": "WITH dear AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1), last AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1) SELECT c_custkey AS o_custkey, coalesce(d.o_orderkey, l.o_orderkey) AS head FROM customer LEFT JOIN dear d ON d.o_custkey = c_custkey LEFT JOIN last l ON l.o_custkey = c_custkey",
    "exists_chain": f"WITH {TABLES} SELECT l1_id, project_id FROM t_l1 WHERE l1_id IN (SELECT l1_id FROM t_l2 WHERE l2_id IN (SELECT l2_id FROM t_l3))",
    "upsert_documents": "WITH o AS (SELECT c_custkey AS k, c_name AS t, CAST(c_nationkey AS BIGINT) AS p FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS k, upper(c_name) AS t FROM customer WHERE c_mktsegment = 'BUILDING') SELECT coalesce(n.k, o.k) AS machine_id, coalesce(n.t, o.t) AS title, coalesce(o.p, -1) AS project_id, CASE WHEN n.k IS NOT NULL AND o.k IS NOT NULL THEN 2 ELSE 1 END AS version FROM o FULL JOIN n ON o.k = n.k",
    "project_meta_merge": "SELECT s_name AS root_path, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'old' END AS state, CASE WHEN s_acctbal < 0 THEN 'call' END AS note, CASE WHEN s_acctbal < 0 THEN 3 ELSE 2 END AS entries FROM supplier",
    "metadata_flat": "SELECT event_id, k AS key, v AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || k) AS v) WHERE v IS NOT NULL",
    "ingest_log_summary": "SELECT count(*) FILTER (event_type = 'click') AS md, count(*) FILTER (event_type = 'view') AS code, count(*) FILTER (value > 50) AS ok FROM events",
    "dependency_rollup": "SELECT CASE WHEN bool_or(o_orderstatus = 'F') THEN 'degraded' ELSE 'ok' END AS status FROM orders",
    "heading_toc": f"WITH {REGION_MD} SELECT doc, section_id, level, text, path, parent_section_id FROM toc",
    "heading_sections": f"WITH {REGION_MD} SELECT doc, CAST(sec + 1 AS INT) AS chunk_no, CASE WHEN sec < 0 THEN 'root' ELSE 's' || CAST(sec AS BIGINT) END AS section_id, sha256(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '{WS}', '', 'g')) AS text_hash FROM numbered GROUP BY doc, sec",
    "toc_json": f"""WITH {REGION_MD}, e AS (SELECT doc, -1 AS sec, '{{"id":"root","t":"root","d":1}}' AS j FROM md UNION ALL SELECT doc, sec, '{{"id":"' || section_id || '","t":"' || text || '","d":' || level || '}}' FROM toc) SELECT doc, '[' || string_agg(j, ',' ORDER BY sec) || ']' AS toc FROM e GROUP BY doc""",
    "table_rows": "SELECT p_brand AS doc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS pos, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part",
    "clause_split": f"WITH {SENTENCES}, c AS (SELECT doc_id, pos, sentence, list_filter(list_transform(regexp_split_to_array(sentence, '[,|;]'), lambda x: regexp_replace(x, '{WS}', '', 'g')), lambda x: x <> '') AS parts, strlen(sentence) < 120 AND NOT contains(sentence, '|') AND length(sentence) - length(replace(sentence, ',', '')) <= 1 AS short FROM good), k AS (SELECT doc_id, pos, CASE WHEN short OR len(parts) <= 1 THEN [sentence] ELSE parts END AS p FROM c) SELECT doc_id, pos, CAST(i - 1 AS INT) AS clause_no, p[i] AS clause FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM k)",
    "code_lines": f"WITH {CODE} SELECT doc, line_num, content, node_type, is_anchor, is_block_start, parent_idx FROM code",
    "code_chunks": f"WITH {CODE}, n AS (SELECT *, sum(CAST(is_anchor AS INT)) OVER (PARTITION BY doc ORDER BY line_num) AS g, max(CAST(is_anchor AS INT)) OVER (PARTITION BY doc) AS a FROM code) SELECT doc, CASE WHEN a = 0 THEN 'f1' WHEN g = 0 THEN 'pre' ELSE 'fn' || CAST(g AS BIGINT) END AS section_id, CAST(g AS INT) AS chunk_no, CASE WHEN a = 1 AND g > 0 THEN regexp_extract(arg_min(content, line_num), '^def ([^(]+)', 1) ELSE '' END AS title, min(line_num) AS first_line, string_agg(content, chr(10) ORDER BY line_num) AS text FROM n GROUP BY doc, g, a HAVING g > 0 OR a = 0 OR bool_or(trim(content) <> '')",
    "restore_code": f"WITH {CODE} SELECT doc, string_agg(content, chr(10) ORDER BY line_num) AS content FROM code GROUP BY doc",
    "text_scalars": f"WITH t AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(regexp_replace(x, '{WS}', '', 'g'), '#')) AS l FROM documents) SELECT doc_id, sha256(array_to_string(l, chr(10))) AS without_headings, {cut_bytes('text', 100)} AS first_bytes, round(length(regexp_replace(text, '[^가-힣]', '', 'g')) / greatest(length(text), 1), 6) AS hangul, CAST(greatest(1, 2 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS INT) AS tokens, sha256(source || chr(10) || {cut_bytes('text', 500)}) AS embedding_hash, sha256('passage: ' || text) AS passage_hash FROM t",
    "heading_scalars": f"WITH {REGION_MD} SELECT doc, '# ' || r_name AS heading, 'intro of ' || r_name AS intro, CAST(length(regexp_replace(substr(content, 2 + length('intro of ' || r_name) + length('# ' || r_name) + 1), '{WS}', '', 'g')) AS INT) AS body_chars FROM md JOIN region ON r_regionkey = doc",
    "snippets": f"SELECT doc_id, {excerpt('text', 80)} AS snippet FROM documents",
    "section_summaries": f"WITH b AS (SELECT doc_id, source, lang, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(regexp_replace(x, '{WS}', '', 'g'), '#')), chr(10)), '{WS}', '', 'g') AS body FROM documents), s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(body, '{END}'), lambda x: regexp_replace(x, '{WS}', '', 'g')), lambda x: x <> '') AS p FROM b), j AS (SELECT *, coalesce(nullif(array_to_string(p[1:2], '. '), ''), body) AS two FROM s) SELECT doc_id, source || ' | ' || lang || ' — ' || {cut_bytes('two', 400)} AS summary FROM j",
    "path_functions": f"WITH {EDGES} SELECT file AS page_id, dir_path AS directory, 'python' AS language, CASE WHEN file % 2 = 0 THEN 'code' ELSE 'wiki' END AS domain FROM edges",
    "declared_names": "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part",
    "block_formats": "SELECT r_regionkey, '| x | y |' || chr(10) || '| --- | --- |' || chr(10) || '# ' || r_name || chr(10) || 'a' || chr(10) || 'b' AS as_table, '```sql' || chr(10) || '# ' || r_name || chr(10) || ' a ' || chr(10) || 'b' || chr(10) || '```' AS as_code, '# ' || r_name || chr(10) || 'a' || chr(10) || 'b' AS as_image, '# ' || r_name || chr(10) || chr(10) || 'a b' AS as_heading, '# ' || r_name || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || 'b' AS as_plain FROM region",
    "point_lookup": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42",
    "batch_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "sample_and_count": "SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS total FROM embeddings ORDER BY vec_id LIMIT 3",
    "code_atoms": f"WITH {CODE} SELECT doc, line_num * 1000 AS sort_order, sha256(line_num || '|' || content) AS content_hash, is_anchor AS embedded, parent_idx + 1 AS parent_line FROM code",
    "code_fragments": "SELECT DISTINCT p_brand AS doc, pos, fragment FROM part, (VALUES (0, 'select 1'), (1, '  from t')) AS f(pos, fragment)",
    "symbol_chunks": f"WITH {REGION_MD} SELECT doc, section_id, text FROM toc WHERE parent_section_id IS NULL",
    "atom_hashes": f"WITH {ATOMS} SELECT l2_id, sha256(string_agg(l, chr(10) ORDER BY l)) AS l3_child_hash FROM (SELECT l2_id, l2_id || '#' || sort_order || '|' || sha256(content) AS l FROM atoms) GROUP BY 1",
}
