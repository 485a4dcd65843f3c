"""SQL for DuckDB of the queries in `store_queries`."""

from __future__ import annotations

import hashlib

from strata import structure_queries
from strata.oracles import CODE, END, REGION_MD, WS, folded, uuid

SEP = " || chr(31) || "
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


def natural(*parts: str) -> str:
    return uuid(f"sha256({SEP.join(parts)})")


def unit(text: str) -> str:
    """The unit vector of counts of letters and digits, as 32-bit numbers."""
    counts = f"list_transform(string_split_regex('{SIGNS}', ''), lambda c: CAST(length(lower({text})) - length(replace(lower({text}), c, '')) AS DOUBLE))"
    return f"(SELECT list_transform(v, lambda x: CAST(CASE WHEN n = 0 THEN x ELSE x / n END AS FLOAT)) FROM (SELECT v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT {counts} AS v)))"


def dots(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def hierarchy(project: int = 7) -> str:
    return f"""{REGION_MD},
  d0 AS (SELECT doc, content, 'region-' || doc AS title, sha256(content) AS content_hash, {natural("'doc'", f"'{project}'", "'region-' || doc")} AS doc_key FROM md),
  d AS (SELECT *, {natural("'l1'", "doc_key", "content_hash", "'masked-1'")} AS l1_id FROM d0),
  sec0 AS (SELECT doc, CAST(sec AS BIGINT) AS sec, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '{WS}', '', 'g') AS text, regexp_replace(coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY line_no), ''), '{WS}', '', 'g') AS body, max(CASE WHEN h THEN line END) AS head FROM numbered GROUP BY doc, sec),
  l2a AS (SELECT d.doc, d.title, d.l1_id, s.sec, s.text, s.body, s.head, CASE WHEN s.sec < 0 THEN 'root' ELSE 's' || s.sec END AS section_id, coalesce(t.path, '') AS path, t.parent_section_id FROM sec0 s JOIN d USING (doc) LEFT JOIN toc t ON t.doc = s.doc AND t.sec = s.sec),
  l2b AS (SELECT *, {natural("l1_id", "section_id")} AS l2_id, CASE WHEN parent_section_id IS NOT NULL THEN {natural("l1_id", "parent_section_id")} END AS parent_id, CAST((sec + 2) * 1000 AS INT) AS sort_order FROM l2a),
  said AS (SELECT l2_id, list_filter(list_transform(regexp_split_to_array(body, '{END}'), lambda x: regexp_replace(x, '{WS}', '', 'g')), lambda x: x <> '') AS p FROM l2b),
  at0 AS (SELECT l2_id, 0 AS sort_order, head AS content FROM l2b WHERE head IS NOT NULL
          UNION ALL SELECT l2_id, CAST(i * 1000 AS INT), p[i] FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM said)),
  at1 AS (SELECT *, {natural("l2_id", "CAST(sort_order AS VARCHAR)")} AS l3_id FROM at0),
  l3 AS (SELECT at1.*, l1_id, section_id, title, lag(l3_id) OVER (PARTITION BY at1.l2_id ORDER BY at1.sort_order) AS parent_id, at1.sort_order > 0 AS embedded FROM at1 JOIN l2b USING (l2_id)),
  sums AS (SELECT l2_id, sha256(string_agg(l, chr(10) ORDER BY l)) AS l3_child_hash FROM (SELECT l2_id, l3_id || '|' || sha256(content) AS l FROM l3) GROUP BY 1),
  kids AS (SELECT l1_id, sha256(string_agg(l, chr(10) ORDER BY l)) AS l2_child_hash FROM (SELECT l1_id, section_id || '|' || coalesce(parent_section_id, '') || '|heading|' || path || '|' || sha256(text) AS l FROM l2b) GROUP BY 1),
  brief AS (SELECT l2_id, title || CASE WHEN path <> '' THEN ' | ' || path ELSE '' END || ' — ' || coalesce(nullif(array_to_string(p[1:2], '. '), ''), body) AS summary FROM l2b JOIN said USING (l2_id)),
  entry AS (SELECT l1_id, sec, '{{"id":"' || section_id || '","t":"' || coalesce(nullif(string_split(path, ' > ')[-1], ''), section_id) || '","d":' || greatest(len(string_split(path, ' > ')), 1) || '}}' AS j FROM l2b),
  tocs AS (SELECT l1_id, '[' || string_agg(j, ',' ORDER BY sec) || ']' AS toc FROM entry GROUP BY 1)"""


HIER = hierarchy()


def found(asked: str, most: int, order: str = "score DESC, l3_id") -> str:
    """The nearest atoms to a query, with what is around them."""
    return f"""{HIER}, q AS (SELECT {unit(f"'query: {asked}'")} AS v),
  scored AS (SELECT l3.*, {dots("e", "v")} / (sqrt({dots("e", "e")}) * sqrt({dots("v", "v")})) AS score FROM (SELECT *, {unit("'passage: ' || content")} AS e FROM l3 WHERE embedded) l3, q),
  best AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS rank FROM scored QUALIFY rank <= {most}),
  around AS (SELECT b.l3_id, string_agg(a.content, chr(10) || chr(10) ORDER BY a.sort_order) AS surrounding_context FROM best b JOIN l3 a ON a.l2_id = b.l2_id AND a.sort_order BETWEEN b.sort_order - 2000 AND b.sort_order + 2000 GROUP BY 1),
  hits AS (SELECT rank, b.l3_id, round(score, 5) AS score, b.title AS l1_title, coalesce(s.head, '') AS section_heading, b.content AS matched_content, '[문서: ' || b.title || '] > [섹션: ' || coalesce(s.head, '(section)') || ']' AS breadcrumb, surrounding_context, b.l2_id, b.l1_id, b.section_id, summary, toc
           FROM best b JOIN l2b s ON s.l2_id = b.l2_id JOIN around USING (l3_id) JOIN brief ON brief.l2_id = b.l2_id JOIN tocs ON tocs.l1_id = b.l1_id)"""


ASKED = "supplier number 7 is not here"


def values(columns: str, *rows: tuple) -> str:
    """Rows of fixed values."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


PART = """parts AS (SELECT p_brand AS doc, string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS rows FROM part GROUP BY 1)"""
FENCE = "'```sql' || chr(10) || 'select 1' || chr(10) || chr(10) || '  from t' || chr(10) || '```'"
IMAGE = "'![logo](https://example.com/a.png)'"
LIST = "'1. first item' || chr(10) || 'more of it' || chr(10) || '2. second item'"
PROSE = "'# ' || doc || chr(10) || 'Parts of the brand. See v1.2.3 of list.md!' || chr(10) || chr(10) || chr(10) || 'Last words.'"
RULE = "'| --- | ---: |'"

STORE_ORACLES: dict[str, str] = {
    "ingest_documents": f"WITH {HIER} SELECT doc_key, {folded('sha256(doc_key)')} AS machine_id, 7::BIGINT AS project_id, title, title AS path, 'md' AS source_type, content_hash, l1_id AS current_l1_id, 1 AS version FROM d",
    "ingest_snapshots": f"WITH {HIER} SELECT l1_id, doc_key, 7::BIGINT AS project_id, content_hash, l2_child_hash, toc, true AS created, false AS synced FROM d JOIN kids USING (l1_id) JOIN tocs USING (l1_id)",
    "ingest_sections": f"""WITH {HIER} SELECT l2_id, l1_id, section_id, parent_id, sort_order, 'heading' AS section_type, path, text, '{{"block_type": "heading"}}' AS source_metadata, sha256(text) AS summary_hash, summary, CASE WHEN head IS NOT NULL THEN {natural("l2_id", "'0'")} END AS title_id, l3_child_hash FROM l2b JOIN brief USING (l2_id) LEFT JOIN sums USING (l2_id)""",
    "ingest_atoms": f"WITH {HIER} SELECT l3_id, l2_id, l1_id, parent_id, sort_order, content, sha256(content) AS content_hash, embedded FROM l3",
    "ingest_document_vectors": f"WITH {HIER}, v AS (SELECT l1_id, {unit(chr(39) + 'passage: ' + chr(39) + ' || title || chr(10) || substr(content, 1, 500)')} AS v FROM d) SELECT l1_id, 7::BIGINT AS project_id, CAST(len(v) AS INT) AS size, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM v",
    "ingest_atom_vectors": f"""WITH {HIER}, v AS (SELECT *, {unit("'passage: ' || content")} AS v, len(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9_-]{{2,}}'), lambda k: length(k) >= 4))) AS k FROM l3 WHERE embedded) SELECT {uuid('sha256(l3_id)')} AS point_id, l1_id, l2_id, l3_id, section_id, 'heading' AS section_type, 'md' AS source_type, 7::BIGINT AS project_id, CAST(k AS INT) AS keywords, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM v""",
    "ingest_edges": f"WITH {HIER} SELECT '/' AS src, 'directory' AS src_type, l1_id AS dst, 'file' AS dst_type, 7::BIGINT AS project_id, 'contains' AS rel FROM d UNION ALL SELECT l1_id, 'file', l2_id, 'section', 7, 'contains' FROM l2b UNION ALL SELECT l2_id, 'section', l3_id, 'chunk', 7, 'contains' FROM l3",
    "sync_marks": f"WITH {HIER} SELECT l1_id, title FROM d WHERE doc % 2 = 1",
    "reset_and_ingest_again": f"WITH {HIER}, n AS (SELECT (SELECT count(*) FROM d) AS d, (SELECT count(*) FROM l2b) AS s) SELECT 'first' AS step, d AS written, 0::BIGINT AS skipped, 0::BIGINT AS failed FROM n UNION ALL SELECT 'other', d, 0, 0 FROM n UNION ALL SELECT 'again', 0, d, 0 FROM n UNION ALL SELECT 'after reset', d, 0, 0 FROM n UNION ALL SELECT 'gone and left', s, s, d FROM n",
    "project_audit": "SELECT CAST(n_nationkey AS VARCHAR) AS doc_key, CAST(n_regionkey AS BIGINT) AS project_id, r_name AS root_path, r_regionkey AS project_machine_id FROM nation JOIN region ON n_regionkey = r_regionkey",
    "section_versions": "WITH e AS (SELECT user_id, event_type, event_id, floor(value / 50) AS t, lag(floor(value / 50)) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) SELECT user_id AS l1_id, event_type AS section_id, event_id AS chunk_no, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INT) AS section_version FROM e WHERE b IS NULL OR b <> t",
    "search_store": f"WITH {found(ASKED, 10)} SELECT rank, l3_id, score, l1_title, section_heading, matched_content, breadcrumb, surrounding_context FROM hits",
    "search_levels": f"WITH {found(ASKED, 3)} SELECT level, rank, l3_id, section_id, summary AS l2_summary, 'places' AS doc_name, '' AS source_path, CASE level WHEN 0 THEN '' WHEN 2 THEN summary || chr(10) || chr(10) || matched_content ELSE surrounding_context END AS surrounding_context, sha256(CASE WHEN level = 3 THEN toc ELSE '' END) AS toc_hash FROM hits, (VALUES (0), (2), (3)) AS l(level)",
    "search_hits_json": f"WITH {found(ASKED, 4)} SELECT l3_id, l1_title AS title, matched_content AS snippet, '' AS source_path, 'places' AS doc_name FROM hits",
    "search_markdown": f"WITH {found(ASKED, 3)} SELECT string_agg('### ' || rank || '. ' || l1_title || chr(10) || breadcrumb || chr(10) || 'score: ' || CAST(round(score, 4) AS VARCHAR) || chr(10) || chr(10) || matched_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS markdown FROM hits",
    "graph_search": f"WITH {found(ASKED, 1)}, others AS (SELECT l1_id, arg_min(l3_id, (s, o)) AS l3_id, arg_min(content, (s, o)) AS content FROM (SELECT l3.l1_id, l3.l3_id, l3.content, l2b.sort_order AS s, l3.sort_order AS o FROM l3 JOIN l2b ON l2b.l2_id = l3.l2_id WHERE l3.l1_id NOT IN (SELECT l1_id FROM hits)) GROUP BY 1) SELECT rank, l3_id, 'search' AS source, score, matched_content FROM hits UNION ALL SELECT CAST(row_number() OVER (ORDER BY l1_id) + 1 AS INT), l3_id, 'graph_expansion', NULL, content FROM others",
    "rank_search_with_rewrite": f"WITH {found(ASKED, 30)}, near AS (SELECT *, len(list_filter(['supplier', 'number', '7', 'not', 'here'], lambda t: length(t) >= 2 AND list_contains(regexp_extract_all(lower(matched_content), '[\\p{{L}}\\p{{N}}_]+'), t))) / 4.0 AS r FROM hits) SELECT CAST(row_number() OVER (ORDER BY r DESC, l3_id) AS INT) AS rank, l3_id, score FROM near QUALIFY row_number() OVER (ORDER BY r DESC, l3_id) <= 4",
    "restore_documents": f"WITH {HIER}, b AS (SELECT l1_id, sec, coalesce(head, '') || CASE WHEN head IS NOT NULL AND len(p) > 0 THEN chr(10) || chr(10) ELSE '' END || array_to_string(p, ' ') AS block FROM l2b JOIN said USING (l2_id)) SELECT l1_id, title, string_agg(block, chr(10) || chr(10) ORDER BY sec) AS content FROM b JOIN d USING (l1_id) GROUP BY 1, 2",
    "restore_code_sections": f"WITH {CODE}, n AS (SELECT *, sum(CAST(is_anchor AS INT)) OVER (PARTITION BY doc ORDER BY line_num) AS g, max(CAST(is_anchor AS INT)) OVER (PARTITION BY doc) AS a FROM code) SELECT CAST(doc AS VARCHAR) AS title, CASE WHEN a = 0 THEN 'f1' WHEN g = 0 THEN 'pre' ELSE 'fn' || CAST(g AS BIGINT) END AS section_id, string_agg(content, chr(10) ORDER BY line_num) AS content FROM n GROUP BY doc, g, a HAVING g > 0 OR a = 0 OR bool_or(trim(content) <> '')",
    "answer_loop": f"WITH {found(ASKED, 5)}, firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY l2_id ORDER BY rank) = 1), top AS (SELECT * FROM firsts ORDER BY rank LIMIT 1) SELECT 'answered' AS status, 'found' AS answer, 3::BIGINT AS turns, top.l3_id AS source, (SELECT count(*) FROM firsts) AS hits, substr(coalesce(head || chr(10) || chr(10), '') || array_to_string(p, ' '), 1, 3000) AS restored FROM top JOIN l2b USING (l2_id) JOIN said USING (l2_id)",
    "single_toc": "SELECT r_regionkey, 'document' AS text, 1 AS level, 's0' AS section_id, 'document' AS path FROM region",
    "toc_trees": f"""WITH {REGION_MD}, n AS (SELECT n_regionkey, string_agg('{{"text":"' || n_name || '","level":2,"children":[{{"text":"Notes","level":3}}]}}', ',' ORDER BY n_nationkey) AS c FROM nation GROUP BY 1) SELECT r_regionkey AS doc, '[{{"text":"' || r_name || '","level":1' || coalesce(',"children":[' || c || ']', '') || '}}]' AS toc FROM region LEFT JOIN n ON n_regionkey = r_regionkey""",
    "toc_of_code": f"WITH {CODE} SELECT doc, line_num, regexp_extract(content, '^def (\\w+)', 1) AS text, 2 AS level, node_type FROM code WHERE is_anchor",
    "project_trees": """WITH n AS (SELECT n_regionkey, string_agg('{"id":"n' || n_nationkey || '","parent_id":"r' || n_regionkey || '","title":"' || n_name || '","children":[]}', ',' ORDER BY 'n' || n_nationkey) AS c FROM nation GROUP BY 1) SELECT 'r' || r_regionkey AS id, '{"id":"r' || r_regionkey || '","parent_id":"planet","title":"' || r_name || '","children":[' || coalesce(c, '') || ']}' AS json FROM region LEFT JOIN n ON n_regionkey = r_regionkey""",
    "atoms_by_type": f"""WITH {PART}, a AS (SELECT doc, 's0' AS section_id, 0 AS sort_order, '# ' || doc AS content FROM parts
      UNION ALL SELECT doc, 's0', 1000, 'Parts of the brand' FROM parts UNION ALL SELECT doc, 's0', 2000, 'See v1.2.3 of list.md' FROM parts UNION ALL SELECT doc, 's0', 3000, 'Last words' FROM parts
      UNION ALL SELECT doc, 'o1', 1000, {LIST} FROM parts
      UNION ALL SELECT doc, 'c1', 1000, 'select 1' FROM parts UNION ALL SELECT doc, 'c1', 2000, '  from t' FROM parts UNION ALL SELECT doc, 'i1', 1000, {IMAGE} FROM parts
      UNION ALL SELECT p_brand, 't1', CAST(1000 * row_number() OVER (PARTITION BY p_brand ORDER BY k) AS INT), '| ' || p_name || ' | ' || p_size || ' |' FROM (SELECT p_brand, p_name, p_size, min(p_partkey) AS k FROM part GROUP BY ALL))
      SELECT doc AS title, section_id, sort_order, content FROM a""",
    "graph_sync_rows": f"WITH {HIER} SELECT 1 AS steps, count(*) AS reached FROM d UNION ALL SELECT 2, count(*) FROM l2b UNION ALL SELECT 3, count(*) FROM l3",
    "structured_blocks": f"""WITH {PART}, c AS (SELECT doc, 0 AS chunk_no, 's0' AS section_id, 'heading' AS section_type, doc AS path, NULL AS parent_section_id, {PROSE} AS text, '{{"block_type": "heading"}}' AS metadata FROM parts
      UNION ALL SELECT doc, 1, 't1', 'table', doc || ' > t1', 's0', '| name | size |' || chr(10) || {RULE} || chr(10) || rows, '{{"block_type": "table", "headers": ["name", "size"], "column_count": 2, "separator_row": "| --- | ---: |"}}' FROM parts
      UNION ALL SELECT doc, 2, 'o1', 'ordered', doc || ' > o1', 's0', {LIST}, '{{"block_type": "ordered"}}' FROM parts
      UNION ALL SELECT doc, 3, 'c1', 'code', doc || ' > c1', 's0', {FENCE}, '{{"block_type": "code", "language": "sql"}}' FROM parts
      UNION ALL SELECT doc, 4, 'i1', 'image', doc || ' > i1', 's0', {IMAGE}, '{{"block_type": "image", "alt": "logo", "url": "https://example.com/a.png"}}' FROM parts)
      SELECT doc, chunk_no, section_id, section_type, path, parent_section_id, sha256(text) AS text_hash, metadata FROM c""",
}

STORE_ORACLES |= structure_queries.ORACLES
STORE_ORACLES |= {
    "file_records": f"""WITH {REGION_MD} SELECT 'name=b-' || doc || '/page.md' AS path, 'Region ' || doc AS title, content || chr(10) AS content, 'x' AS tags, 'wiki' AS domain, 7::BIGINT AS project_id FROM md
      UNION ALL SELECT 'name=code-' || doc || '/main.py', 'name=code-' || doc || '/main.py', content || chr(10), NULL, 'code', 7 FROM (WITH {CODE} SELECT * FROM src)""",
    "domain_chunks": "SELECT n_name AS title, CASE n_regionkey WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS chunks, CASE n_regionkey WHEN 1 THEN 'code' WHEN 3 THEN '' ELSE 'heading' END AS type, n_regionkey <> 3 AS ok, CASE WHEN n_regionkey = 3 THEN 'unknown domain: video' ELSE '' END AS message FROM nation",
    "store_catalog": f"WITH {HIER} SELECT t AS table_name, t <> 'projects' AS present, CASE t WHEN 'documents' THEN (SELECT count(*) FROM d) WHEN 'l1' THEN (SELECT count(*) FROM d) WHEN 'l2' THEN (SELECT count(*) FROM l2b) WHEN 'l3' THEN (SELECT count(*) FROM l3) END AS n, t = 'documents' AS again FROM (SELECT unnest(['projects', 'documents', 'l1', 'l2', 'l3', 'keywords', 'l1_vectors', 'l3_vectors', 'edges', 'versions', 'collections']) AS t)",
    "vector_collections": f"WITH {HIER} SELECT 'l1_vectors' AS name, 36 AS size, 'cosine' AS distance, true AS refused, count(*) AS vectors FROM d UNION ALL SELECT 'l3_vectors', 36, 'cosine', true, count(*) FROM l3 WHERE embedded",
    "pipeline_versions": "SELECT 1::BIGINT AS id, 'masked-1' AS name, '{}' AS metadata, count(*) AS snapshots FROM region",
    "project_nodes": "SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS source_type, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INT) AS position FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)",
    "service_states": "SELECT * FROM (VALUES ('snapshots', CAST((SELECT count(*) FROM region) AS VARCHAR)), ('empty', 'degraded'), ('filled', 'ok'), ('path:' || substr(sha256('/data/x'), 1, 16), 'succeeded 3'), ('same', 'True'), ('hk:k', 'failed'), ('times', 'True')) AS t(what, state)",
    "query_terms": r"""WITH q AS (SELECT item_id, string_split_regex(lower('Of the text-item ' || item_id || '_x: ' || text || ' (end) v1.2_beta?'), '[\s,()\[\]{}?!#@=><|&]+') AS raw FROM benchmark),
      bare AS (SELECT item_id, list_transform(raw, lambda x: regexp_replace(x, '^[^a-z0-9_.-]+|[^a-z0-9_.-]+$', '', 'g')) AS b FROM q),
      every AS (SELECT item_id, flatten(list_transform(list_filter(b, lambda t: length(t) >= 2 AND t NOT IN ('a', 'an', 'the', 'of', 'in', 'on', 'at', 'to', 'is', 'or') AND length(regexp_replace(t, '[^a-z0-9]', '', 'g')) > 0),
        lambda t: list_prepend(t, list_filter(string_split_regex(t, '[-_]'), lambda p: length(p) >= 2 AND p NOT IN ('a', 'an', 'the', 'of', 'in', 'on', 'at', 'to', 'is', 'or') AND length(regexp_replace(p, '[^a-z0-9]', '', 'g')) > 0)))) AS e FROM bare),
      seen AS (SELECT item_id, term, min(i) AS i FROM (SELECT item_id, unnest(e) AS term, unnest(range(len(e))) AS i FROM every) GROUP BY 1, 2)
      SELECT item_id, string_agg(term, ' ' ORDER BY i) AS terms FROM seen GROUP BY 1""",
    "checked_parameters": r"""WITH g AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 2 THEN '' WHEN 3 THEN event_type END AS g FROM events), n AS (SELECT event_id, g, TRY_CAST(CASE WHEN regexp_matches(g, '^[+-]?[0-9]+$') THEN g END AS BIGINT) AS n FROM g)
      SELECT event_id, CASE WHEN n BETWEEN 1 AND 100 THEN n ELSE 5 END AS hits, n AS project, CASE WHEN g <> '' AND n IS NULL THEN 'bad_request' END AS error FROM n""",
    "settings_cases": """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) END, CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN 'env' || c_nationkey END, 'none') AS host,
      coalesce(CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) END, CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_name || ' ' END, CASE WHEN c_custkey % 2 = 0 THEN 'env' || c_nationkey END, '') AS first, CASE WHEN c_custkey % 7 <> 0 AND c_custkey > 50 THEN c_custkey - 50 ELSE 9 END AS project, CASE WHEN c_custkey % 4 = 0 THEN 3072 ELSE 1536 END AS size FROM customer""",
    "json_cases": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(props, ' ', '') WHEN 2 THEN '[1]' ELSE '{}' END AS json, CASE WHEN event_id % 4 = 0 THEN regexp_extract(props, '"k": ?([0-9]+)', 1) END AS k, event_type || CASE WHEN event_id % 4 = 3 THEN chr(65533) ELSE 'é' END AS summary FROM events""",
    "search_hybrid": f"""WITH {HIER}, q AS (SELECT {unit(f"'query: {ASKED}'")} AS v),
      scored AS (SELECT l3.*, {dots("e", "v")} / (sqrt({dots("e", "e")}) * sqrt({dots("v", "v")})) AS ds FROM (SELECT *, {unit("'passage: ' || content")} AS e FROM l3 WHERE embedded) l3, q),
      dense AS (SELECT l3_id, ds, row_number() OVER (ORDER BY ds DESC, l3_id) - 1 AS dr FROM scored QUALIFY dr < 8),
      said_ AS (SELECT l3_id, 0.1 * len(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t IN ('supplier', 'number', 'not', 'here'))) AS ss FROM l3),
      sparse AS (SELECT l3_id, ss, row_number() OVER (ORDER BY ss DESC, l3_id) - 1 AS sr FROM said_ WHERE ss > 0 QUALIFY sr < 60),
      fused AS (SELECT l3_id, coalesce(0.5::DOUBLE / (61 + dr), 0) + coalesce(0.5::DOUBLE / (61 + sr), 0) AS f, coalesce(ds, ss) AS score, dr, sr FROM dense FULL JOIN sparse USING (l3_id)),
      cut AS (SELECT * FROM fused ORDER BY f DESC, dr NULLS LAST, sr NULLS LAST LIMIT 8),
      best AS (SELECT l3.*, c.score, CAST(row_number() OVER (ORDER BY f DESC, l3_id) AS INT) AS rank FROM cut c JOIN l3 USING (l3_id) QUALIFY rank <= 5),
      around AS (SELECT b.l3_id, string_agg(a.content, chr(10) || chr(10) ORDER BY a.sort_order) AS surrounding_context FROM best b JOIN l3 a ON a.l2_id = b.l2_id AND a.sort_order BETWEEN b.sort_order - 2000 AND b.sort_order + 2000 GROUP BY 1)
      SELECT rank, b.l3_id, round(score, 5) AS score, b.title AS l1_title, coalesce(s.head, '') AS section_heading, b.content AS matched_content, '[문서: ' || b.title || '] > [섹션: ' || coalesce(s.head, '(section)') || ']' AS breadcrumb, surrounding_context FROM best b JOIN l2b s ON s.l2_id = b.l2_id JOIN around USING (l3_id)""",
}


def project_number(path: str) -> int:
    """H3: the id of a project's path."""
    n = int(hashlib.sha256(f"project:{path}".encode()).hexdigest()[:16], 16)
    return max(1, min(n, 2**64 - n, 2**63 - 1))


PLACES, OTHER = project_number("/data/places"), project_number("/data/other")
STORE_ORACLES["project_registry"] = f"""WITH {hierarchy(PLACES)}, m AS (SELECT {folded("sha256(doc_key)")} AS machine_id, l2_child_hash AS h FROM d JOIN kids USING (l1_id)), merkle AS (SELECT sha256(unhex(string_agg(lpad(hex(machine_id), 16, '0') || h, '' ORDER BY machine_id))) AS content_hash FROM m)
  SELECT {PLACES}::BIGINT AS id, 'places' AS name, '/data/places' AS root_path, '{{"owner":"me"}}' AS metadata, content_hash, true AS up_to_date FROM merkle UNION ALL SELECT {OTHER}, 'other', '/data/other', '{{}}', NULL, NULL"""
