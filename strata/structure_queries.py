"""Registered queries of code, traversal, trees and splitters, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import oracles
from strata.operators import embedding, graphs, index, parse, rank, sentences
from strata.queries import TERMS, query, rounded, table

ORACLES: dict[str, str] = {}

# Parsed code

HEAD = ['"""Stock of {name}', "def not_code(): pass", '"""', "import os", "", '@register("class X:")', "class Supplier_{key}:", "    def parts(self):", "        return ["]
TAIL = ["        ]", "", "    def price(self, n):", "        if n == {nation}:", "            return {key}", "        else:", "            def inner():  # if {name}:", "                return n", "            return inner()"]
#: Up to so many parts, their lines (84 MB) are sent to all tasks; more are joined by a shuffle.
SENT = 4_000_000


def supplier_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier: a class with a decorator, closures and strings of more lines, and a list of the parts whose key leaves the same rest by 100."""

    def filled(lines: list[str]) -> F.Column:
        text = F.lit("\n".join(lines))
        for mark, column in (("{name}", "s_name"), ("{key}", "s_suppkey"), ("{nation}", "s_nationkey")):
            text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
        return text

    part = table(spark, sf_dir, "part")
    keys = part.groupBy((F.col("p_partkey") % 100).alias("rest")).agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    # the lines of parts are made once for all suppliers of a rest
    listed = keys.select("rest", F.array_join(F.transform("keys", lambda k: F.concat(F.lit("            "), k.cast("string"), F.lit(","))), "\n").alias("listed"))
    # files are far longer than their suppliers' rows, so rows are dealt out before, as the parser wants them, and the parts' lines (about 21 bytes each) are brought to them
    dealt = table(spark, sf_dir, "supplier").repartition(4 * spark.sparkContext.defaultParallelism, parse.placed("s_suppkey"))
    rows = dealt.join(F.broadcast(listed) if part.count() <= SENT else listed, F.col("s_suppkey") % 100 == F.col("rest"), "left")
    return rows.select(F.col("s_suppkey").alias("doc"), F.concat_ws("\n", filled(HEAD), "listed", filled(TAIL)).alias("content"))


@query
def parsed_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the suppliers' files as nodes."""
    return parse.parse_lines(supplier_code(spark, sf_dir), "doc", F.col("content"), "python")


#: (node type, is it an anchor, does it begin a block, line it lies in, line of the anchor around it), for each line of HEAD and TAIL.
_NODES = [
    ("expression_statement", False, True, 0, 0), ("continuation", False, False, 0, 0), ("continuation", False, False, 0, 0), ("import_statement", False, False, 0, 0), ("empty_line", False, False, 0, 0), ("decorated_definition", True, True, 0, 0), ("class_definition", True, True, 0, 0),
    ("function_definition", True, True, 0, 7), ("return_statement", False, True, 8, 8), ("continuation", False, False, 8, 8), ("empty_line", False, False, 8, 8), ("function_definition", True, True, 0, 7), ("if_statement", True, True, 0, 12), ("return_statement", False, False, 13, 13),
    ("else_clause", True, True, 0, 12), ("function_definition", True, True, 0, 15), ("return_statement", False, False, 16, 16), ("return_statement", False, False, 15, 15),
]


def _rows() -> str:
    shown = [f"({i}, '{line.replace(chr(39), chr(39) * 2)}', '{kind}', {anchor}, {block}, {parent}, {scope})" for i, (line, (kind, anchor, block, parent, scope)) in enumerate(zip(HEAD + TAIL, _NODES, strict=True), 1)]
    return ", ".join(shown)


ORACLES["parsed_python"] = f"""
WITH t(pos, line, node_type, is_anchor, is_block_start, p, s) AS (VALUES {_rows()}),
  sup AS (SELECT s_suppkey AS doc, s_name, s_nationkey, (SELECT count(*) FROM part WHERE p_partkey % 100 = s_suppkey % 100) AS n FROM supplier),
  listed AS (SELECT s_suppkey AS doc, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) AS r FROM supplier JOIN part ON p_partkey % 100 = s_suppkey % 100)
SELECT doc, CAST(pos + CASE WHEN pos > 9 THEN n ELSE 0 END AS INT) AS line_num, replace(replace(replace(line, '{{name}}', s_name), '{{key}}', CAST(doc AS VARCHAR)), '{{nation}}', CAST(s_nationkey AS VARCHAR)) AS content, node_type, is_anchor, is_block_start,
  CAST(p - 1 + CASE WHEN p > 9 THEN n ELSE 0 END AS INT) AS parent_idx, CAST(s - 1 + CASE WHEN s > 9 THEN n ELSE 0 END AS INT) AS scope_idx FROM t, sup
UNION ALL SELECT doc, CAST(9 + r AS INT), '            ' || p_partkey || ',', 'continuation', false, false, 7, 7 FROM listed"""


def nation_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go file for each nation, with a function for each of its suppliers."""
    f = F.concat(F.lit("func S"), F.col("s_suppkey").cast("string"), F.lit("(n int) int { // }\n\tif n > 0 {\n\t\treturn "), F.col("s_suppkey").cast("string"), F.lit("\n\t}\n\treturn len(`}\nfunc x() {`)\n}\n\n"))
    held = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", f.alias("f")))), lambda x: x.getField("f")), "").alias("body"))
    rows = table(spark, sf_dir, "nation").join(held, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select(F.col("n_nationkey").alias("doc"), F.concat(F.lit('package main\n\nimport (\n\t"fmt"\n)\n\n'), F.coalesce("body", F.lit("")), F.lit("type "), F.initcap("n_name"), F.lit(" struct {\n\ta int\n}\n")).alias("content"))


@query
def parsed_go_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarations of the nations' files."""
    return parse.parse_toc(parse.parse_lines(nation_go(spark, sf_dir), "doc", F.col("content"), "go"), "doc")


ORACLES["parsed_go_toc"] = """
WITH n AS (SELECT n_nationkey AS doc, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation),
  f AS (SELECT s_nationkey AS doc, s_suppkey, 7 + 8 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS a FROM supplier)
SELECT doc, 'package main' AS text, 2 AS level, 'package_clause' AS node_type, 1 AS start_line, 1 AS end_line FROM n
UNION ALL SELECT doc, 'import (', 2, 'import_declaration', 3, 5 FROM n
UNION ALL SELECT doc, 'S' || s_suppkey, 2, 'function_declaration', CAST(a AS INT), CAST(a + 6 AS INT) FROM f
UNION ALL SELECT doc, 'type ' || array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(n_name, ' ')], ' ') || ' struct {', 2, 'type_declaration', CAST(7 + 8 * n AS INT), CAST(9 + 8 * n AS INT) FROM n"""

# Traversal and trees


@query
def customer_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as edges from their customer to the one whose key is that of the order by the number of customers; what every 50th customer reaches, and in how many steps."""
    customers = table(spark, sf_dir, "customer")
    n = customers.agg(F.max("c_custkey").alias("n")).first()["n"]
    edges = table(spark, sf_dir, "orders").where("o_orderpriority like '1-%'").select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 7 + 3, F.lit((n or 0) + 1)).alias("dst"))
    return graphs.reach(edges, customers.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node")))


ORACLES["customer_reach"] = """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7 + 3) % (SELECT max(c_custkey) + 1 FROM customer) AS dst FROM orders WHERE o_orderpriority LIKE '1-%'),
  r(node, distance) USING KEY (node) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey % 50 = 0
    UNION SELECT e.dst, min(r.distance) + 1 FROM r JOIN e ON e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = e.dst) GROUP BY e.dst)
SELECT node, distance FROM r"""


@query
def nation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation the JSON of its customers, each with its orders by price."""
    customers = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("none").alias("parent_id"), F.col("n_nationkey").alias("tree"), F.col("n_name").alias("title"), F.lit(0.0).alias("price"))
    people = customers.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_nationkey").alias("tree"), F.col("c_name").alias("title"), F.lit(0.0).alias("price"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.col("c_nationkey").alias("tree"), F.col("o_orderstatus").alias("title"), F.col("o_totalprice").cast("double").alias("price"))
    found = graphs.nested_json(nation.unionByName(people).unionByName(orders), "tree", ["id", "title"], ["price"])
    return found.select("tree", F.sha2("json", 256).alias("json_hash"), F.length("json").alias("chars"), "nodes")


ORACLES["nation_trees"] = """
WITH o AS (SELECT o_custkey, count(*) AS n, string_agg('{"id":"o' || o_orderkey || '","title":"' || o_orderstatus || '","children":[]}', ',' ORDER BY o_totalprice, 'o' || o_orderkey) AS j FROM orders GROUP BY 1),
  c AS (SELECT c_nationkey, count(*) + coalesce(sum(n), 0) AS n, string_agg('{"id":"c' || c_custkey || '","title":"' || c_name || '","children":[' || coalesce(j, '') || ']}', ',' ORDER BY 'c' || c_custkey) AS j FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1),
  t AS (SELECT n_nationkey AS tree, '[{"id":"n' || n_nationkey || '","title":"' || n_name || '","children":[' || coalesce(j, '') || ']}]' AS json, 1 + coalesce(n, 0) AS nodes FROM nation LEFT JOIN c ON c_nationkey = n_nationkey)
SELECT tree, sha256(json) AS json_hash, CAST(length(json) AS INT) AS chars, CAST(nodes AS BIGINT) AS nodes FROM t"""

# Search structures


@query
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as dense_topk_batch, by an inverted file that skips lists that can't hold a nearer vector."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rounded(index.VectorIndex.build(rows, "vec_id", "embedding").top_each(asked, 5, exact=True))


ORACLES["vector_index_topk"] = oracles.ORACLES["dense_topk_batch"]


@query
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten nearest of each query, how many the inverted file finds with as many probes as its own sample asks for (at least nine in ten over all)."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    built = index.VectorIndex.build(rows, "vec_id", "embedding")
    probes = built.probes_for(0.97)
    found, all_ = (built.top_each(asked, 10, probes=probes, exact=exact).select("query_id", "vec_id") for exact in (False, True))
    hits = all_.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("*").alias("pairs"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


ORACLES["vector_index_recall"] = "SELECT 10 * count(*) AS pairs, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


@query
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as lexical_topk, by posting lists."""
    return rounded(index.Postings.build(table(spark, sf_dir, "documents"), "doc_id", "text").top(TERMS, 60))


ORACLES["postings_topk"] = oracles.ORACLES["lexical_topk"]



@query
def benchmark_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the first half of each benchmark text finds the text, by a hashed embedding fitted on all of them."""
    rows = table(spark, sf_dir, "benchmark")
    embed = embedding.HashedModel.fit(rows, "text", 4096, 64).embedder()
    vectors = rows.select("item_id", embed(F.col("text")).alias("vector"))
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    asked = rows.select(F.col("item_id").alias("query_id"), embed(half).alias("query_vector"))
    run = rank.dense_top_each(vectors, asked, 10, "item_id", "vector").select("query_id", F.col("item_id").alias("id"), "rank")
    relevant = rows.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("id"))
    found = rank.retrieval_metrics(run, relevant)
    return found.select(*(F.round(c, 4).alias(c) for c in found.columns))


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
ORACLES["benchmark_retrieval"] = f"""
WITH t AS (SELECT item_id, 0 AS half, {_WORDS.format("text")} AS w FROM benchmark UNION ALL SELECT item_id, 1, {_WORDS.format("left(text, CAST(floor(length(text) / 2) AS INT))")} FROM benchmark),
  f AS (SELECT item_id, half, unnest(w) AS word FROM t),
  k AS (SELECT word, {oracles.CRC_SQL.format("h")} % 4096 AS b FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM f), ({oracles.CRC_TABLE})),
  d AS (SELECT b, ln((SELECT count(*) FROM benchmark) + 1.0::DOUBLE) - ln(count(DISTINCT item_id) + 1.0::DOUBLE) AS weight FROM f JOIN k USING (word) WHERE half = 0 GROUP BY b),
  v AS (SELECT item_id, half, b % 64 AS dim, sum(CASE WHEN (b // 64) % 2 = 0 THEN weight ELSE -weight END) AS x FROM f JOIN k USING (word) JOIN d USING (b) GROUP BY 1, 2, 3),
  n AS (SELECT item_id, half, sqrt(sum(x * x)) AS n FROM v GROUP BY 1, 2),
  s AS (SELECT a.item_id AS q, c.item_id AS i, sum(a.x * c.x) / (any_value(na.n) * any_value(nc.n)) AS s FROM v a JOIN v c ON a.dim = c.dim JOIN n na ON na.item_id = a.item_id AND na.half = 1 JOIN n nc ON nc.item_id = c.item_id AND nc.half = 0 WHERE a.half = 1 AND c.half = 0 GROUP BY 1, 2),
  r AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY s DESC, i) AS rank FROM s),
  m AS (SELECT item_id, rank FROM benchmark LEFT JOIN r ON q = item_id AND i = item_id AND rank <= 10)
SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr_10, round(avg(coalesce(1.0::DOUBLE / log2(rank + 1), 0)), 4) AS ndcg_10, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE / 3 ELSE 0 END), 4) AS p_3 FROM m"""

# Splitters (U5, U6, U7, U11; their queries are in queries and store_queries)

_DOT = "chr(64976)"


def _list_sql(key: str, parts: str, source: str) -> str:
    """The non-blank parts of a list, trimmed and with stops turned back, with their places."""
    kept = f"list_filter(list_transform({parts}, lambda x: regexp_replace(replace(x, {_DOT}, '.'), '{oracles.WS}', '', 'g')), lambda x: x <> '')"
    return f"SELECT {key}, CAST(i - 1 AS INT) AS pos, p[i] AS sentence FROM (SELECT {key}, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT {key}, {kept} AS p FROM {source}))"


#: The spans of documents are decimal numbers: their stops are hidden, two numbers at a time from the left.
_HIDDEN = f"docs AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '([0-9]+)\\.([0-9]+)', '\\1' || {_DOT} || '\\2', 'g') AS t FROM documents)"
ORACLES["masked_sentence_split"] = f"WITH {_HIDDEN} {_list_sql('doc_id', chr(39).join(['string_split_regex(t, ', '[.!?。！？…]+', ')']), 'docs')}"

_TITLES = sentences.TITLES
_ONCE = f"regexp_replace({{0}}, '(?i)(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])({_TITLES})\\.(\\s)', '\\1\\2' || {_DOT} || '\\3', 'g')"
_INITIALS = f"regexp_replace({{0}}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_.])(\\p{{{{Lu}}}})\\.(\\s+\\p{{{{Lu}}}})', '\\1\\2' || {_DOT} || '\\3', 'g')"
_SPACES = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_CLOSED = f"regexp_replace(u, '([.!?。！？…][\"''”’»)\\]]{{{{0,3}}}}){_SPACES}+', '\\1' || chr(30), 'g')"
ORACLES["language_aware_split"] = (
    f"WITH {_HIDDEN}, calm AS (SELECT doc_id, regexp_replace({_INITIALS.format(_INITIALS.format(_ONCE.format(_ONCE.format('t'))))}, '\\.{{2,}}(\\s+\\p{{Ll}})', repeat({_DOT}, 3) || '\\1', 'g') AS u FROM docs) "
    + _list_sql("doc_id", f"string_split_regex({_CLOSED}, chr(30) || '|\\n+')".replace("{{", "{").replace("}}", "}"), "calm")
)


def _cuts_sql(key: str, source: str, most: int) -> str:
    """Pieces one after the other: the farthest break of each kind in what is left."""
    window, wider = f"left(rest, {most})", f"left(rest, {most + 1})"
    plain = " , ".join([f"length(regexp_extract({window}, '(?s)^(.*[\\n,|;)}}])', 1))", f"length(regexp_extract({wider}, '(?s)^(.*[.!?]){_SPACES}', 1))", f"length(regexp_extract({window}, '(?s)^(.*\\n-)', 1))", f"CASE WHEN 2 * length(regexp_extract({window}, '(?s)^(.*{_SPACES})', 1)) >= {most} THEN length(regexp_extract({window}, '(?s)^(.*{_SPACES})', 1)) ELSE 0 END"])
    bracket = f"length(regexp_extract({window}, '(?s)^(.+[({{])', 1))"
    cut = f"CASE WHEN length(rest) <= {most} THEN length(rest) WHEN b > a THEN b - 1 WHEN a > 0 THEN a ELSE {most} END"
    step = f"SELECT {key}, n, rest, {cut} AS e FROM (SELECT *, greatest({plain}) AS a, {bracket} AS b FROM r WHERE rest <> '')"
    trimmed = f"regexp_replace({{0}}, '{oracles.WS}', '', 'g')"
    return f"""WITH RECURSIVE r AS (SELECT {key}, 0 AS n, '' AS piece, {trimmed.format("coalesce(text, '')")} AS rest FROM {source}
    UNION ALL SELECT {key}, n + 1, {trimmed.format("left(rest, e)")}, {trimmed.format("substr(rest, e + 1)")} FROM ({step}))
  SELECT {key}, 's' || (n - 1) AS section_id, CAST(n - 1 AS INT) AS chunk_no, piece AS text FROM r WHERE n > 0"""


ORACLES["fixed_size_chunks"] = _cuts_sql("doc_id", "documents", 1000)
ORACLES["fixed_cuts"] = _cuts_sql("id", "(SELECT conv_id || '-' || turn AS id, text FROM conversations)", 60)

_SPANS = ["'v' || n || '.2.3'", "'core/p' || k || '.md'", "'https://a.b/' || k || '.html'", "'[x. ' || n || '](y. z)'", "'1.' || n", "'4.1.' || n || '~4.2.' || n", "'e.g.'"]
_NOTE = "'1. See v' || n || '.2.3 and core/p' || k || '.md. Open https://a.b/' || k || '.html now! [x. ' || n || '](y. z) is 1.' || n || '? Then 4.1.' || n || '~4.2.' || n || ', e.g. here.' || chr(10) || chr(10) || 'Last'"
_PARTS = "p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, CAST(p_partkey AS VARCHAR) AS k FROM part)"
ORACLES["protected_spans"] = f"WITH {_PARTS}, s AS (SELECT p_partkey, note, unnest(spans) AS span FROM (SELECT p_partkey, {_NOTE} AS note, [{', '.join(_SPANS)}] AS spans FROM p)) SELECT p_partkey, CAST(CASE WHEN span LIKE '1.%' THEN strpos(note, 'is ' || span) + 2 ELSE strpos(note, span) - 1 END AS INT) AS start, span, true AS restored FROM s"
_SAID = ["'1. See v' || n || '.2.3 and core/p' || k || '.md{0}'", "'Open https://a.b/' || k || '.html now{1}'", "'[x. ' || n || '](y. z) is 1.' || n || '{2}'", "'Then 4.1.' || n || '~4.2.' || n || ', e.g. here{0}'", "'Last'"]
ORACLES["split_cases"] = f"WITH {_PARTS}, s AS (SELECT p_partkey, false AS ends, [{', '.join(x.format('', '', '') for x in _SAID)}] AS l FROM p UNION ALL SELECT p_partkey, true, [{', '.join(x.format('.', '!', '?') for x in _SAID)}] FROM p) SELECT p_partkey, ends, CAST(i - 1 AS INT) AS pos, l[i] AS sentence FROM (SELECT *, unnest(range(1, 6)) AS i FROM s)"
