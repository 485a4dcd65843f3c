"""The registered queries: each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import coerce, ids
from strata.functions import text as X
from strata.operators import admin, code, context, graphs, markdown, rank, sentences
from strata.plans import hierarchy, service

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sentences of documents


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, sentence: non-blank parts between sentence ends, with their place among all parts."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", X.SENTENCE_END, -1)).alias("pos", "part"))
    return parts.select("doc_id", "pos", X.trim_ws(F.col("part")).alias("sentence")).where("sentence <> ''")


@query
def sentence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir)


def ranked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = document_sentences(spark, sf_dir).groupBy("doc_id", "sentence").agg(F.min("pos").alias("pos"))
    return first.withColumn("sort_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) * 1000)


@query
def sentence_dedup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_sentences(spark, sf_dir).select("doc_id", "sort_order", "sentence")


@query
def sentence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked_sentences(spark, sf_dir)
    parent = F.lag("sort_order").over(Window.partitionBy("doc_id").orderBy("sort_order"))
    return rows.select("doc_id", "sort_order", F.coalesce(parent, F.lit(-1)).alias("parent_order"), ids.sha_hex(F.col("sentence")).alias("content_hash"))


# Hashes, identity, no-op detection


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.sha_hex(F.col("text")).alias("content_hash"))


@query
def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.sha_hex(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query
def ingest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't copies of one with a lower id: what an ingest in order of ids would write."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", ids.sha_hex(F.col("text")).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"))
    stored = rows.join(first, "content_hash").where("doc_id > first_doc").select("doc_id")
    return rows.join(stored, "doc_id", "left_anti").select("doc_id", "source", "content_hash")


@query
def section_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: of each conversation, its turns as sections."""
    rows = table(spark, sf_dir, "conversations")
    chunks = rows.select("conv_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), F.lit("heading").alias("section_type"), F.col("role").alias("path"), "text")
    return markdown.chunk_hash(chunks, "conv_id")


@query
def project_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: of each nation, its suppliers as documents."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("machine_id"), ids.sha_hex(F.col("s_name")).alias("child_hash"))
    return admin.merkle(rows, "project_id", "machine_id", "child_hash")


@query
def project_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each nation's hash over names is the one over upper-cased names (those written in upper case already)."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), "n_name")
    fresh = rows.select("project_id", ids.sha_hex(F.col("n_name")).alias("content_hash"))
    stored = rows.select("project_id", ids.sha_hex(F.upper("n_name")).alias("content_hash"))
    return admin.up_to_date(fresh, stored, "project_id")


@query
def keyword_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of each document with their ids."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.keywords(F.col("text"))).alias("keyword"))
    return rows.select("doc_id", "keyword", ids.keyword_id(F.col("keyword")).alias("keyword_id"))


@query
def keyword_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keywords of all documents, and in how many they are."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.keywords(F.col("text"))).alias("canonical_name"))
    counted = rows.groupBy("canonical_name").agg(F.count("*").alias("documents"))
    return counted.select(ids.keyword_id(F.col("canonical_name")).alias("machine_id"), "canonical_name", "documents")


@query
def project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, H4, H6 of paths made of nations."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("/data/./"), "n_name", F.lit("//wiki/")).alias("root_path"))
    return rows.select(ids.clean_path(F.col("root_path")).alias("root_path"), ids.project_id(F.col("root_path")).alias("project_id"), ids.uuid_of(F.col("root_path")).alias("point_id"), ids.idempotency_key(F.lit(""), F.col("root_path")).alias("job_key"))


# The hierarchy of conversations


def conversation_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, sort_order, content: sentences of turns as atoms of sections."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(X.sentences(F.col("text"))).alias("pos", "content"))
    return rows.select("conv_id", "turn", "role", ((F.col("pos") + 1) * 1000).alias("sort_order"), "content")


@query
def conv_hierarchy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms with section and document."""
    atoms = conversation_atoms(spark, sf_dir)
    l2 = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("heading"), ((F.col("turn") + 1) * 1000).alias("section_order"))
    l1 = l2.groupBy("conv_id").agg(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), F.count("*").alias("sections"))
    rows = atoms.join(l2, ["conv_id", "turn"]).join(l1, "conv_id")
    return rows.select("conv_id", "turn", "sort_order", "section_order", "sections", "content", X.breadcrumb(F.col("title"), F.col("heading"), "document", "section").alias("breadcrumb"))


@query
def title_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section with the first atom of the user's turn before it, if there is one."""
    atoms = conversation_atoms(spark, sf_dir)
    titles = atoms.where("sort_order = 1000 and role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("section_heading"))
    l2 = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return l2.join(titles, ["conv_id", "turn"], "left")


@query
def neighbor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every atom with the texts around it in its section."""
    atoms = conversation_atoms(spark, sf_dir).withColumn("l2_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return context.neighbour_frame(atoms).select("l2_id", "sort_order", "content", "surrounding_context")


@query
def neighbor_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest atom of each section and those within 1500 of it."""
    atoms = conversation_atoms(spark, sf_dir).withColumn("l2_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    order = Window.partitionBy("l2_id").orderBy(F.desc(F.length("content")), "sort_order")
    hits = atoms.withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("l2_id").alias("l3_id"), "l2_id", "sort_order")
    return context.neighbours(hits, atoms, context.LEVEL2)


@query
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leading sentences of each turn fit 40 tokens."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.sentences(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("sentences"), F.size(context.within_budget(F.col("s"), F.lit(40))).alias("kept"))


@query
def restore_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined by blank lines, their sentences by spaces."""
    blocks = conversation_atoms(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "content"))), lambda x: x.getField("content")), " ").alias("block"))
    full = blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x.getField("block")), "\n\n").alias("content"))
    return full


@query
def restore_rows_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation joined as Markdown and as code."""
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.getField("text")).alias("rows"))
    return held.select("conv_id", F.length(X.join_rows(F.col("rows"), F.lit("md"))).alias("md_chars"), ids.sha_hex(X.join_rows(F.col("rows"), F.lit("code"))).alias("code_hash"))


@query
def l1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations summed up by their turns, cut at 1200 bytes."""
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.getField("text")).alias("s"))
    return held.select("conv_id", X.summary_of_document(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")), F.col("s")).alias("summary"))


# Ranking (T1-T6, R3, R5, A9, A14)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def first_vector(spark: SparkSession, sf_dir: str) -> tuple[list[float], int]:
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding", "label").first()
    return ([float(x) for x in row["embedding"]], row["label"]) if row else ([], 0)


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 vectors nearest to the first."""
    return rounded(rank.dense_top(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir)[0], 30, "vec_id", "embedding"))


@query
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the 10 nearest with the first vector's label."""
    vector, label = first_vector(spark, sf_dir)
    return rounded(rank.dense_top(table(spark, sf_dir, "embeddings"), vector, 10, "vec_id", "embedding", F.col("label") == label))


def queried_vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The query set: every vector whose id is divisible by 100, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rank.dense_top_each(rows, asked, k, "vec_id", "embedding")


@query
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(queried_vectors(spark, sf_dir, 5))


@query
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: the sum of each unit vector's components."""
    total = F.aggregate(ids.unit(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 5).alias("total"), F.size("embedding").alias("dim"))


TERMS = ["the", "and", "this"]


@query
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how often they have the terms."""
    return rounded(rank.lexical_top(table(spark, sf_dir, "documents"), TERMS, 60, "doc_id", "text"))


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors to the first fused with those of its label nearest to it in the other direction."""
    rows = table(spark, sf_dir, "embeddings")
    vector, label = first_vector(spark, sf_dir)
    dense = rank.dense_top(rows, vector, 30, "vec_id", "embedding")
    other = rank.dense_top(rows, vector, 20, "vec_id", "embedding", F.col("label") == label)
    return rounded(rank.fuse(dense, other, "vec_id", alpha=0.5)).withColumn("fused", F.round("fused", 8))


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical rankings of documents, one of them by a rarer term, fused and cut to 10."""
    docs = table(spark, sf_dir, "documents")
    a = rank.lexical_top(docs, ["the"], 30, "doc_id", "text")
    b = rank.lexical_top(docs, ["to", "of"], 60, "doc_id", "text")
    return rounded(rank.fuse(a, b, "doc_id", alpha=0.6, limit=10)).withColumn("fused", F.round("fused", 8))


@query
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical candidates ordered anew by the share of terms that they have; the best 5."""
    docs = table(spark, sf_dir, "documents")
    found = rank.lexical_top(docs, ["the", "and", "le"], 60, "doc_id", "text")
    best = rank.rerank(found, docs, rank.overlap_score("the-of and le un der"), "doc_id", "text")
    return best.limit(5).select("doc_id", F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))


@query
def first_hit_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, as the first hit of each section."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("l2_id"), F.lit("").alias("l1_id"), F.col("event_id").alias("rank"))
    return rank.first_per_section(rows, "rank").select("l2_id", "rank")


@query
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 (extension): vectors of the query's label are relevant."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(rows.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    run = queried_vectors(spark, sf_dir, 10).select("query_id", F.col("vec_id").alias("id"), "rank")
    out = rank.retrieval_metrics(run, relevant)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


# Hits and their shapes


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("l1_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("l2_id"), F.when(F.col("turn") % 3 > 0, F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("matched_l3_id"), F.col("role").alias("l1_title"), F.col("text").alias("matched_content"), F.when(F.col("turn") % 2 == 0, F.col("turn") / 4).alias("score"), F.col("conv_id").cast("string").alias("project_id"))


@query
def search_hits_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.normalise_hits(raw_hits(spark, sf_dir), 60).select(*service.chosen_fields("summary"))


@query
def search_hits_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.normalise_hits(raw_hits(spark, sf_dir), 60).select(*service.chosen_fields("standard"))


@query
def search_hits_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen fields as JSON without nulls."""
    return service.as_json(service.normalise_hits(raw_hits(spark, sf_dir), 60), service.chosen_fields("full", " L3_id, score ,project_id,l3_id"))


@query
def agent_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an answering loop is shown them."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("l1_id"), F.col("lang").alias("l2_id"), F.col("doc_id").alias("l3_id"), F.col("source").alias("title"), F.col("lang").alias("section_heading"), F.col("text").alias("l2_summary"), F.col("text").alias("matched_content"), F.col("text").alias("surrounding_context"), (F.col("n_chars") / 7).alias("score"))
    return service.for_agent(rows)


# Graphs (K15, J9, J16, J18, R4)


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.lit(1).cast("bigint").alias("project"))
    return graphs.directory_edges(rows, "page_id", "path", "project")


@query
def directory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_edges(spark, sf_dir)


@query
def sibling_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in a directory with one of the seeds (ids divisible by 100)."""
    edges = page_edges(spark, sf_dir)
    seeds = edges.where("file % 100 = 0").select("project", "file").distinct()
    return graphs.siblings(edges, seeds)


@query
def graph_expansion_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, 3 at most."""
    edges = page_edges(spark, sf_dir)
    seeds = edges.where("file % 100 = 0").select("project", "file").distinct()
    return graphs.siblings(edges, seeds, 3)


@query
def first_atom_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation that has more than three."""
    rows = table(spark, sf_dir, "conversations")
    related = rows.groupBy(F.col("conv_id").alias("l1_id")).count().where("count > 3")
    l2 = rows.select(F.col("conv_id").alias("l1_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("l2_id"), F.col("turn").alias("sort_order"))
    l3 = l2.select("l2_id", F.concat("l2_id", F.lit("#0")).alias("l3_id"), F.lit(0).alias("sort_order"))
    return graphs.first_atoms(related, l2, l3)


@query
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph: how many documents mention each keyword id (distinct edges)."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("l3_id"), F.col("text").alias("content"))
    return hierarchy.mention_edges(rows).groupBy(F.col("dst").alias("keyword_id")).agg(F.count("*").alias("mentions"))


# Projects (J13, A1, F11, K17, K1, K12, W5, W6)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("planet").alias("parent_id"), F.col("r_name").alias("title"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("title"))
    return region.unionByName(nation)


@query
def project_tree_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations; a parent that isn't there makes a root."""
    return admin.roots(places(spark, sf_dir))


def customer_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations as documents of their region's project, customers as snapshots, orders as sections, lineitems as atoms."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_key"), F.col("n_regionkey").cast("bigint").alias("project_id"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey").cast("string") == F.col("doc_key")).select(F.col("c_custkey").alias("l1_id"), "project_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l1_id"), F.col("o_orderkey").alias("l2_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("l2_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("l3_id"))
    return {"documents": nation, "l1": customer, "l2": orders, "l3": items}


@query
def scoped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of project 2 by table."""
    return admin.counts(admin.scoped(*customer_tables(spark, sf_dir).values(), 2))


@query
def scoped_reset_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay by table when project 2 goes."""
    return admin.counts(admin.without(customer_tables(spark, sf_dir), 2))


@query
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type."""
    return admin.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query
def head_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer, the order that is current (the dearest over 300000), else the latest."""
    orders = table(spark, sf_dir, "orders")
    dear = orders.where("o_totalprice > 300000").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("current"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(dear, "o_custkey", "left")
    return admin.heads(docs, orders, "o_custkey", "o_orderkey", "o_orderdate")


@query
def exists_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order that has a lineitem."""
    t = customer_tables(spark, sf_dir)
    return admin.complete(t["l1"], t["l2"], t["l3"]).select("l1_id", "project_id")


@query
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: customers with a balance as stored documents, those of segment BUILDING as the new batch, without a project."""
    rows = table(spark, sf_dir, "customer")
    old = rows.where("c_acctbal > 0").select(F.col("c_custkey").alias("machine_id"), F.col("c_name").alias("title"), F.col("c_nationkey").cast("bigint").alias("project_id"), F.lit(1).alias("version"))
    new = rows.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("machine_id"), F.upper("c_name").alias("title"), F.lit(None).cast("bigint").alias("project_id"), F.lit(1).alias("version"))
    return admin.upsert_versions(old, new, "machine_id").withColumn("project_id", F.coalesce("project_id", F.lit(-1).cast("bigint")))


@query
def project_meta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers' metadata merged with new entries for those with a balance under 0."""
    rows = table(spark, sf_dir, "supplier")
    old = rows.select(F.col("s_name").alias("root_path"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("state"), F.lit("old")).alias("source_metadata"))
    new = rows.where("s_acctbal < 0").select(F.col("s_name").alias("root_path"), F.create_map(F.lit("state"), F.lit("debt"), F.lit("note"), F.lit("call")).alias("source_metadata"))
    merged = admin.upsert_projects(old, new)
    return merged.select("root_path", *(F.try_element_at("source_metadata", F.lit(k)).alias(k) for k in ("nation", "state", "note")), F.size("source_metadata").alias("entries"))


@query
def metadata_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of each event's JSON properties."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(coerce.flat_metadata(F.col("props"))).alias("key", "value"))
    return rows.select("event_id", "key", "value")


@query
def ingest_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: events as lines of a log."""
    log = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_type") == "click", "[md] ").when(F.col("event_type") == "view", "[code] ").otherwise("[other] "), F.when(F.col("value") > 50, "OK").otherwise("skip")).alias("line"))
    return admin.ingest_summary(log)


@query
def dependency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded if any order failed."""
    deps = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"))
    return admin.rolled_up(deps)


# Markdown made of the tables


def region_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each region: its name, a heading for each nation, a sentence for each of its suppliers."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(x.getField("s_name"), F.lit(" is here."))), "\n").alias("lines"))
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    part = F.concat(F.lit("## "), F.col("n_name"), F.lit("\n"), F.coalesce("lines", F.lit("")), F.lit("\n### Notes\nnone\n"))
    held = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("p")))), lambda x: x.getField("p")), "").alias("body"))
    r = table(spark, sf_dir, "region")
    return r.join(held, r["r_regionkey"] == held["n_regionkey"], "left").select(F.col("r_regionkey").alias("doc"), F.concat(F.lit("intro of "), F.col("r_name"), F.lit("\n# "), F.col("r_name"), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("content"))


@query
def heading_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.headings(region_markdown(spark, sf_dir), "doc", "content").select("doc", "section_id", "level", "text", "path", "parent_section_id")


@query
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(region_markdown(spark, sf_dir), "doc", "content").select("doc", "chunk_no", "section_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query
def toc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return markdown.toc_json(markdown.sections(region_markdown(spark, sf_dir), "doc", "content"), "doc")


def part_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each part brand: heading, prose, pipe table of parts, a list, a fence, an image."""
    row = F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    held = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x.getField("r")), "\n").alias("rows"))
    body = F.concat(F.lit("# "), "p_brand", F.lit("\nParts of the brand. See v1.2.3 of list.md!\n| name | size |\n| --- | ---: |\n"), "rows", F.lit("\n\n1. first item\n   more of it\n2. second item\n\n```sql\nselect 1\n\n  from t\n```\n![logo](https://example.com/a.png)\nLast words.\n"))
    return held.select(F.col("p_brand").alias("doc"), body.alias("content"))


@query
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each brand's table."""
    found = F.regexp_extract("content", r"(?s)(\| name .*?\|)\n\n", 1)
    rows = part_markdown(spark, sf_dir).select("doc", F.posexplode(X.table_rows(found)).alias("pos", "row"))
    return rows.select("doc", "pos", F.get(X.pipe_cells(F.col("row")), F.lit(0)).alias("name"), F.get(X.pipe_cells(F.col("row")), F.lit(1)).alias("size"))


@query
def structured_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each brand's document."""
    chunks = markdown.expand_blocks(markdown.sections(part_markdown(spark, sf_dir), "doc", "content"), "doc")
    return chunks.select("doc", "chunk_no", "section_id", "section_type", "path", "parent_section_id", ids.sha_hex(F.col("text")).alias("text_hash"), "metadata")


@query
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of document sentences."""
    rows = document_sentences(spark, sf_dir).select("doc_id", "pos", F.posexplode(X.clauses(F.col("sentence"))).alias("clause_no", "clause"))
    return rows


@query
def masked_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents with protected spans kept whole."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.masked_sentences(F.col("text"))).alias("pos", "sentence"))


@query
def language_aware_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their punctuation."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.language_aware(F.col("text"))).alias("pos", "sentence"))


@query
def fixed_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1000 characters."""
    return markdown.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


# Code (U15, U16, A7, W10, W11)


def nation_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file for each nation, with a function for each of its suppliers."""
    f = F.concat(F.lit("def "), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_")), F.lit("(x):\n    return "), F.col("s_suppkey").cast("string"), F.lit("\n\n"))
    held = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", f.alias("f")))), lambda x: x.getField("f")), "").alias("body"))
    n = table(spark, sf_dir, "nation").join(held, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select(F.col("n_nationkey").alias("doc"), F.concat(F.lit("import os\n\n"), F.coalesce("body", F.lit(""))).alias("content"))


@query
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_lines(nation_code(spark, sf_dir), "doc", "content")


@query
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nation_code(spark, sf_dir)
    return code.code_chunks(docs, code.code_lines(docs, "doc", "content"), "doc")


@query
def restore_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to atoms and back."""
    lines = code.code_lines(nation_code(spark, sf_dir), "doc", "content")
    return code.restore_code(code.code_atoms(lines, "doc"), "doc")


# Scalars (X1-X15, S6, S8, P9-P11)


@query
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X4, X5, X13, X24, X25, P11 on documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", ids.sha_hex(X.strip_headings(t)).alias("without_headings"), X.truncate_bytes(t, 100).alias("first_bytes"), F.round(X.hangul_ratio(t), 6).alias("hangul"), X.token_count(t).alias("tokens"), ids.sha_hex(X.embedding_text(F.col("source"), t)).alias("embedding_hash"), ids.sha_hex(X.passage(t)).alias("passage_hash"))


@query
def heading_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2-X4 on Markdown."""
    c = F.col("content")
    rows = region_markdown(spark, sf_dir)
    return rows.select("doc", X.first_heading(c).alias("heading"), X.intro(c).alias("intro"), F.length(X.split_heading(X.trim_ws(F.regexp_replace(c, "^intro[^\n]*\n", ""))).getField("body")).alias("body_chars"))


@query
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of documents of 80 characters at most."""
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), 80).alias("snippet"))


@query
def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of documents as sections."""
    return table(spark, sf_dir, "documents").select("doc_id", X.summary_of_section(F.col("source"), F.col("lang"), F.col("text")).alias("summary"))


@query
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15, S8, S6 on page addresses."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", X.directory(path).alias("directory"), X.language_of_path(F.concat(path, F.lit(".PY"))).alias("language"), hierarchy.record_domain(F.lit(""), F.create_map(F.lit("domain"), F.when(F.col("page_id") % 2 == 0, "code").otherwise(""))).alias("domain"))


@query
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10 on part types written as declarations."""
    line = F.concat(F.when(F.col("p_size") % 3 == 0, "def ").when(F.col("p_size") % 3 == 1, "async def ").otherwise("type "), F.regexp_replace("p_name", " ", "_"), F.lit("(a, b):"))
    return table(spark, sf_dir, "part").select("p_partkey", X.declared_name(line).alias("name"))


@query
def block_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same atoms as table, code, image, list and plain block."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.concat(F.lit("# "), "r_name"), F.lit(" a "), F.lit("b")).alias("atoms"))
    sid, none = F.lit(""), F.lit(None).cast("string")

    def block(kind: str) -> F.Column:
        return X.format_block(sid, F.lit(kind), F.array(F.lit("x"), F.lit("y")), none, F.lit("sql"), F.col("atoms"))

    return rows.select("r_regionkey", *(block(k).alias(f"as_{k}") for k in ("table", "code", "image", "heading", "plain")))


@query
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ingest of all documents as records: rows by source type of atoms (no SQL form)."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang")).alias("source_metadata"), F.lit("wiki").alias("domain"), F.lit(1).cast("bigint").alias("project_id"))
    built = hierarchy.build(records)
    return built.l3.groupBy("embedded").agg(F.count("*").alias("atoms"), F.countDistinct("l1_id").alias("documents"))


# Lookups and the rest of the atom functions


@query
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer by key; the filter reaches the scan."""
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that a table of ids names (those of lineitems returned), as a semi join."""
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def sample_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors there are, with the first three."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.agg(F.count("*").alias("total"))
    return rows.select("vec_id", "label").orderBy("vec_id").limit(3).crossJoin(n)


@query
def code_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as atoms, anchors embedded."""
    lines = code.code_lines(nation_code(spark, sf_dir), "doc", "content")
    atoms = code.code_atoms(lines, "doc")
    return atoms.select("doc", "sort_order", "content_hash", "embedded", F.coalesce("parent_line", F.lit(0)).alias("parent_line"))


@query
def code_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fenced lines of each brand's document."""
    fence = F.regexp_extract("content", r"(?s)(```.*```)", 1)
    return part_markdown(spark, sf_dir).select("doc", F.posexplode(X.code_fragments(fence)).alias("pos", "fragment"))


@query
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each root heading."""
    return markdown.symbol_chunks(markdown.headings(region_markdown(spark, sf_dir), "doc", "content"), "doc").select("doc", "section_id", "text")


@query
def atom_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the hash over the atoms of each turn."""
    atoms = conversation_atoms(spark, sf_dir).withColumn("l2_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return hierarchy.atom_hash(atoms.withColumn("l3_id", F.concat_ws("#", "l2_id", F.col("sort_order").cast("string"))))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents, ranked by terms, the best with their document and neighbours."""
    docs = table(spark, sf_dir, "documents")
    atoms = ranked_sentences(spark, sf_dir).select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("sort_order").cast("string")).alias("l3_id"), F.col("doc_id").cast("string").alias("l2_id"), "doc_id", "sort_order", F.col("sentence").alias("content"))
    best = rank.lexical_top(atoms, TERMS, 5)
    hits = atoms.join(F.broadcast(best), "l3_id").join(docs.select("doc_id", "source", "lang"), "doc_id")
    near = context.neighbours(hits, atoms).groupBy("l3_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_sort", "n_content"))), lambda x: x.getField("n_content")), "\n\n").alias("surrounding_context"))
    return hits.join(near, "l3_id").select("l3_id", "doc_id", "source", "lang", "score", "content", "surrounding_context").orderBy(F.desc("score"), "l3_id")
