"""Registered queries over a store, and over small fixed inputs: files, ingest, search, context, restore, and the rest of the public functions.

The documents of the store are the Markdown of `queries.region_markdown`, one for each region.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import coerce, ids
from strata.functions import text as X
from strata.operators import admin, code, graphs, markdown, rank, sentences
from strata.plans import hierarchy, restore, service
from strata import structure_queries  # noqa: F401  registers its queries
from strata.queries import QUERIES as QUERIES
from strata.queries import customer_tables, nation_code, part_markdown, query, region_markdown, table
from strata.sources import files
from strata.sources.scratch import folder
from strata.sources.store import Store

PROJECT = 7
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


def signs(text: Column) -> Column:
    """An embedding that any engine can compute: the unit vector of counts of letters and digits."""
    lowered = F.lower(text)
    counts = F.transform(F.lit([*SIGNS]), lambda c: (F.length(lowered) - F.length(F.replace(lowered, c))).cast("double"))
    return F.transform(ids.unit(counts), lambda x: x.cast("float"))


def region_records(spark: SparkSession, sf_dir: str, project: int = PROJECT) -> DataFrame:
    title = F.concat(F.lit("region-"), F.col("doc").cast("string"))
    return region_markdown(spark, sf_dir).select(title.alias("title"), "content", F.create_map(F.lit("name"), F.lit("places")).alias("source_metadata"), F.lit("").alias("domain"), F.lit(project).cast("bigint").alias("project_id"))


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", buckets=2)


_stores: dict[tuple[str, str, str], Store] = {}


def regions(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a session and a folder of tables, filled once."""
    key = (spark.sparkContext.applicationId, folder(spark), sf_dir)
    if key not in _stores:
        store = new_store(spark)
        store.create_vectors(len(SIGNS))
        service.ingest_records(store, region_records(spark, sf_dir), embed=signs)
        _stores[key] = store
    return _stores[key]


# Sources (S1-S5, S7, S14, T12)



@query
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as Markdown files with a head and nations as source files, written out and read as ingest records, in order of paths."""
    root = f"{folder(spark)}/files-{uuid.uuid4().hex}"
    title = F.concat(F.lit("---\ntitle: Region "), "doc", F.lit("\ntags: x\n---\n"))
    files.write_texts(region_markdown(spark, sf_dir).select(F.concat(F.lit("b-"), "doc").alias("name"), F.concat(title, "content").alias("content")), root, "name", "content", "page.md")
    files.write_texts(nation_code(spark, sf_dir).select(F.concat(F.lit("code-"), "doc").alias("name"), "content"), root, "name", "content", "main.py")
    rows = files.records(spark, root, PROJECT)
    meta = F.col("source_metadata")
    return rows.select(F.try_element_at(meta, F.lit("path")).alias("path"), "title", "content", F.try_element_at(meta, F.lit("tags")).alias("tags"), "domain", "project_id").orderBy("path")


@query
def domain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text on each nation, whose region says its domain, in chunks; nations of two regions have a domain that no chunker takes."""
    domain = F.get(F.array(*map(F.lit, ("wiki", "code", "pdf", "video", ""))), F.col("n_regionkey").cast("int"))
    text = F.concat(F.lit("# "), "n_name", F.lit("\nbody\n\ndef f(x):\n    return "), "n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), text.alias("content"), F.create_map().cast("map<string,string>").alias("source_metadata"), domain.alias("domain"), F.lit(1).cast("bigint").alias("project_id"))
    rows = hierarchy.normalise(rows)
    registry = hierarchy.Registry()
    chunks = registry.chunks(rows).join(rows.select("doc_key", "title"), "doc_key").groupBy("title").agg(F.count("*").alias("chunks"), F.min("section_type").alias("type"), F.lit(True).alias("ok"), F.lit("").alias("message"))
    failed = registry.failures(rows).join(rows.select("doc_key", "title"), "doc_key").select("title", F.lit(0).cast("bigint").alias("chunks"), F.lit("").alias("type"), "ok", F.col("error_message").alias("message"))
    return chunks.unionByName(failed)


@query
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the store of regions with the rows of four of them; and of a store that was created, dropped, and had its documents created again."""
    filled = regions(spark, sf_dir)
    store = new_store(spark)
    store.create()
    store.drop()
    store.replace("documents", filled.read("documents"))
    again = store.catalog().select("table_name", F.col("present").alias("again"))
    return filled.catalog().select("table_name", "present").join(filled.counts(), "table_name", "left").join(again, "table_name").select("table_name", "present", "n", "again")


# Ingest (K2-K9, K11, K13-K18, P7, P12, T9, F13, J5, J12, J14, J15, R11, R12)


@query
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: documents with their head snapshot."""
    return regions(spark, sf_dir).read("documents").select("doc_key", "machine_id", "project_id", "title", "path", "source_type", "content_hash", "current_l1_id", "version")


@query
def ingest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots; all have a time of creation."""
    return regions(spark, sf_dir).read("l1").select("l1_id", "doc_key", "project_id", "content_hash", "l2_child_hash", "toc", F.col("created_at").isNotNull().alias("created"), F.col("synced_at").isNotNull().alias("synced"))


@query
def ingest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4, J12, A3, P9."""
    return regions(spark, sf_dir).read("l2").select("l2_id", "l1_id", "section_id", "parent_id", "sort_order", "section_type", "path", "text", "source_metadata", "summary_hash", "summary", "title_id", "l3_child_hash")


@query
def ingest_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5, W2-W4."""
    return regions(spark, sf_dir).read("l3").select("l3_id", "l2_id", "l1_id", "parent_id", "sort_order", "content", "content_hash", "embedded")


def rounded_sum(vector: Column) -> Column:
    return F.round(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 5)


@query
def ingest_document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, P11."""
    return regions(spark, sf_dir).read("l1_vectors").select("l1_id", "project_id", F.size("vector").alias("size"), rounded_sum(F.col("vector")).alias("total"))


@query
def ingest_atom_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads and vectors of embedded atoms."""
    return regions(spark, sf_dir).read("l3_vectors").select("point_id", "l1_id", "l2_id", "l3_id", "section_id", "section_type", "source_type", "project_id", F.size("keyword_ids").alias("keywords"), rounded_sum(F.col("vector")).alias("total"))


@query
def vector_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: created once; a vector of another size is refused."""
    store = regions(spark, sf_dir)
    store.create_vectors(3)  # they are there: no change
    bad = store.read("l1_vectors").withColumn("vector", F.slice("vector", 1, 3))
    try:
        store.merge("l1_vectors", bad)
        refused = False
    except PySparkException:
        refused = True
    sizes = store.read("l1_vectors").select(F.lit("l1_vectors").alias("name")).unionByName(store.read("l3_vectors").select(F.lit("l3_vectors").alias("name"))).groupBy("name").agg(F.count("*").alias("vectors"))
    return store.read("collections").join(sizes, "name").withColumn("refused", F.lit(refused))


@query
def ingest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory > file > section > chunk."""
    return regions(spark, sf_dir).read("edges").select("src", "src_type", "dst", "dst_type", "project_id", "rel")


@query
def pipeline_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's versions, and the snapshots that were written under them."""
    store = regions(spark, sf_dir)
    return store.read("versions").withColumn("snapshots", F.lit(store.read("l1").count()))


@query
def project_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of one ingest each are registered (blank metadata goes), finalised by their Merkle hash, and found up to date."""
    store = new_store(spark)
    found = service.register_project(store, "/data/places/", metadata={"owner": " me ", "note": "  "})
    records = region_records(spark, sf_dir).withColumn("project_id", F.lit(found["project_id"]).cast("bigint"))
    service.ingest_records(store, records, embed=signs)
    service.register_project(store, "/data/other")
    stored = service.finalise_project(store, found["project_id"])
    again = service.register_project(store, "/data/places", content_hash=stored)
    rows = store.read("projects").withColumn("up_to_date", F.when(F.col("id") == found["project_id"], F.lit(again["already_up_to_date"])))
    return rows.select("id", "name", "root_path", F.to_json("source_metadata").alias("metadata"), "content_hash", "up_to_date")


@query
def sync_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of even regions are marked as synced; those that aren't are left."""
    store = new_store(spark)
    service.ingest_records(store, region_records(spark, sf_dir), embed=signs)
    even = store.read("l1").where(F.col("title").rlike("[02468]$")).select("l1_id")
    store.mark_synced(even)
    return admin.unsynced(store.read("l1")).select("l1_id", "title")


@query
def reset_and_ingest_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after an ingest of two projects, the same again, a reset of one, and its ingest."""
    store = new_store(spark)
    seven, eight = region_records(spark, sf_dir, 7), region_records(spark, sf_dir, 8)
    steps = [("first", service.ingest_records(store, seven, embed=signs)), ("other", service.ingest_records(store, eight, embed=signs)), ("again", service.ingest_records(store, seven, embed=signs))]
    gone = store.reset(7)
    left = {r["table_name"]: r["n"] for r in store.counts().collect()}
    steps.append(("after reset", service.ingest_records(store, seven, embed=signs)))
    rows = [(name, s["written"], s["skipped"], s["failed"]) for name, s in steps] + [("gone and left", gone["l2"], left["l2"], left["documents"])]
    return spark.createDataFrame(rows, "step string, written bigint, skipped bigint, failed bigint")


@query
def project_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the snapshots of their customer's project, with their position by time."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l1_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("source_type"), F.col("o_custkey").alias("doc_key"), F.col("o_orderdate").alias("created_at"))
    customer = table(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("c")).first()["c"]
    return admin.nodes(rows, customer).select("id", "title", "source_type", "position")


@query
def project_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents of their region's project."""
    projects = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("root_path"), F.col("r_regionkey").alias("machine_id"))
    return admin.audit(customer_tables(spark, sf_dir)["documents"], projects)


@query
def section_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sections of their user, by type; the text is the value's half hundred."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("l1_id"), F.col("event_type").alias("section_id"), F.col("event_id").alias("chunk_no"), F.floor(F.col("value") / 50).cast("string").alias("text"))
    return hierarchy.versioned(rows).select("l1_id", "section_id", "chunk_no", "section_version")


# Search, context, restore

ASKED = "supplier number 7 is not here"
SHOWN = ["rank", "l3_id", "score", "l1_title", "section_heading", "matched_content", "breadcrumb", "surrounding_context"]


def shown(hits: DataFrame) -> DataFrame:
    return hits.select(*SHOWN).withColumn("score", F.round("score", 5))


@query
def search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest atoms with their context."""
    return shown(service.retrieve(regions(spark, sf_dir), ASKED, None, 10, service.Search(embed=signs)))


@query
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by dense and lexical rank together."""
    return shown(service.retrieve(regions(spark, sf_dir), ASKED, PROJECT, 5, service.Search(embed=signs, hybrid=True, candidates=8)))


@query
def search_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three hits at levels 0, 2 and 3."""
    out: DataFrame | None = None
    for level in (0, 2, 3):
        hits = service.retrieve(regions(spark, sf_dir), ASKED, PROJECT, 3, service.Search(embed=signs, level=level))
        toc = F.col("toc") if level == 3 else F.lit("")
        rows = hits.select(F.lit(level).alias("level"), "rank", "l3_id", "section_id", "l2_summary", "doc_name", "source_path", "surrounding_context", ids.sha_hex(toc).alias("toc_hash"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def search_hits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P4, K20 through the public function; the budget of tokens leaves no surroundings."""
    hits = service.search(regions(spark, sf_dir), ASKED, fields="l3_id,title,snippet,source_path,doc_name", top_k="4", how=service.Search(embed=signs, max_tokens=1))
    return hits


@query
def search_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return service.search(regions(spark, sf_dir), ASKED, format="markdown", top_k=3, how=service.Search(embed=signs, level=0))


@query
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit, and after it the first atoms of other files in its directory."""
    hits = service.retrieve(regions(spark, sf_dir), ASKED, PROJECT, 1, service.Search(embed=signs, expand=True))
    return hits.select("rank", "l3_id", "source", F.round("score", 5).alias("score"), "matched_content")


@query
def rank_search_with_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that is rewritten, and hits that are ordered anew by the share of its terms."""
    how = service.Search(embed=signs, rewrite=lambda q: f"{q} 7 is not here", reranker=rank.overlap_score)
    hits = service.retrieve(regions(spark, sf_dir), "supplier number", None, 4, how)
    return shown(hits).select("rank", "l3_id", "score")


@query
def restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from their atoms."""
    store = regions(spark, sf_dir)
    return restore.documents(store.read("l1"), store.read("l2"), store.read("l3")).select("l1_id", "title", "content")


@query
def restore_code_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of source files from their lines, by file and number of the first line."""
    rows = nation_code(spark, sf_dir).select(F.col("doc").cast("string").alias("title"), "content", F.create_map().cast("map<string,string>").alias("source_metadata"), F.lit("code").alias("domain"), F.lit(1).cast("bigint").alias("project_id"))
    built = hierarchy.build(rows, embed=signs)
    code_ = restore.section_code(built.l3)
    return built.l2.join(built.documents.select(F.col("current_l1_id").alias("l1_id"), "title"), "l1_id").join(code_, "l2_id").select("title", "section_id", "content")


@query
def answer_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted model that searches, restores and answers; how long its tools' results are."""
    store = regions(spark, sf_dir)

    def llm(q: str, messages: list[dict]) -> dict:
        if not messages:
            return {"tool": "search", "arguments": {"query": q}}
        if len(messages) == 1:
            return {"tool": "restore_l2", "arguments": {"l2_id": messages[0]["result"][0]["l2_id"]}}
        return {"tool": "answer", "arguments": {"text": "found", "sources": [messages[0]["result"][0]["l3_id"]]}}

    done = service.answer(store, ASKED, llm, how=service.Search(embed=signs))
    rows = [(done["status"], done["answer"], done["turns"], done["sources"][0], len(done["messages"][0]["result"]), done["messages"][1]["result"])]
    return spark.createDataFrame(rows, "status string, answer string, turns bigint, source string, hits bigint, restored string")


@query
def service_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of an empty store and of a filled one; a job and the same job again; one that fails."""
    jobs = service.Jobs()
    done, failed = jobs.submit(lambda: 3, "/data/x"), jobs.submit(lambda: 1 // 0, "/data/y", header=" k ")
    again = jobs.submit(lambda: 4, " /data/x ")
    until = time.monotonic() + 60
    while any(job.ended is None for job in (done, failed)) and time.monotonic() < until:
        time.sleep(0.01)
    rows = [("snapshots", str(regions(spark, sf_dir).read("l1").count())), ("empty", service.health(new_store(spark))["status"]), ("filled", service.health(regions(spark, sf_dir))["status"]), (done.id, f"{done.status} {done.result}"), ("same", str(again is done)), (failed.id, failed.status), ("times", str(done.created <= done.started <= done.ended))]
    return spark.createDataFrame(rows, "what string, state string")


@query
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search terms of benchmark texts, each with a compound and with stop words before it."""
    asked = F.concat(F.lit("Of the text-item "), "item_id", F.lit("_x: "), "text", F.lit(" (end) v1.2_beta?"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(rank.terms(asked), " ").alias("terms"))


@query
def checked_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: what of events counts as a number of hits and as a project."""
    kind = F.col("event_id") % 5
    given = F.when(kind == 0, F.col("user_id").cast("string")).when(kind == 1, F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(" "))).when(kind == 2, "").when(kind == 3, F.col("event_type"))
    project = coerce.project_asked(given)
    return table(spark, sf_dir, "events").select("event_id", coerce.hits_wanted(given).alias("hits"), project["id"].alias("project"), project["error"].alias("error"))


@query
def settings_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of customers by their precedence, projects of their metadata, the first value that is set, and sizes of vectors."""
    key = F.col("c_custkey")
    explicit = F.when(key % 5 == 0, F.lower("c_mktsegment"))
    meta, env = F.when(key % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise("  "), F.when(key % 2 == 0, F.concat(F.lit("env"), F.col("c_nationkey").cast("string")))
    model = F.get(F.array(F.lit("text-embedding-3-large"), F.lit("text-embedding-3-small"), F.col("c_name"), F.lit(None).cast("string")), (key % 4).cast("int"))
    project = F.create_map(F.lit("project_id"), F.when(key % 7 == 0, F.col("c_name")).otherwise((key - 50).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", coerce.resolved(explicit, meta, env, "none").alias("host"), X.or_empty(explicit, meta, env).alias("first"), coerce.positive_project(project, 9).alias("project"), ids.vector_size_of(model).alias("size"))


@query
def json_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as JSON that may be none, and types of events as bytes, some of which are no text."""
    kind = F.col("event_id") % 4
    held = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("x"), "props")).when(kind == 2, "[1]")
    blob = F.concat(F.encode("event_type", "UTF-8"), F.when(kind == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("C3A9"))))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(coerce.json_or_empty(held)).alias("json"), F.try_element_at(coerce.flat_metadata(held), F.lit("k")).alias("k"), X.decode_summary(blob).alias("summary"))


# Splitters and trees


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note on each part, with spans of every kind that hold its size or key."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("n"), F.col("p_partkey").cast("string").alias("k"))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # work by note, however few files the parts are in
    text = F.concat(F.lit("1. See v"), "n", F.lit(".2.3 and core/p"), "k", F.lit(".md. Open https://a.b/"), "k", F.lit(".html now! [x. "), "n", F.lit("](y. z) is 1."), "n", F.lit("? Then 4.1."), "n", F.lit("~4.2."), "n", F.lit(", e.g. here.\n\nLast"))
    return rows.select("p_partkey", text.alias("note"))


@query
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protected spans of notes on parts; what is masked and unmasked is the note."""

    def looked(note: Column) -> Column:
        def rows(restored: Column) -> Column:
            return F.transform(sentences.spans_of(note), lambda s: F.struct(s["start"].alias("start"), F.substring(note, s["start"] + 1, s["end"] - s["start"]).alias("span"), restored.alias("restored")))

        return X.let(sentences.restore(sentences.protect(note)) == note, rows)

    # one expression makes a note's rows, so that neither the note nor its spans are computed again for each
    return part_notes(spark, sf_dir).select("p_partkey", F.inline(X.let(F.col("note"), looked)))


@query
def split_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of notes on parts, without and with their ends."""
    texts = part_notes(spark, sf_dir)
    parts = [texts.select("p_partkey", F.lit(keep).alias("ends"), F.posexplode(sentences.masked_sentences(F.col("note"), keep)).alias("pos", "sentence")) for keep in (False, True)]
    return parts[0].unionByName(parts[1])


@query
def fixed_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations in pieces of at most 60 characters."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return markdown.fixed_chunks(rows, "id", "text", 60)


@query
def single_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U13."""
    return markdown.single_toc(table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey")


@query
def toc_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: nested tables of contents."""
    return markdown.toc_tree(markdown.headings(region_markdown(spark, sf_dir), "doc", "content"), "doc")


@query
def toc_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of each source file."""
    return code.code_toc(code.code_lines(nation_code(spark, sf_dir), "doc", "content"), "doc")


@query
def project_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations, nested, as JSON by root."""
    from strata.queries import places

    nodes = places(spark, sf_dir)
    rooted = graphs.tree_paths(nodes, []).withColumn("tree", F.regexp_extract("path", "^([^/]*)/", 1)).drop("depth", "path")
    held = graphs.nested_json(rooted, "tree", ["id", "parent_id", "title"], [])
    bare = F.substring("json", F.lit(2), F.length("json") - 2)
    return held.select(F.get_json_object(bare, "$.id").alias("id"), bare.alias("json"))


@query
def atoms_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U18, K4-K6 of Markdown: atoms of prose, table, list, code and image sections of each brand's document."""
    rows = part_markdown(spark, sf_dir).select(F.col("doc").alias("title"), "content", F.create_map().cast("map<string,string>").alias("source_metadata"), F.lit("wiki").alias("domain"), F.lit(1).cast("bigint").alias("project_id"))
    built = hierarchy.build(rows, embed=signs)
    named = built.l3.join(built.l2.select("l2_id", "section_id"), "l2_id").join(built.documents.select(F.col("current_l1_id").alias("l1_id"), "title"), "l1_id")
    return named.select("title", "section_id", "sort_order", "content")


@query
def graph_sync_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph is given of a store, walked from its directory down to its chunks, with the number of steps."""
    edges = regions(spark, sf_dir).read("edges").select("src", "dst")
    at = edges.where("src = '/'").select("dst", F.lit(1).alias("steps"))
    out = at
    for steps in (2, 3):  # a contains edge leads one kind down: directory, file, section, chunk
        at = at.select(F.col("dst").alias("src")).join(edges, "src").select("dst", F.lit(steps).alias("steps"))
        out = out.unionByName(at)
    return out.groupBy("steps").agg(F.count("*").alias("reached"))
