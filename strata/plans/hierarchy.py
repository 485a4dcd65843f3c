"""Ingest: records into documents, snapshots (L1), sections (L2), atoms (L3), keywords, vectors and edges.

Chunks and atoms, which all tables are made of, are written once; the tables are lazy.

All ids are hashes of natural keys, so that ingesting again, or a retried task, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import ids
from strata.functions import text as X
from strata.operators import code as code_ops
from strata.operators import markdown as md
from strata.operators import parse
from strata.operators.sentences import masked_sentences
from strata.sources.scratch import held

STEP = 1000
SPLITTER = "masked-1"

Embedder = Callable[[Column], Column]


def hashed_bag(text: Column, size: int = 64) -> Column:
    """The default embedding: a unit vector of counts of hashed words; native and deterministic."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return F.transform(ids.unit(counts), lambda x: x.cast("float"))


def record_domain(domain: Column, metadata: Column) -> Column:
    """The request's domain, else the metadata's, else wiki."""
    return F.coalesce(F.nullif(domain, F.lit("")), F.nullif(F.try_element_at(metadata, F.lit("domain")), F.lit("")), F.lit("wiki"))


def wiki_chunks(records: DataFrame) -> DataFrame:
    return md.expand_blocks(md.sections(records, "doc_key", "content"), "doc_key")


def code_domain_chunks(records: DataFrame) -> DataFrame:
    return _code_chunks(records, code_ops.code_lines(records, "doc_key", "content"))


def parsed_code_chunks(records: DataFrame) -> DataFrame:
    """U14 as a chunker (`Registry.register("code", parsed_code_chunks)`): Python and Go files are parsed, by the suffix of their path; each anchor, nested ones too, begins a chunk."""
    named = records.withColumn("_lang", X.language_of_path(F.col("path")))
    return _code_chunks(records, parse.source_lines(named, "doc_key", "content", "_lang").drop("scope_idx"))


def _code_chunks(records: DataFrame, lines: DataFrame) -> DataFrame:
    chunks = code_ops.code_chunks(records, lines, "doc_key")
    path = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("section_id"))
    return chunks.select("doc_key", "chunk_no", "section_id", path.alias("path"), F.lit(2).alias("level"), F.lit(None).cast("string").alias("parent_section_id"), "text", F.lit("code").alias("section_type"), F.to_json(F.struct(F.lit("code").alias("block_type"), "first_line")).alias("metadata"))


def pdf_chunks(records: DataFrame) -> DataFrame:
    cut = md.fixed_chunks(records, "doc_key", "content")
    return cut.select("doc_key", "chunk_no", "section_id", F.lit("document").alias("path"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_section_id"), "text", F.lit("heading").alias("section_type"), F.lit('{"block_type":"heading"}').alias("metadata"))


@dataclass
class Registry:
    """Domain -> chunker; records of an unknown domain are kept as failures, not raised."""

    chunkers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=lambda: {"wiki": wiki_chunks, "code": code_domain_chunks, "pdf": pdf_chunks})
    default: str | None = None

    def register(self, domain: str, chunker: Callable[[DataFrame], DataFrame]) -> None:
        self.chunkers[domain] = chunker

    def get(self, domain: str) -> Callable[[DataFrame], DataFrame] | None:
        return self.chunkers.get(domain) or self.chunkers.get(self.default or "")

    def chunks(self, records: DataFrame, domains: set[str] | None = None) -> DataFrame:
        """Chunks of all records. domains: those of the chunkers' names that records have, and '' if there are others; the plan then holds no other chunker."""
        parts = [chunker(records.where(F.col("domain") == domain)) for domain, chunker in self.chunkers.items() if domains is None or domain in domains]
        if self.default in self.chunkers and (domains is None or "" in domains):
            parts.append(self.chunkers[self.default](records.where(~F.col("domain").isin(*self.chunkers))))
        if not parts:
            return self.chunks(records)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def domains(self, records: DataFrame) -> set[str]:
        """Which of the chunkers' names records have, and '' if they have others: no more values than chunkers."""
        known = F.when(F.col("domain").isin(*self.chunkers), F.col("domain")).otherwise("")
        return {r["d"] for r in records.select(known.alias("d")).distinct().collect()}

    def known(self) -> Column:
        """Whether a chunker takes a record."""
        return F.lit(True) if self.default in self.chunkers else F.col("domain").isin(*self.chunkers)

    def failures(self, records: DataFrame) -> DataFrame:
        """doc_key, ok, error_message of records that no chunker takes."""
        return records.where(~self.known()).select("doc_key", F.lit(False).alias("ok"), F.concat(F.lit("unknown domain: "), "domain").alias("error_message"))


@dataclass
class Hierarchy:
    documents: DataFrame
    l1: DataFrame
    l2: DataFrame
    l3: DataFrame
    keywords: DataFrame
    l1_vectors: DataFrame
    l3_vectors: DataFrame
    edges: DataFrame
    failures: DataFrame


def normalise(records: DataFrame) -> DataFrame:
    """Records (title, content, source_metadata, domain, project_id) with doc_key, path, content_hash and source_type.

    The key of a document is its project and path, or its title where metadata has no path.
    """
    meta = F.coalesce("source_metadata", F.create_map().cast("map<string,string>"))
    path = X.or_empty(F.try_element_at(meta, F.lit("path")), F.col("title"))
    project = F.coalesce(F.col("project_id"), F.lit(0).cast("bigint"))
    rows = records.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"), meta.alias("source_metadata"), record_domain(F.col("domain"), meta).alias("domain"), project.alias("project_id"), path.alias("path"))
    kind = F.when(F.col("domain") == "code", "code").otherwise(X.or_else(F.try_element_at("source_metadata", F.lit("source_type")), F.lit("md")))
    return rows.withColumns({"doc_key": ids.natural_id(F.lit("doc"), F.col("project_id"), F.col("path")), "content_hash": ids.sha_hex(F.col("content")), "source_type": kind})


def latest_records(records: DataFrame) -> DataFrame:
    """One record of each document, should a batch hold several: the last by content hash."""
    order = Window.partitionBy("doc_key").orderBy(F.desc("content_hash"), F.desc("title"))
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unchanged(records: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Records but for those whose document has the same content hash at its head."""
    if stored is None:
        return records
    return records.join(stored.select("doc_key", "content_hash"), ["doc_key", "content_hash"], "left_anti")


def atoms_of(chunks: DataFrame, semantic: bool = False) -> DataFrame:
    """l1_id, l2_id, sort_order, parent_order (of the parent), content, own_hash, embedded, source_metadata of prose, table, list and image chunks.

    The heading line is atom 0. Repeated texts of a section (the heading's too) keep their first place
    only; then atoms are numbered 1000, 2000, .., and each has the one before as its parent.
    """
    heading = X.first_heading(F.col("text"))
    prose = masked_sentences(F.when(F.col("section_type").isin("heading", "ordered"), X.strip_headings(F.col("text"))).otherwise(""))
    held = chunks.where("section_type <> 'code'").withColumn("_prose", prose).withColumn("_head", F.when(F.col("section_type") == "heading", heading).otherwise(""))
    parts = F.concat(F.when(F.col("_head") != "", F.array(F.col("_head"))).otherwise(F.array().cast("array<string>")), md.fragments(F.col("section_type"), F.col("text"), F.col("_prose"), F.lit(semantic)))
    # an l2_id names one chunk, so places in its array give numbers and parents, and no atom is shuffled
    kept = F.filter(F.array_distinct(parts), lambda x: ~X.blank(x))
    rows = held.select("l1_id", "l2_id", "_head", F.posexplode(kept).alias("_pos", "content"))
    number = F.col("_pos") + 1 - F.when(F.col("_head") != "", 1).otherwise(0)
    rows = rows.withColumn("sort_order", (number * STEP).cast("int")).withColumn("is_title", (F.col("_pos") == 0) & (F.col("_head") != "") & ~X.blank(F.col("_head")))
    rows = rows.withColumn("parent_order", F.when(F.col("_pos") > 0, F.col("sort_order") - STEP))
    return rows.select("l1_id", "l2_id", "sort_order", "parent_order", "content", F.lit(None).cast("string").alias("own_hash"), (~F.col("is_title")).alias("embedded"), F.lit(None).cast("string").alias("source_metadata"))


def code_atoms_of(chunks: DataFrame) -> DataFrame:
    """K6 for code chunks: one atom for each line; of code files only anchors are embedded, of code blocks every fragment."""
    code = chunks.where("section_type = 'code'")
    filed = code.where("source_type = 'code'")
    offset = F.coalesce(F.get_json_object("metadata", "$.first_line").cast("int"), F.lit(1)) - 1
    lines = code_ops.code_lines(filed.select("l1_id", F.struct("l1_id", "l2_id", offset.alias("offset")).alias("k"), "text").select("k", "text"), "k", "text", whole_file=False)
    atoms = code_ops.code_atoms(lines, "k")
    own = atoms.select(F.col("k.l1_id").alias("l1_id"), F.col("k.l2_id").alias("l2_id"), (F.col("sort_order") + F.col("k.offset") * STEP).alias("sort_order"), "content", F.col("content_hash").alias("own_hash"), "embedded", "source_metadata", ((F.col("parent_line") + F.col("k.offset")) * STEP).alias("parent_order"))
    blocks = code.where("source_type <> 'code'").select("l1_id", "l2_id", F.posexplode(X.code_fragments(F.col("text"))).alias("_pos", "content"))
    blocks = blocks.withColumn("sort_order", ((F.col("_pos") + 1) * STEP).cast("int")).withColumn("parent_order", F.when(F.col("_pos") > 0, F.col("sort_order") - STEP))
    blocks = blocks.withColumns({"own_hash": F.lit(None).cast("string"), "embedded": F.lit(True), "source_metadata": F.lit(None).cast("string")})
    names = ["l1_id", "l2_id", "sort_order", "parent_order", "content", "own_hash", "embedded", "source_metadata"]
    return own.select(*names).unionByName(blocks.select(*names))


def identified(atoms: DataFrame) -> DataFrame:
    """Atoms as of `atoms_of` with their ids and hashes, which follow from the other columns and are longer than most atoms."""
    parent = F.when(F.col("parent_order").isNotNull(), ids.natural_id(F.col("l2_id"), F.col("parent_order")))
    return atoms.select("l1_id", "l2_id", ids.natural_id(F.col("l2_id"), F.col("sort_order")).alias("l3_id"), parent.alias("parent_id"), "sort_order", "content", F.coalesce("own_hash", ids.sha_hex(F.col("content"))).alias("content_hash"), "embedded", "source_metadata")


def versioned(chunks: DataFrame, dealt_by: str = "l1_id") -> DataFrame:
    """Chunks with section_version: of chunks of a snapshot with the same section id, one whose text is that of the one before goes, and another is the next version. dealt_by: a column that a snapshot has one value of; chunks that are dealt by it stay where they are."""
    order = Window.partitionBy(*dict.fromkeys([dealt_by, "l1_id", "section_id"])).orderBy("chunk_no")
    rows = chunks.withColumn("_same", F.col("text").eqNullSafe(F.lag("text").over(order)) & (F.row_number().over(order) > 1)).where("not _same").drop("_same")
    return rows.withColumn("section_version", F.row_number().over(order))


def atom_hash(atoms: DataFrame) -> DataFrame:
    """A3: l2_id, l3_child_hash: SHA-256 over the sorted lines l3_id|sha256(text)."""
    line = F.concat_ws("|", "l3_id", F.sha2(F.col("content").cast("binary"), 256))
    return atoms.groupBy("l2_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("l3_child_hash"))


def keyword_ids(text: Column) -> Column:
    """The ids of a text's keywords."""
    return F.transform(X.keywords(text), ids.keyword_id)


def new_keywords(atoms: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """machine_id, canonical_name of keywords that the dictionary lacks."""
    found = atoms.select(F.explode(X.keywords(F.col("content"))).alias("canonical_name")).distinct()
    rows = found.select(ids.keyword_id(F.col("canonical_name")).alias("machine_id"), "canonical_name")
    return rows if dictionary is None else rows.join(dictionary.select("machine_id"), "machine_id", "left_anti")


def contains_edges(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """Src, src_type, dst, dst_type, rel, project_id: directory > file > section > chunk, each once."""
    own = l1.select("l1_id", "project_id", "path")
    files = own.select(X.directory(F.col("path")).alias("src"), F.lit("directory").alias("src_type"), F.col("l1_id").alias("dst"), F.lit("file").alias("dst_type"), "project_id")
    parts = l2.join(own, "l1_id").select(F.col("l1_id").alias("src"), F.lit("file").alias("src_type"), F.col("l2_id").alias("dst"), F.lit("section").alias("dst_type"), "project_id")
    chunks = l3.join(own, "l1_id").select(F.col("l2_id").alias("src"), F.lit("section").alias("src_type"), F.col("l3_id").alias("dst"), F.lit("chunk").alias("dst_type"), "project_id")
    return files.unionByName(parts).unionByName(chunks).withColumn("rel", F.lit("contains")).distinct()


def mention_edges(l3: DataFrame) -> DataFrame:
    """src, dst, rel mentions: atoms and the ids of their keywords."""
    return l3.select(F.col("l3_id").alias("src"), F.explode(keyword_ids(F.col("content"))).alias("dst"), F.lit("mentions").alias("rel")).distinct()


def build(records: DataFrame, stored: DataFrame | None = None, registry: Registry | None = None, embed: Embedder = hashed_bag, semantic: bool = False, at: Column | None = None) -> Hierarchy:
    """The tables of a batch of records (title, content, source_metadata, domain, project_id); unchanged documents give no rows. at: the time of creation (now)."""
    return build_fresh(fresh(records, stored), registry, embed, semantic, at)


def fresh(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Normalised records whose document is new or changed, written once, so that what is made of them has a small plan."""
    return held(unchanged(latest_records(normalise(records)), stored))


def build_fresh(rows: DataFrame, registry: Registry | None = None, embed: Embedder = hashed_bag, semantic: bool = False, at: Column | None = None) -> Hierarchy:
    """The tables of records as of `fresh`."""
    registry = registry or Registry()
    good = rows.where(registry.known())
    l1_id = ids.natural_id(F.lit("l1"), F.col("doc_key"), F.col("content_hash"), F.lit(SPLITTER))
    heads = good.withColumn("l1_id", l1_id)
    chunks = registry.chunks(good, registry.domains(good)).join(heads.select("doc_key", "l1_id", "title", "source_type", "project_id"), "doc_key")
    chunks = held(versioned(chunks, "doc_key").withColumn("l2_id", ids.natural_id(F.col("l1_id"), F.col("section_id"), F.nullif(F.col("section_version"), F.lit(1)))))
    l3 = identified(held(atoms_of(chunks, semantic).unionByName(code_atoms_of(chunks))))
    parent = F.when(F.col("parent_section_id").isNotNull(), ids.natural_id(F.col("l1_id"), F.col("parent_section_id")))
    title_id = F.when((F.col("section_type") == "heading") & (X.first_heading(F.col("text")) != ""), ids.natural_id(F.col("l2_id"), F.lit(0)))
    l2 = chunks.select("l1_id", "l2_id", "section_id", parent.alias("parent_id"), ((F.col("chunk_no") + 1) * STEP).alias("sort_order"), "section_type", "path", "text", F.col("metadata").alias("source_metadata"), ids.sha_hex(F.col("text")).alias("summary_hash"), X.summary_of_section(F.col("title"), F.col("path"), F.col("text")).alias("summary"), title_id.alias("title_id"))
    l2 = l2.join(atom_hash(l3), "l2_id", "left")
    summaries = l2.groupBy("l1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "summary"))), lambda x: x.getField("summary")).alias("_s"))
    hashes = md.chunk_hash(chunks, "l1_id")
    toc = md.toc_json(chunks, "l1_id")
    l1 = heads.join(summaries, "l1_id", "left").join(hashes, "l1_id", "left").join(toc, "l1_id", "left")
    l1 = l1.select("doc_key", "l1_id", "project_id", "title", "path", "source_type", "source_metadata", "content_hash", X.summary_of_document(F.col("title"), F.coalesce("_s", F.array().cast("array<string>"))).alias("summary"), "l2_child_hash", F.coalesce("toc", F.lit("[]")).alias("toc"), (F.current_timestamp() if at is None else at).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("synced_at"))
    documents = heads.select("doc_key", ids.folded(F.substring(ids.sha_hex(F.col("doc_key")), 1, 16)).alias("machine_id"), "project_id", "title", "path", "source_type", "source_metadata", "content_hash", F.col("l1_id").alias("current_l1_id"))
    l1_vectors = heads.select("l1_id", "project_id", embed(X.passage(X.embedding_text(F.col("title"), F.col("content")))).alias("vector"))
    points = l3.where("embedded").join(l2.select("l2_id", "section_id", "section_type"), "l2_id").join(heads.select("l1_id", "project_id", "source_type"), "l1_id")
    l3_vectors = points.select(ids.uuid_of(F.col("l3_id")).alias("point_id"), "l1_id", "l2_id", "l3_id", "section_id", "section_type", "source_type", "project_id", keyword_ids(F.col("content")).alias("keyword_ids"), embed(X.passage(F.col("content"))).alias("vector"))
    return Hierarchy(documents, l1, l2, l3, new_keywords(l3), l1_vectors, l3_vectors, contains_edges(l1, l2, l3), registry.failures(rows))


def records_of(spark: SparkSession, rows: list[tuple[str, str, dict[str, str], str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "title string, content string, source_metadata map<string,string>, domain string, project_id bigint")
