"""The public functions: ingest, search, restore, answer, reset, health and jobs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import ids
from strata.functions import text as X
from strata.operators import admin, context, graphs, rank
from strata.plans import hierarchy, restore as restoring
from strata.sources import files
from strata.sources.store import SCHEMAS, Store


class ServiceError(ValueError):
    """An error with a code, as callers are shown it."""

    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.code, self.retryable = code, retryable

    def as_dict(self, request_id: str = "") -> dict[str, object]:
        return {"code": self.code, "message": str(self), "details": "", "retryable": self.retryable, "request_id": request_id}


# Fields of a search hit, and those of the smaller presets.
FIELDS = ["doc_id", "project_id", "doc_name", "l1_id", "l2_id", "l3_id", "score", "title", "section_heading", "snippet", "source_path", "breadcrumb", "surrounding_context"]
PRESETS = {"summary": ["doc_id", "doc_name", "l3_id", "score", "title", "snippet", "source_path"], "standard": FIELDS[:-1], "full": FIELDS, "": FIELDS}
SNIPPET = 240


def chosen_fields(detail: str = "", fields: str = "") -> list[str]:
    """The columns of a preset, or of a list (trimmed, lower-cased, each once), which goes first."""
    if fields.strip():
        names = list(dict.fromkeys(n for p in fields.split(",") if (n := p.strip().lower())))
        if unknown := [n for n in names if n not in FIELDS]:
            raise ServiceError("bad_request", f"unknown fields key {unknown[0]!r}")
        if not names:
            raise ServiceError("bad_request", "fields must list at least one valid key")
        return names
    try:
        return PRESETS[detail.strip().lower()]
    except KeyError:
        raise ServiceError("bad_request", "invalid detail (use summary, standard, full, or omit)") from None


def normalise_hits(raw: DataFrame, snippet: int = SNIPPET) -> DataFrame:
    """Raw hits as the 13 fields; l3_id falls back to matched_l3_id, rows with neither go, score is 0 if missing, the snippet is taken from the match, else from its surroundings."""
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)

    def text(*names: str) -> Column:
        return X.or_empty(*(col(n) for n in names))

    rows = raw.withColumn("_l3", X.or_else(col("l3_id"), col("matched_l3_id"))).where(F.col("_l3").isNotNull())
    return rows.select(text("doc_id").alias("doc_id"), col("project_id", "bigint").alias("project_id"), text("doc_name").alias("doc_name"), text("l1_id").alias("l1_id"), text("l2_id").alias("l2_id"), F.col("_l3").alias("l3_id"), F.coalesce(col("score", "double"), col("vector_score", "double"), F.lit(0.0)).alias("score"), text("title", "l1_title").alias("title"), text("section_heading").alias("section_heading"), X.snippet(text("snippet", "matched_content", "surrounding_context"), snippet).alias("snippet"), text("source_path").alias("source_path"), text("breadcrumb").alias("breadcrumb"), text("surrounding_context").alias("surrounding_context"))


def as_json(hits: DataFrame, names: list[str]) -> DataFrame:
    """Json: one object for each hit; null fields are left out."""
    return hits.select(F.to_json(F.struct(*names)).alias("json"))


def as_markdown(hits: DataFrame, order: str) -> DataFrame:
    """Markdown: all hits of a (small) result in one text, parted by rules."""
    block = F.concat_ws("\n", F.concat(F.lit("### "), F.col(order).cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))), F.when(~X.blank(F.col("breadcrumb")), F.col("breadcrumb")), F.concat(F.lit("score: "), F.round("score", 4).cast("string")), F.lit(""), F.coalesce(X.or_else(F.col("surrounding_context"), F.col("snippet")), F.lit("")))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x.getField("b")), "\n\n---\n\n").alias("markdown"))


def for_agent(hits: DataFrame) -> DataFrame:
    """What the answering loop is shown."""
    return hits.select("l1_id", "l2_id", "l3_id", "title", "section_heading", F.substring("l2_summary", 1, 300).alias("l2_summary"), F.substring("matched_content", 1, 500).alias("snippet"), F.substring("surrounding_context", 1, 600).alias("context"), F.round("score", 4).alias("score"))


def checked_top_k(value: object, default: int = 5) -> int:
    """F16: a number from 1 to 100; anything else counts as not given."""
    try:
        n = int(str(value))
    except ValueError:
        return default
    return n if 1 <= n <= 100 else default


def checked_project(value: object) -> int | None:
    if value is None or str(value).strip() == "":
        return None
    try:
        return int(str(value))
    except ValueError:
        raise ServiceError("bad_request", "project_id must be an integer") from None


def _identity(query: str) -> str:
    return query


@dataclass
class Search:
    """What a search does besides its query."""

    embed: hierarchy.Embedder = hierarchy.hashed_bag
    rewrite: Callable[[str], str] = _identity
    candidates: int = 30
    hybrid: bool = False
    alpha: float = 0.5
    reranker: Callable[[str], Callable[[Column], Column]] | None = None
    window: int = context.WINDOW
    level: int = 1
    max_tokens: int | None = None
    expand: bool = False
    max_siblings: int | None = None
    max_graph_results: int | None = None


def retrieve(store: Store, q: str, project_id: int | None = None, limit: int = 5, how: Search | None = None) -> DataFrame:
    """Rewrite, embed, dense top-k (with lexical top-k fused), rerank, cut, enrich, expand; raw hits with `rank` from 1, of heads only."""
    how = how or Search()
    spark = store.spark
    asked = rewritten if (rewritten := how.rewrite(q)) else q
    query_row = spark.createDataFrame([(asked,)], "q string").select(how.embed(X.query(F.col("q"))).alias("v"))
    vector = [float(x) for x in query_row.first()["v"]]
    head = store.read("documents").select(F.col("current_l1_id").alias("l1_id"))
    points = store.read("l3_vectors").join(head, "l1_id", "left_semi")
    where = None if project_id is None else F.col("project_id") == project_id
    found = rank.dense_top(points, vector, how.candidates, where=where)
    l1, l2, l3 = (store.read(t) for t in ("l1", "l2", "l3"))
    if how.hybrid:
        texts = l3.join(head, "l1_id", "left_semi")
        if project_id is not None:
            texts = texts.join(l1.where(F.col("project_id") == project_id).select("l1_id"), "l1_id", "left_semi")
        found = rank.fuse(found, rank.lexical_top(texts, asked, max(2 * how.candidates, 60)), alpha=how.alpha, limit=how.candidates)
        order = [F.desc("fused"), F.asc("l3_id")]
    else:
        order = [F.desc("score"), F.asc("l3_id")]
    if how.reranker is not None:
        found = rank.rerank(found, l3, how.reranker(asked))
        order = [F.desc("rerank_score"), F.asc("l3_id")]
    best = found.orderBy(*order).limit(limit)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("l3_id", "score", "rank")
    if how.expand and project_id is not None:
        own = best.join(l3.select("l3_id", "l1_id"), "l3_id")
        edges = store.read("edges").where("dst_type = 'file'").join(head.select(F.col("l1_id").alias("dst")), "dst", "left_semi")
        both = graphs.expand(own, edges, l2, l3, project_id, how.max_siblings, how.max_graph_results)
        added = both.where("source = 'graph_expansion'").withColumn("rank", F.row_number().over(Window.orderBy("l1_id")) + limit)
        best = best.withColumn("source", F.lit("search")).unionByName(added.select("l3_id", "score", "rank", "source"))
    else:
        best = best.withColumn("source", F.lit("search"))
    rich = context.rich_context(best.select("l3_id", "score"), l1, l2, l3, how.window, how.level, how.max_tokens)
    return rich.join(best.select("l3_id", "rank", "source"), "l3_id").orderBy("rank")


def search(store: Store, q: str, format: str = "json", detail: str = "", fields: str = "", project_id: object = None, top_k: object = 5, how: Search | None = None) -> DataFrame:
    """The hits of a query with the chosen fields, best first; or, for format markdown, one text."""
    if not q.strip():
        raise ServiceError("bad_request", "q is required")
    if format not in ("json", "markdown"):
        raise ServiceError("bad_request", "format must be markdown or json")
    names = chosen_fields(detail, fields)
    raw = retrieve(store, q, checked_project(project_id), checked_top_k(top_k), how)
    hits = normalise_hits(raw).join(raw.select("l3_id", "rank"), "l3_id").orderBy("rank")
    return as_markdown(hits, "rank") if format == "markdown" else hits.select(*names)


def restore(store: Store, l1_id: str = "", l2_id: str = "") -> DataFrame:
    """A document by its snapshot, or a section; exactly one id."""
    if bool(l1_id) == bool(l2_id):
        raise ServiceError("bad_request", "exactly one of l1_id and l2_id is required")
    l1, l2, l3 = (store.read(t) for t in ("l1", "l2", "l3"))
    if l1_id:
        own = [t.where(F.col("l1_id") == l1_id) for t in (l1, l2, l3)]
        return restoring.documents(*own)
    one = l2.where(F.col("l2_id") == l2_id)
    code = restoring.section_code(l3.where(F.col("l2_id") == l2_id)).select("l2_id", F.col("content").alias("_code"))
    rows = restoring.section_texts(one, l3.where(F.col("l2_id") == l2_id)).join(code, "l2_id", "left").join(one.select("l2_id", "section_type"), "l2_id")
    return rows.select("l2_id", F.when(F.col("section_type") == "code", F.col("_code")).otherwise(F.col("block")).alias("content"))


Turn = Callable[[str, list[dict]], dict]


def answer(store: Store, q: str, llm: Turn, project_id: int | None = None, turns: int = 8, how: Search | None = None) -> dict:
    """A loop of a model over the tools search, restore_l2 and restore_l1, ended by answer or not_found, by plain text, or after `turns`.

    llm(question, messages) returns {"tool": name, "arguments": {..}} or {"text": ..}.
    """
    messages: list[dict] = []
    for turn in range(1, turns + 1):
        said = llm(q, messages)
        tool, args = said.get("tool"), said.get("arguments", {})
        if tool is None:
            return {"status": "answered", "answer": said.get("text", ""), "turns": turn, "messages": messages}
        if tool in ("answer", "not_found"):
            return {"status": "answered" if tool == "answer" else "not_found", "answer": args.get("text", ""), "sources": args.get("sources", []), "turns": turn, "messages": messages}
        if tool == "search":
            raw = retrieve(store, args.get("query", q), project_id, how=how)
            shown = for_agent(rank.first_per_section(raw.withColumnRenamed("l1_title", "title"), "rank").orderBy("rank")).collect()
            out: object = [r.asDict() for r in shown]
        elif tool in ("restore_l2", "restore_l1"):
            which, most = ("l2_id", 3000) if tool == "restore_l2" else ("l1_id", 5000)
            row = restore(store, **{which: args.get(which, "")}).select(F.substring("content", 1, most).alias("c")).first()
            out = row["c"] if row else ""
        else:
            out = f"unknown tool {tool}"
        messages.append({"tool": tool, "arguments": args, "result": out})
    return {"status": "exhausted", "answer": "", "turns": turns, "messages": messages}


def reset(store: Store, project_id: object = None, dry_run: bool = False) -> dict[str, int]:
    return store.reset(checked_project(project_id), dry_run)


def register_project(store: Store, root_path: str, name: str = "", metadata: dict[str, str] | None = None, content_hash: str | None = None) -> dict[str, object]:
    """Adds or updates a project; already_up_to_date if the hash of its sources is the stored one."""
    held = {k: v.strip() for k, v in (metadata or {}).items() if v and v.strip()}
    new = store.spark.createDataFrame([(root_path, name or root_path.rstrip("/").rsplit("/", 1)[-1], None, held)], "root_path string, name string, description string, source_metadata map<string,string>")
    new = new.withColumn("root_path", ids.clean_path(F.col("root_path"))).withColumn("id", ids.project_id(F.col("root_path")))
    new = new.select("id", F.col("id").alias("machine_id"), "name", "root_path", "description", "source_metadata", F.lit(None).cast("string").alias("content_hash"))
    merged = admin.upsert_projects(store.read("projects"), new)
    store.replace("projects", merged)
    row = store.read("projects").join(new.select("root_path"), "root_path", "left_semi").first()
    return {"project_id": row["id"], "machine_id": row["machine_id"], "already_up_to_date": content_hash is not None and row["content_hash"] == content_hash}


def source_hash(records: DataFrame) -> str:
    """The hash of what a project's files hold: of sorted hashes, so that order and partitioning don't matter."""
    rows = hierarchy.normalise(records).select(F.concat_ws("|", "doc_key", "content_hash").alias("h"))
    bucket = F.substring(ids.sha_hex(F.col("h")), 1, 4)
    parts = rows.groupBy(bucket.alias("b")).agg(ids.sha_hex(F.array_join(F.array_sort(F.collect_list("h")), "\n")).alias("h"))
    return parts.agg(ids.sha_hex(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), "\n")).alias("h")).first()["h"]


def finalise_project(store: Store, project_id: int, content_hash: str | None = None) -> str | None:
    """Stores the hash of a project's sources, or else its Merkle hash; None if it has no documents."""
    if content_hash is None:
        own = store.read("documents").where(F.col("project_id") == project_id).join(store.read("l1").select(F.col("l1_id").alias("current_l1_id"), "l2_child_hash"), "current_l1_id")
        row = admin.merkle(own, "project_id", "machine_id", "l2_child_hash").first()
        content_hash = row["content_hash"] if row else None
    if content_hash is not None:
        projects = store.read("projects")
        store.replace("projects", projects.withColumn("content_hash", F.when(F.col("id") == project_id, content_hash).otherwise(F.col("content_hash"))))
    return content_hash


def ingest_records(store: Store, records: DataFrame, registry: hierarchy.Registry | None = None, embed: hierarchy.Embedder = hierarchy.hashed_bag) -> dict[str, int]:
    """Adds records to the store; returns how many documents were written, skipped and failed."""
    stored = store.read("documents")
    total = hierarchy.latest_records(hierarchy.normalise(records)).count()
    fresh = hierarchy.fresh(records, stored if store.exists("documents") else None)
    registry = registry or hierarchy.Registry()
    failed = registry.failures(fresh).count()
    if fresh.count() == failed:
        return {"written": 0, "skipped": total - failed, "failed": failed}
    built = hierarchy.build_fresh(fresh, registry, embed)
    new = built.documents.withColumn("version", F.lit(1))
    written = new.count()
    tables = [("l1", built.l1), ("l2", built.l2), ("l3", built.l3), ("keywords", built.keywords), ("l1_vectors", built.l1_vectors), ("l3_vectors", built.l3_vectors), ("edges", built.edges)]
    if written:
        for name, df in tables:
            store.merge(name, df)
        known = stored.join(new.select("doc_key"), "doc_key", "left_semi")
        store.merge("documents", admin.upsert_versions(known, new.select(*stored.columns), "doc_key"))
        store.merge("versions", store.spark.createDataFrame([(1, hierarchy.SPLITTER, "{}")], SCHEMAS["versions"]))
    return {"written": written, "skipped": total - written - failed, "failed": failed}


def ingest(store: Store, path: str, force: bool = False) -> dict[str, object]:
    """A folder of files as a project: registered, skipped if its files are as stored, else ingested and finalised."""
    spark = store.spark
    project = spark.createDataFrame([(path,)], "p string").select(ids.project_id(ids.clean_path(F.col("p"))).alias("i")).first()["i"]
    records = files.records(spark, path, project)
    fresh = source_hash(records)
    found = register_project(store, path, content_hash=fresh)
    if found["already_up_to_date"] and not force:
        return found | {"written": 0, "skipped": records.count(), "failed": 0}
    done = ingest_records(store, records)
    finalise_project(store, project, fresh)
    return found | done


def health(store: Store, tables: tuple[str, ...] = ("documents", "l1", "l2", "l3", "l3_vectors", "edges")) -> dict[str, object]:
    """Whether each table can be read; degraded if one cannot."""
    rows = []
    for name in tables:
        began = time.monotonic()
        status = "ok" if store.exists(name) else "error"
        rows.append((name, status, int((time.monotonic() - began) * 1000)))
    return {"status": "degraded" if any(r[1] == "error" for r in rows) else "ok", "deps": {n: {"status": s, "latency_ms": ms} for n, s, ms in rows}}


@dataclass
class Job:
    id: str
    status: str = "pending"
    result: object = None
    failure: dict | None = None
    created: float = field(default_factory=time.time)
    started: float | None = None
    ended: float | None = None


class Jobs:
    """Jobs in threads of the driver, one for each idempotency key."""

    def __init__(self) -> None:
        self._held: dict[str, Job] = {}
        self._lock = threading.Lock()

    @staticmethod
    def key(header: str, path: str) -> str:
        import hashlib

        return f"hk:{header.strip()}" if header.strip() else "path:" + hashlib.sha256(path.strip().encode()).hexdigest()[:16]

    def submit(self, work: Callable[[], object], path: str, header: str = "") -> Job:
        """Starts the work, or returns the job that has its key and hasn't failed."""
        key = self.key(header, path)
        with self._lock:
            held = self._held.get(key)
            if held is not None and held.status != "failed":
                return held
            job = self._held[key] = Job(key)
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return job

    def _run(self, job: Job, work: Callable[[], object]) -> None:
        job.status, job.started = "running", time.time()
        try:
            job.result = work()
            job.status = "succeeded"
        except Exception as e:  # the job keeps what went wrong
            job.failure = e.as_dict() if isinstance(e, ServiceError) else ServiceError("internal", str(e), True).as_dict()
            job.status = "failed"
        job.ended = time.time()

    def get(self, job_id: str) -> Job | None:
        return self._held.get(job_id)


def ingest_async(store: Store, jobs: Jobs, path: str, header: str = "") -> Job:
    return jobs.submit(lambda: ingest(store, path), path, header)
