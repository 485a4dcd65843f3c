"""Projects, revisions, upserts, counts and scoped deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.coerce import merge_maps


def merkle(rows: DataFrame, project: str, machine_id: str, child_hash: str) -> DataFrame:
    """Project, content_hash: SHA-256 over machine_id (8 bytes, big-endian) and hash (hex) of its documents in order of machine_id; projects without hashes are left out."""
    pair = F.struct(F.col(machine_id).alias("m"), F.col(child_hash).alias("h"))
    held = rows.where(F.col(child_hash).isNotNull()).groupBy(project).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    text = F.array_join(F.transform("_pairs", lambda x: F.concat(F.lpad(F.hex(x.getField("m")), 16, "0"), x.getField("h"))), "")
    return held.select(project, F.sha2(F.unhex(text), 256).alias("content_hash"))


def up_to_date(fresh: DataFrame, stored: DataFrame, project: str) -> DataFrame:
    """Project, already_up_to_date: whether its stored hash is the one of its sources."""
    both = fresh.select(project, F.col("content_hash").alias("f")).join(stored.select(project, F.col("content_hash").alias("s")), project, "left")
    return both.select(project, (F.col("f").eqNullSafe(F.col("s")) & F.col("s").isNotNull()).alias("already_up_to_date"))


def upsert_versions(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """K1: old rows and new ones by key; a row that is in both has the new values, version + 1, and its old value of a kept column where the new one is null."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == "version":
            return F.when(is_new & is_old, F.col("o.version") + 1).when(is_new, F.lit(1)).otherwise(F.col("o.version")).alias(c)
        if c == key or c in keep:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*(value(c) for c in old.columns))


def upsert_projects(old: DataFrame, new: DataFrame, key: str = "root_path") -> DataFrame:
    """Projects by root path; metadata is merged, new entries first."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def value(c: str) -> Column:
        if c == "source_metadata":
            return merge_maps(F.col("o.source_metadata"), F.col("n.source_metadata")).alias(c)
        return F.coalesce(f"n.{c}", f"o.{c}").alias(c)

    return both.select(*(value(c) for c in old.columns))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def heads(documents: DataFrame, revisions: DataFrame, key: str, revision: str, at: str) -> DataFrame:
    """Key, head: the document's current revision, else its latest."""
    last = latest(revisions, [key], at, revision).select(key, F.col(revision).alias("_last"))
    return documents.join(last, key, "left").select(key, F.coalesce("current", "_last").alias("head"))


def complete(heads_: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """the heads (l1_id) that have a section with an atom."""
    filled = l2.join(l3.select("l2_id"), "l2_id", "left_semi").select("l1_id")
    return heads_.join(filled, "l1_id", "left_semi")


def scoped(documents: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame, project_id: int | None) -> dict[str, DataFrame]:
    """the rows of each table that belong to a project (to any, for None)."""
    if project_id is None:
        return {"documents": documents, "l1": l1, "l2": l2, "l3": l3}
    own = l1.where(F.col("project_id") == project_id)
    sections = l2.join(own.select("l1_id"), "l1_id", "left_semi")
    return {"documents": documents.where(F.col("project_id") == project_id), "l1": own, "l2": sections, "l3": l3.join(sections.select("l2_id"), "l2_id", "left_semi")}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A1: table_name, n."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """What stays of each table when a project is deleted."""
    gone = scoped(tables["documents"], tables["l1"], tables["l2"], tables["l3"], project_id)
    ids = {"documents": "doc_key", "l1": "l1_id", "l2": "l2_id", "l3": "l3_id"}
    return {name: tables[name].join(gone[name].select(ids[name]), ids[name], "left_anti") for name in ids}


def roots(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Nodes with is_root: no parent, or one that isn't there."""
    known = nodes.select(F.col(id_col).alias("_p"), F.lit(1).alias("_known"))
    return nodes.join(known, F.col(parent_col) == F.col("_p"), "left").withColumn("is_root", F.col("_known").isNull()).drop("_p", "_known")


def nodes(l1: DataFrame, project_id: int) -> DataFrame:
    """Id, title, source_type, document of a project's snapshots, and their position (from 1) by creation, then id."""
    own = l1.where(F.col("project_id") == project_id)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "l1_id"))
    return own.select(F.col("l1_id").alias("id"), "title", "source_type", F.col("doc_key").alias("document_id"), "created_at", place.alias("position")).orderBy("position")


def unsynced(l1: DataFrame) -> DataFrame:
    """snapshots that a graph hasn't been given."""
    return l1.where(F.col("synced_at").isNull())


def audit(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents with their project's root path and machine id."""
    return documents.join(projects.select(F.col("id").alias("project_id"), "root_path", F.col("machine_id").alias("project_machine_id")), "project_id").select("doc_key", "project_id", "root_path", "project_machine_id")


def ingest_summary(log: DataFrame, line: str = "line") -> DataFrame:
    """A10: md, code, ok: how many lines of a log start with [md] and [code], and how many end in OK."""
    text = F.trim(F.col(line))
    return log.agg(F.count_if(text.startswith("[md]")).alias("md"), F.count_if(text.startswith("[code]")).alias("code"), F.count_if(text.rlike(r"\bOK\b")).alias("ok"))


def rolled_up(deps: DataFrame) -> DataFrame:
    """Status: degraded if any dependency has an error, else ok."""
    return deps.agg(F.when(F.coalesce(F.bool_or(F.col("status") == "error"), F.lit(False)), "degraded").otherwise("ok").alias("status"))
