"""A store of Parquet tables in one folder: create, read, replace, reset.

A table's rows are dealt over buckets by a hash of their key. A write makes a new
generation of the buckets that it touches, and then names them in a small pointer table, so that
readers of old ones and failed writes do no harm, and a merge costs what it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import admin
from strata.sources.scratch import held

# Columns of the tables.
SCHEMAS = {
    "projects": "id bigint, machine_id bigint, name string, root_path string, description string, source_metadata map<string,string>, content_hash string",
    "documents": "doc_key string, machine_id bigint, project_id bigint, title string, path string, source_type string, source_metadata map<string,string>, content_hash string, current_l1_id string, version int",
    "l1": "doc_key string, l1_id string, project_id bigint, title string, path string, source_type string, source_metadata map<string,string>, content_hash string, summary string, l2_child_hash string, toc string, created_at timestamp, synced_at timestamp",
    "l2": "l1_id string, l2_id string, section_id string, parent_id string, sort_order int, section_type string, path string, text string, source_metadata string, summary_hash string, summary string, title_id string, l3_child_hash string",
    "l3": "l1_id string, l2_id string, l3_id string, parent_id string, sort_order int, content string, content_hash string, embedded boolean, source_metadata string",
    "keywords": "machine_id bigint, canonical_name string",
    "l1_vectors": "l1_id string, project_id bigint, vector array<float>",
    "l3_vectors": "point_id string, l1_id string, l2_id string, l3_id string, section_id string, section_type string, source_type string, project_id bigint, keyword_ids array<bigint>, vector array<float>",
    "edges": "src string, src_type string, dst string, dst_type string, project_id bigint, rel string",
    "versions": "id bigint, name string, metadata string",
    "collections": "name string, size int, distance string",
}
KEYS = {"projects": "root_path", "documents": "doc_key", "l1": "l1_id", "l2": "l2_id", "l3": "l3_id", "keywords": "machine_id", "l1_vectors": "l1_id", "l3_vectors": "point_id", "collections": "name"}
SPREAD = {"edges": ["src", "dst"], "versions": ["id", "name"]}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        """buckets: over how many a new table is dealt; a table keeps the number that it was made with."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _pointers(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}/_heads_table"
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema("no bigint, buckets int, bucket int, path string").parquet(path)

    def exists(self, name: str) -> bool:
        """S14."""
        return self._pointers(name) is not None

    def _heads(self, name: str) -> tuple[int, int, dict[int, str]]:
        """(number of the last write, buckets of the table, folder of each bucket that has rows)."""
        held = self._pointers(name)
        if held is None:
            return 0, self.buckets, {}
        rows = held.groupBy("bucket", "buckets").agg(F.max("no").alias("no"), F.max_by("path", F.struct("no", "path")).alias("path")).collect()
        return max(r["no"] for r in rows), rows[0]["buckets"], {r["bucket"]: r["path"] for r in rows}

    def _load(self, name: str, paths: dict[int, str]) -> DataFrame:
        """The rows of some buckets; none is listed that holds none."""
        folders = sorted({f"{self.root}/{name}/{p}" for p in paths.values() if p})
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders)

    def read(self, name: str) -> DataFrame:
        """The table; an empty one if it was never written."""
        return self._load(name, self._heads(name)[2])

    def _bucket(self, name: str, buckets: int) -> Column:
        keys = SPREAD.get(name) or [KEYS[name]]
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, name: str, df: DataFrame, touched: list[int] | None) -> None:
        """A new generation of the touched buckets (all, for None), then its pointers."""
        no, buckets, _ = self._heads(name)
        path = f"gen-{uuid.uuid4().hex}"
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMAS[name]).schema}
        typed = df.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).withColumn("_b", self._bucket(name, buckets))
        typed.write.partitionBy("_b").parquet(f"{self.root}/{name}/{path}")
        jvm = self.spark._jvm
        system = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{path}").getFileSystem(self.spark._jsc.hadoopConfiguration())
        rows = []
        for b in range(buckets) if touched is None else touched:
            some = system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{path}/_b={b}"))
            rows.append((no + 1, buckets, b, f"{path}/_b={b}" if some else ""))
        self.spark.createDataFrame(rows, "no bigint, buckets int, bucket int, path string").coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/_heads_table")

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a new generation of all buckets."""
        self._write(name, df, None)

    def merge(self, name: str, new: DataFrame) -> None:
        """New rows take the place of old ones of the same key (whole rows, for tables without a key); only buckets that they fall into are read and written."""
        _, buckets, heads = self._heads(name)
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        new = new.select(*columns)
        if not any(heads.values()):
            return self.replace(name, self._checked(name, new))
        new = held(self._checked(name, new))
        touched = sorted(r["b"] for r in new.select(self._bucket(name, buckets).alias("b")).distinct().collect())  # `buckets` rows at most
        if not touched:
            return
        old = self._load(name, {b: heads[b] for b in touched if b in heads})
        if name in KEYS:
            both = old.join(new.select(KEYS[name]), KEYS[name], "left_anti").select(*columns).unionByName(new)
        else:
            both = old.unionByName(new).distinct()
        self._write(name, both, touched)

    def _checked(self, name: str, new: DataFrame) -> DataFrame:
        """New rows of vectors, which must have the collection's size; writing others fails."""
        size = self.read("collections").where(F.col("name") == name).select("size").first() if name.endswith("_vectors") else None
        if size is None:
            return new
        wrong = F.raise_error(F.concat(F.lit(f"{name} holds vectors of {size['size']} numbers, not of "), F.size("vector").cast("string")))
        return new.withColumn("vector", F.when(F.size("vector") == size["size"], F.col("vector")).otherwise(wrong))

    def create_vectors(self, size: int, distance: str = "cosine") -> None:
        """K9: empty vector tables if there are none, with the size that vectors must have to be merged; those that are there keep theirs."""
        made = {r["name"] for r in self.read("collections").select("name").collect()}
        fresh = [(n, size, distance) for n in ("l1_vectors", "l3_vectors") if n not in made]
        if fresh:
            self.merge("collections", self.spark.createDataFrame(fresh, SCHEMAS["collections"]))
        for name in ("l1_vectors", "l3_vectors"):
            if not self.exists(name):
                self.replace(name, self.read(name))

    def create(self) -> None:
        """Every table, empty, that isn't there yet."""
        for name in SCHEMAS:
            if not self.exists(name):
                self.replace(name, self.read(name))

    def drop(self) -> None:
        """All tables with their rows."""
        jvm = self.spark._jvm
        for name in SCHEMAS:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def catalog(self) -> DataFrame:
        """table_name, present, columns."""
        rows = [(name, self.exists(name), len(columns.split(", "))) for name, columns in SCHEMAS.items()]
        return self.spark.createDataFrame(rows, "table_name string, present boolean, columns int")

    def mark_synced(self, l1_ids: DataFrame, at: Column | None = None) -> None:
        """Sets synced_at of the snapshots that a table of l1_id names."""
        l1 = self.read("l1")
        self.merge("l1", l1.join(l1_ids.select("l1_id"), "l1_id", "left_semi").withColumn("synced_at", F.current_timestamp() if at is None else at))

    def counts(self, project_id: int | None = None) -> DataFrame:
        """A1."""
        return admin.counts(admin.scoped(*(self.read(t) for t in ("documents", "l1", "l2", "l3")), project_id))

    def reset(self, project_id: int | None = None, dry_run: bool = False) -> dict[str, int]:
        """Deletes a project's rows, or all (the keyword dictionary only then; versions never); returns the counts of what goes. dry_run only counts."""
        tables = {t: self.read(t) for t in ("documents", "l1", "l2", "l3")}
        gone = {r["table_name"]: r["n"] for r in self.counts(project_id).collect()}
        if dry_run:
            return gone
        if project_id is None:
            for name in SCHEMAS:
                if name not in ("versions", "collections"):
                    self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]))
            return gone
        for name, rest in admin.without(tables, project_id).items():
            self.replace(name, rest)
        for name in ("l1_vectors", "l3_vectors", "edges"):
            self.replace(name, self.read(name).where(F.col("project_id") != project_id))
        # the project's row and source hash go too, so that it can be ingested again
        self.replace("projects", self.read("projects").where(F.col("id") != project_id))
        return gone
