"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from strata.llm.textvec import release, tidy, tidy_group


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset: a new temporary one if driver and executors are one process, else an error."""
    sc = spark.sparkContext
    kept = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not kept:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        kept = tempfile.mkdtemp(prefix="strata-checkpoints-")
        sc.setCheckpointDir(kept)
    return kept.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to be none of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows in an Arrow batch keep what each Python worker and its JVM side hold small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A table of a few rows that the driver has. By Arrow, as one of Python rows would start a second daemon and further workers in each executor, which stay in its memory."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns), DataType.fromDDL(schema))


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of what jobs that are over have left: Python's references to plans, then the driver's broadcasts, bitmaps and shuffle files. Else the driver's heap grows with the number of jobs, up to its limit."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's input size; where it has none (tables that aren't files), the bytes of its texts and blobs, added up."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    total = F.lit(8).cast("long")
    for c in long:
        total = total + c
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]


def fragments(df: DataFrame, each_mb: float, least: int = 1) -> int:
    """How many fragments a hash space is cut into, so that each gets about each_mb of the input; grows with the input."""
    return int(max(least, -(-input_bytes(df) // int(each_mb * (1 << 20)))))


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text; 0 for null."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0))


class Bitmap:
    """A set of 64-bit hashes with false positives only, of a fixed number of bits: it may be broadcast at any input size."""

    def __init__(self, bits: int = 1 << 25, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.bits)).astype(np.int64)

    def add_slots(self, slots: np.ndarray) -> None:
        np.bitwise_or.at(self.data, slots >> 3, (1 << (slots & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        s = self.slots(h)
        return (self.data[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def folded_up(df: DataFrame, keys: list[str], add, schema: str, at_once: int = 32) -> DataFrame:
    """One row for each key: `add` (table -> table of one row) over the rows of df, of which each task has one for each key.

    Rows are added up in a tree of three levels, so that one task holds `at_once` of them, or
    at the root a thousandth of the tasks'.
    """

    def some(table):
        import pyarrow as pa

        return add(table.drop_columns(["_task"])).append_column("_task", pa.chunked_array([table["_task"].combine_chunks()[:1]]))

    rows = df.withColumn("_task", F.spark_partition_id())
    for _ in range(2):
        rows = rows.withColumn("_task", F.floor(F.col("_task") / at_once).cast("int")).groupBy(*keys, "_task").applyInArrow(tidy_group(some), f"{schema}, _task int")
    return rows.drop("_task").groupBy(*keys).applyInArrow(tidy_group(add), schema)


def bitmap_of_longs(df: DataFrame, bits: int = 1 << 25) -> Bitmap:
    """A Bitmap (of a power of two of bits) of a one-column table of 64-bit values.

    Spark's own bitmap aggregates make it, in pieces of 4 kB that are joined by place, so
    that the driver gets each piece once.
    """
    slot = F.col(df.columns[0]).cast("long").bitwiseAND(bits - 1) + 1
    slots = df.select(slot.alias("s"))
    pieces = slots.groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = Bitmap(bits)
    for row in pieces.collect():  # bits / 8 bytes in all
        if row["k"] is not None:
            piece = np.frombuffer(row["bits"], np.uint8)
            at = (row["k"] - 1) * len(piece)
            out.data[at : at + len(piece)] |= piece[: len(out.data) - at]
    return out


def split_by(df: DataFrame, key: Column, bitmap: Bitmap) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in the bitmap, the others); no shuffle. The bitmap is held by each task (bits / 8 bytes)."""
    held = df.sparkSession.sparkContext.broadcast(bitmap.data)

    def choose(wanted: bool):
        def apply(batches):
            import pyarrow as pa

            own = Bitmap(bitmap.bits, held.value)
            for b in batches:
                found = own.has(np.asarray(b.column(b.num_columns - 1)).view(np.uint64))
                yield b.filter(pa.array(found == wanted)).select(b.schema.names[:-1])

        return apply

    rows = df.select(*df.columns, key.alias(fresh(df, "_split")[0]))
    return tuple(rows.mapInArrow(tidy(choose(x)), df.schema) for x in (False, True))


def running_sum(df: DataFrame, group: list[str], key: str, value: str, out: str, buckets: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group that come before by `key`, a column of hash values that is unique in its group.

    The key's range is cut into `buckets`; sums of buckets are added up first (a few
    numbers for each group and bucket), then each bucket is summed on its own, so that a
    group with most of the rows is spread over as many tasks as there are buckets.
    """
    b = F.pmod(F.shiftrightunsigned(F.col(key), 40), F.lit(1 << 24)) * buckets / (1 << 24)
    df = df.withColumn("_bucket", b.cast("int"))
    by = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(by), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, "_bucket").orderBy(F.shiftrightunsigned(F.col(key), 1), key).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [within[c].eqNullSafe(base[c]) for c in [*group, "_bucket"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return within.join(base, cond).select(*[within[c] for c in df.columns if c != "_bucket"], (F.col("_base") + F.col("_within")).alias(out))
