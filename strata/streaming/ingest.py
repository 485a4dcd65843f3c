"""Extension: files that arrive in a folder are ingested as a stream (the reference system has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.plans import service
from strata.sources import files
from strata.sources.store import Store


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Files of a folder, once each, as path and content; at most per_batch in a batch."""
    raw = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", str(per_batch)).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return raw.select(files.relative(F.col("path"), folder).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def start(spark: SparkSession, folder: str, store: Store, checkpoint: str, project_id: int = 0) -> StreamingQuery:
    """Ingests what is there and ends (availableNow). A batch that is run again skips what it has written."""

    def add(batch: DataFrame, _: int) -> None:
        service.ingest_records(store, files.as_records(files.readable(batch), project_id))

    return file_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, at: str, delay: str = "1 hour", text_col: str = "content") -> DataFrame:
    """The first row of each content hash within the watermark."""
    return stream.withColumn("content_hash", F.sha2(F.col(text_col).cast("binary"), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])
