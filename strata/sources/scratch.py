"""Small tables that end a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new temporary folder if driver and executors are one process, else an error."""
    sc = spark.sparkContext
    kept = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not kept:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        kept = tempfile.mkdtemp(prefix="strata-")
        sc.setCheckpointDir(kept)
    return kept.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """df, written once and read back: what reads it several times doesn't compute it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/strata-held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in any store that Hadoop knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
