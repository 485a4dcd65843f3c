"""Files as ingest records, read by Spark's binaryFile source from any store it knows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# Extensions that are read.
MARKDOWN = ("md", "markdown")
CODE = ("go", "py", "js", "ts", "tsx", "jsx", "java", "rs", "c", "cpp", "h")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = MARKDOWN + CODE) -> DataFrame:
    """Path (below the root), extension, content (UTF-8 with marks for bytes that are none) of the files with these extensions; no directory below the root whose name starts with a dot."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    below = relative(F.col("path"), root)
    rows = rows.select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return readable(rows, extensions)


def readable(rows: DataFrame, extensions: tuple[str, ...] = MARKDOWN + CODE) -> DataFrame:
    """Of path and content, with the extension: files with one of the extensions, in no directory whose name starts with a dot."""
    rows = rows.where(~F.concat(F.lit("/"), F.col("path")).rlike(r"/\.[^/]+/"))
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    return rows.where(F.col("extension").isin(*extensions)).select("path", "extension", "content")


def relative(path: Column, root: str) -> Column:
    bare = re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z][a-z0-9+.-]*:/+", "/"), "^" + re.escape(bare) + "/+", "")


HEAD = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"


def parse_head(head: str | None) -> dict[str, str]:
    """A YAML front matter as text values; nulls are dropped. Empty for what is no mapping."""
    if not head:
        return {}
    try:
        import yaml

        held = yaml.safe_load(head)
    except ImportError:
        held = dict(m.groups() for m in re.finditer(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.+?)[ \t]*$", head))
    except Exception:  # not YAML: the text stays without metadata
        return {}
    return {str(k): str(v) for k, v in held.items() if v is not None} if isinstance(held, dict) else {}


@F.pandas_udf(MapType(StringType(), StringType()))
def _heads(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for h in heads:
        yield h.map(parse_head, na_action=None)


def title_of(path: Column) -> Column:
    """A file's stem with - and _ as spaces, in title case."""
    return F.initcap(F.translate(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), "-_", "  "))


def front_matter(files: DataFrame) -> DataFrame:
    """Path, title, content (without the head), source_metadata: the head's title or one made of the path."""
    head = F.regexp_extract("content", HEAD, 1)
    rows = files.select("path", F.regexp_replace("content", HEAD, "").alias("content"), _heads(head).alias("_m"))
    title = F.coalesce(F.nullif(F.trim(F.try_element_at("_m", F.lit("title"))), F.lit("")), title_of(F.col("path")))
    return rows.select("path", title.alias("title"), "content", F.map_filter("_m", lambda k, v: k != "title").alias("source_metadata"))


def records(spark: SparkSession, root: str, project_id: int = 0) -> DataFrame:
    """Ingest records of a folder: Markdown files go to the wiki domain, code files, titled by path, to the code domain."""
    return as_records(scan(spark, root), project_id)


def as_records(files: DataFrame, project_id: int = 0) -> DataFrame:
    """The same for files (path, extension, content)."""
    pages = front_matter(files.where(F.col("extension").isin(*MARKDOWN))).withColumn("domain", F.lit("wiki"))
    empty = F.create_map().cast("map<string,string>")
    code = files.where(F.col("extension").isin(*CODE)).select("path", F.col("path").alias("title"), "content", empty.alias("source_metadata"), F.lit("code").alias("domain"))
    rows = pages.unionByName(code)
    path = F.create_map(F.lit("path"), F.col("path"))
    meta = F.map_concat(F.map_filter("source_metadata", lambda k, v: k != "path"), path)
    return rows.select("title", "content", meta.alias("source_metadata"), "domain", F.lit(project_id).cast("bigint").alias("project_id"))


def write_texts(df: DataFrame, root: str, name: str, content: str, file_name: str) -> None:
    """A file for each row: root/NAME=value/file_name, by the values of the column `name`, with a line feed after the content.

    Spark's text writer writes them, whatever their number, and each is then renamed; only names come to the driver.
    """
    spark = df.sparkSession
    df.select(name, F.col(content).alias("value")).repartition(name).write.partitionBy(name).mode("append").text(root)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}=*/part-*")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(place) or []:
        old = status.getPath()
        fs.rename(old, spark._jvm.org.apache.hadoop.fs.Path(old.getParent(), file_name))
