"""Documents and sections from their atoms, for any number of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.functions.coerce import json_or_empty


def section_texts(l2: DataFrame, l3: DataFrame) -> DataFrame:
    """A6 (inner level), J4, T7: l1_id, l2_id, sort_order, block: each section's atoms in order, formatted by its type."""
    atoms = l3.groupBy("l2_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "l3_id", "content"))), lambda x: x.getField("content")).alias("_a"))
    rows = l2.join(atoms, "l2_id", "left")
    meta = json_or_empty(F.col("source_metadata"))
    kind = F.coalesce(F.try_variant_get(meta, "$.block_type", "string"), F.col("section_type"))
    headers = F.coalesce(F.try_variant_get(meta, "$.headers", "array<string>"), F.array().cast("array<string>"))
    block = X.format_block(F.col("section_id"), kind, headers, F.try_variant_get(meta, "$.separator_row", "string"), F.try_variant_get(meta, "$.language", "string"), F.coalesce("_a", F.array().cast("array<string>")))
    return rows.select("l1_id", "l2_id", "section_id", "sort_order", block.alias("block"))


def documents(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """l1_id, title, source_type, source_metadata, toc, l1_summary, content: code files line by line, others by blocks."""
    blocks = section_texts(l2, l3).where("block <> ''")
    prose = blocks.groupBy("l1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "section_id", "block"))), lambda x: x.getField("block")), "\n\n").alias("_prose"))
    lines = l3.join(l1.where("source_type = 'code'").select("l1_id"), "l1_id", "left_semi")
    code = lines.groupBy("l1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "content"))), lambda x: x.getField("content")), "\n").alias("_code"))
    rows = l1.join(prose, "l1_id", "left").join(code, "l1_id", "left")
    content = F.when(F.col("source_type") == "code", F.col("_code")).otherwise(F.col("_prose"))
    return rows.select("l1_id", "title", "source_type", "source_metadata", "toc", F.col("summary").alias("l1_summary"), F.coalesce(content, F.lit("")).alias("content"))


def section_code(l3: DataFrame) -> DataFrame:
    """l2_id, content: a section's lines joined by newlines."""
    return l3.groupBy("l2_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "content"))), lambda x: x.getField("content")), "\n").alias("content"))
