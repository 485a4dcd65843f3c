"""Source code into lines and chunks, natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import ids
from strata.functions import text as X

DEF = r"^(?:async\s+)?def\s+\w+\s*\("
CLASS = r"^class\s+\w+"
FUNC = r"^func\s+"


def code_lines(df: DataFrame, key: str, content: str, whole_file: bool = True) -> DataFrame:
    """Key, line_num (from 1), content, node_type, is_anchor, is_block_start, parent_idx.

    Anchors are unindented def, async def and class lines, and lines that start with `func `.
    Any other line, blank ones too, points to the anchor before it (its index from 0), or to -1.
    A newline at the end of a whole file ends its last line; elsewhere a blank line follows it.
    """
    unified = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n")
    held = F.when(unified == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(unified, r"\n\z", "") if whole_file else unified, "\n", -1))
    rows = df.select(key, F.posexplode(held).alias("_i", "content"))
    line = F.col("content")
    kind = F.when(X.blank(line), "empty_line").when(line.rlike(DEF), "function_definition").when(line.rlike(CLASS), "class_definition").when(line.rlike(FUNC), "function_declaration").otherwise("expression_statement")
    rows = rows.withColumn("node_type", kind).withColumn("is_anchor", F.col("node_type").isin("function_definition", "class_definition", "function_declaration"))
    before = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("is_anchor"), F.col("_i")), ignorenulls=True).over(before), F.lit(-1))
    return rows.select(key, (F.col("_i") + 1).alias("line_num"), "content", "node_type", "is_anchor", F.lit(False).alias("is_block_start"), F.when(F.col("is_anchor"), -1).otherwise(last).alias("parent_idx"))


def code_toc(lines: DataFrame, key: str) -> DataFrame:
    """key, line_num, text, level 2, node_type: def and class lines, by their names."""
    rows = lines.where(F.col("node_type").isin("function_definition", "class_definition"))
    return rows.select(key, "line_num", X.declared_name(F.col("content")).alias("text"), F.lit(2).alias("level"), "node_type")


def code_chunks(df: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Key, section_id, chunk_no, title, first_line, text: lines before the first anchor (`pre`, unless all blank), one chunk for each anchor (fn1, ..); without anchors the whole file (f1), without lines an empty one (f0)."""
    order = Window.partitionBy(key).orderBy("line_num")
    rows = lines.withColumn("_no", F.sum(F.col("is_anchor").cast("int")).over(order)).withColumn("_all", F.max(F.col("is_anchor").cast("int")).over(Window.partitionBy(key)))
    held = rows.groupBy(key, "_no", "_all").agg(F.array_sort(F.collect_list(F.struct("line_num", "content"))).alias("_l"), F.max((~X.blank(F.col("content"))).cast("int")).alias("_some"))
    held = held.where((F.col("_no") > 0) | (F.col("_some") == 1) | (F.col("_all") == 0))
    name = F.when(F.col("_all") == 0, "f1").when(F.col("_no") == 0, "pre").otherwise(F.concat(F.lit("fn"), F.col("_no").cast("string")))
    first = F.get("_l", F.lit(0))
    title = F.when((F.col("_all") == 1) & (F.col("_no") > 0), X.declared_name(first.getField("content"))).otherwise("")
    full = held.select(key, name.alias("section_id"), F.col("_no").cast("int").alias("chunk_no"), title.alias("title"), first.getField("line_num").alias("first_line"), F.array_join(F.transform("_l", lambda x: x.getField("content")), "\n").alias("text"))
    empty = df.select(key).join(lines.select(key).distinct(), key, "left_anti")
    return full.unionByName(empty.select(key, F.lit("f0").alias("section_id"), F.lit(0).alias("chunk_no"), F.lit("").alias("title"), F.lit(0).alias("first_line"), F.lit("").alias("text")))


def code_atoms(lines: DataFrame, key: str) -> DataFrame:
    """K6: one atom for each line: sort_order, content_hash, JSON of its node, whether it is embedded (F6), parent_line."""
    node = F.to_json(F.struct("node_type", "is_anchor", "is_block_start", "line_num"))
    return lines.select(key, (F.col("line_num") * 1000).alias("sort_order"), "content", ids.line_hash(F.col("line_num"), F.col("content")).alias("content_hash"), node.alias("source_metadata"), (F.col("is_anchor") & ~X.blank(F.col("content"))).alias("embedded"), F.when(F.col("parent_idx") >= 0, F.col("parent_idx") + 1).alias("parent_line"))


def restore_code(atoms: DataFrame, key: str) -> DataFrame:
    """Key, content: the lines in order, joined by newlines."""
    held = F.array_sort(F.collect_list(F.struct("sort_order", "content")))
    return atoms.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x.getField("content")), "\n").alias("content"))
