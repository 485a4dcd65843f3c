"""Context of hits: relational joins and neighbour windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as X

#: Atoms on either side in which sort_order counts; level 2 looks no further than LEVEL2.
WINDOW, LEVEL2 = 2000, 1500


def neighbour_frame(atoms: DataFrame, window: int = WINDOW, section: str = "l2_id") -> DataFrame:
    """W1 for every atom: the texts of its section within `window` of its sort_order, in order, as surrounding_context."""
    frame = Window.partitionBy(section).orderBy("sort_order").rangeBetween(-window, window)
    near = F.collect_list(F.struct("sort_order", F.when(~X.blank(F.col("content")), F.col("content")).alias("c"))).over(frame)
    kept = F.array_compact(F.transform(F.array_sort(near), lambda x: x.getField("c")))
    return atoms.withColumn("surrounding_context", F.array_join(kept, "\n\n"))


def neighbours(hits: DataFrame, atoms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hits (l3_id, l2_id, sort_order) and the non-blank atoms of their section within `window`: l3_id, n_sort, n_content."""
    h = hits.select("l3_id", "l2_id", F.greatest(F.col("sort_order") - window, F.lit(0)).alias("lo"), (F.col("sort_order") + window).alias("hi"))
    a = atoms.where(~X.blank(F.col("content"))).select(F.col("l2_id").alias("_l2"), F.col("sort_order").alias("n_sort"), F.col("content").alias("n_content"))
    return h.join(a, (h["l2_id"] == a["_l2"]) & F.col("n_sort").between(F.col("lo"), F.col("hi"))).select("l3_id", "n_sort", "n_content")


def within_budget(texts: Column, budget: Column) -> Column:
    """the leading texts whose joined text stays within a budget of tokens; none after the first that does not fit."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, t: Column) -> Column:
        longer = F.concat(acc.getField("kept"), F.array(t))
        over = acc.getField("full") | (X.token_count(F.array_join(longer, "\n\n")) > budget)
        return F.struct(F.when(over, acc.getField("kept")).otherwise(longer).alias("kept"), over.alias("full"))

    kept = F.aggregate(texts, start, step).getField("kept")
    return F.when(budget <= 0, F.array().cast("array<string>")).otherwise(kept)


def rich_context(hits: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame, window: int = WINDOW, level: int = 1, max_tokens: int | None = None) -> DataFrame:
    """Hits (l3_id, score) with their section, document, title, breadcrumb and surrounding text.

    Level 0 has no surroundings; level 2 has the section's summary and the text itself; level 3 adds summary and toc of the document.
    """
    reach = min(window, LEVEL2) if level == 2 else window
    title = l3.select(F.col("l3_id").alias("title_id"), F.col("content").alias("section_heading"))
    rows = hits.join(l3.select("l3_id", "l2_id", "sort_order", F.col("content").alias("matched_content")), "l3_id")
    rows = rows.join(l2.select("l2_id", "l1_id", "section_id", F.col("summary").alias("l2_summary"), "title_id"), "l2_id")
    rows = rows.join(l1.select("l1_id", "doc_key", "project_id", F.col("title").alias("l1_title"), "path", "source_type", "source_metadata", F.col("summary").alias("l1_summary"), "toc"), "l1_id")
    rows = rows.join(title, "title_id", "left")
    near = neighbours(rows, l3, reach) if level > 0 else rows.select("l3_id", F.lit(0).alias("n_sort"), F.lit("").alias("n_content")).limit(0)
    lists = near.groupBy("l3_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_sort", "n_content"))), lambda x: x.getField("n_content")).alias("_near"))
    rows = rows.join(lists, "l3_id", "left").withColumn("_near", F.coalesce("_near", F.array().cast("array<string>")))
    heading = F.coalesce("section_heading", F.lit(""))
    crumb = X.breadcrumb(F.col("l1_title"), heading)
    if max_tokens is not None:
        used = F.concat_ws("\n", crumb, "l1_title", "l2_summary", heading, "matched_content", *(("l1_summary", "toc") if level >= 3 else ()))
        rows = rows.withColumn("_near", within_budget(F.col("_near"), F.lit(max_tokens) - X.token_count(used)))
    around = F.array_join("_near", "\n\n")
    if level == 2 and max_tokens is None:
        around = X.or_else(X.trim_ws(F.concat_ws("\n\n", F.when(~X.blank(F.col("l2_summary")), F.col("l2_summary")), "matched_content")), around, F.lit(""))
    name = X.or_empty(F.try_element_at("source_metadata", F.lit("name")), F.try_element_at("source_metadata", F.lit("project_id")))
    extra = [F.col("l1_summary"), F.col("toc")] if level >= 3 else []
    return rows.select("l1_id", "l2_id", "l3_id", F.col("doc_key").alias("doc_id"), "project_id", "score", "l1_title", "section_id", heading.alias("section_heading"), "matched_content", "l2_summary", F.when(F.col("source_type") == "code", F.col("path")).otherwise("").alias("source_path"), name.alias("doc_name"), crumb.alias("breadcrumb"), F.coalesce(around, F.lit("")).alias("surrounding_context"), *extra)
