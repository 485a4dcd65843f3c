"""Directed graphs and trees as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import directory
from strata.sources.scratch import held


def directory_edges(files: DataFrame, file_col: str, path_col: str, project_col: str) -> DataFrame:
    """Project, dir_path, file: each once."""
    return files.select(F.col(project_col).alias("project"), directory(F.col(path_col)).alias("dir_path"), F.col(file_col).alias("file")).distinct()


def siblings(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """Project, file: files in a directory of a seed of the same project, but for the seeds; `most` (if above 0) by id."""
    dirs = edges.join(seeds.select("project", "file"), ["project", "file"], "left_semi").select("project", "dir_path").distinct()
    found = edges.join(dirs, ["project", "dir_path"]).select("project", "file").distinct().join(seeds, ["project", "file"], "left_anti")
    return found.orderBy("project", "file").limit(most) if most else found


def first_atoms(related: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """l1_id, l3_id: the first atom of each related document."""
    rows = related.select("l1_id").join(l2.select("l1_id", "l2_id", F.col("sort_order").alias("s2")), "l1_id").join(l3.select("l2_id", "l3_id", "sort_order"), "l2_id")
    order = Window.partitionBy("l1_id").orderBy("s2", "sort_order", "l3_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("l1_id", "l3_id")


def expand(hits: DataFrame, edges: DataFrame, l2: DataFrame, l3: DataFrame, project_id: int, max_siblings: int | None = None, max_results: int | None = None) -> DataFrame:
    """Hits (l3_id, l1_id, score) and, after them, the first atoms of sibling files; score null, source graph_expansion."""
    files = edges.where((F.col("dst_type") == "file") & (F.col("project_id") == project_id)).select(F.col("project_id").alias("project"), F.col("src").alias("dir_path"), F.col("dst").alias("file"))
    seeds = hits.select(F.lit(project_id).cast("bigint").alias("project"), F.col("l1_id").alias("file")).distinct()
    related = siblings(files, seeds, max_siblings).select(F.col("file").alias("l1_id"))
    added = first_atoms(related, l2, l3).orderBy("l1_id")
    added = added.limit(max_results) if max_results else added
    own = hits.select("l3_id", "l1_id", "score", F.lit("search").alias("source"))
    return own.unionByName(added.select("l3_id", "l1_id", F.lit(None).cast("double").alias("score"), F.lit("graph_expansion").alias("source")))


def reach(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", most: int | None = None) -> DataFrame:
    """Node, distance: what can be reached from any seed (column `node`; distance 0) along the edges, in the fewest steps, `most` at most.

    Each round follows the edges of the frontier and keeps what no round has seen, so cycles
    end; a round is written before the next one reads it. A node with very many edges is a
    join's hot key, which Spark splits. Edges with a null end are left out.
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("_from"), F.col(dst).alias(node)).distinct()
    known = held(known)
    frontier = held(seeds.where(F.col(node).isNotNull()).select(node).distinct().withColumn("distance", F.lit(0)))
    seen, step = frontier, 0
    while (most is None or step < most) and frontier.head(1):
        step += 1
        next_ = known.join(frontier.select(F.col(node).alias("_from")), "_from").select(node).distinct()
        frontier = held(next_.join(seen.select(node), node, "left_anti").withColumn("distance", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def tree_paths(nodes: DataFrame, order: list[str], id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Nodes (ids are unique) with depth (0 for a root: no parent, or one that isn't there) and path: a text that sorts a tree's nodes depth first, siblings by `order`, then id.

    Paths are made by pointer jumping: each round doubles the stretch of ancestors that a path
    covers, so a tree of depth d takes log2(d) rounds. Nodes on a cycle, or below one, have no root
    and are left out.
    """
    known = nodes.select(F.col(id_col).alias("_p"), F.lit(1).alias("_known")).where("_p is not null")
    rows = nodes.join(known, F.col(parent_col) == F.col("_p"), "left").withColumn("_up", F.when(F.col("_known").isNotNull(), F.col(parent_col))).drop("_p", "_known")
    number = F.row_number().over(Window.partitionBy("_up").orderBy(*order, id_col))
    # the digits' length goes first, so that any number of siblings sorts as text
    label = F.concat(F.char(F.length(number.cast("string")) + 64), number.cast("string"), F.lit("/"))
    rows = held(rows.withColumn("_label", label))
    state = rows.select(F.col(id_col).alias("_id"), F.col("_up").alias("_at"), F.col("_label").alias("_path"), F.lit(0).alias("_depth"))
    left = state.count()
    rounds = max(1, left).bit_length() + 1
    for _ in range(rounds):
        above = state.select(F.col("_id").alias("_a"), F.col("_at").alias("_a_at"), F.col("_path").alias("_a_path"), F.col("_depth").alias("_a_depth"))
        joined = state.join(above, F.col("_at") == F.col("_a"), "left")
        path = F.concat(F.coalesce("_a_path", F.lit("")), "_path")
        depth = F.when(F.col("_at").isNull(), F.col("_depth")).otherwise(F.col("_depth") + F.col("_a_depth") + 1)
        state = held(joined.select("_id", F.col("_a_at").alias("_at"), path.alias("_path"), depth.alias("_depth")))
        if not state.where("_at is not null").head(1):
            break
    whole = state.where("_at is null").select("_id", F.col("_path").alias("path"), F.col("_depth").alias("depth"))
    return rows.join(whole, F.col(id_col) == F.col("_id")).drop("_id", "_up", "_label")


def nested_json(nodes: DataFrame, tree: str, fields: list[str], order: list[str], id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Tree, json, nodes: of each tree (column `tree`) its roots as a JSON list, each node with its fields (nulls are left out) and its `children`, in order.

    A node's depth and its follower's say which lists open and close after it, so a tree's
    text is its nodes' pieces in the order of their paths; nothing nests in memory or comes to
    the driver.
    """
    rows = tree_paths(nodes, order, id_col, parent_col)
    after = F.lead("depth").over(Window.partitionBy(tree).orderBy("path"))
    own = F.to_json(F.struct(*fields))
    opened = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.when(own == "{}", "").otherwise(","), F.lit('"children":['))
    closed = F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("_next", F.lit(0)) + 1)
    piece = F.concat(opened, F.when(F.col("_next") > F.col("depth"), "").otherwise(F.concat(closed, F.when(F.col("_next").isNull(), "").otherwise(","))))
    pieces = rows.withColumn("_next", after).withColumn("_piece", piece).groupBy(tree).agg(F.array_sort(F.collect_list(F.struct("path", "_piece"))).alias("_l"), F.count("*").alias("nodes"))
    return pieces.select(tree, F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["_piece"]), ""), F.lit("]")).alias("json"), "nodes")
