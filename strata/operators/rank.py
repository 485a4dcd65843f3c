"""Ranked retrieval: dense and lexical top-k, reciprocal rank fusion, reranking."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import HANGUL_ALL, let
from strata.operators.nearest import best_of
from strata.sources.scratch import folder

# Words that are no search terms.
STOP = frozenset("a an the of in on at to is or".split())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine likeness; 0 if either is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def dense_top(vectors: DataFrame, query: list[float] | Column, k: int = 30, id_col: str = "l3_id", vector_col: str = "vector", where: Column | None = None) -> DataFrame:
    """Id and score of the k nearest by cosine, ties by id. The filter comes before the scoring."""
    rows = vectors.where(F.col(id_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    q = F.lit([float(x) for x in query]) if isinstance(query, list) else query
    return rows.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Queries that are sent to every task at once.
BLOCK = 1000


def blocks_of(queries: DataFrame, query_col: str) -> list[DataFrame]:
    """Queries in parts of about BLOCK rows, by a hash of their id."""
    blocks = max(1, -(-queries.count() // BLOCK))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == b) for b in range(blocks)]


def dense_top_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_col: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """T1 for a table of queries: query, id, score, rank.

    Queries go in blocks of about BLOCK rows, whatever their number, so that what is
    broadcast is bounded; each block is a job of its own that writes its best rows to the shared
    folder, so that no plan grows with the blocks. Tasks multiply their vectors with a block
    (`nearest`) and pass on what may be among the k best. index.VectorIndex reads less of the vectors.
    """
    parts = blocks_of(queries, query_col)
    size = pc.list_value_length
    path = f"{folder(vectors.sparkSession)}/top-{uuid.uuid4().hex}"
    for part in parts:
        asked = part.select(query_col, F.col(query_vector).cast("array<double>").alias("v")).toArrow()
        lengths = pc.unique(pc.fill_null(size(asked.column(1)), -1)).to_pylist() or [-1]
        for n in lengths:  # one, but for queries of several lengths
            same = asked.filter(pc.equal(pc.fill_null(size(asked.column(1)), -1), n))
            best = best_of(vectors, same, k, id_col, vector_col, query_col, queries.schema[query_col], cosine=True)
            if len(parts) == 1 and len(lengths) == 1:
                return best
            best.write.mode("append").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def technical(token: str) -> bool:
    """two characters or more, of whose ASCII letters, digits and Hangul at least 60 % are ASCII."""
    ascii_n = sum(c.isascii() and c.isalnum() for c in token)
    hangul_n = len(re.findall(f"[{HANGUL_ALL}]", token))
    return len(token) >= 2 and ascii_n > 0 and ascii_n >= 0.6 * (ascii_n + hangul_n)


def search_terms(query: str) -> list[str]:
    """The distinct terms of a query in order; compounds with - and _ are followed by their parts."""
    out: dict[str, None] = {}
    for raw in re.split(r"[\s,()\[\]{}?!#@=><|&]+", query.strip().lower()):
        token = re.sub(r"^[^a-z0-9가-힣\-_.]+|[^a-z0-9가-힣\-_.]+$", "", raw)
        token = re.sub(f"[{HANGUL_ALL}]+$", "", token)
        if token and token not in STOP and technical(token):
            out[token] = None
            parts = [p for p in re.split("[-_]", token) if len(p) > 1 and p not in STOP and technical(p)]
            out |= dict.fromkeys(parts)
    return list(out)


def terms(query: Column) -> Column:
    """F10, X11, X12 for a column: as search_terms, natively; null queries have no terms."""

    def is_term(t: Column) -> Column:
        ascii_n, hangul_n = F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")), F.length(F.regexp_replace(t, f"[^{HANGUL_ALL}]", ""))
        return ~t.isin(*STOP) & (F.length(t) >= 2) & (ascii_n > 0) & (ascii_n >= (ascii_n + hangul_n) * 0.6)

    def each(raw: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(raw, r"^[^a-z0-9가-힣\-_.]+|[^a-z0-9가-힣\-_.]+$", ""), f"[{HANGUL_ALL}]+$", "")
        return let(bare, lambda t: F.when(is_term(t), F.concat(F.array(t), F.filter(F.split(t, "[-_]"), is_term))).otherwise(F.array().cast("array<string>")))

    raw = F.split(F.lower(F.trim(F.coalesce(query, F.lit("")))), r"[\s,()\[\]{}?!#@=><|&]+")
    return F.array_distinct(F.flatten(F.transform(raw, each)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _, and the compounds of such runs with hyphens."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)+"), F.lit(0)))


def lexical_top(atoms: DataFrame, query: str | list[str], k: int = 60, id_col: str = "l3_id", text_col: str = "content") -> DataFrame:
    """Id and score (0.1 for each token that is a term) of the k best, ties by id; none for a query without terms."""
    terms = search_terms(query) if isinstance(query, str) else query
    if not terms:
        return atoms.select(id_col, F.lit(0.0).alias("score")).limit(0)
    hits = F.size(F.filter(tokens(F.col(text_col)), lambda t: t.isin(*terms)))
    return atoms.select(id_col, (hits * F.lit(0.1)).alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def ranked(rows: DataFrame, id_col: str) -> DataFrame:
    """Id, rank from 0 by score, ties by id. The input is a top-k, which is small."""
    order = Window.orderBy(F.desc("score"), id_col)
    return rows.select(id_col, "score", (F.row_number().over(order) - 1).alias("rank"))


def fuse(dense: DataFrame, sparse: DataFrame, id_col: str = "l3_id", alpha: float = 0.5, k: int = 60, limit: int | None = None) -> DataFrame:
    """Id, fused, score: reciprocal ranks weighted alpha (dense) and 1 - alpha; score is the dense one, else the lexical one. Ties: dense order, then sparse order."""
    d = ranked(dense, id_col).select(id_col, F.col("score").alias("ds"), F.col("rank").alias("dr"))
    s = ranked(sparse, id_col).select(id_col, F.col("score").alias("ss"), F.col("rank").alias("sr"))
    term = F.coalesce(alpha / (F.lit(float(k)) + F.col("dr") + 1), F.lit(0.0)) + F.coalesce((1 - alpha) / (F.lit(float(k)) + F.col("sr") + 1), F.lit(0.0))
    rows = d.join(s, id_col, "full").select(id_col, term.alias("fused"), F.coalesce("ds", "ss").alias("score"), "dr", "sr")
    rows = rows.orderBy(F.desc("fused"), F.asc_nulls_last("dr"), F.asc_nulls_last("sr"))
    return (rows if limit is None else rows.limit(limit)).drop("dr", "sr")


def overlap_score(query: str) -> Callable[[Column], Column]:
    """The default reranker: the share of the query's terms that a text has."""
    terms = search_terms(query)
    return lambda text: F.size(F.array_intersect(tokens(text), F.lit(terms).cast("array<string>"))) / F.lit(max(1, len(terms)))


def rerank(candidates: DataFrame, atoms: DataFrame, scorer: Callable[[Column], Column], id_col: str = "l3_id", text_col: str = "content") -> DataFrame:
    """Candidates with rerank_score of their text ('' if there is none), best first, ties by id."""
    rows = candidates.join(atoms.select(id_col, text_col), id_col, "left")
    return rows.withColumn("rerank_score", scorer(F.coalesce(text_col, F.lit("")))).drop(text_col).orderBy(F.desc("rerank_score"), id_col)


def first_per_section(hits: DataFrame, order: str) -> DataFrame:
    """The first hit of each section (of each document, for hits without one); hits with neither all stay."""
    key = F.coalesce(F.nullif(F.col("l2_id"), F.lit("")), F.nullif(F.col("l1_id"), F.lit("")), F.concat(F.lit("#"), F.col(order).cast("string")))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def retrieval_metrics(run: DataFrame, relevant: DataFrame, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """A14 (extension): recall_5, mrr_10, ndcg_10, p_3, means over the queries of `relevant`. run: query, id, rank from 1."""
    total = relevant.groupBy(query_col).agg(F.count("*").alias("n"))
    hits = run.join(relevant.select(query_col, id_col), [query_col, id_col])
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    per = hits.groupBy(query_col).agg(F.count_if(F.col("rank") <= 5).alias("r5"), F.count_if(F.col("rank") <= 3).alias("r3"), F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, gain).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
    rows = total.join(per, query_col, "left").select((F.coalesce("r5", F.lit(0)) / F.col("n")).alias("recall_5"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr_10"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_10"), (F.coalesce("r3", F.lit(0)) / 3).alias("p_3"))
    return rows.agg(*(F.avg(c).alias(c) for c in rows.columns))
