"""The k best rows of each query by products of blocks of vectors.

A task multiplies its rows with a block of queries. What comes near the k best so far is computed
again one component after the other, as `rank.dot` does, so scores and ties are its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows and queries that are multiplied at once, and pairs that are computed again at once.
ROWS, QUERIES, PAIRS = 4096, 1024, 1 << 16
#: Stands for the score of a pair without one (null vectors, or of different lengths), and what a product may be off by.
NULL, SLACK = -1e300, 1e-9


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A column of vectors as rows of numbers, and which of them are whole: not null, without null components, and `dim` long (the commonest length)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(np.bincount(lengths[lengths >= 0]).argmax()) if (lengths >= 0).any() else 0
    good = lengths == dim
    out = np.zeros((len(column), dim))
    flat = pc.list_flatten(column.filter(pa.array(good)))
    held = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(int(good.sum()), dim)
    out[good] = held
    if flat.null_count:
        good[good] = ~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(held.shape).any(axis=1)
    return out, good


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        norms = np.sqrt(_dots(v, v))
        return v / np.where(norms == 0, 1.0, norms)[:, None], norms


class _Best:
    """The k best scores so far of each query of a block."""

    def __init__(self, vectors: np.ndarray, good: np.ndarray, k: int, cosine: bool, least: np.ndarray | None = None):
        self.vectors, self.good, self.k, self.cosine = vectors, good, k, cosine
        self.scaled, self.norms = _scaled(vectors)
        floor = np.full(len(vectors), -np.inf) if least is None else np.where(np.isnan(least), -np.inf, least)
        self.best = np.repeat(floor[:, None], k, axis=1)

    def _scores(self, rows: np.ndarray, norms: np.ndarray, good: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        with np.errstate(all="ignore"):
            for at in range(0, len(r), PAIRS):
                a, b = r[at : at + PAIRS], q[at : at + PAIRS]
                score = _dots(rows[a], self.vectors[b])
                if self.cosine:
                    both = norms[a] * self.norms[b]
                    score = np.where(both == 0, 0.0, score / np.where(both == 0, 1.0, both))
                out[at : at + PAIRS] = np.where(good[a] & self.good[b], score, NULL)
        return out

    def take(self, rows: np.ndarray, good: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, score) of rows, in order of ids, that may be among the k best of the queries `asked`."""
        for at in range(0, len(rows), ROWS):
            part, whole = rows[at : at + ROWS], good[at : at + ROWS]
            scaled, norms = _scaled(part)
            for first in range(0, len(asked), QUERIES):
                some = asked[first : first + QUERIES]
                with np.errstate(all="ignore"):
                    near = scaled @ self.scaled[some].T
                    near[np.isnan(near)] = np.inf
                    near[~whole] = NULL
                    near[:, ~self.good[some]] = NULL
                    least = self.best[some, -1]
                    if len(part) > self.k and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(near, -self.k, axis=0)[-self.k])
                    r, c = np.nonzero(near >= least - SLACK)
                q = some[c]
                score = self._scores(part, norms, whole, r, q)
                key = np.where(np.isnan(score), np.inf, score)
                order = np.lexsort((r, -key, c))
                r, c, q, score, key = r[order], c[order], q[order], score[order], key[order]
                place = np.arange(len(c)) - np.searchsorted(c, c)
                kept = (place < self.k) & (key >= self.best[q, -1])
                new = np.full((len(some), self.k), -np.inf)
                new[c[kept], place[kept]] = key[kept]
                self.best[some] = -np.sort(-np.concatenate([self.best[some], new], axis=1), axis=1)[:, : self.k]
                yield r[kept] + at, q[kept], score[kept]


def best_of(rows: DataFrame, queries: pa.Table, k: int, id_col: str, vector_col: str, query_col: str, query_kind: StructField, cosine: bool, lists: str | None = None, allowed: Callable[[], np.ndarray] | None = None, least: np.ndarray | None = None) -> DataFrame:
    """query, id, score, rank of the k best rows of each query of one block (its ids and vectors), by cosine or by product, ties by id.

    lists: the column of a row's list, if rows come in lists; then allowed() says, once for
    each task, which queries (columns) read which lists (rows).
    least: scores below which no row of a query is asked for (nan: none is known).
    """
    vectors, good = matrix(queries.column(1))
    carried = rows.sparkSession.sparkContext.broadcast((queries.column(0).combine_chunks(), vectors, good))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, whole = carried.value
        best = _Best(asked, whole, k, cosine, least)
        may = None
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))
            held, sound = matrix(b.column(1), asked.shape[1])
            if lists is None:
                parts = [(np.arange(len(b)), np.arange(len(asked)))]
            else:
                may = allowed() if may is None else may
                own = b.column(2).to_numpy(zero_copy_only=False)
                parts = [(np.flatnonzero(own == n), np.flatnonzero(may[n])) for n in np.unique(own)]
            for at, some in parts:
                for r, q, score in best.take(held[at], sound[at], some):
                    if len(r):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(0).take(pa.array(at[r])), pa.array(score, mask=score == NULL)], [query_col, id_col, "score"])

    columns = [id_col, F.col(vector_col).cast("array<double>").alias("v"), *([lists] if lists else [])]
    read = rows.select(*columns)
    kind = StructType([StructField(query_col, query_kind.dataType), StructField(id_col, rows.schema[id_col].dataType), StructField("score", DoubleType())])
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return read.mapInArrow(multiply, kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
