"""Embeddings of a text column (R7): any model that each worker loads once, and a fitted one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Model = Callable[[list[str]], np.ndarray]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors, dtype=float), where=norm > 0)


def by_model(load: Callable[[], Model], batch: int = 128, normalised: bool = True) -> Callable[[Column], Column]:
    """An embedder of a text column by a model: `load` is called once in each task that has texts, and the model gets `batch` of them at a time. Null texts are empty."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for part in texts:
            model = model or load()
            held = part.fillna("").tolist()
            found = [np.asarray(model(held[i : i + batch]), dtype=float) for i in range(0, len(held), batch)]
            vectors = np.concatenate(found) if found else np.zeros((0, 1))
            yield pd.Series([*(_unit(vectors) if normalised else vectors).astype(np.float32)], dtype=object)

    return embed


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


@dataclass
class HashedModel:
    """A fitted embedding: words and longer runs of them are hashed (crc32) to buckets; a bucket adds its weight, with its sign, to one of `size` numbers.

    weights: the log of how few of the fitted texts have the bucket, one number for each bucket.
    """

    weights: np.ndarray
    size: int
    longest: int

    @staticmethod
    def buckets_of(text: Column, buckets: int, longest: int) -> Column:
        w = words(text)

        def runs_of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))

        runs = [w, *map(runs_of, range(2, longest + 1))]
        every = F.concat(*(F.when(F.size(w) >= n, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs, 1)))
        return F.transform(every, lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int"))

    @staticmethod
    def fit(texts: DataFrame, text_col: str, buckets: int = 4096, size: int = 64, longest: int = 1) -> HashedModel:
        """Counts over all texts in how many each bucket is; `buckets` numbers come to the driver."""
        had = texts.select(F.explode(F.array_distinct(HashedModel.buckets_of(F.col(text_col), buckets, longest))).alias("b")).groupBy("b").count().collect()
        weights = np.full(buckets, np.log(texts.count() + 1.0))
        for r in had:
            weights[r["b"]] -= np.log(r["count"] + 1.0)
        return HashedModel(weights, size, longest)

    def embedder(self) -> Callable[[Column], Column]:
        """The unit vector of a text column; zero for texts without words. Hashing is native, sums are numpy's."""
        weights, size = self.weights, self.size
        place, sign = np.arange(len(weights)) % size, 1.0 - 2.0 * ((np.arange(len(weights)) // size) % 2)

        @F.pandas_udf(ArrayType(FloatType()))
        def add(lists: pd.Series) -> pd.Series:
            n = np.array([len(x) for x in lists], dtype=np.int64)
            held = np.concatenate([*lists]).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            total = np.bincount(row * size + place[held], weights[held] * sign[held], minlength=len(n) * size).reshape(-1, size)
            return pd.Series([*_unit(total).astype(np.float32)], dtype=object)

        return lambda text: add(self.buckets_of(text, len(weights), self.longest))
