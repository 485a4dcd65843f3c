"""Language identification by words first, then ever shorter character n-grams.

A word that was learned gives its log frequency in each language. Any other word is
cut into n-grams of its marked form `<word>`: of the longest n for which one is known,
the known ones' log frequencies are averaged. A text's score for a language is
the sum over its words.

The model is fitted on a bounded sample of labelled rows: `max_rows` in all, shared evenly
among languages as far as they have rows (those with the lowest hashes of id), so that
rare languages are learned at any size. Of the sample's words and n-grams those stay
that occur `least_word` and `least_gram` times in a language; a word seen less often, or
longer than LONGEST_WORD, teaches by its n-grams. There is no other limit, so the model
is bounded by the sample.

Texts that are null or have no letter are `und` with score 0, as are all texts if nothing
was learned. Rows that repeat are predicted one by one; ties go to the first language by
code point. Columns with the names of the results give way to them; others pass. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from strata.llm.textvec import tidy

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
#: Words longer than this are learned and looked up by their n-grams only.
LONGEST_WORD = 40


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


Counts = tuple[list[str], np.ndarray]


def logs(counts: np.ndarray) -> np.ndarray:
    """Log frequencies of a table of counts, one column for each language; what one has not seen has the same floor in all, below whatever any has seen."""
    total = np.maximum(counts.sum(axis=0), 1.0)
    return np.log(counts / total + 0.5 / total.max(initial=1.0)).astype(np.float32)


class Model:
    """Log frequencies by word and by n-gram, one column for each language."""

    def __init__(self, langs: list[str], words: Counts, tables: list[Counts], memo: int = 20_000):
        """memo: how many unseen words keep their row for the texts to come."""
        self.langs, self.memo = langs, memo
        self.grams = [(dict(zip(names, range(len(names)), strict=True)), logs(counts)) for names, counts in tables]
        self.first = dict(zip(words[0], range(len(words[0])), strict=True))
        self.rows = np.concatenate([logs(words[1]), np.zeros((memo, len(langs)), np.float32)]) if langs else np.zeros((0, 0), np.float32)
        self.later: dict[str, int] = {}

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST_GRAM, 0, -1):
            index, rows = self.grams[n - 1]
            if known := [index[g] for g in grams(word, n) if g in index]:
                return rows[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """The row of each word."""
        first, later, at, fresh = self.first.get, self.later, [], []
        for w in words:
            r = first(w)
            if r is None and (r := later.get(w)) is None:
                r = -1 - len(fresh)
                fresh.append(w)
            at.append(r)
        index = np.array(at, dtype=np.int64)
        rows = self.rows[np.maximum(index, 0)]  # those below 0 are filled in now
        if fresh:
            new = np.array([self.unseen(w) for w in fresh], np.float32)
            rows[index < 0] = new[-1 - index[index < 0]]
            if len(later) + len(fresh) > self.memo:
                later.clear()
            for w, row in zip(fresh[: self.memo], new, strict=False):
                later[w] = len(self.first) + len(later)
                self.rows[later[w]] = row
        return rows

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(WORD.findall(text.lower())) if text else None
        if not counts or not self.langs:
            return "und", 0.0
        n = np.fromiter(counts.values(), np.float32, len(counts))
        score = (n[:, None] * self.scores([*counts])).sum(axis=0, dtype=np.float64)
        best = int(np.argmax(score))
        # the posterior as if of at most 25 words: longer texts are not more certain without bound
        z = (score - score[best]) / max(1.0, n.sum() / 25.0)
        return self.langs[best], float(1.0 / np.exp(z).sum())


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language, `most` in all: the same number of each, or all that it has."""
    out: dict[str, int] = {}
    left = most
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(sizes) - i)))
        left -= out[lang]
    return out


def fit(df: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 12_000, least_word: int = 2, least_gram: int = 3) -> Model:
    """A Model of the rows that are `labelled` and have a language.

    max_rows: about how many rows are read, see above; at least one of each language.
    """
    from strata.llm.common import materialize, small_table

    spark = df.sparkSession
    rows = df.where(labelled & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)).alias("at"))
    held = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()}
    sizes = {lang: r["n"] for lang, r in held.items()}
    if sum(sizes.values()) > max_rows:
        below = {lang: max(held[lang]["first"] + 1, int((1 << 30) * min(1.0, n / sizes[lang]))) for lang, n in quotas(sizes, max_rows).items()}
        limits = small_table(spark, {"lang": [*below], "below": [*below.values()]}, "lang string, below long")
        rows = rows.join(F.broadcast(limits), "lang").where("at < below")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        out = [(lang, w, c) for lang, counter in by.items() for w, c in counter.items()]
        for i in range(0, len(out), 50_000):
            langs, words, counts = zip(*out[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    words = materialize(rows.select("lang", "text").mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams(word, size):
                        by[lang, g, size] += n
            for i in range(0, len(part := list(by.items())), 50_000):
                some = part[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.string()), pa.array([k[2] for k, _ in some], pa.int32()), pa.array([v for _, v in some], pa.int64())], ["lang", "word", "size", "n"])

    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())

    def table(counted: DataFrame, least: int) -> Counts:
        """Those with `least` in a language, with their counts by language."""
        if not langs:
            return [], np.zeros((0, 0))
        often = counted.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)))
        rows = often.where(F.greatest(*(F.col(f"n{i}") for i in range(len(langs))), F.lit(0)) >= least).toArrow()
        names = rows["word"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        counts = [np.asarray(rows[f"n{i}"], dtype=float)[order] for i in range(len(langs))]
        return [names[i] for i in order], np.stack(counts, axis=1) if counts else np.zeros((0, 0))

    gram = materialize(words.mapInArrow(tidy(cut), "lang string, word string, size int, n long").groupBy("size", "lang", "word").agg(F.sum("n").alias("n")))
    tables = [table(gram.where(F.col("size") == size).drop("size"), least_gram) for size in range(1, LONGEST_GRAM + 1)]
    return Model(langs, table(words.where(F.char_length("word") <= LONGEST_WORD), least_word), tables)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df's columns and the predicted language and its score."""
    df = df.select(*(F.col(c) for c in df.columns if c not in (lang_out, score_out)))
    held = df.sparkSession.sparkContext.broadcast(model)
    held.__dict__.pop("_value", None)  # the driver's copy is the caller's; tasks load theirs
    at = df.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        try:
            for b in batches:
                found = [m.predict(t.as_py()) for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*b.schema.names, lang_out, score_out])
        finally:
            held.__dict__.pop("_value", None)  # a worker lives on for other stages; a task that comes loads it again

    from pyspark.sql.types import DoubleType, StringType, StructType

    return df.mapInArrow(tidy(apply), StructType(list(df.schema.fields)).add(lang_out, StringType()).add(score_out, DoubleType()))


def accuracy(pairs: list[tuple[str, str]]) -> float:
    return sum(a == b for a, b in pairs) / len(pairs) if pairs else math.nan
