"""Periodic runs of words by Stoye and Gusfield's suffix tree.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
`least` words and `exponent` periods that can't be extended on either side.

Of each text, only words below a repeated window of `least - least // exponent` words can
be in a run, as a run and the same run moved by its period share a window of that length;
these stretches are put into one string with a unique end for each. Its suffix tree is held as
arrays: leaves in lexical order, and the depth at which neighbours part. Each inner node
is a split of its leaves in two; the smaller half's leaf list is traversed, and a leaf i
with i + depth (or i - depth) in the other half starts (or ends) a branching tandem
repeat. Those that are preceded by one more copy are rotated to the left as far as they
go, and those that meet in the same stretch are merged: the least period is the run's.

Work is n log n at any text, and holds the stretches of about a megabyte of text at once
(of one text at least). Null and empty texts have no words and no runs. Rows are judged
one by one, so that repeated ids and texts do no harm; other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import textvec as tv
from strata.llm.textvec import tidy

#: Leaves that are looked up at once.
AT_ONCE = 1 << 21


class SuffixTree:
    """The suffix tree of an array of numbers whose last one is unique."""

    def __init__(self, ids: np.ndarray):
        self.n = n = len(ids)
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        #: levels[j][i]: rank of the 2**j numbers from i on
        self.levels = [rank.astype(np.int32)]
        width = 1
        while True:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            self.levels.append(rank.astype(np.int32))
            if rank[order[-1]] == n - 1:
                break
            width *= 2
        self.leaves, self.place = order, rank
        x, y = order[:-1].copy(), order[1:].copy()
        depth = np.zeros(n, np.int64)
        for j in reversed(range(len(self.levels) - 1)):
            same = (self.levels[j][x] == self.levels[j][y]).astype(np.int64) << j
            depth[1:] += same
            x += same
            y += same
        #: depth[t]: common numbers of the leaves t - 1 and t
        self.depth = depth

    def splits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, leaf, low, high) of leaves in smaller halves: the other half is leaves low to high."""
        depth = self.depth.tolist()
        depth[0] = -1
        left, right, open_ = [0] * self.n, [self.n] * self.n, [0]
        for t in range(1, self.n):
            d = depth[t]
            while depth[open_[-1]] >= d:
                right[open_.pop()] = t
            left[t] = open_[-1]
            open_.append(t)
        at = np.flatnonzero(self.depth > 0)
        low, high = np.array(left)[at], np.array(right)[at]
        first_half = at - low <= high - at
        size = np.where(first_half, at - low, high - at)
        start = np.where(first_half, low, at)
        low, high = np.where(first_half, at, low), np.where(first_half, high, at)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = size[a:b]
            leaf = np.repeat(start[a:b] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            yield np.repeat(self.depth[at[a:b]], n), leaf, np.repeat(low[a:b], n), np.repeat(high[a:b], n)

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of tandem repeats that the number after them does not continue."""
        starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for depth, leaf, low, high in self.splits():
            i = self.leaves[leaf]
            for first, other in ((i, i + depth), (i - depth, i - depth)):
                ok = (other >= 0) & (other < self.n)
                place = self.place[np.where(ok, other, 0)]
                ok &= (place >= low) & (place < high)
                starts.append(first[ok])
                periods.append(depth[ok])
        return np.concatenate(starts), np.concatenate(periods)

    def equal(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` (at least 1) numbers from x and from y on are the same."""
        out = np.zeros(len(x), bool)
        level = np.frexp(length)[1] - 1
        for j in np.unique(level).tolist():
            k, held = np.flatnonzero(level == j), self.levels[j]
            a, b, far = x[k], y[k], length[k] - (1 << j)
            out[k] = (held[a] == held[b]) & (held[a + far] == held[b + far])
        return out

    def rotated(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers before x and y (x < y) are the same."""
        out = np.zeros(len(x), np.int64)
        for j in reversed(range(len(self.levels) - 1)):
            at, to = x - out - (1 << j), y - out - (1 << j)
            same = (at >= 0) & (self.levels[j][np.maximum(at, 0)] == self.levels[j][np.maximum(to, 0)])
            out += same.astype(np.int64) << j
        return out

    def runs(self, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, least period) of maximal runs of `exponent` (2 or more) periods at least."""
        start, period = self.branching_repeats()
        for copies in range(1, exponent - 1):
            ok = start >= copies * period
            start, period = start[ok], period[ok]
            ok = self.equal(start - copies * period, start - (copies - 1) * period, period)
            start, period = start[ok], period[ok]
        end = start + 2 * period
        start = start - self.rotated(start, start + period)
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return start[new], end[new], period[new]


def _stretches(words: tv.Words, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the stretches of words that can be in runs: those below windows that their text repeats."""
    window = least - least // exponent
    at = tv.runs(words.first, window)
    if not len(at):
        return at, at
    doc = np.searchsorted(words.first, at, "right") - 1
    key = tv.mix(tv.rolling(words.hashes(), at, window) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    at, doc = at[repeated], doc[repeated]
    if not len(at):
        return at, at
    fresh = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)])
    return at[fresh], at[np.r_[fresh[1:], len(at)] - 1] + window


def _numbered(words: tv.Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the stretches' words, one unique number after each; where each stretch starts). Words of different texts differ."""
    data, own, of = words.data.tobytes(), {}, -1
    doc = (np.searchsorted(words.first, start, "right") - 1).tolist()
    out, starts, base = [], [], 0
    for d, a, b in zip(doc, start.tolist(), end.tolist(), strict=True):
        if d != of:
            base, own, of = base + len(own), {}, d
        starts.append(len(out))
        out += [base + own.setdefault(data[x:y], len(own)) for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
        out.append(-1 - len(starts))
    return np.array(out, np.int64), np.array(starts, np.int64)


def runs_of(words: tv.Words, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; places are those of the words of all texts."""
    start, end = _stretches(words, least, exponent)
    if not len(start):
        return start, start, start
    ids, starts = _numbered(words, start, end)
    a, b, period = SuffixTree(ids).runs(exponent)
    ok = b - a >= least
    a, b, period = a[ok], b[ok], period[ok]
    at = np.searchsorted(starts, a, "right") - 1
    moved = start[at] - starts[at]
    a, b = a + moved, b + moved
    order = np.lexsort((period, a))
    return a[order], b[order], period[order]


def _find(least: int, exponent: int):
    """doc_id, text -> doc_id, n_words, runs, collapsed_text."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for i, j, words in tv.slices(texts, lower=False):
                start, end, period = runs_of(words, least, exponent)
                cuts = np.searchsorted(start, words.first)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(start - words.first[np.searchsorted(words.first, start, "right") - 1], pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], fields=list(run)))
                gone = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, end, -1)
                kept = np.cumsum(gone[:-1]) == 0
                out = []
                for d, text in enumerate(texts.slice(i, j - i).to_pylist()):
                    own = (text or "").encode().split()
                    if cuts[d + 1] > cuts[d]:
                        own = [own[x] for x in np.flatnonzero(kept[words.first[d] : words.first[d + 1]]).tolist()]
                    out.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(words.first), pa.int64()), lists, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

    return apply


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed_text: the words joined by one space, of each run only those of its first period (a word goes if any run drops it)."""
    if exponent < 2 or least < exponent:
        raise ValueError("a run has two periods at least, and a word in each")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(_find(least, exponent)), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly (ties: least start, then period); null without runs."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    return F.get(F.array_sort(runs, order), F.lit(0))


def run_lines(runs: Column) -> Column:
    """`start,length,period` of each run, each with a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the texts of about a tenth of its rows made periodic from some word on, by the crc32 of the id (a null id: unchanged)."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.nullif(F.size(words), F.lit(0))
    g = F.floor(crc / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return df.withColumn(text_col, F.when((crc % 10 == 0) & n.isNotNull(), made).otherwise(F.col(text_col)))
