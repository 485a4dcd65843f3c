"""Scoring by a class-based bigram model (Brown classes by exchange clustering).

Words (lower-cased A-Z) are known by a 64-bit hash, and every word of the training texts
has a class. Exchange clustering moves the `cluster` most frequent words between `classes`
classes as long as that raises the likelihood of the class bigrams. The other ones of the
`class_words` most frequent words join the class that fits the classes beside them best,
and so then does each remaining word, whatever the vocabulary's size, by these and by how
frequent the classes are: tasks send how often a word has which classes beside it to the
fragment of the hash space that holds its count. (A word with no classed neighbour joins the
largest class.) Words that training has once are a class of their own, as two neighbours tell
nothing that holds elsewhere; a word that training lacks is taken for one of them when it
comes before others. After either the class before them is remembered.

A word's probability is that of its class after what came before (Witten-Bell smoothing
with the classes' own frequencies), times that of the word in its class: its count less a
discount (n1 / (n1 + 2 n2), by how many words are there once and twice). What is
discounted is the class's share of unseen words; an unseen word has the sum over all
classes. So the probabilities of all words, unseen ones as one, sum up to 1, as those of the
base do. All counts are over all training documents.

Scores take two passes: a chunk of documents asks the fragments once for the classes and
counts of its words that aren't in the lexicon, and gets its class sequences; the class
bigrams of the training ones give the transitions, by which all sequences are scored.

Null texts are empty: one end token. Rows that repeat are scored one by one. Other columns
are ignored. An empty table gives an empty result; without training documents every
count is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import textvec as tv
from strata.llm.common import folded_up, fragments, materialize
from strata.llm.textvec import tidy, tidy_group

U64 = np.uint64
CHUNK = 600_000
HIST = 512  # bins of counts: 16 for each doubling


def frag_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int64)


def bin_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(HIST - 1, np.floor(16 * np.log2(np.maximum(count, 1)))).astype(np.int64)


def _count_words(parts: int):
    """text -> frag, ids, counts: the words of a chunk and how often it has them."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        s = np.sort(np.concatenate(held))
        starts = tv.group_starts(s)
        count = np.diff(np.r_[starts, len(s)]).astype("<u4")
        s = s[starts]
        cuts = np.searchsorted(frag_of(s, parts), np.arange(parts + 1))
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([s[cuts[f] : cuts[f + 1]].tobytes() for f in range(parts)], pa.binary()), pa.array([count[cuts[f] : cuts[f + 1]].tobytes() for f in range(parts)], pa.binary())], ["frag", "ids", "counts"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, _, words in tv.slices(b.column(0), lower=True):
                held.append(words.hashes())
                n += len(held[-1])
                if n >= CHUNK:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return apply


def _sum_words(table: pa.Table) -> pa.Table:
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<u8")
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4").astype(np.int64)
    order = np.argsort(ids)
    ids, counts = ids[order], counts[order]
    starts = tv.group_starts(ids)
    ids, counts = ids[starts], np.add.reduceat(counts, starts) if len(starts) else counts
    hist = np.bincount(bin_of(counts), minlength=HIST)
    return pa.table([table["frag"].combine_chunks()[:1], pa.array([ids.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([hist.tolist()], pa.list_(pa.int64()))], ["frag", "ids", "counts", "tokens", "types", "hist"])


def _summed(counts: DataFrame, col: str, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for pos, n in counts.select(F.posexplode(col)).groupBy("pos").agg(F.sum("col")).collect():
        out[pos] = n
    return out


def frequent(counts: DataFrame, hist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ids, counts) of the most frequent words: those in whole bins of counts, `most` at most."""
    above = np.cumsum(hist[::-1])[::-1]
    fits = np.flatnonzero(above <= most)
    least = int(fits[0]) if len(fits) else HIST

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.frombuffer(y, "<i8")
                keep = bin_of(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<u8")[keep].view(np.int64)), pa.array(n[keep])], ["id", "n"])

    rows = counts.select("ids", "counts").mapInArrow(tidy(pick), "id long, n long").toArrow()
    ids, n = np.asarray(rows["id"]).view(U64), np.asarray(rows["n"])
    order = np.argsort(ids)
    return ids[order], n[order]


@dataclass
class Lexicon:
    """Sorted ids of the frequent words, and the symbol of each; symbols: these, then one for all other words, then the end."""

    ids: np.ndarray
    symbol: np.ndarray

    @property
    def other(self) -> int:
        return len(self.ids)

    @property
    def end(self) -> int:
        return len(self.ids) + 1

    def find(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each word."""
        if not len(self.ids):
            return np.full(len(words), self.other, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.ids, words), len(self.ids) - 1)
        return np.where(self.ids[at] == words, self.symbol[at], self.other).astype(np.int32)


def sequences(words: tv.Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with an end after each text, where texts end, word ids, position of words in the symbols)."""
    ids = words.hashes()
    n = len(words.first) - 1
    place = np.arange(len(ids)) + words.doc
    out = np.full(len(ids) + n, lexicon.end, dtype=np.int32)
    out[place] = lexicon.find(ids)
    return out, words.first[1:] + np.arange(n), ids, place


def _pairs(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(rows.astype(np.int64) * shape[1] + columns, minlength=shape[0] * shape[1]).reshape(shape)


def _matrix_pass(df: DataFrame, count, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all texts of count(words), a matrix of a fixed shape; each task adds up its own and sends it by bands of rows."""
    bands = [*range(0, shape[0], max(1, (1 << 16) // shape[1])), shape[0]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64)
        for b in batches:
            for _, _, words in tv.slices(b.column(0), lower=True):
                total += count(words)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(bands) - 1), pa.int32()), pa.array([zlib.compress(total[x:y].astype("<i8").tobytes(), 1) for x, y in zip(bands, bands[1:], strict=False)], pa.binary())], ["band", "cells"])

    def add(table: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in table["cells"].to_pylist())
        return pa.table([table["band"].combine_chunks()[:1], pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["band", "cells"])

    out = np.zeros(shape, dtype=np.int64)
    for r in folded_up(df.mapInArrow(tidy(apply), "band int, cells binary"), ["band"], add, "band int, cells binary").toLocalIterator():
        out[bands[r["band"]] : bands[r["band"] + 1]] = np.frombuffer(zlib.decompress(r["cells"]), "<i8").reshape(-1, shape[1])
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """The class of each symbol after exchange clustering of a matrix of bigram counts, most frequent symbol first."""
    n = len(bigrams)
    classes = max(1, min(classes, n))
    own = np.arange(n) % classes
    b = bigrams.astype(float)
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    right, left = b @ member, b.T @ member  # counts of each symbol with classes after and before it
    between = member.T @ right
    follows, leads = between.sum(axis=1), between.sum(axis=0)
    out_n, in_n = b.sum(axis=1), b.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, self_n = own[w], b[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_n
            l[a] -= self_n

            def shift(c: int, sign: float) -> None:
                between[c] += sign * r
                between[:, c] += sign * l
                between[c, c] += sign * self_n
                follows[c] += sign * out_n[w]
                leads[c] += sign * in_n[w]

            shift(a, -1)
            base = xlogx(between)
            gain = (xlogx(between + r[None, :]) - base).sum(axis=1) + (xlogx(between + l[:, None]) - base).sum(axis=0)
            d = np.diag(between)
            gain += xlogx(d + r + l + self_n) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
            gain -= xlogx(follows + out_n[w]) - xlogx(follows) + xlogx(leads + in_n[w]) - xlogx(leads)
            c = int(np.argmax(gain))
            if gain[c] <= gain[a] + 1e-9:
                c = a
            own[w] = c
            if c != a:
                moved += 1
                right[:, a] -= b[:, w]
                right[:, c] += b[:, w]
                left[:, a] -= b[w]
                left[:, c] += b[w]
            r, l = right[w].copy(), left[w].copy()
            r[c] -= self_n
            l[c] -= self_n
            shift(c, 1)
        if not moved:
            break
    return own


@dataclass
class Classes:
    """Classes 0 to k - 1 are of words, k is the end's, k + 1 that of words that training has once. `of`: the class of each symbol (k + 1 for other words too)."""

    lexicon: Lexicon
    k: int
    of: np.ndarray
    p_after: np.ndarray  # k x (k + 1): log P(class after | class)
    p_before: np.ndarray  # k x k: log P(class before | class)
    prior: np.ndarray  # log of each class's share of the tokens that have a class so far

    @property
    def once(self) -> int:
        return self.k + 1

    @property
    def unseen(self) -> int:
        """Stands in class sequences for a word that training lacks."""
        return self.k + 2


@dataclass
class Scorer:
    classes: Classes
    count: np.ndarray  # of each symbol but the one of other words
    discount: float
    tokens: np.ndarray  # N_c, by class
    types: np.ndarray  # V_c
    base: float  # log10 of N + 0.5 (V + 1)

    def emission(self, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | its class) of words that training has n times; 0 for ends, and for words that it lacks."""
        seen = np.log10(np.maximum(n - self.discount, 1e-9)) - np.log10(self.tokens + 0.5)[np.minimum(cls, self.classes.once)]
        return np.where((cls == self.classes.k) | (n == 0), 0.0, seen)

    def share_unseen(self) -> np.ndarray:
        """P(a word that training lacks | class)."""
        out = (self.discount * self.types + 0.5) / (self.tokens + 0.5)
        out[self.classes.k] = 0.0
        return out


def _beside_requests(parts: int, held):
    """text -> frag, ids, before, after, counts: how often a chunk has each word outside the lexicon with which classes on either side (k + 1: none known). In a row without counts each is there once."""

    def flush(held_words: list, held_pairs: list) -> pa.RecordBatch:
        word, pair = np.concatenate(held_words), np.concatenate(held_pairs)
        order = np.lexsort((pair, word))
        word, pair = word[order], pair[order]
        starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])]) if len(word) else np.zeros(0, np.int64)
        count = np.diff(np.r_[starts, len(word)])
        word, pair = word[starts], pair[starts]
        rows: list[tuple] = []
        for often in (False, True):
            w, p, n = (x[(count > 1) == often] for x in (word, pair, count))
            cuts = np.searchsorted(frag_of(w, parts), np.arange(parts + 1))  # rising hashes are rising fragments
            for f in np.flatnonzero(np.diff(cuts)).tolist():
                x, y = cuts[f], cuts[f + 1]
                rows.append((f, w[x:y].tobytes(), (p[x:y] >> 8).astype(np.uint8).tobytes(), (p[x:y] & 255).astype(np.uint8).tobytes(), n[x:y].astype("<u4").tobytes() if often else b""))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["frag", "ids", "before", "after", "counts"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Classes = held.value
        none = c.once
        words_held, pairs_held, n = [], [], 0
        for b in batches:
            for _, _, words in tv.slices(b.column(0), lower=True):
                s, ends, ids, place = sequences(words, c.lexicon)
                own = c.of[s].astype(np.uint16)
                before = np.r_[np.uint16(none), own[:-1]] if len(own) else own
                before[ends[:-1] + 1] = none
                after = np.r_[own[1:], np.uint16(none)] if len(own) else own
                rare = s[place] == c.lexicon.other
                at = place[rare]
                words_held.append(ids[rare])
                pairs_held.append(before[at] << 8 | after[at])
                n += len(at)
                if n >= CHUNK:
                    yield flush(words_held, pairs_held)
                    words_held, pairs_held, n = [], [], 0
        if n:
            yield flush(words_held, pairs_held)

    return apply


def best_classes(index: np.ndarray, n: int, before: np.ndarray, after: np.ndarray, count: np.ndarray, c: Classes) -> np.ndarray:
    """Of n words, the class under which the classes beside their occurrences (`index` names the word, `count` says how often) and the class itself are likeliest; the first of ties."""
    out = np.full(n, int(c.prior.argmax()), dtype=np.uint8)
    width = c.k + 2
    order = np.argsort(index, kind="stable")
    index, before, after, count = index[order], before[order].astype(np.int64), after[order].astype(np.int64), count[order]
    for start in range(0, n, 20_000):
        stop = min(n, start + 20_000)
        x, y = np.searchsorted(index, [start, stop])
        rows = (index[x:y] - start) * width
        a = np.bincount(rows + after[x:y], count[x:y], minlength=(stop - start) * width).reshape(-1, width)[:, : c.k + 1]
        b = np.bincount(rows + before[x:y], count[x:y], minlength=(stop - start) * width).reshape(-1, width)[:, : c.k]
        told = (a.sum(axis=1) + b.sum(axis=1)) > 0
        out[start:stop][told] = (a @ c.p_after.T + b @ c.p_before.T + c.prior).argmax(axis=1)[told]
    return out


def _classify(held, own: np.ndarray):
    """One fragment: its words outside the lexicon with counts and classes, and the tokens and types of each class."""

    def apply(asked: pa.Table, counts: pa.Table) -> pa.Table:
        c: Classes = held.value
        if not len(counts):
            return pa.table({"frag": pa.array([], pa.int32()), **{x: pa.array([], pa.binary()) for x in ("ids", "counts", "cls")}, **{x: pa.array([], pa.list_(pa.int64())) for x in ("tokens", "types")}})
        ids, n = np.frombuffer(counts["ids"][0].as_py(), "<u8"), np.frombuffer(counts["counts"][0].as_py(), "<i8")
        rest = ~np.isin(ids, c.lexicon.ids)
        ids, n = ids[rest], n[rest]
        word, before, after = (np.frombuffer(b"".join(asked[x].to_pylist()), kind) for x, kind in (("ids", "<u8"), ("before", "u1"), ("after", "u1")))
        often = [np.frombuffer(x, "<u4") if x else np.ones(len(w) // 8, "<u4") for w, x in zip(asked["ids"].to_pylist(), asked["counts"].to_pylist(), strict=True)]
        cls = best_classes(np.searchsorted(ids, word), len(ids), before, after, np.concatenate(often) if often else np.zeros(0, "<u4"), c)
        cls[n == 1] = c.once
        tokens, types = np.bincount(cls, n, minlength=c.k + 2).astype(np.int64), np.bincount(cls, minlength=c.k + 2)
        return pa.table({"frag": counts["frag"].combine_chunks()[:1], **{x: pa.array([y.tobytes()], pa.binary()) for x, y in (("ids", ids), ("counts", n), ("cls", cls))}, **{x: pa.array([y.tolist()], pa.list_(pa.int64())) for x, y in (("tokens", tokens), ("types", types))}})

    return apply


def fit(df: DataFrame, training: Column, text_col: str = "text", classes: int = 40, cluster: int = 1000, class_words: int = 8192) -> tuple[Scorer, DataFrame, int, int]:
    """(scorer, table of other words by fragment, number of fragments, training tokens).

    cluster and class_words say how many words are clustered and placed on the driver and
    sent to every task; all others are classed by fragments.
    """
    train = df.where(training).select(text_col)
    parts = fragments(df.select(text_col), 12, least=4)
    counts = materialize(train.mapInArrow(tidy(_count_words(parts)), "frag int, ids binary, counts binary").groupBy("frag").applyInArrow(tidy_group(_sum_words), "frag int, ids binary, counts binary, tokens long, types long, hist array<long>"))
    docs = train.count()
    sums = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    total, distinct = sums["n"] + docs, sums["v"] + (docs > 0)
    hist = _summed(counts, "hist", HIST)
    n1, n2 = int(hist[bin_of(np.array(1))]), int(hist[bin_of(np.array(2))])
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    ids, n = frequent(counts, hist, class_words)
    by = np.lexsort((ids, -n))
    rank = np.empty(len(ids), dtype=np.int32)
    rank[by] = np.arange(len(ids))
    lexicon = Lexicon(ids, rank)
    symbols = len(ids) + 2
    dense = min(cluster, len(ids))
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(lexicon)

    def near(words: tv.Words) -> np.ndarray:
        s, *_ = sequences(words, held.value)
        s = np.minimum(s, dense)
        return _pairs(s[:-1], s[1:], (dense + 1,) * 2) if len(s) else np.zeros((dense + 1,) * 2, np.int64)

    bigrams = _matrix_pass(train, near, (dense + 1,) * 2)[:-1, :-1]  # ends and other words are apart
    first = exchange(bigrams, classes)
    k = int(first.max()) + 1 if len(first) else 1
    cls = np.full(symbols, k + 1, dtype=np.int64)
    cls[:dense] = first
    cls[lexicon.end] = k
    held_classes = spark.sparkContext.broadcast((lexicon, cls.copy()))

    def beside(words: tv.Words) -> np.ndarray:
        """Counts of each symbol with the class after it, and before it (none before a start)."""
        lex, of = held_classes.value
        s, ends, *_ = sequences(words, lex)
        shape = (symbols, 2 * (k + 2))
        if not len(s):
            return np.zeros(shape, np.int64)
        inner = np.ones(len(s), dtype=bool)
        inner[ends] = False
        a, b = s[:-1][inner[:-1]], s[1:][inner[:-1]]
        out = _pairs(a, of[b], shape)
        out += _pairs(b, k + 2 + of[a], shape)
        return out

    table = _matrix_pass(train, beside, (symbols, 2 * (k + 2)))
    after, before = table[:, : k + 2], table[:, k + 2 :]
    placed = np.zeros(symbols, dtype=bool)
    placed[:dense] = True

    def log_rows(x: np.ndarray) -> np.ndarray:
        return np.log((x + 0.5) / (x + 0.5).sum(axis=1, keepdims=True))

    def odds() -> tuple[np.ndarray, np.ndarray]:
        between, back = np.zeros((k, k + 1)), np.zeros((k, k))
        np.add.at(between, cls[placed], after[placed][:, : k + 1])
        np.add.at(back, cls[placed], before[placed][:, :k])
        return log_rows(between), log_rows(back)

    p_after, p_before = odds()
    rest = np.arange(dense, len(ids))
    cls[rest] = (after[rest][:, : k + 1] @ p_after.T + before[rest][:, :k] @ p_before.T).argmax(axis=1)
    placed[: len(ids)] = True
    p_after, p_before = odds()
    size = np.r_[n[by], 0, docs]
    mass = np.bincount(cls[: len(ids)], size[: len(ids)], minlength=k)
    prior = np.log((mass + 1) / (mass + 1).sum())
    cls[: len(ids)][size[: len(ids)] == 1] = k + 1
    known = Classes(lexicon, k, cls, p_after, p_before, prior)
    held_known = spark.sparkContext.broadcast(known)
    asked = train.mapInArrow(tidy(_beside_requests(parts, held_known)), "frag int, ids binary, before binary, after binary, counts binary")
    others = materialize(asked.groupBy("frag").cogroup(counts.select("frag", "ids", "counts").groupBy("frag")).applyInArrow(tidy_group(_classify(held_known, ids)), "frag int, ids binary, counts binary, cls binary, tokens array<long>, types array<long>"))
    tokens, types = (_summed(others, c, k + 2) for c in ("tokens", "types"))
    tokens += np.bincount(cls[: len(ids)], size[: len(ids)], minlength=k + 2).astype(np.int64)
    types += np.bincount(cls[: len(ids)], minlength=k + 2)
    tokens[k], types[k] = docs, docs > 0
    return Scorer(known, size, discount, tokens, types, float(np.log10(total + 0.5 * (distinct + 1)))), others, parts, total


SEQUENCE = ["chunk", "frag", "cls", "counts", "ids", "flags", "lengths", "symbols"]


def _ask_classes(parts: int, held, id_kind: pa.DataType):
    """id, flag, text -> frag, chunk, words: the words outside the lexicon that a chunk asks for, each once; and a row for each chunk with its documents' symbols, in which -j stands for the j-th word asked for."""
    names = ["frag", "chunk", "words", "ids", "flags", "lengths", "symbols"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(id_kind), pa.list_(pa.bool_()), pa.binary(), pa.binary()]

    def flush(chunk: int, ids: list, flags: list, lengths: list, symbols: list, words: list, other: int) -> pa.RecordBatch:
        s, word = np.concatenate(symbols), np.concatenate(words)
        unique, which = np.unique(word, return_inverse=True)  # rising hashes are rising fragments
        s[s == other] = -1 - which
        cuts = np.searchsorted(frag_of(unique, parts), np.arange(parts + 1))
        filled = np.flatnonzero(np.diff(cuts))
        none = [None] * len(filled)
        columns = [[*filled.tolist(), chunk % parts], [chunk] * (len(filled) + 1), [*(unique[cuts[f] : cuts[f + 1]].tobytes() for f in filled), None], [*none, pa.concat_arrays(ids).to_pylist()], [*none, pa.concat_arrays(flags).to_pylist()], [*none, np.concatenate(lengths).astype("<u4").tobytes()], [*none, s.astype("<i4").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = held.value.classes.lexicon
        chunk, n = TaskContext.get().partitionId() << 24, 0
        parts_of: list[list] = [[], [], [], [], []]
        for b in batches:
            for i, j, words in tv.slices(b.column(2), lower=True):
                s, _, ids, place = sequences(words, lexicon)
                for x, y in zip(parts_of, (b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), np.diff(words.first) + 1, s, ids[s[place] == lexicon.other]), strict=True):
                    x.append(y)
                n += len(s)
                if n >= 2 * CHUNK:
                    yield flush(chunk, *parts_of, lexicon.other)
                    chunk, n, parts_of = chunk + 1, 0, [[], [], [], [], []]
        if n:
            yield flush(chunk, *parts_of, lexicon.other)

    return apply


def _tell_classes(held):
    def apply(table: pa.Table, others: pa.Table) -> pa.Table:
        """One fragment: the class and count of each word asked for; rows of chunks pass."""
        asked = table.filter(pa.compute.is_valid(table["words"]))
        passed = table.filter(pa.compute.is_null(table["words"])).select(["chunk", "frag", "ids", "flags", "lengths", "symbols"])
        unseen = held.value.classes.unseen
        ids, n, cls = (np.frombuffer(others[c][0].as_py() if len(others) else b"", kind) for c, kind in (("ids", "<u8"), ("counts", "<i8"), ("cls", "u1")))
        out: dict[str, list] = {"chunk": [], "frag": [], "cls": [], "counts": []}
        for frag, chunk, words in zip(*(asked[c].to_pylist() for c in ("frag", "chunk", "words")), strict=True):
            words = np.frombuffer(words, "<u8")
            own, count = np.full(len(words), unseen, dtype=np.uint8), np.zeros(len(words), dtype="<u4")
            if len(ids):
                at = np.minimum(np.searchsorted(ids, words), len(ids) - 1)
                hit = ids[at] == words
                own[hit], count[hit] = cls[at[hit]], np.minimum(n[at[hit]], 2**32 - 1)
            for c, v in (("chunk", chunk), ("frag", frag), ("cls", own.tobytes()), ("counts", count.tobytes())):
                out[c].append(v)
        replies = pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "frag": pa.array(out["frag"], pa.int32()), "cls": pa.array(out["cls"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})
        return pa.concat_tables([replies, passed], promote_options="default").select(SEQUENCE)

    return apply


def _sequence(held):
    def apply(table: pa.Table) -> pa.Table:
        """One chunk: for each document the numbers that its words give on their own, and its classes, a byte for each token."""
        m: Scorer = held.value
        head = table.filter(pa.compute.is_valid(table["symbols"]))
        replies = table.filter(pa.compute.is_valid(table["cls"])).select(["frag", "cls", "counts"]).sort_by("frag")
        cls, counts = (np.frombuffer(b"".join(replies[c].to_pylist()), kind) for c, kind in (("cls", "u1"), ("counts", "<u4")))
        s = np.frombuffer(head["symbols"][0].as_py(), "<i4")
        lengths = np.frombuffer(head["lengths"][0].as_py(), "<u4").astype(np.int64)
        asked = s < 0
        c, n = np.zeros(len(s), dtype=np.uint8), np.zeros(len(s), dtype=np.int64)
        c[asked], n[asked] = cls[-1 - s[asked]], counts[-1 - s[asked]]
        c[~asked], n[~asked] = m.classes.of[s[~asked]], m.count[s[~asked]]
        log_n = np.log10(n + 0.5)
        sums, emits, known = (np.r_[0, np.cumsum(x)] for x in (log_n, m.emission(c, n), n > 0))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        held_classes = c.tobytes()
        columns = {"n_known": pa.array(known[ends] - known[starts], pa.int64()), "base_score": pa.array(sums[ends] - sums[starts] - lengths * m.base), "emit": pa.array(emits[ends] - emits[starts]), "classes": pa.array([held_classes[x:y] for x, y in zip(starts, ends, strict=True)], pa.binary())}
        return pa.table({"doc_id": head["ids"].combine_chunks().flatten(), "held_out": head["flags"].combine_chunks().flatten(), "n_tokens": pa.array(lengths), **columns})

    return apply


def _steps(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, class, document) of each token.

    A state is the class before, k + 2 at the start of a text, or, after words seen once or never,
    k + 3 and the last state that was none of these.
    """
    c = np.frombuffer(b"".join(column.to_pylist()), "u1").astype(np.int64)
    ends = np.flatnonzero(c == k)
    first = np.zeros(len(c), bool)
    first[:1] = True
    first[ends[:-1] + 1] = True
    told = c <= k
    last = np.where(told, c, k + 2)[np.maximum.accumulate(np.where(told | first, np.arange(len(c)), 0))]
    before = np.r_[k + 2, np.where(told, c, k + 3 + last)[:-1]] if len(c) else c
    before[first] = k + 2
    return before, c, np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))


def transitions(rows: DataFrame, k: int) -> np.ndarray:
    """P(class | state), by the class sequences of training documents; smoothed with the classes' own frequencies by how many classes follow a state."""
    shape = (2 * k + 6, k + 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64)
        for b in batches:
            if len(b):
                before, c, _ = _steps(b.column(0), k)
                total += _pairs(before, c, shape)
        x, y = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total[x, y])], ["x", "y", "n"])

    seen = np.zeros(shape)
    for x, y, n in rows.where("not held_out").select("classes").mapInArrow(tidy(count), "x int, y int, n long").groupBy("x", "y").agg(F.sum("n")).collect():  # one for each pair of state and class
        seen[x, y] = n
    share = (seen.sum(axis=0) + 0.5) / (seen.sum(axis=0) + 0.5).sum()
    kinds = (seen > 0).sum(axis=1, keepdims=True) + 1
    return (seen + kinds * share) / (seen.sum(axis=1, keepdims=True) + kinds)


def class_sequences(df: DataFrame, held_out: Column, scorer: Scorer, others: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emit, classes."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = df.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col))
    kind = rows.schema[0].dataType
    held = df.sparkSession.sparkContext.broadcast(scorer)
    lists = f"ids array<{kind.simpleString()}>, flags array<boolean>, lengths binary, symbols binary"
    asked = rows.mapInArrow(tidy(_ask_classes(parts, held, to_arrow_type(kind))), f"frag int, chunk long, words binary, {lists}")
    told = asked.groupBy("frag").cogroup(others.select("frag", "ids", "counts", "cls").groupBy("frag")).applyInArrow(tidy_group(_tell_classes(held)), f"chunk long, frag int, cls binary, counts binary, {lists}")
    return materialize(told.groupBy("chunk").applyInArrow(tidy_group(_sequence(held)), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, emit double, classes binary"))


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows that aren't held out."""
    scorer, others, parts, total = fit(df, ~held_out, text_col, **options)
    rows = class_sequences(df, held_out, scorer, others, parts, id_col, text_col)
    k = scorer.classes.k
    p = transitions(rows, k)
    after = df.sparkSession.sparkContext.broadcast(np.log10(np.c_[p, p @ scorer.share_unseen()]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, c, doc = _steps(b.column(6), k)
            model = np.asarray(b.column(5)) + np.bincount(doc, after.value[before, c], minlength=len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(len(b), total, np.int64)), b.column(4), pa.array(model)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(add), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
