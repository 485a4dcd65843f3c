"""Removal of repeated passages: every window of `size` words that occurs more than once goes.

Each window has a Rabin-Karp hash (64 bits and 32 more of another base). Windows are
counted by fragments of the hash space: a task sends a hash that it sees once, or a mark
that it sees it more often, so that a passage of any frequency costs a row per task.
Repeated windows merge into maximal intervals, which are removed.

Before, the minimal `gram`-word hashes of all windows (about 7 in 100 positions) are
counted the same way: equal windows have equal minima at the same offset, so a window
whose minimum occurs once is unique and needn't be sent. The repeated minima are held in a
bitmap of fixed size, which may only say too often that one is repeated.

Null or empty texts have no words. Rows that repeat are judged as further occurrences, and
returned one by one. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textvec as tv
from strata.llm.common import Bitmap, bitmap_of_longs, fragments, materialize, split_by
from strata.llm.textvec import tidy, tidy_group

U64 = np.uint64
#: Hashes that a task holds before it sends them on: CHUNK, or as many as give each fragment EACH of them, MOST at most.
CHUNK, EACH, MOST = 600_000, 64, 4_000_000
ANCHOR_BITS = 1 << 26
OTHER_BASE = 0xD1342543DE82EF95


def chunk_size(parts: int) -> int:
    """A chunk sends a row to each fragment, so chunks grow along with the fragments."""
    return min(MOST, max(CHUNK, EACH * parts))


def sliding(x: np.ndarray, k: int, pick) -> np.ndarray:
    """pick.reduce of each k values from x[i] on; shorter by k - 1."""
    if len(x) < k:
        return x[:0]
    width, out = 1, x
    while width * 2 <= k:
        out = pick(out[:-width], out[width:])
        width *= 2
    rest = k - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def minima(words: tv.Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, starts of windows, minimum of each window, minima by position)."""
    h = words.hashes()
    at = tv.runs(words.first, size)
    if not len(at):
        return h, at, h[:0], h[:0]
    g = tv.rolling(h, np.arange(len(h) - gram + 1), gram) | U64(1)
    span = size - gram + 1
    low = sliding(g, span, np.minimum)
    least = low[at]
    masked = np.zeros(len(g) + span - 1, dtype=np.uint64)
    masked[at + span - 1] = least
    high = sliding(masked, span, np.maximum)[: len(g)]
    return h, at, least, g[high == g]


def frag_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int64)


def _anchor_requests(size: int, gram: int, parts: int):
    """text -> frag, once, many: minima that a chunk has once, and more often."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        s = np.sort(np.concatenate(held))
        starts = tv.group_starts(s)
        count = np.diff(np.r_[starts, len(s)])
        columns = []
        for some in (s[starts[count == 1]], s[starts[count > 1]]):
            cuts = np.searchsorted(frag_of(some, parts), np.arange(parts + 1))
            columns.append([some[cuts[f] : cuts[f + 1]].tobytes() for f in range(parts)])
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["frag", "once", "many"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, _, words in tv.slices(b.column(0), lower=False):
                *_, anchors = minima(words, size, gram)
                held.append(anchors)
                n += len(anchors)
                if n >= chunk_size(parts):
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return apply


def _repeated_anchors(table: pa.Table) -> pa.Table:
    once = np.frombuffer(b"".join(table["once"].to_pylist()), "<u8")
    many = np.unique(np.frombuffer(b"".join(table["many"].to_pylist()), "<u8"))
    s = np.sort(np.concatenate([once, many, many]))
    starts = tv.group_starts(s)
    out = s[starts[np.diff(np.r_[starts, len(s)]) > 1]]
    return pa.table({"anchor": pa.array(out.view(np.int64))})


def gaps(at: np.ndarray) -> bytes:
    """Rising indexes as differences, in two bytes where they fit: the first byte tells."""
    d = np.diff(at, prepend=0)
    kind = "<u2" if not len(d) or d.max() < 65536 else "<u4"
    return (b"\2" if kind == "<u2" else b"\4") + d.astype(kind).tobytes()


def from_gaps(held: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(held, "<u2" if held[:1] == b"\2" else "<u4", offset=1), dtype=np.int64)


PAIR = np.dtype([("h", "<u8"), ("c", "<u4")])


def _runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, lengths) of runs of consecutive numbers."""
    starts = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else np.zeros(0, np.int64)
    return at[starts], np.diff(np.r_[starts, len(at)])


def _window_requests(size: int, gram: int, parts: int, repeated):
    """key, text -> frag, chunk, hashes, at, many; and a row for each chunk with its candidate windows as runs (key, first, length) and those that it repeats itself."""
    names = ["frag", "chunk", "hashes", "at", "many", "keys", "first", "length", "own"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def flush(chunk: int, hashes: list, checks: list, keys: list, firsts: list, lengths: list) -> pa.RecordBatch:
        pair = np.empty(sum(map(len, hashes)), PAIR)
        pair["h"], pair["c"] = np.concatenate(hashes), np.concatenate(checks)
        order = np.argsort(pair["h"])
        sorted_ = pair[order]
        starts = np.flatnonzero(np.r_[True, (sorted_["h"][1:] != sorted_["h"][:-1]) | (sorted_["c"][1:] != sorted_["c"][:-1])])
        count = np.diff(np.r_[starts, len(pair)])
        once = np.zeros(len(pair), dtype=bool)
        once[order] = np.repeat(count == 1, count)
        many = sorted_[starts[count > 1]]
        many_cuts = np.searchsorted(frag_of(many["h"], parts), np.arange(parts + 1))
        at = np.flatnonzero(once)
        frag = frag_of(pair["h"][at], parts).astype(np.int32)
        by = np.argsort(frag, kind="stable")
        cuts = np.searchsorted(frag[by], np.arange(parts + 1))
        asked = [at[by[cuts[f] : cuts[f + 1]]] for f in range(parts)]
        none = [None] * parts
        rows = [
            [*range(parts), chunk % parts], [chunk] * (parts + 1), [*(pair[a].tobytes() for a in asked), None], [*map(gaps, asked), None], [*(many[many_cuts[f] : many_cuts[f + 1]].tobytes() for f in range(parts)), None],
            [*none, np.concatenate(keys).tobytes()], [*none, np.concatenate(firsts).astype("<u4").tobytes()], [*none, np.concatenate(lengths).astype("<u4").tobytes()], [*none, np.packbits(~once).tobytes()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(ANCHOR_BITS, repeated.value)
        chunk, n, held = TaskContext.get().partitionId() << 24, 0, [[], [], [], [], []]
        for b in batches:
            keys = np.asarray(b.column(0))
            for i, j, words in tv.slices(b.column(1), lower=False):
                h, at, least, _ = minima(words, size, gram)
                at = at[bitmap.has(least)]
                if not len(at):
                    continue
                doc = np.searchsorted(words.first, at, "right") - 1
                first, length = _runs_of(at + doc)  # the added number parts runs of neighbouring texts
                who = doc[np.r_[0, np.cumsum(length)[:-1]]]
                for x, y in zip(held, (tv.rolling(h, at, size), tv.rolling(h, at, size, OTHER_BASE).astype("<u4"), keys[i:j][who], first - who - words.first[who], length), strict=True):
                    x.append(y)
                n += len(at)
                if n >= chunk_size(parts):
                    yield flush(chunk, *held)
                    chunk, n, held = chunk + 1, 0, [[], [], [], [], []]
        if n:
            yield flush(chunk, *held)

    return apply


def _count_windows(table: pa.Table) -> pa.Table:
    """One fragment of the hash space: for each chunk, which of its windows occur elsewhere too."""
    asked = table.filter(pa.compute.is_valid(table["hashes"]))
    passed = table.filter(pa.compute.is_null(table["hashes"])).select(["chunk", "keys", "first", "length", "own"])
    chunks, hashes, ats, many = (asked[c].to_pylist() for c in ("chunk", "hashes", "at", "many"))
    own = [np.frombuffer(x, PAIR) for x in hashes]
    often = np.frombuffer(b"".join(many), PAIR)
    pair = np.concatenate([*own, often, often]) if own else np.zeros(0, PAIR)
    order = np.argsort(pair["h"])
    s = pair[order]
    starts = np.flatnonzero(np.r_[True, (s["h"][1:] != s["h"][:-1]) | (s["c"][1:] != s["c"][:-1])]) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.r_[starts, len(s)])
    repeated = np.zeros(len(s), dtype=bool)
    repeated[order] = np.repeat(count > 1, count)
    out, i = {"chunk": [], "at": []}, 0
    for chunk, x, at in zip(chunks, own, ats, strict=True):
        found = from_gaps(at)[repeated[i : i + len(x)]]
        i += len(x)
        if len(found):
            out["chunk"].append(chunk)
            out["at"].append(gaps(found))
    replies = pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "at": pa.array(out["at"], pa.binary())})
    return pa.concat_tables([replies, passed], promote_options="default").select(["chunk", "at", "keys", "first", "length", "own"])


def _intervals(size: int):
    def apply(table: pa.Table) -> pa.Table:
        """One chunk: key and the merged intervals of words (from, to) that its repeated windows cover."""
        head = table.filter(pa.compute.is_valid(table["keys"])).to_pylist()[0]
        first, length = (np.frombuffer(head[c], "<u4").astype(np.int64) for c in ("first", "length"))
        keys = np.repeat(np.frombuffer(head["keys"], "<i8"), length)
        at = np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))
        run = np.repeat(np.arange(len(length)), length)
        hit = np.unpackbits(np.frombuffer(head["own"], np.uint8), count=len(at)).astype(bool)
        for x in table["at"].drop_null().to_pylist():
            hit[from_gaps(x)] = True
        keys, at, run = keys[hit], at[hit], run[hit]
        if not len(at):
            return pa.table({"key": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        # a new text starts where the run changes and the position does not rise, or the key changes
        text = np.cumsum(np.r_[0, (run[1:] != run[:-1]) & ((keys[1:] != keys[:-1]) | (at[1:] <= at[:-1]))])
        fresh = np.r_[True, (text[1:] != text[:-1]) | (at[1:] > at[:-1] + size)]
        starts = np.flatnonzero(fresh)
        spans = np.stack([at[starts], at[np.r_[starts[1:], len(at)] - 1] + size], axis=1).astype("<u4")
        edges = np.r_[tv.group_starts(text[starts]), len(starts)]
        return pa.table({"key": pa.array(keys[starts[edges[:-1]]]), "spans": pa.array([spans[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    return apply


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words_n, removed, digests, kept_texts = [], [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            n, gone = len(words), 0
            if spans:
                cut = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
                gone = sum(y - x for x, y in cut)
                edges = [0, *(e for pair in cut for e in pair), n]
                words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
            kept = b" ".join(words)
            words_n.append(n)
            removed.append(gone)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_spans(df: DataFrame, id_col: str, text_col: str, size: int, gram: int) -> DataFrame:
    """key, spans: for each row with repeated windows its key (hash of id and text) and the intervals of words, as packed pairs of uint32."""
    spark = df.sparkSession
    text = df.select(F.col(text_col))
    parts = fragments(text, 12, least=4)
    asked = text.mapInArrow(tidy(_anchor_requests(size, gram, parts)), "frag int, once binary, many binary")
    found = bitmap_of_longs(asked.groupBy("frag").applyInArrow(tidy_group(_repeated_anchors), "anchor long"), ANCHOR_BITS)
    held = spark.sparkContext.broadcast(found.data)  # ANCHOR_BITS / 8 bytes at any size
    keyed = df.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col))
    asked = keyed.mapInArrow(tidy(_window_requests(size, gram, parts, held)), "frag int, chunk long, hashes binary, at binary, many binary, keys binary, first binary, length binary, own binary")
    replies = asked.groupBy("frag").applyInArrow(tidy_group(_count_windows), "chunk long, at binary, keys binary, first binary, length binary, own binary")
    return replies.groupBy("chunk").applyInArrow(tidy_group(_intervals(size)), "key long, spans binary")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, gram: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words, joined by one space)."""
    spans = materialize(repeated_spans(df, id_col, text_col, size, gram))
    touched = bitmap_of_longs(spans.select("key"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    clear, open_ = split_by(rows, F.col("key"), touched)
    whole = clear.select("doc_id", "text", F.lit(None).cast("binary").alias("spans"))
    some = open_.join(spans.dropDuplicates(["key"]), "key", "left").select("doc_id", "text", "spans")
    return whole.unionByName(some).mapInArrow(tidy(_keep), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
