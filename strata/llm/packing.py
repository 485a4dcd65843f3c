"""Best-fit packing of tokenised documents by bin completion.

Lengths are whole numbers up to the capacity, so everything that the search needs to
know of any corpus is one count per length. Bin completion branch and bound works on
those counts: it takes the largest length that is left, enumerates undominated fillings
of the rest of its bin, and branches on which one is used and how often. A branch ends
when its waste shows that it can't beat the incumbent, which is best-fit decreasing's
packing at first; the search ends at a lower bound of bins, when all branches are done,
or when `budget` is spent (bin packing is NP-hard; the incumbent then stands). Pieces
look up their place by their rank among pieces of equal length.

Ids are those of the tokenizers library with its defaults: strings of special tokens
(`<|endoftext|>`) become their ids.

Null texts are empty and still give one piece (the end token). Rows that repeat an id are
packed one by one. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize, running_sum
from strata.llm.textvec import release, tidy

#: The split pattern of the public byte-level BPE vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBE = "Probe: they'll  see 1234 naïve\n\n\tžluťoučký <|endoftext|> 你好 ... _x_y "

_loaded: dict[tuple[str, bool], object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def merge_ranks(path: str) -> dict[bytes, int]:
    """bytes -> id of a byte-level BPE vocabulary whose ids are in merge order."""
    with open(path) as f:
        held = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {x["content"] for x in held.get("added_tokens", [])}
    return {bytes(byte[c] for c in k): v for k, v in held["model"]["vocab"].items() if k not in special}


def encoder(path: str, fast: bool):
    """text -> list of ids, by the vocabulary at `path` (tokenizers' JSON). fast: by tiktoken, several times faster; texts with a special token's string go to the tokenizers library."""
    if (path, fast) not in _loaded:
        if fast:
            import tiktoken

            with open(path) as f:
                special = [x["content"] for x in json.load(f).get("added_tokens", [])]
            quick = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=merge_ranks(path), special_tokens={}).encode_ordinary

            def encode(text: str) -> list[int]:
                if any(s in text for s in special):
                    return encoder(path, False)(text)
                try:
                    return quick(text)
                except BaseException as e:  # its panics are no Exceptions; a run of a million spaces is one
                    if type(e).__name__ != "PanicException":
                        raise
                    return encoder(path, False)(text)

            _loaded[path, fast] = encode
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            _loaded[path, fast] = lambda text: slow.encode(text, add_special_tokens=False).ids
    return _loaded[path, fast]


def forget() -> None:
    """Drops the loaded tokenizers. A function of the module, as one that is sent to tasks has a copy of `_loaded`."""
    _loaded.clear()


def can_be_fast(path: str) -> bool:
    """Whether tiktoken has the vocabulary's ids for a probe; else the tokenizers library is used throughout."""
    try:
        return encoder(path, True)(PROBE) == encoder(path, False)(PROBE)
    except (ImportError, KeyError, ValueError):
        return False
    finally:  # the driver has no other use for them
        forget()
        release()


def pieces(df: DataFrame, capacity: int, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents cut into pieces of `capacity` tokens, of which the first may be shorter."""

    fast = can_be_fast(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            encode = encoder(path, fast)
            for b in batches:
                docs, number, start, length, crc = [], [], [], [], []
                for row, text in enumerate(b.column(1)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                    n = len(ids)
                    first = n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for k in range(len(edges) - 1):
                        docs.append(row)
                        number.append(k)
                        start.append(edges[k])
                        length.append(edges[k + 1] - edges[k])
                        crc.append(zlib.crc32(ids[edges[k] : edges[k + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:  # a worker lives on for other stages
            forget()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts by length: each length goes to the fullest open bins that have room for it."""
    open_: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def put(room: int, pattern: Pattern) -> None:
        (done if room == 0 else open_.setdefault(room, [])).append(pattern)

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            r = min((x for x in open_ if x >= length), default=None)
            if r is not None:
                held, times = open_[r].pop()
                used = min(left, times)
                if used < times:
                    open_[r].append((held, times - used))
                if not open_[r]:
                    del open_[r]
                put(r - length, ((*held, length), used))
                left -= used
            else:
                each = min(capacity // length, left)
                times = left // each
                put(capacity - each * length, ((length,) * each, times))
                left -= each * times
    return done + [p for held in open_.values() for p in held]


def bins_of(patterns: list[Pattern]) -> int:
    return sum(times for _, times in patterns)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: for each a, lengths over capacity - a and over half of it are alone or apart, and what those of a or more don't find room for takes more bins."""
    n = np.r_[np.cumsum(counts[::-1])[::-1], 0].astype(np.int64)  # how many of at least each length
    size = np.r_[np.cumsum((counts * np.arange(len(counts)))[::-1])[::-1], 0].astype(np.int64)
    half = capacity // 2 + 1
    a = np.arange(capacity // 2 + 1)
    alone = n[np.minimum(capacity - a + 1, len(n) - 1)]
    apart, apart_size = n[half] - alone, size[half] - size[np.minimum(capacity - a + 1, len(n) - 1)]
    small = size[np.minimum(a, half)] - size[half]
    return int((n[half] + np.maximum(0, -(-(small - (apart * capacity - apart_size)) // capacity))).max())


class Spent(Exception):
    """The search's budget is used up."""


class Meter:
    def __init__(self, budget: int):
        self.left = budget

    def take(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent


def dominated(chosen: tuple[int, ...], room: int, left: dict[int, int], order: np.ndarray) -> bool:
    """Whether some items of a filling (or none) could give way to one item that is left, as large as they are together or larger, and still fit.

    left: how often each length is left beside the filling; order: the lengths, rising.
    """
    slack = room - sum(chosen)
    sums: dict[int, int] = {0: 0}  # each sum of some of the items, and the most items that give it
    for x in chosen:
        for s, n in list(sums.items()):
            sums[s + x] = max(sums.get(s + x, 0), n + 1)
    for s, n in sums.items():
        at = int(np.searchsorted(order, max(1, s if n > 1 else s + 1)))
        while at < len(order) and order[at] <= s + slack:
            if left[int(order[at])] > 0:
                return True
            at += 1
    return False


def fillings(counts: np.ndarray, largest: int, room: int, waste: int, meter: Meter) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of `room` with lengths that are left and waste no more than `waste`: for each waste from 0, those of large lengths first."""
    order = np.flatnonzero(counts[: min(largest, room) + 1])
    left = {int(x): int(counts[x]) for x in order}
    falling = [int(x) for x in order[::-1]]
    reach: list[int] = []  # for each place, a bit for each sum that lengths from there on can make; known once it pays
    seen = 0

    def sums() -> Iterator[int]:
        every, mask = 1, (1 << room + 1) - 1
        yield every
        for x in falling[::-1]:
            times, step = min(left[x], room // x), 1
            while times > 0:  # 1, 2, 4, .. and the rest of them make any number of times
                step = min(step, times)
                every |= (every << x * step) & mask
                times -= step
                step *= 2
            yield every

    def go(i: int, need: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Those that fill `need` exactly, with lengths from place i on."""
        nonlocal seen
        if need == 0:
            if not dominated(chosen, room, left, order):
                yield chosen
            return
        for j in range(i, len(falling)):
            if seen == 50 and not reach:
                for x in chosen:
                    left[x] += 1
                reach.extend([*sums()][::-1])
                for x in chosen:
                    left[x] -= 1
            x = falling[j]
            if reach and not reach[j] >> need & 1:
                return
            if x > need or not left[x] or (reach and not reach[j] >> (need - x) & 1):
                continue
            seen += 1
            meter.take()
            left[x] -= 1
            yield from go(j, need - x, (*chosen, x))
            left[x] += 1

    for w in range(min(waste, room) + 1):
        meter.take()
        yield from go(0, room - w, ())


def bin_completion(counts: np.ndarray, capacity: int, budget: int = 2_000_000, dives: int = 12) -> list[Pattern]:
    """Patterns (lengths, times) that use up all counts, in as few bins as the search finds.

    A branch completes the largest length that is left by a filling, as often as counts
    allow first, then less often. Depth first, it changes its last completions before its
    first ones, so the budget (visited items of fillings) is shared by `dives`: the first
    is free, in each other one a completion at an early place takes its second branch.
    """
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    depth = len(best)
    for dive in range(dives):
        if bins_of(best) <= bound:
            break
        meter = Meter(budget // dives)
        try:
            best, done = _search(counts, capacity, total, bound, best, meter, (dive - 1) * depth // dives if dive else -1)
        except Spent:
            continue
        if done and not dive:
            break
    return best


def _search(counts: np.ndarray, capacity: int, total: int, bound: int, best: list[Pattern], meter: Meter, skip_at: int) -> tuple[list[Pattern], bool]:
    """(the best packing, True) once all branches are done; as far as the meter goes, what was found is kept. At depth skip_at the first branch is passed over."""
    found = best
    left = counts.copy()
    out: list[Pattern] = []

    def branches(allowed: int) -> Iterator[tuple[Pattern, int]]:
        large = int(np.flatnonzero(left)[-1])
        left[large] -= 1
        some = fillings(left.copy(), large, capacity - large, allowed, meter)
        left[large] += 1
        for pick in some:
            need: dict[int, int] = {}
            for x in (large, *pick):
                need[x] = need.get(x, 0) + 1
            most = min(int(left[x]) // n for x, n in need.items())
            lost = capacity - large - sum(pick)
            for times in range(most if not lost else min(most, allowed // lost), 0, -1):
                yield ((large, *pick), times), lost * times

    def use(p: Pattern, sign: int) -> None:
        for x in p[0]:
            left[x] -= sign * p[1]

    def allowed(waste: int) -> int:
        return (bins_of(found) - 1) * capacity - total - waste

    waste = 0
    stack: list[tuple[Iterator[tuple[Pattern, int]], Pattern | None, int]] = []
    try:
        stack.append((branches(allowed(0)), None, 0))
        if skip_at == 0:
            next(stack[0][0], None)
        while stack:
            steps, held, lost = stack[-1]
            if held is not None:
                use(held, -1)
                out.pop()
                waste -= lost
            step = next(steps, None)
            if step is None or waste + step[1] > allowed(0):
                stack.pop()
                continue
            p, lost = step
            use(p, 1)
            out.append(p)
            waste += lost
            stack[-1] = (steps, p, lost)
            if left.any():
                more = branches(allowed(waste))
                if len(stack) == skip_at:
                    next(more, None)
                stack.append((more, None, 0))
            else:
                found = list(out)
                if bins_of(found) <= bound:
                    break
    except Spent:
        return found, False
    return found, True


def pack(df: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    cut = materialize(pieces(df, capacity, tokenizer or default_tokenizer(), end_id, id_col, text_col))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    place, base = {}, 0
    used = np.zeros(capacity + 1, dtype=np.int64)
    for lengths, times in bin_completion(counts, capacity):
        offset = 0
        for x in lengths:
            place[(x << 44) + int(used[x])] = (int(used[x]), base, offset)
            used[x] += times
            offset += x
        base += times
    keys = np.array(sorted(place), dtype=np.int64)
    table = np.array([place[int(k)] for k in keys], dtype=np.int64).reshape(-1, 3)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = table[at, 1] + rank - table[at, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(table[at, 2], pa.int64())], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = running_sum(cut.withColumns({"_key": F.xxhash64("doc_id", "piece", "ids_crc32"), "_one": F.lit(1).cast("long")}), ["length"], "_key", "_one", "rank", buckets)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(tidy(assign), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
