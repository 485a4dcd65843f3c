"""N-gram Jaccard join by vertical partitioning, and its connected components.

A document's set is its distinct shingles of `k` words (lower-cased A-Z); with fewer words
the whole sequence is one. The hash of a shingle is its place in the global order, which
is cut into fragments; each fragment counts what it sees on its own and the partial
counts are summed: first for each document (how many of its shingles occur elsewhere at
all), then for each candidate pair (its overlap).

1. A document whose shingles occur in other documents for less than `percent` of its set
   can't be linked with any; this drops nearly all, and moves four bytes a shingle.
2. Equal sets become one node; only one text of each is read again. The same count over
   the nodes leaves of each set what other nodes have too, and drops more nodes.
3. Nodes that share one of their least hashes are verified against one pivot of that
   bucket, and linked ones contracted, for a few rounds, so that a group of near copies
   costs a few pairs a member.
4. What is left is exact: by prefix filtering, any two linked nodes share a hash among
   the first n - ceil(n * percent / 100) + 1 of either under one global order (frequent
   hashes last). Only pairs across components are verified, and contracted.

Candidates of 3 and 4 must pass a bound that loses no link: sets differ in at least as
many hashes as the parities of their hashes modulo 64 * BITS do.

Null or empty texts have the empty set: no links, and the component is their own id. Rows
that repeat an id are returned one by one. Other columns are ignored. An empty table
gives an empty result. Nodes are known by a 64-bit hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textvec as tv
from strata.llm.common import Bitmap, bitmap_of_longs, collect_garbage, fragments, materialize
from strata.llm.graph import contract
from strata.llm.textvec import tidy, tidy_group

#: Shingles that a task holds before it sends them on.
CHUNK = 400_000
#: Bits of a fragment's part of the order that pairs' overlaps are counted in: 2 ** PARTS fragments.
PARTS = 2
U64 = np.uint64


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes, ends): sorted distinct shingle hashes of texts, text by text."""
    for i, j, words in tv.slices(texts, lower=True):
        h = words.hashes()
        at = tv.runs(words.first, k)
        s = tv.rolling(h, at, k)
        doc = words.doc[at]
        n = np.diff(words.first)
        for few in range(1, k):
            short = np.flatnonzero(n == few)
            if len(short):
                s = np.r_[s, tv.rolling(h, words.first[:-1][short], few) + U64(few)]
                doc = np.r_[doc, short]
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
        yield i, j, s, np.searchsorted(doc, np.arange(1, j - i + 1))


def set_hash(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.r_[U64(0), np.cumsum(tv.mix(s ^ U64(0x5851F42D4C957F2D)))]
    first = np.r_[0, ends[:-1]]
    return tv.mix(sums[ends] - sums[first] + (ends - first).astype(U64)).view(np.int64)


def _requests(k: int, parts: int, id_kind: pa.DataType):
    """documents -> rows (frag, chunk, tokens, runs, many, ids, n, node, seen).

    For each chunk of documents and each fragment: the low halves of those hashes that the
    chunk has once (by document; `runs` counts them), and those that it has more often.
    One more row of each chunk has its documents.
    """
    names = ["frag", "chunk", "tokens", "runs", "many", "ids", "n", "node", "seen"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def flush(chunk: int, ids: list, hashes: list, sizes: list, nodes: list) -> pa.RecordBatch:
        s, n = np.concatenate(hashes), np.concatenate(sizes)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(s)
        starts = tv.group_starts(s[order])
        count = np.diff(np.r_[starts, len(s)])
        once = np.zeros(len(s), dtype=bool)
        once[order] = np.repeat(count == 1, count)
        seen = np.bincount(doc[~once], minlength=len(n))
        many = s[order][starts[count > 1]]
        frag = (((s >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int32)
        runs = np.bincount(frag[once].astype(np.int64) * len(n) + doc[once], minlength=parts * len(n)).reshape(parts, len(n)).astype("<u4")
        by = np.argsort(frag[once], kind="stable")
        low = s[once][by].astype("<u4")
        cuts = np.searchsorted(frag[once][by], np.arange(parts + 1))
        many_frag = (((many >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int32)
        many_cuts = np.searchsorted(many_frag, np.arange(parts + 1))
        tokens = [low[cuts[f] : cuts[f + 1]].tobytes() for f in range(parts)]
        counted = [runs[f].tobytes() for f in range(parts)]
        often = [many[many_cuts[f] : many_cuts[f + 1]].astype("<u4").tobytes() for f in range(parts)]
        none = [None] * parts
        columns = [[*range(parts), chunk % parts], [chunk] * (parts + 1), [*tokens, None], [*counted, None], [*often, None], [*none, pa.concat_arrays(ids).to_pylist()], [*none, n.tolist()], [*none, np.concatenate(nodes).tolist()], [*none, seen.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        ids, hashes, sizes, nodes = [], [], [], []
        for b in batches:
            for i, j, s, ends in shingle_sets(b.column(1), k):
                ids.append(b.column(0).slice(i, j - i))
                hashes.append(s)
                sizes.append(np.diff(np.r_[0, ends]))
                nodes.append(set_hash(s, ends))
                held += len(s) + (j - i)
                if held >= CHUNK:
                    yield flush(chunk, ids, hashes, sizes, nodes)
                    chunk, held = chunk + 1, 0
                    ids, hashes, sizes, nodes = [], [], [], []
        if ids:
            yield flush(chunk, ids, hashes, sizes, nodes)

    return apply


def _count_shared(table: pa.Table) -> pa.Table:
    """One fragment: for each chunk, which of its documents have hashes that occur elsewhere, and how many; rows of documents pass."""
    asked = table.filter(pa.compute.is_valid(table["tokens"]))
    passed = table.filter(pa.compute.is_null(table["tokens"])).select(["chunk", "ids", "n", "node", "seen"])
    rows = asked.select(["chunk", "tokens", "runs", "many"]).to_pylist()
    tokens = [np.frombuffer(r["tokens"], "<u4") for r in rows]
    many = [np.frombuffer(r["many"], "<u4") for r in rows]
    all_ = np.concatenate([*tokens, *many, *many]) if rows else np.zeros(0, "<u4")
    order = np.argsort(all_)
    starts = tv.group_starts(all_[order])
    count = np.diff(np.r_[starts, len(all_)])
    shared = np.zeros(len(all_), dtype=bool)
    shared[order] = np.repeat(count > 1, count)
    out, at = {"chunk": [], "at": [], "count": []}, 0
    for r, t in zip(rows, tokens, strict=True):
        runs = np.frombuffer(r["runs"], "<u4").astype(np.int64)
        sums = np.r_[0, np.cumsum(shared[at : at + len(t)])]
        ends = np.cumsum(runs)
        n = sums[ends] - sums[ends - runs]
        at += len(t)
        has = np.flatnonzero(n)
        if len(has):
            out["chunk"].append(r["chunk"])
            out["at"].append(has.astype("<u4").tobytes())
            out["count"].append(n[has].astype("<u4").tobytes())
    replies = pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "at": pa.array(out["at"], pa.binary()), "count": pa.array(out["count"], pa.binary())})
    return pa.concat_tables([replies, passed], promote_options="default").select(["chunk", "at", "count", "ids", "n", "node", "seen"])


def _sum_shared(table: pa.Table) -> pa.Table:
    """One chunk: the sums of the fragments' counts for each document."""
    docs = table.filter(pa.compute.is_valid(table["n"]))
    sums = np.array(docs["seen"][0].as_py(), dtype=np.int64)
    for r in table.filter(pa.compute.is_valid(table["at"])).select(["at", "count"]).to_pylist():
        sums[np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["count"], "<u4")
    return pa.table({"doc_id": docs["ids"].combine_chunks().flatten(), "n": docs["n"].combine_chunks().flatten(), "node": docs["node"].combine_chunks().flatten(), "shared": pa.array(sums)})


def shared_counts(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, n (size of the set), node (hash of the set), shared (how many of the set other rows have too; never too few)."""
    rows = df.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    parts = fragments(rows, 6, least=16)
    from pyspark.sql.pandas.types import to_arrow_type

    asked = rows.mapInArrow(tidy(_requests(k, parts, to_arrow_type(rows.schema[0].dataType))), f"frag int, chunk long, tokens binary, runs binary, many binary, ids array<{kind}>, n array<long>, node array<long>, seen array<long>")
    replies = asked.groupBy("frag").applyInArrow(tidy_group(_count_shared), f"chunk long, at binary, count binary, ids array<{kind}>, n array<long>, node array<long>, seen array<long>")
    return replies.groupBy("chunk").applyInArrow(tidy_group(_sum_shared), f"doc_id {kind}, n long, node long, shared long")


def _token_rows(k: int, wanted: Bitmap):
    """(key, text) -> key, node, n, tokens of those whose key is in the bitmap."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(wanted.has(np.asarray(b.column(0)).view(U64))))
            if not len(b):
                continue
            for i, j, s, ends in shingle_sets(b.column(1), k):
                node = set_hash(s, ends)
                first = np.r_[0, ends[:-1]]
                held = s.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(node), pa.array(ends - first), pa.array([held[8 * x : 8 * y] for x, y in zip(first, ends, strict=True)], pa.binary())], ["key", "node", "n", "tokens"])

    return apply


def _segments(wanted: Bitmap):
    """node, n, tokens -> node, part, n, segment of the nodes in a bitmap: the set cut at fixed places of the global order."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << PARTS, dtype=np.uint64) << U64(64 - PARTS)
        for b in batches:
            b = b.filter(pa.array(wanted.has(np.asarray(b.column(0)).view(U64))))
            out = []
            for node, n, held in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                cuts = [0, *np.searchsorted(np.frombuffer(held, "<u8"), edges).tolist(), len(held) // 8]
                out += [(node, p, n, held[8 * cuts[p] : 8 * cuts[p + 1]]) for p in range(1 << PARTS)]
            if out:
                yield _rows(out)

    return apply


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["node", "part", "n", "segment"])


def _partial_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, na, nb, sa, sb -> a, b, na, nb, overlap of two segments."""
    for b in batches:
        n = np.zeros(len(b), dtype=np.int64)
        for r, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
            both.sort(kind="stable")
            n[r] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n)], ["a", "b", "na", "nb", "overlap"])


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link: overlaps are counted in each fragment of the order and summed."""
    involved = bitmap_of_longs(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    cut = tokens.select("node", "n", "tokens").mapInArrow(tidy(_segments(involved)), "node long, part int, n long, segment binary")
    left = cut.select(F.col("node").alias("a"), "part", F.col("n").alias("na"), F.col("segment").alias("sa"))
    right = cut.select(F.col("node").alias("b"), F.col("part"), F.col("n").alias("nb"), F.col("segment").alias("sb"))
    rows = pairs.select("a", "b").withColumn("part", F.explode(F.lit([*range(1 << PARTS)])))
    rows = rows.join(left, ["a", "part"]).join(right, ["b", "part"]).select("a", "b", "na", "nb", "sa", "sb")
    counted = rows.mapInArrow(tidy(_partial_overlap), "a long, b long, na long, nb long, overlap long")
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return summed.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b")


def _ask_shared(parts: int):
    """node, n, tokens -> frag, tokens, nodes, ns, many; and rows (node, n, own) with what a batch shares within itself."""
    names = ["frag", "tokens", "nodes", "ns", "many", "node", "n", "own"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            node, n = (np.asarray(b.column(c)) for c in (0, 1))
            sets = [np.frombuffer(x, "<u8") for x in b.column(2).to_pylist()]
            s = np.concatenate(sets)
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(s)
            starts = tv.group_starts(s[order])
            count = np.diff(np.r_[starts, len(s)])
            once = np.zeros(len(s), dtype=bool)
            once[order] = np.repeat(count == 1, count)
            many = s[order][starts[count > 1]]
            own, own_at = s[~once], at[~once]
            edges = np.searchsorted(own_at, np.arange(len(sets) + 1))
            alone, alone_at = s[once], at[once]
            frag = _frag(alone, parts)
            by = np.argsort(frag.astype(np.int32), kind="stable")
            cuts = np.searchsorted(frag[by], np.arange(parts + 1))
            many_cuts = np.searchsorted(_frag(many, parts), np.arange(parts + 1))
            pick = [by[cuts[f] : cuts[f + 1]] for f in range(parts)]
            none, blank = [None] * parts, [None] * len(sets)
            columns = [[*range(parts), *(int(x) % parts for x in node)], [*(alone[x].tobytes() for x in pick), *blank], [*(node[alone_at[x]].tobytes() for x in pick), *blank], [*(n[alone_at[x]].tobytes() for x in pick), *blank], [*(many[many_cuts[f] : many_cuts[f + 1]].tobytes() for f in range(parts)), *blank], [*none, *node.tolist()], [*none, *n.tolist()], [*none, *(own[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return apply


def _frag(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int64)


def _tell_shared(table: pa.Table) -> pa.Table:
    """One fragment: node, n, own: those hashes of each node that other nodes have too; rows of batches pass."""
    passed = table.filter(pa.compute.is_valid(table["node"])).select(["node", "n", "own"])
    asked = table.filter(pa.compute.is_valid(table["tokens"]))
    token, node, n, many = (np.frombuffer(b"".join(asked[c].to_pylist()), k) for c, k in (("tokens", "<u8"), ("nodes", "<i8"), ("ns", "<i8"), ("many", "<u8")))
    both = np.concatenate([token, many, many])
    order = np.argsort(both)
    starts = tv.group_starts(both[order])
    count = np.diff(np.r_[starts, len(both)])
    shared = np.zeros(len(both), dtype=bool)
    shared[order] = np.repeat(count > 1, count)
    shared = shared[: len(token)]
    token, node, n = token[shared], node[shared], n[shared]
    by = np.argsort(node, kind="stable")
    token, node, n = token[by], node[by], n[by]
    first = tv.group_starts(node)
    ends = np.r_[first[1:], len(node)][: len(first)]
    found = pa.table({"node": pa.array(node[first]), "n": pa.array(n[first]), "own": pa.array([token[x:y].tobytes() for x, y in zip(first, ends, strict=True)], pa.binary())})
    return pa.concat_tables([found, passed])


BITS = 16  # words of 64 bits of a node's parity bitmap


def _kept(percent: int):
    """node, n, pieces -> node, n, m, b0.., tokens of the nodes that keep enough of their set: m hashes, sorted, and their parity bitmap."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, bits = [], []
            for node, n, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = np.sort(np.frombuffer(b"".join(pieces), "<u8"))
                if len(t) * 100 >= n * percent:
                    odd = np.bincount((t % U64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
                    rows.append((node, n, len(t), t.tobytes()))
                    bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
            if rows:
                node, n, m, held = zip(*rows, strict=True)
                words = np.stack(bits)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), *(pa.array(words[:, i].copy()) for i in range(BITS)), pa.array(held, pa.binary())], ["node", "n", "m", *(f"b{i}" for i in range(BITS)), "tokens"])

    return apply


def prune(tokens: DataFrame, percent: int) -> DataFrame:
    """node, n, m, b0.., tokens: nodes with those of their hashes that other nodes have too (m of n); nodes with too few to be linked go."""
    parts = fragments(tokens, 6, least=16)
    asked = tokens.select("node", "n", "tokens").mapInArrow(tidy(_ask_shared(parts)), "frag int, tokens binary, nodes binary, ns binary, many binary, node long, n long, own binary")
    told = asked.groupBy("frag").applyInArrow(tidy_group(_tell_shared), "node long, n long, own binary")
    whole = told.groupBy("node", "n").agg(F.collect_list("own").alias("pieces"))
    words = "".join(f"b{i} long, " for i in range(BITS))
    return whole.mapInArrow(tidy(_kept(percent)), f"node long, n long, m long, {words}tokens binary")


def _may_link(x: str, y: str, percent: int, placed: bool = False) -> str:
    """SQL: whether nodes x and y can link, by their bitmaps: their kept sets differ in at least as many hashes as their parities do.

    placed: x and y stand in the list of a hash, `place` by place in their order. If it is the first that they share, no more than what follows is shared; of a pair that links, the first shared hash passes.
    """
    differ = " + ".join(f"bit_count({x}.b{i} ^ {y}.b{i})" for i in range(BITS))
    left = f"least({x}.m - {x}.place, {y}.m - {y}.place)" if placed else f"least({x}.m, {y}.m)"
    enough = "100 * {0} >= %d * (%s.n + %s.n - {0})" % (percent, x, y)
    return f"{enough.format(left)} and {enough.format(f'(({x}.m + {y}.m - ({differ})) div 2)')}"


def _marks(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """node, comp, n, m, b0..: what candidates are judged by, without the hashes."""
    return nodes.drop("tokens").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _buckets(keys: int):
    """node, tokens -> bucket, node: the least hashes of a set name its buckets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [np.frombuffer(x[: 8 * keys], "<i8") for x in b.column(1).to_pylist()]
            if least:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(least)), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), [len(x) for x in least])))], ["bucket", "node"])

    return apply


def _near_pivots(nodes: DataFrame, comps: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may link: each node of a bucket with pivots of the bucket, which change with the seed.

    The first round joins most nodes of most groups with one pivot of two buckets; later
    ones try four of four for the nodes that are left.
    """
    many = 1 if seed == 0 else 4
    marks = _marks(nodes, comps)
    rows = nodes.select("node", "tokens").mapInArrow(tidy(_buckets(2 if seed == 0 else 4)), "bucket long, node long")
    turns = [F.lit((seed * 4 + k) * 0x5851F42D4C957F2D % (1 << 63)).cast("long") for k in range(many)]
    least = [F.min(F.col("node").bitwiseXOR(t)).bitwiseXOR(t) for t in turns]
    pivots = rows.groupBy("bucket").agg(F.array_distinct(F.array(*least)).alias("pivots"))
    pairs = rows.join(pivots, "bucket").select(F.col("node").alias("own"), F.explode("pivots").alias("pivot")).where("own <> pivot").distinct()
    near = pairs.join(marks.alias("x"), F.expr("own = x.node"))
    near = near.join(marks.alias("y"), F.expr(f"pivot = y.node and x.comp <> y.comp and {_may_link('x', 'y', percent)}"))
    return near.select(F.least("own", "pivot").alias("a"), F.greatest("own", "pivot").alias("b")).distinct()


def _frequent_requests(parts: int):
    """node, m, comp, tokens -> frag, pairs: distinct (shingle, component) by fragment."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            comps, n = np.asarray(b.column(2)), np.asarray(b.column(1))
            s = np.concatenate([np.frombuffer(x, "<u8") for x in b.column(3).to_pylist()]) if len(b) else np.zeros(0, U64)
            pair = np.zeros(len(s), dtype=[("t", "<u8"), ("c", "<i8")])
            pair["t"], pair["c"] = s, np.repeat(comps, n)
            order = np.lexsort((pair["c"], pair["t"]))
            pair = pair[order]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = pair[1:] != pair[:-1]
            pair = pair[new]
            cuts = np.searchsorted(((pair["t"] >> U64(40)) * U64(parts)) >> U64(24), np.arange(parts + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([pair[cuts[f] : cuts[f + 1]].tobytes() for f in range(parts)], pa.binary())], ["frag", "pairs"])

    return apply


def _frequent(least: int):
    def apply(table: pa.Table) -> pa.Table:
        pair = np.frombuffer(b"".join(table["pairs"].to_pylist()), dtype=[("t", "<u8"), ("c", "<i8")])
        pair = pair[np.lexsort((pair["c"], pair["t"]))]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        t = pair["t"][new]
        starts = tv.group_starts(t)
        often = np.diff(np.r_[starts, len(t)]) >= least
        return pa.table({"token": pa.array(t[starts[often]].view(np.int64))})

    return apply


def _prefixes(percent: int, frequent: Bitmap):
    """node, n, comp, tokens -> token, node, comp, place of the prefix under the order (not shared, shared by few, frequent; hash)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], np.zeros(len(b), dtype=np.int64)
            for r, (n, held) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                t = np.frombuffer(held, "<u8")
                p = n + (-n * percent) // 100 + 1 - (n - len(t))  # those that no other node has come first, and are in no list
                size[r] = p
                out.append(t[np.argsort(frequent.has(t), kind="stable")[:p]])
            who = pa.array(np.repeat(np.arange(len(b)), size))
            if out:
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), b.column(0).take(who), b.column(2).take(who), pa.array(place)], ["token", "node", "comp", "place"])

    return apply


def _across(nodes: DataFrame, comps: DataFrame, percent: int, least: int = 8) -> DataFrame:
    """All pairs (a, b) of nodes in different components that share a hash of their prefixes and may link.

    In the list of each hash, nodes of the list's main component meet only the nodes of others.
    """
    rows = nodes.select("node", "n", "m", "tokens").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = fragments(nodes, 6, least=16)
    often = rows.select("node", "m", "comp", "tokens").mapInArrow(tidy(_frequent_requests(parts)), "frag int, pairs binary").groupBy("frag").applyInArrow(tidy_group(_frequent(least)), "token long")
    prefix = materialize(rows.select("node", "n", "comp", "tokens").mapInArrow(tidy(_prefixes(percent, bitmap_of_longs(often))), "token long, node long, comp long, place long"))
    by_comp = prefix.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = by_comp.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("token", "main")
    marks = _marks(nodes, comps).drop("comp")
    lists = materialize(prefix.join(mixed, "token").join(marks, "node"))
    few = lists.where("comp <> main").alias("x")
    pairs = lists.alias("y").join(few, F.expr(f"x.token = y.token and x.comp <> y.comp and (y.comp = y.main or y.node < x.node) and {_may_link('x', 'y', percent, placed=True)}"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between nodes: links are lifted to components and contracted."""
    a, b = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    step = contract(lifted)
    up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    moved = comps.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = step.join(comps, "node", "left_anti")
    return materialize(moved.unionByName(fresh))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that is reachable by links of Jaccard percent / 100 or more."""
    stats = materialize(shared_counts(df, id_col, text_col, k))
    sets = stats.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.max("shared").alias("shared"), F.count("*").alias("copies"), F.min("doc_id").alias("key"))
    open_ = sets.where(F.col("shared") * 100 >= F.col("n") * percent)
    chosen = materialize(open_.select("node", F.xxhash64("key").alias("key")))
    texts = df.select(F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col))
    found = texts.mapInArrow(tidy(_token_rows(k, bitmap_of_longs(chosen.select("key")))), "key long, node long, n long, tokens binary")
    tokens = materialize(found.join(chosen, ["key", "node"], "left_semi").dropDuplicates(["key", "node"]).select("node", "n", "tokens"))
    nodes = materialize(prune(tokens, percent))
    comps = chosen.select("node", F.col("node").alias("comp")).limit(0)
    collect_garbage(df.sparkSession)
    for r in range(rounds):
        links = materialize(verified(materialize(_near_pivots(nodes, comps, percent, seed=r)), nodes, percent))
        if not links.head(1):
            break
        comps = _merge(comps, links)
        collect_garbage(df.sparkSession)
    pairs = materialize(_across(nodes, comps, percent))
    collect_garbage(df.sparkSession)
    links = materialize(verified(pairs, nodes, percent))
    comps = _merge(comps, links)
    collect_garbage(df.sparkSession)
    labelled = stats.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = labelled.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(least, "comp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
