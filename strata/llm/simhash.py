"""SimHash fingerprints, and exact near duplicates by vantage-point trees.

A document's features are the runs of `k` of its words (lower-cased A-Z), repeats included;
with fewer words the whole sequence is one. A bit of its fingerprint is 1 if it is set in
over half of their XXH64 hashes. Distinct fingerprints that differ in `radius` bits at most
link, and components of links are classes.

In a space of 64 even bits a ball of radius 4 meets most branches of a tree, so the
bits are cut into `parts`: fingerprints that link differ by radius // parts bits at most in
one part (else they would differ by more in all). For each part there is a tree over
the Hamming distance in that part:

1. Its upper levels are made on the driver from a sample of at most SAMPLE * 2**LEVELS
   fingerprints. A node has a vantage point and a distance; those up to that distance go
   inside, the others outside. They are chosen so that the pairs left to compare are fewest.
2. Each fingerprint is dealt to the shard (leaf) that it belongs to, and, by the triangle
   inequality, as a guest to all shards that its ball overlaps. Of the two shards in
   which a pair would meet, one is enough: guests go to later shards only.
3. A shard grows the tree further for its own points and prunes its branches for own points and guests
   by the same bounds. What is left is compared by all 64 bits, which makes links exact.
   Points of one class needn't be compared with each other, so that a family of near copies
   costs its size times the number of others in a leaf; a shard returns a tree of links for
   each class that it has found, never all pairs.

Links of all shards are contracted to components by graph.contract. Null and empty texts
have the fingerprint 0 and link like any other. Rows with a null id are linked, but name
no class unless the class has no other id; rows that repeat an id are returned one by one.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textvec as tv
from strata.llm.common import materialize
from strata.llm.graph import contract
from strata.llm.textvec import tidy, tidy_group

U64 = np.uint64
#: Fingerprints of the sample for each shard, and levels of the upper trees at most.
SAMPLE, LEVELS = 64, 12
#: Fingerprints that a task holds before it sends them on; pairs that are compared at once.
CHUNK, PAIRS = 1 << 16, 1 << 18


def fingerprints_of(texts: pa.Array, k: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, fingerprints) of runs of texts."""
    for i, j, words in tv.slices(texts, lower=True):
        data = words.data.tobytes()
        joined = b" ".join([data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
        length = words.end - words.start
        start = np.cumsum(length + 1) - length - 1
        end = start + length
        n = np.diff(words.first)
        at = tv.runs(words.first, k)
        short = (n > 0) & (n < k)
        first = np.r_[at, words.first[:-1][short]]
        last = np.r_[at + k - 1, words.first[1:][short] - 1]
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
        edges = np.searchsorted(first, words.first)
        out = np.zeros(j - i, U64)
        for d in range(j - i):
            own = h[edges[d] : edges[d + 1]]
            if len(own):
                out[d] = majority(own)
        yield i, j, out


def majority(h: np.ndarray, at_once: int = 1 << 16) -> int:
    """The bits that are set in over half of the numbers."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), at_once):
        bits = np.unpackbits(h[i : i + at_once].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed number."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, fp in fingerprints_of(b.column(1), k, seed):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    return rows.mapInArrow(tidy(apply), f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def masks(parts: int) -> list[int]:
    """The 64 bits in `parts` even stretches."""
    edges = [64 * p // parts for p in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def distance(x: np.ndarray, y: np.ndarray, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ y) & U64(mask)).astype(np.int64)


def best_split(points: np.ndarray, mask: int, radius: int, tries: int = 8, most: int = 256) -> tuple[int, int] | None:
    """(vantage point, distance) of some points that leave the fewest pairs to compare; None if none parts them well."""
    some = points[:: -(-len(points) // most)]
    tried = some[:: -(-len(some) // tries)]
    d = distance(tried[:, None], some[None, :], mask) + 66 * np.arange(len(tried))[:, None]
    upto = np.cumsum(np.bincount(d.ravel(), minlength=66 * len(tried)).reshape(-1, 66), axis=1)[:, :65]
    n, far = len(some), np.arange(65)
    work = upto * upto[:, np.minimum(far + radius, 64)] + (n - upto) * (n - np.where(far >= radius, upto[:, np.maximum(far - radius, 0)], 0))
    v, mu = np.unravel_index(np.argmin(work), work.shape)
    return (int(tried[v]), int(mu)) if work[v, mu] < 0.9 * n * n else None


def upper_tree(sample: np.ndarray, mask: int, radius: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(vantage points, distances) of the inner nodes of a complete tree; node x has the children 2x (inside) and 2x + 1, the root is 1."""
    point, mu = np.zeros(1 << levels, U64), np.full(1 << levels, 64)
    held = {1: sample}
    for x in range(1, 1 << levels):
        own = held.pop(x)
        split = best_split(own, mask, radius) if len(own) > 1 else None
        if split:
            point[x], mu[x] = split
        inside = distance(own, point[x], mask) <= mu[x]
        if 2 * x < 1 << levels:
            held[2 * x], held[2 * x + 1] = own[inside], own[~inside]
    return point, mu


def shards_of(fp: np.ndarray, tree: tuple[np.ndarray, np.ndarray], mask: int, radius: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home shard of each fingerprint; place, shard of its visits to later shards)."""
    point, mu = tree
    home = np.ones(len(fp), np.int64)
    who, node = np.arange(len(fp)), np.ones(len(fp), np.int64)
    for _ in range(levels):
        home = 2 * home + (distance(fp, point[home], mask) > mu[home])
        d = distance(fp[who], point[node], mask)
        inside, outside = d - radius <= mu[node], d + radius > mu[node]
        who, node = np.r_[who[inside], who[outside]], np.r_[2 * node[inside], 2 * node[outside] + 1]
    later = node > home[who]
    return home - (1 << levels), who[later], node[later] - (1 << levels)


def _deal(trees: list, cuts: list[int], radius: int, levels: int):
    """fp -> shard, own, guests: fingerprints of a chunk that belong to a shard, and that visit it."""

    def flush(fp: np.ndarray) -> pa.RecordBatch:
        out = []
        for p, (tree, mask) in enumerate(zip(trees, cuts, strict=True)):
            home, who, shard = shards_of(fp, tree, mask, radius, levels)
            by, by_guest = np.argsort(home, kind="stable"), np.argsort(shard, kind="stable")
            edges, guest_edges = (np.searchsorted(x, np.arange((1 << levels) + 1)) for x in (home[by], shard[by_guest]))
            own, guests = fp[by], fp[who[by_guest]]
            out += [((p << levels) + s, own[edges[s] : edges[s + 1]].tobytes(), guests[guest_edges[s] : guest_edges[s + 1]].tobytes()) for s in range(1 << levels) if edges[s + 1] > edges[s] or guest_edges[s + 1] > guest_edges[s]]
        shards, own, guests = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(own, pa.binary()), pa.array(guests, pa.binary())], ["shard", "own", "guests"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0)).view(U64))
            n += len(held[-1])
            if n >= CHUNK:
                yield flush(np.concatenate(held))
                held, n = [], 0
        if n:
            yield flush(np.concatenate(held))

    return apply


class Classes:
    """Classes of the numbers below n."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def of(self, x: np.ndarray) -> np.ndarray:
        top = self.up[x]
        while not np.array_equal(above := self.up[top], top):
            top = above
        self.up[x] = top
        return top

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.of(a), self.of(b)
        a, b = a[a != b], b[a != b]
        for key in np.unique(a * len(self.up) + b).tolist():
            x, y = divmod(key, len(self.up))
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            self.up[max(x, y)] = min(x, y)


def _compare(fp: np.ndarray, points: np.ndarray, asked: np.ndarray, radius: int, classes: Classes) -> None:
    """Joins the classes of all points and asked ones that link (places in fp); those of the points' largest class are compared with the points of others only."""
    at, rows = 0, max(1, (1 << 12) // len(points))
    while at < len(asked):
        block = asked[at : at + rows]
        own = classes.of(points)
        kind, count = np.unique(own, return_counts=True)
        main = kind[np.argmax(count)]
        inside = classes.of(block) == main
        for some, others in ((block[inside], points[own != main]), (block[~inside], points)):
            if len(some) and len(others):
                x, y = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[others][None, :]) <= radius)
                classes.join(some[x], others[y])
        at += rows
        rows = max(1, min(4 * rows, PAIRS // len(points)))


def linked(fp: np.ndarray, own: int, mask: int, part_radius: int, radius: int) -> np.ndarray:
    """The class (a place) of each fingerprint by links of which one end is among the first `own`, found by a tree over them."""
    classes = Classes(len(fp))
    open_ = [(np.arange(own), np.arange(len(fp)))] if own else []
    while open_:
        points, asked = open_.pop()
        if not len(points) or not len(asked):
            continue
        split = best_split(fp[points], mask, part_radius) if len(points) * len(asked) > 1 << 14 else None
        if split is None:
            _compare(fp, points, asked, radius, classes)
            continue
        v, mu = U64(split[0]), split[1]
        inside, d = distance(fp[points], v, mask) <= mu, distance(fp[asked], v, mask)
        open_ += [(points[inside], asked[d - part_radius <= mu]), (points[~inside], asked[d + part_radius > mu])]
    return classes.of(np.arange(len(fp)))


def _links(cuts: list[int], part_radius: int, radius: int, levels: int):
    def apply(table: pa.Table) -> pa.Table:
        """One shard: a, b: each fingerprint that links, with the first of its class."""
        own, guests = (np.frombuffer(b"".join(table[c].to_pylist()), U64) for c in ("own", "guests"))
        fp = np.concatenate([own, guests])
        found = linked(fp, len(own), cuts[table["shard"][0].as_py() >> levels], part_radius, radius)
        at = np.flatnonzero(found != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[found[at]].view(np.int64)), "b": pa.array(fp[at].view(np.int64))})

    return apply


def links(nodes: DataFrame, radius: int = 4, parts: int = 3, each: int = 8192) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that have the components of all links; `each`: own fingerprints of a shard."""
    n = nodes.count()
    levels = min(LEVELS, max(0, (n // each).bit_length()))
    part_radius, cuts = radius // parts, masks(parts)
    chosen = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < SAMPLE << levels)
    sample = np.asarray(chosen.select("fp").toArrow().column(0), dtype=np.int64).view(U64)
    trees = [upper_tree(sample, mask, part_radius, levels) for mask in cuts]
    dealt = nodes.select("fp").mapInArrow(tidy(_deal(trees, cuts, part_radius, levels)), "shard int, own binary, guests binary")
    return dealt.groupBy("shard").applyInArrow(tidy_group(_links(cuts, part_radius, radius, levels)), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, parts: int = 3, seed: int = 42, each: int = 8192) -> DataFrame:
    """doc_id, fp, component_id: the least id that is reachable by links of `radius` differing bits at most."""
    rows = materialize(fingerprints(df, id_col, text_col, k, seed))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("own")))
    comps = contract(links(nodes, radius, parts, each)).withColumnRenamed("node", "fp")
    grouped = nodes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = grouped.groupBy("comp").agg(F.min("own").alias("component_id"))
    named = grouped.join(least, "comp").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
