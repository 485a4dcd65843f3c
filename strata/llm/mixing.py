"""Mixing sources to target weights by a low-discrepancy schedule.

Sources weigh 5, 2, 1, repeating, by code point order (null last) and share the words of
the whole corpus; a target is at most `most` times its source, and the excess is shared
again. The mix is a run of equal slots, as many as it takes to hold the corpus. The point of
each slot in a van der Corput sequence, mapped through the cumulative targets, names its
source; any stretch of slots has each source about as often as its target says, and so does
the whole (but for a few slots, at most about the logarithm of their number, which is 65,536
or more unless the corpus has fewer words).

Each source's documents, shuffled by a hash of their id, form one line of words that is cut
into blocks of a slot's size and starts anew when used up. A slot's rank among its source's
slots names the block that it takes; what no slot names isn't taken, nor is a
document more than `most` times. Ranks have a closed form, so that no task ever sees a
source as a whole.

Null texts have size 0 and are taken 0 times. A null source is a source of its own. Rows
that repeat an id are placed one by one. An empty table gives an empty result. The
table of sources (one row for each) is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import materialize, running_sum, small_table
from strata.llm.textvec import slices, tidy

WEIGHTS = (5, 2, 1)


def word_counts(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """The id, the kept columns and `size`, the number of words of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.zeros(len(b), dtype=np.int64)
            for i, j, words in slices(b.column(len(keep) + 1), lower=False):
                size[i:j] = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size)], [*b.schema.names[:-1], "size"])

    rows = df.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(count), f"{kinds}size long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> dict[str | None, float]:
    """Each source's target of words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    total, active = float(sum(sizes.values())), list(order)
    while active:
        share = (total - sum(out.values())) / sum(weight[s] for s in active)
        above = [s for s in active if share * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: share * weight[s] for s in active}
        out |= {s: float(most * sizes[s]) for s in above}
        active = [s for s in active if s not in out]
    return out


def reverse_bits(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(x)
    for j in range(bits):
        out |= ((x >> j) & 1) << (bits - 1 - j)
    return out


def points_below(n: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """How many of the first n van der Corput points, times 2^bits, are below c."""
    out = np.zeros_like(n)
    for j in range(bits + 1):
        has = (n >> j) & 1 == 1
        fixed = reverse_bits((n >> (j + 1)) << (j + 1), bits)
        step = bits - j
        out += np.where(has, np.clip(-((fixed - c) >> step), 0, 1 << j), 0)
    return out


def cumulative(targets_: list[float], bits: int) -> np.ndarray:
    """The cumulative shares of the targets, times 2^bits."""
    total = sum(targets_)
    sums = np.concatenate([[0.0], np.cumsum(np.array(targets_, dtype=float))])
    edges = np.round(sums / total * (1 << bits)).astype(np.int64) if total else np.zeros(len(sums), np.int64)
    edges[-1] = (1 << bits) if total else 0
    return edges


def bits_of(slots: int) -> int:
    """Bits of the points: as many as tell the slots and, for fine shares, 32 at least."""
    return max(32, slots.bit_length())


def schedule(spark: SparkSession, targets_: list[float], slots: int) -> DataFrame:
    """slot, source_no (an index into the targets), rank: the source that each of the first `slots` points names, and how many slots before name it too."""
    bits = bits_of(slots)
    edges = cumulative(targets_, bits)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(0)).astype(np.int64)
            source = np.searchsorted(edges, reverse_bits(n, bits), "right") - 1
            rank = points_below(n, edges[source + 1], bits) - points_below(n, edges[source], bits)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(source.astype(np.int32)), pa.array(rank)], ["slot", "source_no", "rank"])

    return spark.range(slots if edges[-1] else 0).mapInArrow(tidy(name), "slot long, source_no int, rank long")


def slots_of(targets_: list[float], slots: int) -> list[int]:
    """How many of the slots name each source."""
    bits = bits_of(slots)
    edges = cumulative(targets_, bits)
    below = points_below(np.full(len(edges), slots, np.int64), edges, bits)
    return np.diff(below).tolist()


def mix(df: DataFrame, block_words: int = 1024, least_slots: int = 1 << 16, most: int = 3, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, uses).

    documents: doc_id, source, size, source_size, target, taken, first_slot (the first slot
    that takes of it; null if none does). uses: slot, doc_id, from_word, to_word, one row for
    each part of a document that a slot's block holds. A slot has `block_words` words, or
    fewer, so that there are `least_slots`. buckets: into how many a source's line is cut to be
    added up, by default one for each 200,000 rows and 256 at least.
    """
    spark = df.sparkSession
    sized = materialize(word_counts(df, id_col, text_col, source_col).withColumnRenamed(source_col, "source"))
    held = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    sizes = {r["source"]: r["n"] for r in held}
    aim = targets(sizes, weights, most)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims, total = [aim[s] for s in order], sum(sizes.values())
    block = max(1, min(block_words, total // least_slots))
    slots = -(-total // block)
    named = slots_of(aims, slots)
    kind = sized.schema["source"].dataType.simpleString()
    columns = {"source": order, "source_no": [*range(len(order))], "source_size": [sizes[s] for s in order], "target": [float(aim[s]) for s in order], "words": [named[i] * block for i in range(len(order))]}
    table = small_table(spark, columns, f"source {kind}, source_no int, source_size long, target double, words long")
    docs = sized.join(table, sized["source"].eqNullSafe(table["source"])).drop(table["source"])
    buckets = buckets or max(256, sum(r["rows"] for r in held) // 200_000)
    docs = running_sum(docs.withColumn("_key", F.xxhash64("doc_id", "size", F.lit(seed))), ["source_no"], "_key", "size", "start", buckets).withColumn("_row", F.xxhash64("_key", "start"))
    docs = materialize(docs.drop("_key"))
    lap = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("lap")
    lines = docs.where("size > 0").select("doc_id", "_row", "source_no", "source_size", "size", "start", "words", lap)
    # what lies beyond the words of the source's slots could meet none of them
    lines = lines.withColumn("lo", F.expr("start + lap * source_size")).withColumn("hi", F.expr("least(lo + size, words)")).where("lo < hi")
    blocks = lines.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    blocks = blocks.withColumn("from_word", F.expr(f"greatest(lo, rank * {block}) - lo")).withColumn("to_word", F.expr(f"least(hi, (rank + 1) * {block}) - lo"))
    uses = blocks.join(schedule(spark, aims, slots), ["source_no", "rank"]).select("slot", "doc_id", "_row", "from_word", "to_word")
    taken = uses.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    out = docs.join(taken, "_row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")
    return out, uses.drop("_row")
