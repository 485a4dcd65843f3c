"""Importance resampling towards a target's distribution of hashed n-grams.

Each task counts its rows' features in an in-process DuckDB, batch by batch: SQL unnests
the words of the lower-cased texts (A-Z only), windows make n-grams of them, and a
registered zlib function gives the bucket (crc32 modulo `buckets`) of each distinct n-gram
of a batch. The features' buckets of each row and, once a task, the counts of all buckets are
spilled to Parquet in the shared folder; Spark merges the counts, makes the gain of
each bucket and scores each row by its mean gain and Gumbel noise of its id.

The rows drawn are those with the highest scores. They are found without sorting the
rest: a histogram of 1024 bars tells the bar in which the last one falls, and only rows from
there up are dealt by ranges of (score, id) and numbered range by range.

Rows without words (null and empty texts) have no features and weight 0 and are not drawn.
Null ids count as empty in the noise and come last among equal scores. Rows that repeat an
id are scored and ranked one by one. Other columns are ignored. An empty table gives an
empty result; an empty target has counts of 0. A batch of texts is held at a time, and
the gains (`buckets` numbers).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import materialize
from strata.llm.textvec import tidy

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Bars of the histogram that the last score drawn is looked up in.
BARS = 1024


def _grams_sql(longest: int) -> str:
    """SQL: i, f, one (whether it is a single word) of all n-grams of 1 to `longest` words of the batch."""
    lists = f"SELECT i, regexp_extract_all({LOWER}, '{WORD}') AS w FROM batch"
    if longest == 1:
        return f"SELECT i, unnest(w) AS f, true AS one FROM ({lists})"
    ahead = ", ".join(f"lead(f, {k}) OVER (PARTITION BY i ORDER BY pos) AS w{k}" for k in range(longest))
    runs = [f"SELECT i, concat_ws(' ', {', '.join(f'w{k}' for k in range(n))}) AS f, {n} = 1 AS one FROM ahead WHERE w{n - 1} IS NOT NULL" for n in range(1, longest + 1)]
    return f"WITH words AS (SELECT i, generate_subscripts(w, 1) AS pos, unnest(w) AS f FROM ({lists})), ahead AS (SELECT i, {ahead} FROM words) {' UNION ALL '.join(runs)}"


def _count(longest: int, buckets: int):
    """doc_id, text -> doc_id, n_words, features; and a last row of each task with the counts of its buckets."""

    def crc(texts) -> pa.Array:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        return pa.array(np.fromiter((zlib.crc32(x) % buckets for x in texts.cast(pa.binary()).to_pylist()), np.int32, len(texts)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        pair = pa.struct([("bucket", pa.int32()), ("n", pa.int64())])
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            con.create_function("bucket", crc, ["VARCHAR"], "INTEGER", type="arrow")
            con.sql("CREATE TABLE counts (bucket INTEGER, n BIGINT)")
            schema = None
            for b in batches:
                schema, n = b.schema.field(0), len(b)
                con.register("batch", pa.table({"i": pa.array(np.arange(n)), "text": b.column(1)}))
                con.sql(f"CREATE OR REPLACE TEMP TABLE grams AS {_grams_sql(longest)}")
                con.sql("CREATE OR REPLACE TEMP TABLE keys AS SELECT f, bucket(f) AS bucket FROM (SELECT DISTINCT f FROM grams)")
                con.sql("CREATE OR REPLACE TEMP TABLE features AS SELECT i, bucket, one FROM grams JOIN keys USING (f)")
                con.sql("INSERT INTO counts SELECT bucket, count(*) FROM features GROUP BY bucket")
                con.sql("CREATE OR REPLACE TABLE counts AS SELECT bucket, sum(n)::BIGINT AS n FROM counts GROUP BY bucket")
                found = con.sql("SELECT i, bucket, one FROM features").to_arrow_table()
                con.unregister("batch")
                i, bucket, one = (found[c].to_numpy() for c in ("i", "bucket", "one"))
                order = np.argsort(i, kind="stable")
                cuts = np.searchsorted(i[order], np.arange(n + 1))
                words = np.bincount(i[one], minlength=n)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bucket[order], pa.int32())), pa.nulls(n, pa.list_(pair))], ["doc_id", "n_words", "features", "counts"])
            if schema is not None:
                held = con.sql("SELECT bucket, n FROM counts ORDER BY bucket").to_arrow_table()
                own = pa.StructArray.from_arrays([held["bucket"].combine_chunks(), held["n"].combine_chunks()], fields=list(pair))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["doc_id", "n_words", "features", "counts"])

    return apply


def features(df: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, features: the bucket of each; bucket, n over all rows)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    spilled = materialize(rows.mapInArrow(tidy(_count(longest, buckets)), f"doc_id {kind}, n_words long, features array<int>, counts array<struct<bucket: int, n: long>>"))
    counts = spilled.where("counts is not null").select(F.inline("counts")).groupBy("bucket").agg(F.sum("n").alias("n"))
    return spilled.where("counts is null").select("doc_id", "n_words", "features"), counts


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths: log of its smoothed share of the target over that of the source (`buckets` numbers, collected)."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    total_s, total_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (source, target))
    up = (F.col("t") + 1).cast("double") * F.lit(float(total_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total_t + buckets))
    out = np.zeros(buckets, np.int64)
    for row in both.select("bucket", F.floor(F.lit(1000) * F.log(up / down)).alias("gain")).collect():
        out[row["bucket"]] = row["gain"]
    return out


def _weigh(gain: np.ndarray):
    """doc_id, n_words, features -> doc_id, n_words, n_features, weight: the floored mean of the features' gains."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            first = np.asarray(lists.offsets).astype(np.int64)
            sums = np.r_[0, np.cumsum(gain[np.asarray(lists.values)[first[0] : first[-1]]])]
            n = np.diff(first)
            total = sums[first[1:] - first[0]] - sums[first[:-1] - first[0]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0), pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return apply


def gumbel(seed: str, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from 32 bits of the sha256 of `seed:id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, eligible: Column, percent: int, each: int = 200_000) -> DataFrame:
    """`scored` (a written table with doc_id and score) with rank: 1, 2, 3 ... of the highest floor(percent / 100) of the eligible rows by (score down, doc_id up); the others null."""
    own = scored.where(eligible)
    low, high, n = own.agg(F.min("score"), F.max("score"), F.count("*")).first()
    take = n * percent // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not take:
        return none
    width = -(-(high - low + 1) // BARS)
    bar = F.floor((F.col("score") - low) / width)
    above, cut = 0, low
    for row in sorted(own.groupBy(bar.alias("bar")).count().collect(), key=lambda r: -r["bar"]):  # BARS rows at most
        above, cut = above + row["count"], low + row["bar"] * width
        if above >= take:
            break
    top = eligible & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.where(top).repartitionByRange(-(-above // each), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row for each range
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = dealt.withColumn("_part", part).join(sizes, "_part").withColumn("rank", F.when(rank <= take, rank))
    return ranked.select(*none.columns).unionByName(none.where(~top))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: `percent` of the rows of `least_words` or more are drawn, as the target's features weigh them."""
    rows, counts = features(df, id_col, text_col, longest, buckets)
    aim = features(target.select(F.lit(0).alias("_one"), F.col(target_col)), "_one", target_col, longest, buckets)[1]
    kind = rows.schema[0].dataType.simpleString()
    weighed = rows.mapInArrow(tidy(_weigh(gains(counts, aim, buckets))), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
    return drawn(scored, F.col("n_words") >= least_words, percent)
