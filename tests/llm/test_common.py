import numpy as np
from pyspark.sql import functions as F

from conftest import SCHEMA, corpus
from strata.llm import common, jaccard, langid, mixing, packing, textvec


def test_running_sum(spark):
    r = np.random.default_rng(7)
    rows = [("hot" if i % 3 else None, int(k), int(v)) for i, (k, v) in enumerate(zip(r.integers(-(2**63), 2**63 - 1, 400), r.integers(0, 9, 400), strict=True))]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    out = {(x["g"], x["k"]): x["before"] for x in common.running_sum(df, ["g"], "k", "v", "before", buckets=16).collect()}
    for g in ("hot", None):
        total = 0
        for _, k, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1] % 2**64):
            assert out[g, k] == total
            total += v
    assert len(out) == 400


def test_bitmap_has_no_false_negatives(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"))
    bitmap = common.bitmap_of_longs(df, 1 << 16)
    held = np.array([x["h"] for x in df.collect()])
    assert bitmap.has(held.view(np.uint64)).all()
    other = np.array([x["h"] for x in spark.range(10_000, 12_000).select(F.xxhash64("id").alias("h")).collect()])
    assert bitmap.has(other.view(np.uint64)).mean() < 0.05
    clear, some = common.split_by(spark.range(2000), F.xxhash64("id"), bitmap)
    assert clear.where("id < 500").count() == 0 and clear.count() + some.count() == 2000 and some.count() < 560
    assert not common.bitmap_of_longs(df.limit(0)).data.any()


def test_sizes_and_folder(spark, tmp_path):
    df = spark.createDataFrame([("x" * 1000,), (None,)], "t string")
    assert 1000 <= common.input_bytes(df) < 2000 and common.fragments(df, 6, least=4) == 4
    kept = common.materialize(df)
    assert kept.count() == 2 and kept.inputFiles()[0].replace("file://", "").startswith(spark.conf.get("spark.checkpoint.dir"))


def held_by_workers(spark):
    """Of each task: how many tokenizers and tables of powers its Python worker holds, left by tasks before."""

    def count(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._loaded)]), pa.array([len(textvec._cache)])], ["tokenizers", "powers"])

    return [tuple(r) for r in spark.range(16).repartition(16).mapInArrow(count, "tokenizers long, powers long").collect()]


def test_workers_keep_nothing_of_their_tasks(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(8)
    assert packing.pieces(docs, 64, packing.default_tokenizer(), 2).count() > 8
    assert {*held_by_workers(spark)} == {(0, 0)}
    assert jaccard.components(docs).count() > 8
    assert {*held_by_workers(spark)} == {(0, 0)}


def test_small_tables_need_no_python_workers(spark, monkeypatch):
    """A table of Python rows is read by workers of its own ("ExistingRDD"), one by Arrow is in the plan."""
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(2)
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: made.append(create(self, *a, **b)) or made[-1])
    langid.fit(docs, F.lit(True), max_rows=20)
    mixing.mix(docs)
    assert len(made) == 2 and not any("ExistingRDD" in x._jdf.queryExecution().executedPlan().toString() for x in made)
    assert made[1].where("source is null").count() == 1
