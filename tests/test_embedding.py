"""Embedders: a model for each task, and the fitted one against plain sums."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from strata.operators import embedding
from strata.plans import hierarchy


def test_model_is_loaded_once_in_a_task(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts])

    df = spark.createDataFrame([(i, None if i == 7 else "a" * i) for i in range(50)], "i int, t string").coalesce(2)
    rows = {r["i"]: r["v"] for r in df.select("i", embedding.by_model(load, batch=8, normalised=False)(F.col("t")).alias("v")).collect()}
    assert rows[7] == [0.0, 0.0, 1.0] and rows[20] == [20.0, 20.0, 1.0]
    assert len(list(tmp_path.iterdir())) <= 2
    unit = df.select(embedding.by_model(load)(F.col("t")).alias("v")).collect()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-6 for r in unit)


def test_fitted_model(spark):
    texts = ["the red fox", "the blue fox, the end", "", None, "Red RED é_1"]
    df = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    model = embedding.HashedModel.fit(df, "t", buckets=50, size=7, longest=2)
    embed = model.embedder()
    split = [embedding_words(t) for t in texts]
    had = [{zlib.crc32(x.encode()) % 50 for x in w} for w in split]
    weights = [math.log(6) - math.log(1 + sum(b in h for h in had)) for b in range(50)]
    assert np.allclose(model.weights, weights)
    for r in df.select("i", embed(F.col("t")).alias("v")).collect():
        want = np.zeros(7)
        for x in split[r["i"]]:
            b = zlib.crc32(x.encode()) % 50
            want[b % 7] += weights[b] * (1 if b // 7 % 2 == 0 else -1)
        norm = np.linalg.norm(want)
        assert np.allclose(r["v"], want / norm if norm else want, atol=1e-6)


def embedding_words(text):
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def test_ingest_by_a_fitted_model(spark):
    records = hierarchy.records_of(spark, [("a", "# A\nred fox", {}, "wiki", 1), ("b", "# B\nblue whale", {}, "wiki", 1)])
    embed = embedding.HashedModel.fit(records, "content", buckets=64, size=16).embedder()
    built = hierarchy.build(records, embed=embed)
    assert {len(r["vector"]) for r in built.l3_vectors.collect()} == {16}
