"""Search structures against full scans, traversal and trees against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import graphs, index, rank


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * r.normal(size=8)).tolist()) for i in range(900)] + [(900, [0.0] * 8), (None, [1.0] * 8), (901, centres[0].tolist()), (902, centres[0].tolist())]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def test_vector_index(spark, vectors):
    built = index.VectorIndex.build(vectors, "id", "v", lists=20)
    assert built.rows().count() == 902 and built.centres.agg(F.sum("n")).first()[0] == 902
    asked = vectors.where("id % 100 = 0 and id <> 900").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    want = {(r["query_id"], r["rank"]): r["id"] for r in rank.dense_top_each(vectors.where("id is not null and id <> 900"), asked, 7, "id", "v").collect()}
    exact = {(r["query_id"], r["rank"]): r["id"] for r in built.top_each(asked, 7, probes=1, exact=True).collect()}
    assert exact == want and len(want) == 63
    near = {(r["query_id"], r["id"]) for r in built.top_each(asked, 7, probes=4).collect()}
    assert sum((q, i) in near for (q, _), i in want.items()) >= 0.9 * len(want)
    assert 1 <= built.probes_for(0.9, k=7) <= built.probes_for(1.0, k=7) <= 20
    q = vectors.where("id = 300").first()["v"]
    one = built.top(q, 5, probes=20)
    assert [r["id"] for r in one.collect()] == [r["id"] for r in rank.dense_top(vectors.where("id <> 900"), q, 5, "id", "v").collect()]
    plan = built.top(q, 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list#", "list") or "list#" in plan.split("PartitionFilters")[1][:80]


def test_vector_index_of_few(spark, vectors):
    few = index.VectorIndex.build(vectors.where("id < 2"), "id", "v")
    assert [r["id"] for r in few.top(vectors.where("id = 1").first()["v"], 5).collect()] == [1, 0]
    none = index.VectorIndex.build(vectors.where("id < 0"), "id", "v")
    asked = vectors.where("id = 1").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    assert none.top([1.0] * 8).count() == 0 and none.top_each(asked, 3, exact=True).count() == 0


def test_postings(spark):
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "user-id", "rare", "the"]
    rows = [(i, " ".join(r.choices(words, [9, 5, 3, 2, 0.05, 20], k=r.randint(0, 40)))) for i in range(400)] + [(400, None), (None, "alpha rare"), (401, "rare rare rare")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    built = index.Postings.build(df, "id", "t", buckets=8)
    for query, k in (("alpha", 10), ("alpha beta rare", 5), ("user-id gamma", 500), ("rare", 1), ("nothing here", 5), ("", 5), ("rare alpha beta gamma user", 20)):
        want = [(x["id"], round(x["score"], 6)) for x in rank.lexical_top(df.where("id is not null"), query, k, "id", "t").collect()]
        assert [(x["id"], round(x["score"], 6)) for x in built.top(query, k).collect()] == want, query
    read, skipped = built.plan(["alpha", "rare"], 3)
    assert read and set(read) | set(skipped) == {"alpha", "rare"}
    assert "bucket#" in built.top("alpha rare", 5)._jdf.queryExecution().toString().split("PartitionFilters")[1][:120]


def test_lists_of_small_terms_are_only_asked_about(spark):
    rows = [(i, "big " * 9) for i in range(20)] + [(100 + i, "small") for i in range(50)] + [(5, "small")]
    built = index.Postings.build(spark.createDataFrame(rows, "id long, t string"), "id", "t", buckets=2)
    assert built.plan(["big", "small"], 10) == (["big"], ["small"])
    assert [(r["id"], round(r["score"], 6)) for r in built.top(["big", "small"], 3).collect()] == [(5, 1.0), (0, 0.9), (1, 0.9)]


@pytest.mark.parametrize("most", [None, 2])
def test_reach(spark, most):
    r = random.Random(7)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(150)] + [(None, 3), (4, None), (7, 7)] + [(200 + i, 201 + i) for i in range(30)] + [(230, 200)]
    seeds = [1, 2, 200, 999, None]
    dist, wave, step = {s: 0 for s in seeds if s is not None}, [s for s in seeds if s is not None], 0
    while wave and (most is None or step < most):
        step += 1
        wave = sorted({b for a, b in edges if a in wave and b is not None} - set(dist))
        dist |= {n: step for n in wave}
    got = graphs.reach(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in seeds], "node int"), most=most)
    assert {x["node"]: x["distance"] for x in got.collect()} == dist and (most or max(dist.values()) == 30)


def nested(nodes):
    by = {}
    known = {i for i, *_ in nodes}
    for i, p, order, title in sorted(nodes, key=lambda x: (x[2], x[0])):
        by.setdefault(p if p in known else None, []).append((i, title))

    def below(p):
        return [{k: v for k, v in (("id", i), ("title", t)) if v is not None} | {"children": below(i)} for i, t in by.get(p, [])]

    return below(None)


def test_trees_of_any_depth(spark):
    r = random.Random(9)
    nodes = [(f"n{i}", f"n{r.randrange(i)}" if i > 3 else None, r.randrange(5), None if i % 9 == 0 else f't"{i}') for i in range(200)]
    chain = [(f"c{i}", f"c{i - 1}" if i else "gone", 0, "x") for i in range(70)]
    wide = [("w", None, 0, "w")] + [(f"w{i:03}", "w", 0, "k") for i in range(130)]
    cycle = [("y", "z", 0, "y"), ("z", "y", 0, "z"), ("below", "z", 0, "b"), ("self", "self", 0, "s")]
    rows = [("a", *x) for x in nodes] + [("b", *x) for x in chain + wide] + [("c", *x) for x in cycle]
    df = spark.createDataFrame(rows, "tree string, id string, parent_id string, o int, title string").repartition(3)
    got = {x["tree"]: (json.loads(x["json"]), x["nodes"]) for x in graphs.nested_json(df, "tree", ["id", "title"], ["o"]).collect()}
    assert got == {"a": (nested(nodes), 200), "b": (nested(chain + wide), 201)}
    assert graphs.nested_json(df.limit(0), "tree", ["id"], ["o"]).count() == 0
