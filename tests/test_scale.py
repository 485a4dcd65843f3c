"""How the work of queries is laid out, where results alone don't tell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata import store_queries
from strata.operators import index, nearest, rank
from strata.plans import hierarchy, service
from strata.sources.store import Store

SF = "/root/testdata/sf0.001"


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_are_made_once_and_spread(spark):
    found = store_queries.protected_spans(spark, SF)
    assert optimised(found).count("1. See v") == 1
    assert found.rdd.getNumPartitions() > 1
    assert found.columns == ["p_partkey", "start", "span", "restored"]


def test_queries_are_multiplied_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    whole = r.normal(size=(120, 6)).tolist()
    rows = spark.createDataFrame([(i, whole[i % 100] if i != 50 else None) for i in range(120)] + [(200, [0.0] * 6)], "id long, v array<double>").repartition(3)
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    score = rank.cosine(F.col("v"), F.col("query_vector"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    plain = rows.crossJoin(asked).select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    want = sorted(map(repr, plain.collect()))
    found = rank.dense_top_each(rows, asked, 5, "id", "v")
    assert "CartesianProduct" not in str(found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, found.collect())) == want
    monkeypatch.setattr(nearest, "ROWS", 7)
    monkeypatch.setattr(rank, "BLOCK", 4)
    assert sorted(map(repr, rank.dense_top_each(rows, asked, 5, "id", "v").collect())) == want


def test_lists_are_not_paired_with_queries_by_a_join(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)], "id long, v array<double>")
    built = index.VectorIndex.build(rows, "id", "v", lists=9)
    asked = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    assert "Join" not in built.top_each(asked, 4, probes=2)._jdf.queryExecution().optimizedPlan().toString()
    want = {(r["query_id"], r["rank"], r["id"]) for r in rank.dense_top_each(rows, asked, 4, "id", "v").collect()}
    got = {(r["query_id"], r["rank"]) for r in built.top_each(asked, 4, probes=1, exact=True).collect()}
    assert got == {(q, n) for q, n, _ in want}


def test_nothing_is_built_when_nothing_is_new(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    records = hierarchy.records_of(spark, [("a", "# A\nOne. Two.", {}, "wiki", 1), ("b", "x", {}, "none", 1)])
    used = []
    registry = hierarchy.Registry()
    for name, chunker in list(registry.chunkers.items()):
        registry.register(name, lambda rows, name=name, chunker=chunker: used.append(name) or chunker(rows))
    assert service.ingest_records(store, records, registry) == {"written": 1, "skipped": 0, "failed": 1}
    assert used == ["wiki"] and store.read("l3").count() == 3
    monkeypatch.setattr(hierarchy, "build_fresh", None)
    assert service.ingest_records(store, records, registry) == {"written": 0, "skipped": 1, "failed": 1}


def test_atoms_are_numbered_in_place_and_held_without_ids(spark):
    rows = [("a", "c1", "s", "heading", "# H\n\nOne. Two.\n \nOne. Three."), ("a", "c2", "t", "code", "x = 1\n\ny = 2")]
    chunks = spark.createDataFrame(rows, "l1_id string, l2_id string, section_id string, section_type string, text string").withColumns({"source_type": F.lit("md"), "metadata": F.lit("{}")})
    atoms = hierarchy.atoms_of(chunks).unionByName(hierarchy.code_atoms_of(chunks))
    assert "Window" not in optimised(hierarchy.atoms_of(chunks)) and "l3_id" not in atoms.columns
    found = hierarchy.identified(atoms).orderBy("l2_id", "sort_order").collect()
    assert [r["sort_order"] for r in found if r["l2_id"] == "c1"] == [0, *range(1000, 1000 * sum(r["l2_id"] == "c1" for r in found), 1000)]
    for before, r in zip([None, *found], found):
        first = before is None or before["l2_id"] != r["l2_id"]
        assert r["parent_id"] == (None if first else before["l3_id"])


def test_known_records_need_no_join(spark):
    records = hierarchy.records_of(spark, [("a", "# A\n\nx.", {}, "wiki", 1), ("b", "y", {}, "nope", 1)])
    built = hierarchy.build(records)
    assert "LeftAnti" not in optimised(built.documents)
    assert built.documents.count() == built.failures.count() == 1
