"""Each stage of the pipeline on its own input, and the whole run."""

import pytest

import corpus_pipeline as pipeline
from conftest import SCHEMA, corpus, words
from strata.llm import mixing
from test_joins import components

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = corpus(11)
    rows += [rows[4], (900, "write to a@b.co or +1 (988) 555-2485 now", "en", "s1", 40), (901, "plain words of no harm", "en", "s2", 22)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The table before each stage and after the last, by name."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before.collect(), after.collect(), after.columns) for name, before, after in out}


def test_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "pii", "source_mixing", "packing"]
    assert all(columns == NAMES for name, (_, _, columns) in stages.items() if name != "packing")


def test_language_stage(stages):
    before, after, _ = stages["language_id"]
    want = sorted((r["doc_id"], r["text"]) for r in before if any(c.isalpha() for c in r["text"] or ""))
    assert sorted((r["doc_id"], r["text"]) for r in after) == want and all(r["lang"] for r in after)
    assert len(after) < len(before)


def test_near_duplicate_stage(stages):
    before, after, _ = stages["near_duplicates"]
    comps = components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in comps.items() if i == c)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after) and len(after) < len(before)


def test_personal_data_stage(stages):
    before, after, _ = stages["pii"]
    assert len(before) == len(after)
    held = {r["doc_id"]: r for r in after}
    assert held[900]["text"] == "write to [email] or [phone] now" and held[900]["n_chars"] == len(held[900]["text"])
    assert all(held[r["doc_id"]]["text"] == r["text"] for r in before if r["doc_id"] != 900)


def test_mixing_stage(stages):
    before, after, _ = stages["source_mixing"]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    copies = {}
    for r in after:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    for s, target in mixing.targets(sizes).items():
        own = [i for i in copies if source[i] == s]
        used = sum(copies[i] * size[i] for i in own)
        longest = max((size[i] for i in own), default=0)
        slack = 16  # the schedule may give a source a few slots, of a word each here, more or fewer
        assert target - slack <= used <= target + 2 * longest + slack


def test_packing_stage(stages, spark, folder):
    before, after, _ = stages["packing"]
    assert len({r["doc_id"] for r in before}) == len({r["doc_id"] for r in after}) and max(r["offset"] + r["length"] for r in after) <= 1024
    whole = pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, after))


def test_odd_rows_and_columns_that_clash(spark):
    """Null ids, nulls in all columns, repeated rows; and further columns named as those that the stages and operators use."""
    own = ["key", "uses", "use", "goes", "place", "text_hash", "row_hash", "predicted", "score", "_row", "_text", "_split", "_key", "_i", "_h", "_n", "_uses", "size", "n", "row", "node", "component_id", "source_no", "Goes_"]
    rows = [(*r, *[1] * len(own)) for r in [*corpus(12)[::3], (None, "a null id and a few words", "en", "s1", 25), (None, None, None, None, None), (None, "a null id and a few words", "en", "s1", 25)]]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} int" for c in own)).repartition(3)
    for name, stage in pipeline.STAGES:
        after = pipeline.materialize(stage(spark, docs, ""))
        assert after.columns == docs.columns or name == "packing"
        assert after.count() > 0
        if name == "near_duplicates":
            assert [r["text"] for r in after.where("doc_id is null").collect()] == ["a null id and a few words"]
        docs = after


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
