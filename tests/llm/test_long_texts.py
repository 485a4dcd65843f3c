"""Texts of a hundred thousand words and more, through the joins and each stage of the pipeline."""

import random

import corpus_pipeline as pipeline
from conftest import words
from strata.llm import jaccard, mixing, substring
from test_joins import components, removed

N = 120_000


def long_text(seed, n=N):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(50_000)}" for _ in range(n))


def edited(text, every=40):
    return " ".join(f"v{i}" if i % every == 0 else w for i, w in enumerate(text.split(" ")))


def table(spark):
    first, other = long_text(1), long_text(2)
    rows = [
        (1, first, "en", "a"), (2, edited(first), "en", "a"), (3, other + " write to joe@mail.com", None, "b"), (4, "a short english text of eight words here", "en", "b"),
        (5, "x" * 500_000, "en", "c"), (6, None, "en", "c"), (7, "1" * 300_000, None, None),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3), rows


def test_joins_of_long_texts(spark):
    df, rows = table(spark)
    texts = [r[:2] for r in rows]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect()} == components(texts)
    # two long texts that share a passage of 50,000 words, at different places
    shared = long_text(3, 50_000)
    texts = [(1, shared + " " + long_text(4)), (2, long_text(5) + " " + shared), (3, "clean words")]
    got = substring.deduplicate(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == removed(texts)
    assert sum(r["n_removed"] for r in got) == 100_000


def test_mixing_of_long_texts(spark):
    df, rows = table(spark)
    taken, _ = mixing.mix(df)
    out = {r["doc_id"]: r for r in taken.collect()}
    assert {i: out[i]["size"] for i, *_ in rows} == {i: len(words(t)) for i, t, *_ in rows}
    assert all(r["taken"] <= 3 * r["size"] for r in out.values())


def test_stages_on_long_texts(spark):
    df, rows = table(spark)
    texts = {r[0]: r[1] for r in rows}
    stage = dict(pipeline.STAGES)
    kept = {r["doc_id"]: r for r in stage["language_id"](spark, df, "").collect()}
    assert sorted(kept) == [1, 2, 3, 4, 5] and all(kept[i]["text"] == texts[i] and kept[i]["lang"] for i in kept)
    one = {r["doc_id"]: r["text"] for r in stage["near_duplicates"](spark, df, "").collect()}
    assert sorted(one) == [1, 3, 4, 5, 6, 7] and all(one[i] == texts[i] for i in one)
    clean = {r["doc_id"]: r for r in stage["pii"](spark, df, "").collect()}
    assert clean[3]["text"] == texts[3].replace("joe@mail.com", "[email]") and clean[3]["n_chars"] == len(clean[3]["text"])
    assert all(clean[i]["text"] == texts[i] for i in texts if i != 3)
    mixed = stage["source_mixing"](spark, df, "").collect()
    assert mixed and all(r["text"] == texts[r["doc_id"]] for r in mixed)
    pieces = {}
    for r in stage["packing"](spark, df, "").collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for own in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and length <= 1024
            at += length
    assert sorted(pieces) == sorted(texts) and len(pieces[1]) > N // 1024
