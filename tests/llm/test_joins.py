"""Jaccard components, repeated passages and connected components against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from conftest import corpus, lowered, words
from strata.llm import graph, jaccard, substring
from strata.llm import textvec as tv


def shingles(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    least = {i: i for i, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard_against_brute_force(frame, docs):
    want = components([(r[0], r[1]) for r in docs])
    got = jaccard.components(frame).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        assert r["doc_id"] is None or (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert sum(want[i][1] != i for i in want) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_in_groups_of_near_copies(spark, seed):
    import random

    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(150)] = f"v{r.randrange(30)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.components(df, rounds=1).collect()} == components(rows)


def test_jaccard_of_nothing(empty):
    assert jaccard.components(empty).count() == 0


def test_contract(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))]
    rows = {x["node"]: x["comp"] for x in graph.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {n: c for n, c in least.items() if any(n in e and e[0] != e[1] for e in edges)} == rows
    assert graph.contract(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "stairs"])
def test_contract_of_long_chains(spark, shape):
    """Hooks are followed four steps a round only; longer chains take more rounds."""
    order = np.random.default_rng(4).permutation(60)
    edges = {"path": list(zip(range(59), range(1, 60), strict=True)), "star": [(59, i) for i in range(59)], "stairs": list(zip(order[:-1].tolist(), order[1:].tolist(), strict=True))}[shape]
    rows = graph.contract(spark.createDataFrame([*edges, *edges, (100, 101)], "a long, b long")).collect()
    assert {x["node"]: x["comp"] for x in rows} == {i: 0 for i in range(60)} | {100: 100, 101: 100} and len(rows) == 62


def removed(rows, size=35):
    found = Counter(tuple(w[i : i + size]) for _, t in rows for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if found[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_against_brute_force(frame):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(frame).collect()), key=str)
    assert got == removed(rows) and sum(r[2] for r in got) > 300


def test_substrings_small_windows(spark, empty):
    rows = [(r[0], r[1]) for r in corpus(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(df, size=6, gram=2).collect()), key=str)
    assert got == removed(rows, 6)
    assert substring.deduplicate(empty).count() == 0


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["", "a  b\tc", None, "é x y\n", "a", " "]
    (_, _, w), = tv.slices(pa.array(texts), lower=False)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    h = w.hashes()
    assert h[0] == h[-1] and len(set(h.tolist())) == 5
    assert tv.runs(np.array([0, 3, 3, 5]), 2).tolist() == [0, 1, 3]
    long = pa.array([t * 4000 for t in ("ab c ", "x y z ")])
    assert [np.diff(x.first).tolist() for _, _, x in tv.slices(long, lower=True)] == [[8000, 12000]]
