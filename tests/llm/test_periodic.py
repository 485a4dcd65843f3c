"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import pytest

from conftest import words
from strata.llm import periodic
from strata.llm.queries import op11_periodic_runs


def runs(w, least=24, exponent=3):
    """Each stretch in which words p apart are equal, by its least p."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i:
                if j + p - i >= max(least, exponent * p):
                    found.setdefault((i, j + p), p)
                i = j
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " \t\n", "a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h " * 3, "a b c d e f g h i " * 3 + "a b", "x " * 500 + "y " + "x " * 400, "é " * 3000]
    for _ in range(120):
        letters = "abc"[: r.randint(1, 3)]
        w = []
        for _ in range(r.randint(1, 6)):
            block = [r.choice(letters) for _ in range(r.randint(1, 9))]
            w += block * r.randint(1, 9) + [r.choice(letters) for _ in range(r.randint(0, 5))]
        if r.random() < 0.3:
            w = (w[:20] + ["q"]) * r.randint(2, 5) + w
        out.append((" " if r.random() < 0.5 else "\n\t").join(w))
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join(bin(i).count("1") % 2 and "a" or "b" for i in range(512))]


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (12, 4)])
def test_runs_against_brute_force(spark, least, exponent):
    made = texts(least)
    df = spark.createDataFrame([(i if i != 5 else None, t, "x", 1) for i, t in enumerate(made)] * 2, "doc_id long, text string, runs string, start int").repartition(3)
    want = [(i if i != 5 else None, len(words(t)), (f := runs(words(t), least, exponent)), collapsed(words(t), f)) for i, t in enumerate(made)] * 2
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in periodic.periodic_runs(df, least=least, exponent=exponent).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(bool(f) for _, _, f, _ in want) > 40


def test_long_text(spark):
    r = random.Random(1)
    w = [r.choice("abcdefghij") for _ in range(60_000)] + [str(i) for i in range(9000)] * 4 + ["z"] * 70_000
    found = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(x) for x in found["runs"]] == [(60_000, 36_000, 9000), (96_000, 70_000, 1)] and found["n_words"] == len(w)


def test_nothing(spark, empty):
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, exponent=1)


def test_query(spark, docs, tmp_path):
    rows = [(i + 1, t) for i, t in enumerate([x[1] for x in docs] * 4)] + [(None, "a b " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    hit = 0
    for i, t in rows:
        w, h = words(t), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        f = runs(w)
        best = min(f, key=lambda x: (-(x[1] / x[2]), x[0], x[2]), default=None)
        hit += bool(f)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in f)
        assert got[i] == {"doc_id": i, "n_runs": len(f), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(w, f).encode()).hexdigest()}
    assert hit > 10
