"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from strata.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(rows, aims, longest, buckets, seed, least, percent):
    """(id, words, features, weight, score) of each row, and the ranks of those that are drawn."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, longest) for _, t in rows]
    source, target = Counter(bucket(f) for _, x in own for f in x), Counter(bucket(f) for t in aims for f in features(t, longest)[1])
    big_s, big_t = source.total(), target.total()
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (big_s + buckets) / ((source[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for (i, _), (w, x) in zip(rows, own, strict=True):
        weight = sum(gain[bucket(f)] for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, fit[: len(fit) * percent // 100]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (3, 1000, 100)])
def test_against_brute_force(spark, docs, frame, longest, buckets, percent):
    rows = [(r[0], r[1]) for r in [*docs, docs[5]]] + [(None, "null id text here")]
    odd = [(500 + i, t) for i, t in enumerate(["A_b-C 9é!", "\x00 a\x00b", "ÉCOLE école Iİ", "x" * 90_000, "w " * 40_000])]
    aims = [docs[3][1], None, "", docs[40][1], "new words of the target"]
    df = frame.select("doc_id", "text", "score", "node").unionByName(spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, score string, node int"))
    target = spark.createDataFrame([(t, "k") for t in aims], "text string, doc_id string").repartition(2)
    got = importance.resample(df, target, longest=longest, buckets=buckets, seed="7", least_words=3, percent=percent).collect()
    want, best = resampled(rows + odd, aims, longest, buckets, "7", 3, percent)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == [*range(1, len(best) + 1)] and len(best) > 5
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(x[4], x[0]) for x in best]


def test_many_ties_over_many_ranges(spark, tmp_path):
    """Ranks go on over the borders of ranges, and ties are in the order of ids."""
    r = random.Random(2)
    rows = [(i, r.choice([5, 5, 5, 9, -3]), r.random() < 0.8) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, score long, fit boolean").repartition(7).write.parquet(f"{tmp_path}/scored")
    got = importance.drawn(spark.read.parquet(f"{tmp_path}/scored"), importance.F.col("fit"), 40, each=100).collect()
    fit = sorted((x for x in rows if x[2]), key=lambda x: (-x[1], x[0]))
    want = {x[0]: n + 1 for n, x in enumerate(fit[: len(fit) * 40 // 100])}
    assert len(got) == 3000 and {x["doc_id"]: x["rank"] for x in got if x["rank"]} == want


def test_nothing(spark, empty, frame):
    nothing = importance.resample(empty, empty)
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert importance.resample(frame, empty).where("rank is not null").count() > 0
