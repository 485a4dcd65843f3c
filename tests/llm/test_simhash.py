"""SimHash classes against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from conftest import lowered
from strata.llm import simhash
from strata.llm.queries import op13_simhash_near_dedup


def fingerprint(text, k=4):
    w = lowered(text)
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, radius):
    """The least id that each (id, number) reaches; null ids count last."""
    fp = sorted({f for _, f in rows})
    top = {f: f for f in fp}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(fp):
        for y in fp[:i]:
            if (x ^ y).bit_count() <= radius:
                top[find(x)] = find(y)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f, least.get(find(f))) for i, f in rows]


def family(seed, n):
    """Random numbers, and families with a few changed bits in chains, balls and in one stretch of bits only."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)] + [0, 0, 2**64 - 1]
    for bits in (range(64), range(64), range(3), range(20, 30)):
        base = r.getrandbits(64)
        for _ in range(n):
            x = base
            for b in r.sample(list(bits), r.randint(0, min(len(bits), 6))):
                x ^= 1 << b
            out.append(x)
    chain = r.getrandbits(64)
    for i in range(40):
        out.append(chain := chain ^ sum(1 << b for b in r.sample(range(64), 4)))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("radius,parts,each", [(4, 3, 8192), (4, 3, 40), (4, 1, 60), (0, 1, 100), (7, 2, 100), (3, 4, 30)])
def test_links_against_brute_force(spark, radius, parts, each):
    rows = family(radius * 10 + parts, 300)
    want = classes(rows, radius)
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in {f for _, f in rows}], "fp long").repartition(5)
    comps = {r["node"]: r["comp"] for r in simhash.contract(simhash.links(nodes, radius, parts, each)).collect()}
    signed = {f: int(np.uint64(f).astype(np.int64)) for _, f in rows}
    got = {}
    for i, f in rows:
        c = comps.get(signed[f], signed[f])
        got[c] = min(got.get(c, i), i)
    assert [(i, f, got[comps.get(signed[f], signed[f])]) for i, f in rows] == want
    assert len({c for *_, c in want}) < len({f for _, f in rows}) or not radius


def test_tree_parts_points_and_prunes():
    """Most pairs of random numbers are not compared, and pairs within the radius meet once at least."""
    r = np.random.default_rng(1)
    fp = r.integers(0, 2**64, 4000, dtype=np.uint64)
    mask, levels = simhash.masks(3)[0], 5
    tree = simhash.upper_tree(fp, mask, 1, levels)
    home, who, shard = simhash.shards_of(fp, tree, mask, 1, levels)
    own = np.bincount(home, minlength=32)
    guests = np.bincount(shard, minlength=32)
    assert (own * (own + guests)).sum() < 0.25 * 4000 * 4000
    visits = set(zip(who.tolist(), shard.tolist(), strict=True))
    near = [(a, b) for a in range(0, 4000, 10) for b in np.flatnonzero(simhash.distance(fp, fp[a], mask) <= 1).tolist() if b != a]
    assert len(near) > 5
    assert all(home[a] == home[b] or (a, home[b]) in visits or (b, home[a]) in visits for a, b in near)


def test_large_family_in_one_leaf():
    """A dense family of which no vantage point parts the projections."""
    r = np.random.default_rng(2)
    fp = np.unique(np.uint64(0x123456789ABCDEF0) ^ (r.integers(0, 1 << 20, 60_000, dtype=np.uint64) << np.uint64(40)))
    mask = simhash.masks(3)[0]
    found = simhash.linked(fp, len(fp), mask, 1, 4)
    assert len(np.unique(found)) == 1


def test_documents(spark, frame, docs):
    rows = [(r[0], r[1]) for r in [*docs, docs[5]]] + [(None, "null id text here")]
    want = classes([(i, fingerprint(t)) for i, t in rows], 4)
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(frame).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(i != c for i, _, c in want) > 5


def test_query_and_nothing(spark, docs, empty, tmp_path):
    rows = [(r[0], r[1]) for r in docs]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in op13_simhash_near_dedup(spark, str(tmp_path)).collect())
    assert got == [(i, f"{f:016x}", c) for i, f, c in classes([(i, fingerprint(t)) for i, t in rows], 4)]
    assert simhash.near_duplicates(empty).count() == 0


def test_long_text(spark):
    text = "many words that go on " * 60_000
    row = simhash.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["fp"] % 2**64 == fingerprint(text) and row["component_id"] == 1
