"""TIFF, mixing, packing and fingerprints."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import words
from strata.llm import jaccard, mixing, packing, tiff, winnow


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 5, (70, 64)).astype(np.uint8), r.integers(0, 256, (3, 64)).astype(np.uint8), np.zeros((200, 64), np.uint8)]
    out = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, strip_rows=32)))
    assert len(out) == 3 and all((a == b.pixels).all() for a, b in zip(pages, out, strict=True))


@pytest.mark.parametrize("form", tiff.FORMS)
def test_tiff_forms(form):
    compression, predictor, tile = form
    r = np.random.default_rng(1)
    pages = [r.integers(0, 5, (70, 64)).astype(np.uint8), r.integers(0, 256, (3, 50)).astype(np.uint8), np.zeros((200, 64), np.uint8)]
    out = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, tile=tile)))
    assert len(out) == 3 and all((a == b.pixels).all() for a, b in zip(pages, out, strict=True))


def test_every_form_stores_some_text():
    assert {tiff.FORMS[zlib.crc32(str(i).encode()) % len(tiff.FORMS)] for i in range(400)} == set(tiff.FORMS)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(range(len(tiff.FORMS))), st.lists(st.tuples(st.floats(0, 1), st.integers(0, 255)), min_size=1, max_size=6), st.floats(0.1, 1))
def test_malformed_media_are_errors(form, edits, share):
    compression, predictor, tile = tiff.FORMS[form]
    data = bytearray(tiff.write_pages([np.arange(640, dtype=np.uint8).reshape(10, 64)] * 2, compression, predictor, tile=tile))
    for place, value in edits:
        data[min(len(data) - 1, int(place * len(data)))] = value
    try:
        for page in tiff.read_pages(bytes(data[: int(share * len(data)) + 1])):
            assert page.pixels.nbytes <= 1 << 24
    except (tiff.TiffError, struct.error, IndexError, ValueError):
        pass


def test_bad_codes_are_errors(spark):
    codes = 0
    for c in (256, 300, 257):
        codes = codes << 9 | c
    with pytest.raises(tiff.TiffError):
        tiff.unpack_lzw((codes << 5).to_bytes(4, "big"))
    bad = bytearray(tiff.write_pages([np.ones((4, 64), np.uint8)]))
    at = struct.unpack_from("<I", bad, 4)[0]
    struct.pack_into("<I", bad, at + 2 + 4, 0)  # a count of 0 for the width
    rows = tiff.decode(spark.createDataFrame([(1, bytes(bad)), (2, tiff.write_pages([np.ones((4, 64), np.uint8)]))], "k int, media binary"), "media", "k").collect()
    assert sorted((r["id"], r["error"]) for r in rows if r["error"]) == [(1, "no width or height")] and len(rows) == 2


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_tiff_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_clears_its_table():
    data = np.random.default_rng(2).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_tiff_tiles_big_endian():
    tile = [np.full((16, 16), v, np.uint8) for v in (1, 2, 3, 4)]
    data = bytearray(b"MM\0*\0\0\0\0")
    offsets = []
    for t in tile:
        offsets.append(len(data))
        data += zlib.compress(t.tobytes())
    lists = len(data)
    data += struct.pack(">4I", *offsets) + struct.pack(">4I", *(len(zlib.compress(t.tobytes())) for t in tile))
    struct.pack_into(">I", data, 4, len(data))
    short = lambda v: struct.pack(">HH", v, 0)
    fields = [(256, 3, 1, short(20)), (257, 3, 1, short(30)), (258, 3, 1, short(8)), (259, 3, 1, short(8)), (322, 3, 1, short(16)), (323, 3, 1, short(16)), (324, 4, 4, struct.pack(">I", lists)), (325, 4, 4, struct.pack(">I", lists + 16))]
    data += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in fields) + b"\0\0\0\0"
    page, = tiff.read_pages(bytes(data))
    assert page.pixels.shape == (30, 20) and page.pixels[0, 0] == 1 and page.pixels[0, 19] == 2 and page.pixels[29, 0] == 3 and page.pixels[29, 19] == 4


def test_tiff_errors_and_rows(spark):
    good = tiff.write_pages([np.ones((4, 64), np.uint8)] * 2)
    loop = bytearray(tiff.write_pages([np.ones((1, 64), np.uint8)]))
    at = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * struct.unpack_from("<H", loop, at)[0], at)
    rows = [(1, good), (2, b"nope"), (3, None), (4, bytes(loop)), (5, good[: len(good) // 2]), (6, b"")]
    out = tiff.decode(spark.createDataFrame(rows, "k int, media binary"), "media", "k").collect()
    assert sorted((r["id"], r["page"], r["error"] is None) for r in out) == [(1, 0, True), (1, 1, True), (2, 0, False), (4, 0, True), (4, 1, False), *sorted((r["id"], r["page"], r["error"] is None) for r in out if r["id"] == 5), (6, 0, False)]
    assert any(r["error"] for r in out if r["id"] == 5)


def test_stored_texts(frame, empty):
    rows = tiff.round_trip(frame).collect()
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(rows) == frame.count() and tiff.round_trip(empty).count() == 0
    _, media = tiff.store_text(b"ab" * 700_000)
    assert len(list(tiff.read_pages(media))) == 2


def test_targets():
    out = mixing.targets({"a": 100, "b": 100, "c": 100, None: 100})
    assert sum(out.values()) == pytest.approx(400) and out["a"] == pytest.approx(400 * 5 / 13)
    out = mixing.targets({"a": 10, "b": 100, "c": 100})
    assert out["a"] == 30 and out["b"] == pytest.approx(120) and sum(out.values()) == pytest.approx(210)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 3}) == {"a": 0.0, "b": 3.0}


def test_schedule_is_even(spark):
    """Each source has its share of every stretch of slots, and ranks count on."""
    aims = [50.0, 20.0, 0.0, 1.0, 29.0]
    rows = mixing.schedule(spark, aims, 1000).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1000)) and mixing.slots_of(aims, 1000) == [sum(r["source_no"] == s for r in rows) for s in range(5)]
    for s, aim in enumerate(aims):
        own = [r for r in rows if r["source_no"] == s]
        assert [r["rank"] for r in own] == list(range(len(own)))
        for start in range(0, 1000, 125):
            assert abs(sum(start <= r["slot"] < start + 125 for r in own) - 1.25 * aim) <= 8
        assert abs(len(own) - 10 * aim) <= 6
    assert mixing.schedule(spark, [], 0).count() == 0 and mixing.schedule(spark, [0.0], 0).count() == 0


def test_mixing(spark, frame, empty):
    """Each document's words, and its first slot, by going through the slots one after the other."""
    out, uses = mixing.mix(frame, block_words=16, least_slots=200, buckets=4)
    rows = out.collect()
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert len(rows) == frame.count()
    by = {}
    for r in rows:
        assert r["size"] == len(words(text[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    want, total = mixing.targets(sizes), sum(sizes.values())
    block = max(1, min(16, total // 200))
    keys = {(r["doc_id"], r["size"]): r["k"] % 2**64 for r in out.select("doc_id", "size", F.xxhash64("doc_id", "size", F.lit(17)).alias("k")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    lines = {s: [(place, word) for lap in range(3) for place, r in enumerate(sorted(own, key=lambda r: keys[r["doc_id"], r["size"]])) for word in range(r["size"])] for s, own in by.items()}
    taken, first, at = {}, {}, dict.fromkeys(order, 0)
    edges = [sum(want[s] for s in order[: i + 1]) / total for i in range(len(order))]
    slots = -(-total // block)
    for slot in range(slots):
        point = sum((slot >> j & 1) / 2 ** (j + 1) for j in range(32))
        s = next((s for s, e in zip(order, edges, strict=True) if point < round(e * 2**32) / 2**32), order[-1])
        for place, _ in lines[s][at[s] : at[s] + block]:
            taken[s, place] = taken.get((s, place), 0) + 1
            first.setdefault((s, place), slot)
        at[s] += block
    for s, own in by.items():
        line = sorted(own, key=lambda r: keys[r["doc_id"], r["size"]])
        assert sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["first_slot"])) for r in line) == sorted((str(r["doc_id"]), r["size"], taken.get((s, i), 0), str(first.get((s, i)))) for i, r in enumerate(line))
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] for r in own) and abs(sum(r["taken"] for r in own) - want[s]) <= block * (slots.bit_length() + 1)
    key = lambda r: (str(r["doc_id"]), r["taken"], r["first_slot"])
    assert sorted(map(str, map(key, rows))) == sorted(map(str, map(key, mixing.mix(frame.repartition(2), block_words=16, least_slots=200, buckets=4)[0].collect())))
    assert all(r["from_word"] < r["to_word"] for r in uses.collect()) and mixing.mix(empty)[0].count() == 0


def test_packing(frame, empty):
    rows = packing.pack(frame, capacity=64, buckets=4).collect()
    encode = packing.encoder(packing.default_tokenizer(), False)
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for doc, own in pieces.items():
        ids = np.array([*encode(text[doc] or ""), 2], dtype="<u4")
        at = 0
        for k in range(len(own)):
            r = own[k]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (k == 0 or r["length"] == 64)
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 64) * 1.05 + 1 and packing.pack(empty).count() == 0


def test_fast_and_slow_tokenizers_agree():
    path = packing.default_tokenizer()
    assert packing.can_be_fast(path)
    for text in ("", " a  b\n\n c", "naïve 한국어 <|endoftext|> x" * 5, "a" * 3000, "\t\t 12345 don't", "x" + " " * 1_200_000 + "y"):
        assert packing.encoder(path, True)(text) == packing.encoder(path, False)(text)


def test_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "plain", "x <|endoftext|>" * 200]
    rows = packing.pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), capacity=64).collect()
    for i, t in enumerate(texts):
        ids = np.array([*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (50256 in ids) == ("endoftext" in t)
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [c for *_, c in own] == [zlib.crc32(ids[at : at + n].tobytes()) for _, at, n, _ in own] and sum(n for *_, n, _ in own) == len(ids)


def fewest_bins(lengths, capacity):
    """By trying every bin for every item."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest[rest.index(room)] -= lengths[i]
            place(i + 1, rest)
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=11))
def test_bin_completion_is_optimal_on_small_inputs(lengths):
    counts = np.bincount(lengths, minlength=31)
    best = fewest_bins(sorted(lengths, reverse=True), 30)
    assert packing.lower_bound(counts, 30) <= best == packing.bins_of(packing.bin_completion(counts, 30))


def test_bin_completion_beats_best_fit():
    counts = np.zeros(101, int)
    for x, n in ((51, 60), (27, 60), (26, 60), (23, 120)):  # 51 + 26 + 23 and 27 + 27 + 23 + 23 fill all bins
        counts[x] = n
    assert packing.bins_of(packing.bin_completion(counts, 100)) == 90 < packing.bins_of(packing.best_fit(counts, 100))


def test_fillings_are_undominated():
    counts = np.zeros(21, int)
    for x in (2, 3, 5, 7, 8, 12):
        counts[x] = 1
    found = [*packing.fillings(counts, 20, 12, 12, packing.Meter(10**6))]
    # 12 alone takes the place of any of them; without it, 7 + 5 is not one length that is left
    assert found == [(12,)]
    counts[12] = 0
    found = [*packing.fillings(counts, 20, 12, 12, packing.Meter(10**6))]
    assert found[0] == (7, 5) and (8, 3) in found and (7, 3, 2) not in found and (8, 2) not in found


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_bin_completion(lengths):
    counts = np.bincount(lengths, minlength=51)
    patterns = packing.bin_completion(counts, 50)
    used = np.zeros(51, dtype=int)
    for p, times in patterns:
        assert sum(p) <= 50
        for x in p:
            used[x] += times
    assert (used == counts).all()
    assert -(-sum(lengths) // 50) <= sum(t for _, t in patterns) <= packing.bins_of(packing.best_fit(counts, 50))


def gram_hash(words_of, few=None):
    """By the polynomials' definition, word by word from the left."""
    out = []
    for (p, base), at in zip(winnow.FIELDS, (0, 32), strict=True):
        total = 0 if few is None or at == 0 else few
        for h in words_of:
            total = (total * base + ((h if at == 0 else (h % 2**64) >> 32) % p)) % p
        out.append(total)
    return out[0] << 31 | out[1]


def winnowed(word_hashes, k, window):
    """Brute force: each window's least gram, the rightmost of ties, with its place."""
    n = len(word_hashes)
    grams = [gram_hash(word_hashes[i : i + k]) for i in range(n - k + 1)] if n >= k else [gram_hash(word_hashes, n)] if n else []
    chosen = []
    for start in range(max(1, len(grams) - window + 1) if grams else 0):
        own = [(grams[i], -i) for i in range(start, min(start + window, len(grams)))]
        value, place = min(own)
        if (value, -place) not in chosen:
            chosen.append((value, -place))
    return chosen


@pytest.mark.parametrize(("k", "window"), [(5, 16), (1, 1), (2, 3), (3, 7), (7, 4), (6, 10)])
def test_choices_match_brute_force(spark, k, window):
    from pyspark.sql import functions as F

    import random

    r = random.Random(k * 100 + window)
    texts = [" ".join(r.choice("abcdefgh" if i % 2 else "ab") for _ in range(r.randint(0, 60))) for i in range(40)] + [None, "", " \t\n", "x", "loop " * 70, "a b c d e f"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    hashed = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    for row in df.select("text", hashed.alias("h"), winnow.selected(F.coalesce("text", F.lit("")), k, window).alias("c")).collect():
        assert [(x["hash"], x["place"]) for x in row["c"]] == winnowed(row["h"] or [], k, window), row["text"]


def test_likenesses_and_long_texts(spark):
    texts = ["a b c d e f g h " * 30, "", "z " * 200_000, "the same words here " * 20, "the same words here " * 20]
    rows = winnow.edited_pairs(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    prints = [{p.split("@")[0] for p in r["fingerprint"].split()} for r in rows]
    edits = [{p.split("@")[0] for p in r["edited_fingerprint"].split()} for r in rows]
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    assert [(r["near_edited"], r["near_next"]) for r in rows] == [(like(prints[i], edits[i]), like(prints[i], prints[(i + 1) % 5])) for i in range(5)]
    # 200,000 equal words: the rightmost place of each window, up to the last gram
    assert rows[2]["fingerprint"].endswith(f"@{200_000 - winnow.K}") and rows[3]["near_next"] == 1.0 and rows[1]["fingerprint"] == ""


def test_fingerprints(frame, docs, empty):
    rows = sorted(winnow.edited_pairs(frame).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    source = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert [r["doc_id"] for r in rows] == [i for i, _ in source]
    prints = {}
    for n, (r, (_, text)) in enumerate(zip(rows, source, strict=True)):
        following = source[(n + 1) % len(source)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (edited != text or r["near_edited"] == 1)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == "") == (not words(text))
    assert winnow.edited_pairs(empty).count() == 0


def test_match_guarantee(spark):
    import random

    r = random.Random(4)
    shared = [f"s{i}" for i in range(winnow.WINDOW + winnow.K - 1)]
    texts = [" ".join([*(f"a{r.random()}" for _ in range(r.randint(0, 40))), *shared, *(f"b{r.random()}" for _ in range(30))]) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(x["h"]) for x in df.select(winnow.hashes(winnow.selected(df["text"])).alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)
    places = df.select(winnow.as_text(winnow.selected(df["text"])).alias("f")).first()["f"].split(" ")
    at = [int(p.split("@")[1]) for p in places]
    assert at == sorted(at) and all(b - a <= winnow.WINDOW for a, b in zip(at, at[1:], strict=False))


def test_many_buckets(spark):
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(200)], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["next_text"] for r in winnow.with_next(df, "doc_id", ["text"], each=9).collect()}
    assert out == {i * i: f"t{(i + 1) % 200}" for i in range(200)}


def test_driver_keeps_no_tokenizer_and_collects_its_garbage(spark):
    packing.can_be_fast(packing.default_tokenizer())
    assert not packing._loaded
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory

    def collections():
        return sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Young" not in b.getName())

    before = collections()
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 2}") for i in range(4)], "doc_id long, text string")
    assert jaccard.components(docs).count() == 4
    assert collections() >= before + 3
