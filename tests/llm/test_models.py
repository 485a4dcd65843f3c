"""Language ID, licences, language-model scores and personal data."""

import hashlib
import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import lowered
from strata.llm import brown, langid, licences, pii
from strata.llm.common import crc_of_id


def test_language_id(frame, docs, empty):
    held = crc_of_id() % 4 == 2
    model = langid.fit(frame, ~held)
    rows = langid.predict(frame.select("doc_id", "text"), model).collect()
    truth = {r[0]: r[2] for r in docs}
    text = {r[0]: r[1] for r in docs}
    for r in rows:
        has_letter = any(c.isalpha() for c in text.get(r["doc_id"], "x") or "")
        assert (r["lang_pred"] == "und") == (not has_letter) and 0 <= r["score"] <= 1
    out = [(truth[r["doc_id"]], r["lang_pred"]) for r in rows if r["doc_id"] in truth and truth[r["doc_id"]] and r["lang_pred"] != "und" and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len(text[r["doc_id"]]) > 20]
    assert len(out) > 8 and langid.accuracy(out) > 0.9
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(frame.select("text"), nothing).collect()} == {"und"}
    bounded = langid.fit(frame, ~held, max_rows=20)
    assert len(bounded.first) < len(model.first) and bounded.langs == model.langs
    clash = langid.predict(frame, model)
    assert clash.columns.count("score") == 1 and {r["score"] for r in clash.collect()} != {"x"}


def test_rare_languages_and_long_words(spark):
    """A language with one row in 500 is learned from a small sample, and a word of 60 letters by its n-grams."""
    r = random.Random(3)
    word = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    rows = [(i, " ".join(word("abcdef", 5) for _ in range(30)), "aa") for i in range(1500)] + [(5000 + i, word("uvwxyz", 60), "zz") for i in range(3)] + [(6000, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True), max_rows=40)
    assert model.langs == ["aa", "zz"] and not any(len(w) > langid.LONGEST_WORD for w in model.first)
    assert model.predict(word("uvwxyz", 60))[0] == "zz" and model.predict(word("abcdef", 60))[0] == "aa" and model.predict("uv xy wz")[0] == "zz"
    assert langid.quotas({"a": 10, "b": 1, "c": 100}, 30) == {"b": 1, "a": 10, "c": 19} and langid.quotas({"a": 1, "b": 5}, 1) == {"a": 1, "b": 1}


def test_rows_of_unseen_words_are_kept_and_dropped():
    r = random.Random(8)
    tables = [(["a", "b"], np.array([[5.0, 1.0], [1.0, 5.0]])), *(([], np.zeros((0, 2))) for _ in range(4))]
    small, plain = langid.Model(["x", "y"], (["ab"], np.array([[5.0, 1.0]])), tables, memo=3), langid.Model(["x", "y"], (["ab"], np.array([[5.0, 1.0]])), tables, memo=0)
    for _ in range(60):
        words = list(dict.fromkeys("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))))
        want = np.array([plain.rows[0] if w == "ab" else plain.unseen(w) for w in words])
        assert np.allclose(small.scores(words), want) and np.allclose(plain.scores(words), want)


def test_long_texts_have_one_language(spark):
    model = langid.fit(spark.createDataFrame([(1, "le chat et la souris " * 5, "fr"), (2, "the cat and the mouse " * 5, "en")], "doc_id long, text string, lang string"), F.lit(True))
    rows = spark.createDataFrame([(1, "the cat " * 200_000), (2, "x" * 1_000_000), (3, "la souris " * 100_000 + "the")], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(rows, model).collect()}
    assert out[1][0] == "en" and out[3][0] == "fr" and all(0 <= s <= 1 for _, s in out.values())


def test_backoff_uses_the_longest_known_grams():
    m = langid.Model(["a", "b"], (["xyz"], np.array([[5.0, 0.0]])), [(["q"], np.array([[0.0, 9.0]])), ([], np.zeros((0, 2))), (["<qq"], np.array([[7.0, 1.0]])), ([], np.zeros((0, 2))), ([], np.zeros((0, 2)))])
    assert m.predict("xyz")[0] == "a" and m.predict("qqq")[0] == "a" and m.predict("zq")[0] == "b"
    assert m.predict(None) == ("und", 0.0) and m.predict("12 !") == ("und", 0.0)


def test_licences(spark, empty):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 2.": "gpl", "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by-sa", "He needs permission to renew the license of his boat": "unknown", "nothing of the kind": None}
    rows = [(i, f"intro words\n{line}\nmore words") for i, line in enumerate(lines)] + [(90, None), (91, ""), (92, "word " * 3000 + "Released under the MIT License. " + "word " * 3000), (93, "licence " * 500)]
    out = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["licence"] for i in range(len(lines))] == list(lines.values())
    assert out[0]["confirmed"] and out[0]["n_licence_paragraphs"] == 1 and out[0]["paragraphs"].startswith("1:mit:")
    assert out[90]["licence"] is None and out[91]["licence"] is None and out[92]["licence"] == "mit" and out[93]["licence"] == "unknown"
    assert licences.scan(empty).count() == 0


def test_licences_without_cues(spark):
    lines = [(family, line) for family, own in licences.NOTICES.items() for line in own]
    lines += [("gpl", "GPLv3"), ("mpl", "MPL 2.0"), ("bsd", "BSD-3-Clause"), ("public-domain", "CC0"), ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED')]
    rows = [(i, f"intro words\n{line}\nmore words") for i, (_, line) in enumerate(lines)] + [(len(lines), "nothing of the kind\nthe work is all yours")]
    out = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f, line, out[i]) for i, (f, line) in enumerate(lines) if out[i] != f] == [] and out[len(lines)] is None


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def test_wrapped_licences(spark):
    wrapped = [(f, w, "\n\n".join(textwrap.fill(p, w) for p in body.split("\n\n"))) for f, body in WRAPPED.items() for w in (40, 72, 79)]
    rows = [(i, f"Some title\nwords\n\n{text}\n  \nmore words") for i, (_, _, text) in enumerate(wrapped)] + [(90, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nend"), (91, "the general public\nlicence of a\nboat"), (92, "a\n\nb\nReleased under the MIT\nLicense")]
    out = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f, w, out[i]) for i, (f, w, _) in enumerate(wrapped) if (out[i]["licence"], out[i]["confirmed"]) != (f, True)] == []
    assert [p.split(":")[:2] for p in out[90]["paragraphs"].split(",")] == [["0", "mit"], ["1", "apache"]]
    assert out[91]["licence"] == "unknown" and out[92]["licence"] == "mit" and out[92]["paragraphs"].startswith("2:mit:")


# Notices in words that neither the training lines nor the held-out ones have.
UNSEEN = {
    "mit": ["You can use this under the MIT License, see LICENSE", "Dual use: MIT license", "Copyright (c) 2014 Jane Roe. Licensed under the MIT license."],
    "apache": ["Sources are available under the Apache License v2.0", "Licensed to the foundation under the Apache License, Version 2.0", "apache 2.0 license"],
    "gpl": ["This package may be distributed under the GNU General Public License", "licensed GPL v2", "It comes under the terms of the GNU General Public License version 2"],
    "lgpl": ["The library comes under the GNU Lesser General Public License v3", "license: LGPL 2.1"],
    "agpl": ["The server is under the GNU Affero General Public License v3", "license: AGPL v3"],
    "bsd": ["All code here is under the 2-clause BSD license", "BSD licensed"],
    "mpl": ["Files are under the Mozilla Public License, 2.0", "license: MPL v2"],
    "isc": ["The tool is under the ISC license", "ISC license (ISC)"],
    "cc-by": ["Photos are licensed under CC BY 2.0", "under a Creative Commons Attribution 3.0 License"],
    "cc-by-sa": ["Photos are licensed under CC BY-SA 2.0", "a Creative Commons Attribution-ShareAlike 3.0 License applies"],
    "cc-by-nc": ["Photos are licensed under CC BY-NC 2.0", "a Creative Commons Attribution-NonCommercial 2.0 License applies"],
    "cc-by-nd": ["Photos are licensed under CC BY-ND 2.0", "a Creative Commons Attribution-NoDerivatives 2.0 License applies"],
    "public-domain": ["All data here are in the public domain, under CC0", "We have released it into the public domain"],
    "proprietary": ["(c) 2021 Foo GmbH. All rights reserved.", "Copyright 1999 by the author, all rights reserved"],
}
PLAIN = ["The public library is open from nine to five", "He has a license to drive trucks and a permit for the harbour", "All the rights of the child were discussed", "The general version of the theorem is due to others", "The warranty of this phone is void", "The commons debated the creative industries", "They provided copies of the source to the court", "She reserved all rooms of the house", "The software of the car was updated to version 3", "The foundation published a free book"]


def test_licences_unseen(spark):
    lines = [(f, line) for f, own in UNSEEN.items() for line in own]
    rows = [(i, f"intro\n{line}\nmore words") for i, (_, line) in enumerate(lines)] + [(1000 + i, line) for i, line in enumerate(PLAIN)]
    out = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(out[i] == f for i, (f, _) in enumerate(lines))
    assert right / len(lines) > 0.9, [(f, line, out[i]) for i, (f, line) in enumerate(lines) if out[i] != f]
    assert [line for i, line in enumerate(PLAIN) if out[1000 + i] not in (None, "unknown")] == []


def test_licence_probabilities(spark):
    model = licences.train(["the work of all the people under one roof"])
    lines = [licences.tokens(line) for own in UNSEEN.values() for line in own] + [[], ["license"], licences.tokens("all rights reserved " * 20)]
    rows = spark.createDataFrame([*enumerate(lines)], "i int, words array<string>").select("i", licences.classify(F.col("words"), model, 0.7).alias("c")).collect()
    table = {g: np.array(w) for g, w in model.weights.items()}
    for r in rows:
        words = lines[r["i"]]
        z = np.array(model.bias) + sum((table[g] for g in licences.ngrams(words) if g in table), np.zeros(len(model.bias)))
        p = np.exp((z - z.max()) / model.temperature)
        assert r["c"]["family"] == model.classes[int(z.argmax())] and abs(r["c"]["score"] - p.max() / p.sum()) < 1e-6
        own = [set(licences.tokens(x)) for x in licences.NOTICES.get(r["c"]["family"], [])]
        assert r["c"]["confirmed"] == any(len(t & set(words)) / len(t) >= 0.7 for t in own)


def test_licences_of_odd_tables(spark, frame):
    out = licences.scan(frame).collect()
    assert len(out) == frame.count() and sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in frame.collect())
    assert {r["licence"] for r in out} == {None}
    rows = [(None, "Released under the MIT License", "x"), (7, "Released under the MIT License", "y"), (7, "Released under the MIT License", "y"), (8, "word " * 60_000 + "\n\nReleased under the MIT License\n" + "word " * 60_000, "z")]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string")).collect()
    assert sorted((r["doc_id"] or 0, r["licence"]) for r in out) == [(0, "mit"), (7, "mit"), (7, "mit"), (8, "mit")]


def test_licence_keys_lose_nothing():
    background = ["the work of all the people under one roof", "you should list the terms without any doubt"]
    model = licences.train(background)
    bounds, table = licences.keys(model, 0.6, background), {g: np.array(w) for g, w in model.weights.items()}
    unknown, found = model.classes.index("unknown"), Counter()
    for words, _ in licences.variations(background, 30, seed=7):
        words = words[: licences.MOST_WORDS]
        z = np.array(model.bias) + sum((table[g] for g in licences.ngrams(words) if g in table), np.zeros(len(model.bias)))
        p = np.exp((z - z.max()) / model.temperature)
        surely, may = np.delete(p / p.sum(), unknown).max() >= 0.6, sum(bounds.get(w, 0) for w in set(words)) >= 1
        assert may or not surely, words
        found[bool(surely), bool(may)] += 1
    assert found[True, True] > 1000 and found[False, False] > 0


def test_base_score_and_model(frame, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    tokens = [(i, [*lowered(t), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t in tokens:
        if not held(i):
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for i, t in tokens)
    got = brown.score(frame, crc_of_id() % 5 == 1, class_words=30, cluster=20, classes=6).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    assert brown.score(empty, F.lit(False)).count() == 0
    assert {r["n_known"] for r in brown.score(frame, F.lit(True)).collect()} == {0}


def test_class_model_by_brute_force(frame):
    """Every word's class, and every score, against plain loops over the texts."""
    rows = [(str(r["doc_id"]), lowered(r["text"]), not (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)) for r in frame.collect()]
    held = crc_of_id() % 5 == 1
    scorer, others, parts, _ = brown.fit(frame, ~held, class_words=40, cluster=25, classes=5)
    c = scorer.classes
    hash_of = {w: int(h) for ws in [sorted({w for _, t, _ in rows for w in t})] for w, h in zip(ws, brown.tv.split_words(np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws).encode())]), True).hashes(), strict=True)}
    counts = Counter(w for _, t, trained in rows if trained for w in t)
    own = {int(h): int(c.of[s]) for h, s in zip(c.lexicon.ids, c.lexicon.symbol, strict=True)}
    assert len(own) <= 40 < len(counts)
    rare, total = {}, {}
    for r in others.collect():
        for h, n, k in zip(np.frombuffer(r["ids"], "<u8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["cls"], "u1"), strict=True):
            rare[int(h)], total[int(h)] = int(k), int(n)
    assert {w: n for w, n in counts.items() if hash_of[w] not in own} == {w: total[hash_of[w]] for w in counts if hash_of[w] not in own} and len(rare) + len(own) == len(counts)
    # the class of each word outside the lexicon is the likeliest one by the lexicon's classes beside it
    fit = {h: c.prior.copy() for h in rare}
    beside = Counter()
    for _, t, trained in rows:
        for i, w in enumerate(t if trained else []):
            if (h := hash_of[w]) in fit:
                after = c.k if i + 1 == len(t) else own.get(hash_of[t[i + 1]])
                before = own.get(hash_of[t[i - 1]]) if i else None
                for x, p in ((after, c.p_after), (before, c.p_before)):
                    if x is not None:
                        fit[h] += p[:, x]
                        beside[h] += 1
    assert all(rare[h] == c.once if total[h] == 1 else rare[h] == c.prior.argmax() if not beside[h] else fit[h][rare[h]] >= fit[h].max() - 1e-9 for h in fit)
    n_of = Counter(counts.values())
    assert scorer.discount == min(0.9, max(0.1, n_of[1] / (n_of[1] + 2 * n_of[2])))
    # probabilities of the words of a class, with those that are not seen, sum up to 1
    every, d = own | rare, scorer.discount
    texts = sum(x for *_, x in rows)
    mine = {k: [n for w, n in counts.items() if every[hash_of[w]] == k] for k in range(c.k + 2)}
    emit = lambda k, n: 1.0 if k == c.k else (n - d) / (sum(mine[k]) + 0.5)
    fresh = {k: 0.0 if k == c.k else (d * len(mine[k]) + 0.5) / (sum(mine[k]) + 0.5) for k in mine}
    assert all(abs(sum(emit(k, n) for n in mine[k]) + fresh[k] - 1) < 1e-9 for k in mine if k != c.k) and set(mine[c.once]) == {1}
    assert np.allclose(scorer.share_unseen(), [fresh[k] for k in range(c.k + 2)])
    steps = []
    for i, t, trained in rows:
        state, last = "start", "start"
        for w in [*t, None]:
            cls, n = (c.k, texts) if w is None else (every[hash_of[w]], counts[w]) if w in counts else (None, 0)
            steps.append((i, trained, state, cls, n))
            if cls is None or cls == c.once:
                state = "rare", last
            else:
                state = last = cls
    seen, classes_of = {}, Counter()
    for _, trained, state, cls, _ in steps:
        if trained:
            seen.setdefault(state, Counter())[cls] += 1
            classes_of[cls] += 1
    share = {k: (classes_of[k] + 0.5) / (classes_of.total() + 0.5 * (c.k + 2)) for k in range(c.k + 2)}

    def p(state, cls):
        had = seen.get(state, Counter())
        return (had[cls] + (len(had) + 1) * share[cls]) / (had.total() + len(had) + 1)

    scores = Counter()
    for row, (i, _, state, cls, n) in enumerate(steps):
        scores[i] += math.log10(sum(p(state, k) * fresh[k] for k in fresh) if cls is None else p(state, cls) * emit(cls, n))
        if not row % 50:
            assert abs(sum(p(state, k) for k in fresh) - 1) < 1e-9
    assert any(cls is None for *_, cls, _ in steps)
    # rows with the same id have the same text here
    copies = Counter(i for i, *_ in rows)
    want = sorted((i, round(scores[i] / copies[i], 6)) for i, _, _ in rows)
    got = brown.score(frame, held, class_words=40, cluster=25, classes=5).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == want


@pytest.mark.parametrize("sf,most", [("sf0.001", 1000), ("sf0.01", 2500)])
def test_held_out_perplexity(spark, sf, most):
    """Far below the base on held-out texts (its perplexity is 8,860 and 13,462), and for nearly each of them."""
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    got = [r for r in brown.score(spark.read.parquet(path), crc_of_id() % 5 == 1).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    perplexity = lambda c: 10 ** (-sum(r[c] for r in got) / n)
    assert perplexity("score") < most < perplexity("base_score")
    assert sum(r["score"] < r["base_score"] for r in got) <= 0.1 * len(got)


def test_scores_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat " * 60_000), (2, "the dog sat"), (6, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in brown.score(df, F.col("doc_id") == 2).collect()}
    assert out[1]["n_tokens"] == 360_001 and out[2]["n_known"] == 3 and out[6]["n_tokens"] == 1 and out[1]["score"] > out[1]["base_score"]


def test_exchange_finds_classes():
    r = np.random.default_rng(0)
    b = np.zeros((20, 20))
    for _ in range(5000):
        i = r.integers(0, 20)
        b[i, (i + 1) % 2 + 2 * r.integers(0, 10)] += 1  # even follows odd
    own = brown.exchange(b, 2)
    assert len(set(own[::2])) == 1 and len(set(own[1::2])) == 1 and own[0] != own[1]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


TRICKY = [
    None, "", "mail a.b@c.de, x@y.z.w. and a@b.com_c@d.org @ no@", "ips 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 12.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111111111111111 5500005555555559",
    "call +1 (988) 555-2485 or +49 30 123456, +1.2 +123456789012345678", "é한 x@y.co 한 10.0.0.1é", "9" * 20000, "1." * 9000, "a" * 30000 + "@b.c", "email: joe (at) mail (dot) com; tel 555-123-4567; phone (212) 555-0199", "+" * 500, "1 " * 5000,
]


def test_base_spans(spark, frame, empty):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, text, out[i]["spans"])
        assert [out[i][f"n_{k}"] for k in PATTERNS] == [sum(w[3] == k for w in want) for k in PATTERNS]
        assert set(filter(None, text.split(","))) <= set(out[i]["spans"].split(","))
    assert pii.report(empty).count() == 0 and pii.report(frame).count() == frame.count()


def test_hints_pass_every_match(spark):
    r = random.Random(4)
    parts = {
        "email": [["joe", "a.b"], ["", " "], ["(at)", "[AT]", "{at}", "@"], ["", " "], ["mail", "x-1"], ["", " "], ["(dot)", "[dot]", "{DOT}", "."], ["", " "], ["com", "org"]],
        "ip": [["10", "999"], *[["", " "], ["", "["], ["."], ["", "]"], ["", " "], ["1", "255"]] * 3],
        "card": [["4111"], *[["", " ", ".", "-"], ["1111"]] * 3],
        "phone": [["", "0049 "], ["(212) ", "212-", "(030)", "0171 "], ["555", "5555"], [" ", ".", "-"], ["0199"]],
    }
    for strict, tables in ((False, (pii.LOOSE, pii.LOOSE_HINT)), (True, (PATTERNS, pii.HINT))):
        for kind, choices in parts.items():
            made = ["".join(map(r.choice, choices)) for _ in range(3000)]
            found = [t for t in made if any(not strict or base_spans(m.group()) for m in re.finditer(tables[0][kind], t))]
            assert (found or strict) and [t for t in found if not re.search(tables[1][kind], t)] == []
    texts = ["joe@mail(dot)com", "joe@mail [dot] com", "joe@mail .com", "999.1.1.1", "10[.1.1.1"]
    rows = pii.candidates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "doc_id", "text").collect()
    assert {x["doc_id"]: [s["end"] for s in x["more"]] for x in rows} == {i: [len(t)] for i, t in enumerate(texts)}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.co and 10.0.0.1.", "k"), (2, None, "k"), (3, "clean text 12", "k")], "doc_id long, text string, base string")
    assert {r["doc_id"]: (r["text"], r["base"]) for r in pii.redacted(df).collect()} == {1: ("to [email] and [ip].", "k"), 2: (None, "k"), 3: ("clean text 12", "k")}


def test_estimation_tells_reliable_labelers():
    counts = {(2, "++00" + "0+"): 80, (2, "0-000-"): 60, (2, "0+000+"): 9, (2, "0-00-" + "-"): 10}
    p, rates = pii.estimate(counts)
    assert p[2, "++000+"] > 0.9 and p[2, "0-000-"] < 0.1 and p[2, "0+000+"] > p[2, "0-00--"]
    assert rates[1]["+"][0] > rates[1]["+"][1]
    assert len(pii.train({}, {})) == len(pii.feature_names())


def test_a_small_language_is_in_the_sample(spark):
    """A language with one row in thousands still teaches its words, wherever the hash of its id falls."""
    rows = [(i, f"alpha beta gamma word{i % 9}", "en") for i in range(400)] + [(1000 + i, f"{w} {w} {w}", w) for i, w in enumerate(["uno", "duo", "tri", "quat", "pent"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True), max_rows=12, least_word=1)
    assert model.langs == ["duo", "en", "pent", "quat", "tri", "uno"]
    assert {model.predict(w)[0] for w in ("uno", "duo", "tri", "quat", "pent")} == {"uno", "duo", "tri", "quat", "pent"}


def test_shared_folder_of_a_cluster_must_be_named():
    from types import SimpleNamespace

    from strata.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://a:1", getConf=lambda: conf, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_dir(far)
