"""Licence scans: a trained paragraph classifier, applied with DataFrame functions only.

A paragraph is a run of lines that aren't blank. Its lines are judged one by one (a line of
more than 8 * MOST_WORDS characters by sentences), since each may be a notice of its own,
and all of them joined, since a notice may be wrapped. Of more than MOST_WORDS
words, each MOST_WORDS from every STEP-th word on are judged. What a line confirms isn't
told again for its paragraph, nor what a paragraph confirms for its lines. They are classified
by a sparse multinomial logistic regression on their word n-grams (1 to 3): a licence
family or `unknown`. Features are n-grams of the notices that have a telling word: no
number, and in less than 2 % of the background's paragraphs. A text, a run and a
paragraph are skipped only if the model's weights show that nothing in them can
reach `threshold` for any family (see `keys`); the texts that are left are judged whole.

The model is trained on the notices below, varied at random (fixed seed), against other
uses of the same words and a bounded sample of the corpus' own paragraphs (`max_rows`
documents). Its probabilities are calibrated by a temperature that is fitted on HELD_OUT,
lines that it isn't trained on, and a family needs `threshold`. A prediction is confirmed when
the line or the joined lines hold most words of one of the family's templates.

Null and empty texts have no paragraphs. Rows that repeat are scanned one by one. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices of licence families, as they stand in public licence texts.
NOTICES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "This project is licensed under the terms of the MIT license", "License: MIT", "MIT licensed", "The MIT License (MIT)", "Distributed under the MIT software license", "SPDX-License-Identifier: MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "License: Apache 2.0", "Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2 or later", "License: GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "GPLv3", "GPL-2.0", "License: GPLv2 or later", "You should have received a copy of the GNU General Public License along with this program", "Released under the GNU GPL v3", "Distributed under the terms of the GPL"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "LGPLv3", "LGPL-2.1", "License: LGPLv2 or later", "Licensed under the LGPL", "Released under the GNU LGPL v3", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "AGPLv3", "AGPL-3.0", "Licensed under the AGPL", "Released under the GNU AGPL v3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Licensed under the BSD 3-Clause License", "Released under the BSD license", "License: BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD-3-Clause", "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "License: MPL 2.0", "Licensed under the MPL", "SPDX-License-Identifier: MPL-2.0", "MPL 2.0", "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0"],
    "isc": ["Licensed under the ISC License", "License: ISC", "The ISC License", "SPDX-License-Identifier: ISC", "The software is provided as is and the author disclaims all warranties with regard to this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["Licensed under CC BY 4.0", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Available under the Creative Commons Attribution license", "License: CC BY"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License", "License: CC BY-SA"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "License: CC BY-NC"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "License: CC BY-ND"],
    "public-domain": ["Released under CC0 1.0 Universal", "CC0", "CC0-1.0", "This work is dedicated to the public domain", "Released into the public domain", "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher", "All rights reserved", "Copyright 2020 Example Inc. All rights reserved", "This software is proprietary and confidential; unauthorized copying is strictly prohibited", "Proprietary and confidential"],
}
# Further notices, on which the temperature is fitted; the weights never see them.
HELD_OUT: dict[str, list[str]] = {
    "mit": ["Code released under the MIT license by the team", "It is available under the MIT License", "licensed under MIT"],
    "apache": ["The code is licensed under the Apache License 2.0", "See the Apache License for the specific language governing permissions", "Apache License 2.0"],
    "gpl": ["The program is distributed under the GNU GPL, version 2", "See the GNU General Public License for more details", "GPL version 3 or any later version"],
    "lgpl": ["distributed under the GNU Lesser General Public License", "LGPL version 3 or later"],
    "agpl": ["This file is under the GNU Affero General Public License", "AGPL version 3"],
    "bsd": ["The code is under the BSD license", "distributed under a BSD 2-Clause licence", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"],
    "mpl": ["released under the Mozilla Public License 2.0", "under the MPL, version 2.0"],
    "isc": ["released under the ISC license", "ISC licensed"],
    "cc-by": ["The text is under CC BY 3.0", "Creative Commons Attribution 3.0"],
    "cc-by-sa": ["The text is under CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported"],
    "cc-by-nc": ["The pictures are under CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 3.0"],
    "cc-by-nd": ["The pictures are under CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives 3.0"],
    "public-domain": ["the author has placed this work in the public domain", "CC0 1.0", "dedicated to the public domain worldwide"],
    "proprietary": ["Copyright 2019 The Company. All rights reserved.", "strictly confidential and proprietary; copying is prohibited"],
    "unknown": ["The public house has a license to serve beer", "The permission of the owner is needed", "A copy of the letter was sent to the author", "the general terms of the contract are public", "this software is fast and free", "the version of the file is 2.0", "all the rights of the people", "he works for the Apache foundation", "The program started at nine", "a source of confidential news", "the warranty of the car ends in May", "the commons is a creative place"],
}
# Other uses of the same words.
OTHERS = ["The driver's license was renewed last week", "He asked for permission to leave the room", "The licence fee rose again this year", "Permission denied while opening the file", "The warranty covers parts and labour for two years", "She applied for a fishing license at the office", "The pub lost its license to sell alcohol", "Copyright law is a broad subject of study", "The shop offers a warranty on all phones", "They released the album under a new label", "A general public meeting about the version of events", "The apache helicopter landed", "The public domain of private life", "version 2.0 of the program was released", "students of MIT released a statement", "work under general conditions", "the license of the doctor was revoked", "software version 3 requires a license key", "the terms of the treaty were published", "a copy of the source was found in the library", "free software is reviewed in this issue", "the author reserved a table for later", "rights of the public are subject to law", "the conditions of the contract are the following", "any claim for damages must be in writing", "the project is available in all stores"]
#: Parts of lower-cased text that speak of licences: a paragraph without a family counts as `unknown` if it has one.
CUES = ["licen", "copyright", "permission", "redistribut", "public domain", "creative commons", "all rights reserved", "proprietary and confidential", "cc by", "cc-by", "cc0 1.0"]
MOST_WORDS, STEP = 80, 60
BUCKETS = 64
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def variations(background: list[str], each: int, seed: int, notices: dict[str, list[str]] = NOTICES, others: list[str] = OTHERS) -> list[tuple[list[str], str]]:
    """(words, family): notices with words dropped, numbers changed and other words around; others; the background itself."""
    rng = random.Random(seed)
    filler = [w for line in background + OTHERS for w in tokens(line)] or ["text"]

    def vary(line: str) -> list[str]:
        words = [w if not w.isdigit() or rng.random() < 0.5 else str(rng.randint(1, 5)) for w in tokens(line)]
        if len(words) > 6:
            words = [w for w in words if rng.random() > 0.07]
        if rng.random() < 0.3:
            words = [rng.choice(filler) for _ in range(rng.randint(1, 12))] + words
        if rng.random() < 0.3:
            words = words + [rng.choice(filler) for _ in range(rng.randint(1, 12))]
        return words

    out = [(vary(line), family) for family, lines in notices.items() for line in lines for _ in range(each)]
    out += [(vary(line), UNKNOWN) for line in others for _ in range(each)]
    return out + [(tokens(line), UNKNOWN) for line in background]


def telling(background: list[str], share: float = 0.02) -> Callable[[str], bool]:
    """Whether a word can tell a notice: no number, and in less than `share` of the background's paragraphs."""
    seen = Counter(w for line in background for w in set(tokens(line)))
    least = share * max(50, len(background))
    return lambda w: not w.isdigit() and len(w) > 1 and seen[w] < least


class Model:
    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature


def train(background: list[str], each: int = 12, steps: int = 250, sparsity: float = 2e-4) -> Model:
    """The regression, by accelerated proximal gradient descent (so that most weights are 0 and short notices get their full weights), then its temperature."""
    classes = [*NOTICES, UNKNOWN]
    data = variations(background, each, seed=1)
    tells = telling(background)
    lines = [line for own in NOTICES.values() for line in own] + OTHERS
    vocabulary = {g: i for i, g in enumerate(sorted({g for line in lines for g in ngrams(tokens(line)) if any(map(tells, g.split()))}))}

    def matrix(rows: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(vocabulary) + 1), np.float32), np.zeros((len(rows), len(classes)), np.float32)
        x[:, -1] = 1
        for i, (words, family) in enumerate(rows):
            x[i, [vocabulary[g] for g in ngrams(words) if g in vocabulary]] = 1
            y[i, classes.index(family)] = 1
        return x, y

    x, y = matrix(data)
    w = np.zeros((x.shape[1], len(classes)), np.float32)
    rate = 4.0 / max(1.0, float((x * x).sum(axis=1).mean()))
    ahead, pace = w, 1.0
    for _ in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        last, w = w, ahead - rate * (x.T @ (p - y)) / len(x)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * sparsity, 0)
        before, pace = pace, (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = w + np.float32((before - 1) / pace) * (w - last)
    held = {f: own for f, own in HELD_OUT.items() if f != UNKNOWN}
    held_x, held_y = matrix(variations(background[::3], 2, seed=2, notices=held, others=HELD_OUT[UNKNOWN]))
    z = held_x @ w

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(held_y * (s - np.log(np.exp(s).sum(axis=1, keepdims=True)))).sum())

    temperature = min((0.25 * 1.15**i for i in range(24)), key=loss)
    kept = {g: [round(float(v), 5) for v in w[i]] for g, i in vocabulary.items() if np.abs(w[i]).max() > 0.01}
    return Model(classes, kept, [float(v) for v in w[-1]], temperature)


def keys(model: Model, threshold: float, background: list[str]) -> dict[str, float] | None:
    """Words and bounds: a paragraph whose distinct words' bounds sum to less than 1 reaches the threshold for no family; None if any may.

    A family f has probability t only if its logit is log(t / (1 - t)) temperatures above
    that of `unknown`. Each n-gram's share of that is laid to the one of its words that is
    rarest in the background, and a word bounds the sum of its shares for each family.
    """
    unknown = model.classes.index(UNKNOWN)
    bias = np.array(model.bias)
    t = min(max(threshold, 1e-9), 1 - 1e-9)
    need = np.delete(model.temperature * np.log(t / (1 - t)) - bias + bias[unknown], unknown) - 1e-3
    if (need <= 0).any():
        return None
    seen = Counter(w for line in background for w in tokens(line))
    shares: dict[str, np.ndarray] = {}
    for g, w in model.weights.items():
        word = min(g.split(), key=lambda x: (x.isdigit(), seen[x], x))
        shares[word] = shares.get(word, 0) + np.delete(np.maximum(np.array(w) - w[unknown], 0), unknown) / need
    # rounded up to few levels
    return {x: max(1 / 64, float(1.25 ** np.ceil(np.log(min(1.0, v.max())) / np.log(1.25)))) for x, v in sorted(shares.items()) if v.max() > 0}


def could(words: Column, bounds: dict[str, float] | None) -> Column:
    """Whether a paragraph of these words may reach the threshold, by the bounds of `keys`."""
    if bounds is None:
        return F.lit(True)
    if not bounds:
        return F.lit(False)
    levels: dict[float, list[str]] = {}
    for word, v in bounds.items():
        levels.setdefault(v, []).append(word)

    def level(w: Column) -> Column:
        out = F
        for v in sorted(levels):
            out = out.when(w.isin(levels[v]), F.lit(v))
        return out.otherwise(F.lit(0.0))

    return F.aggregate(F.array_intersect(words, F.lit([*bounds])), F.lit(0.0), lambda acc, w: acc + level(w)) >= 1 - 1e-6


def paragraphs(text: Column, bounds: dict[str, float] | None) -> Column:
    """The lines and wrapped paragraphs of a text that have a cue or could have a family, as array<struct<run, no, wrapped, cue, words>>.

    run: which run of non-blank lines; no: which line (or sentence of a long one) it is or starts in.
    """
    lowered = F.lower(text)

    def warm(part: Column) -> Column:
        """Whether a stretch of lower-cased text may hold a notice or a cue, which may be wrapped; cheap."""
        spaced = [c for c in CUES if " " in c]
        wrapped = part.rlike("|".join(c.replace(" ", r"\s+") for c in spaced))
        return could(F.split(part, "[^a-z0-9]+"), bounds) | has_cue(part, [c for c in CUES if c not in spaced]) | wrapped

    def pieces(run: Column) -> Column:
        return F.flatten(F.transform(F.split(run, r"\n+"), lambda s: F.when(F.length(s) > 8 * MOST_WORDS, F.split(s, r"(?<=[.!?;])\s+")).otherwise(F.array(s))))

    def open_(p: Column) -> Column:
        return p.getField("cue") | could(p.getField("words"), bounds)

    def windows(words: Column, one) -> Column:
        last = F.floor(F.greatest(F.size(words) - (MOST_WORDS - STEP + 1), F.lit(0)) / STEP).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: one(F.slice(words, i * STEP + 1, F.lit(MOST_WORDS)), i * STEP)), open_)

    def item(run: Column, no: Column, wrapped: bool, cue: Column, words: Column) -> Column:
        return F.struct(run.alias("run"), no.cast("int").alias("no"), F.lit(wrapped).alias("wrapped"), cue.alias("cue"), words.alias("words"))

    def of_line(p: Column) -> Column:
        return windows(p.getField("words"), lambda w, _: item(p.getField("run"), p.getField("no"), False, p.getField("cue"), w))

    def of_run(p: Column) -> Column:
        """Windows over all words of a run of several lines; none of a single line."""

        def no(start: Column) -> Column:
            zero = F.struct(start.cast("int").alias("left"), p.getField("no").cast("int").alias("no"))
            step = lambda acc, s: F.when(acc.getField("left") < F.size(s), F.struct(F.lit(-1).alias("left"), acc.getField("no").alias("no"))).otherwise(F.struct((acc.getField("left") - F.size(s)).alias("left"), (acc.getField("no") + 1).alias("no")))
            return F.aggregate(p.getField("lines"), zero, step, lambda acc: acc.getField("no"))

        def one(w: Column, start: Column) -> Column:
            return item(p.getField("run"), start, True, p.getField("across") & has_cue(F.array_join(w, " ")), w)

        found = bind(F.flatten(p.getField("lines")), lambda words: windows(words, one))
        placed = F.transform(found, lambda x: item(x.getField("run"), no(x.getField("no")), True, x.getField("cue"), x.getField("words")))
        return F.when(F.size(p.getField("lines")) > 1, placed).otherwise(F.array().cast(ITEMS))

    def both(p: Column) -> Column:
        lines = F.transform(p.getField("lines"), lambda words, i: F.struct(p.getField("run").alias("run"), (p.getField("no") + i).alias("no"), F.get(p.getField("cues"), i).alias("cue"), words.alias("words")))
        return F.concat(F.flatten(F.transform(lines, of_line)), of_run(p))

    def worded(s: Column, i: Column) -> Column:
        words = F.transform(s, lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
        return F.struct(i.alias("run"), words.alias("lines"), F.transform(s, lambda x: has_cue(x)).alias("cues"), has_cue(F.array_join(F.flatten(words), " "), [c for c in CUES if " " in c]).alias("across"))

    def hot(r: Column) -> Column:
        cue = F.exists(r.getField("cues"), lambda c: c)
        return bind(F.flatten(r.getField("lines")), lambda words: cue | r.getField("across") | could(words, bounds))

    def placed(runs: Column) -> Column:
        """Of the warm runs: their number and how many lines stand before them."""

        def step(acc: Column, s: Column) -> Column:
            own = F.when(warm(s), F.array(F.struct(acc.getField("run").alias("run"), acc.getField("no").alias("no"), s.alias("s")))).otherwise(F.array().cast(STARTS))
            return F.struct((acc.getField("run") + 1).alias("run"), (acc.getField("no") + F.size(pieces(s))).alias("no"), F.concat(acc.getField("out"), own).alias("out"))

        return F.aggregate(runs, F.struct(F.lit(0).alias("run"), F.lit(0).alias("no"), F.array().cast(STARTS).alias("out")), step, lambda acc: acc.getField("out"))

    def judged(runs: Column) -> Column:
        full = F.transform(placed(runs), lambda r: bind(worded(pieces(r.getField("s")), r.getField("run")), lambda w: F.struct(w.getField("run").alias("run"), r.getField("no").alias("no"), w.getField("lines").alias("lines"), w.getField("cues").alias("cues"), w.getField("across").alias("across"))))
        return F.flatten(F.transform(F.filter(full, hot), both))

    return bind(lowered, lambda t: F.when(warm(t), judged(F.split(t, r"\n(?:\s*\n)+"))).otherwise(F.array().cast(ITEMS)))


STARTS = "array<struct<run:int,no:int,s:string>>"
ITEMS = "array<struct<run:int,no:int,wrapped:boolean,cue:boolean,words:array<string>>>"


def has_cue(lowered: Column, cues: list[str] = CUES) -> Column:
    out = lowered.contains(cues[0])
    for c in cues[1:]:
        out = out | lowered.contains(c)
    return out


def bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def classify(words: Column, model: Model, confirm: float) -> Column:
    """struct<family, score, confirmed> of a paragraph's words."""
    k = len(model.classes)
    # a map is searched key by key, so the weights are dealt over small ones; a list of literals is hashed
    dealt: list[dict[str, list[float]]] = [{"": [0.0] * k} for _ in range(BUCKETS)]
    for g, w in model.weights.items():
        dealt[zlib.crc32(g.encode()) % BUCKETS][g] = w
    table = F.array(*(F.map_from_arrays(F.lit([*t]), F.array(*map(F.lit, t.values()))) for t in dealt))
    n = F.size(words)

    def gram(size: int) -> Column:
        return F.transform(F.slice(words, F.lit(1), F.greatest(n - (size - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get(words, i + j) for j in range(1, size))))

    grams = F.filter(F.array_distinct(F.concat(words, gram(2), gram(3))), lambda g: g.isin([*model.weights]))
    start = F.lit(model.bias).cast("array<double>")
    logits = F.aggregate(grams, start, lambda acc, g: bind(F.try_element_at(F.get(table, (F.crc32(g.cast("binary")) % BUCKETS).cast("int")), g), lambda w: F.when(w.isNull(), acc).otherwise(F.zip_with(acc, w, lambda a, b: a + b))))

    def decide(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / model.temperature))
        best = (F.array_position(z, top) - 1).cast("int")
        return F.struct(best.alias("no"), F.get(F.lit(model.classes), best).alias("family"), (1 / total).alias("score"))

    templates = [(model.classes.index(f), sorted(set(tokens(line)))) for f, lines in NOTICES.items() for line in lines if f in model.classes]

    def confirmed(no: Column) -> Column:
        shares = [F.when(no == f, F.size(F.array_intersect(words, F.lit(t))) / len(t)).otherwise(0.0) for f, t in templates]
        return F.array_max(F.array(*shares)) >= confirm

    return bind(bind(logits, decide), lambda d: F.struct(d.getField("family").alias("family"), d.getField("score").alias("score"), confirmed(d.getField("no")).alias("confirmed")))


def background_of(df: DataFrame, id_col: str, text_col: str, max_rows: int, max_words: int = 40) -> list[str]:
    """One paragraph of each of about max_rows documents, those with the lowest hashes of id."""
    n = df.count()
    share = int((1 << 30) * min(1.0, max_rows / n)) if n else 0
    some = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 30)) < share)
    lines = F.filter(F.split(F.col(text_col), r"\n+"), lambda s: (F.length(s) > 0) & ~has_cue(F.lower(s)))
    words = F.array_join(F.slice(F.split(F.get(lines, F.lit(0)), r"\s+"), F.lit(1), F.lit(max_words)), " ")
    return sorted(r["s"] for r in some.select(words.alias("s")).where("s is not null").collect())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, confirm: float = 0.7, max_rows: int = 400) -> DataFrame:
    """doc_id, licence, score, confirmed, n_licence_paragraphs, paragraphs.

    licence: the family of the document's surest paragraph (confirmed ones first), `unknown`
    if it has paragraphs with cues but no family, null without any. paragraphs: no:family:score
    (no: of the line it is or starts in) of each line or wrapped paragraph with a cue or a family.
    """
    background = background_of(df, id_col, text_col, max_rows)
    model = train(background)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def known(p: Column) -> Column:
        return (p.getField("c").getField("family") != UNKNOWN) & (p.getField("c").getField("score") >= threshold)

    found = paragraphs(text, keys(model, threshold, background))
    judged = F.transform(found, lambda p: F.struct(*(p.getField(c).alias(c) for c in ("run", "no", "wrapped", "cue")), classify(p.getField("words"), model, confirm).alias("c")))
    judged = F.filter(judged, lambda p: p.getField("cue") | known(p))

    def listed(j: Column) -> Column:
        """Each notice once: a wrapped paragraph beside lines that say less than it, lines otherwise."""

        def other(p: Column, test) -> Column:
            return F.exists(j, lambda q: (q.getField("run") == p.getField("run")) & (q.getField("wrapped") != p.getField("wrapped")) & test(q))

        def same(p: Column, q: Column) -> Column:
            return known(q) & (p.getField("c").getField("family") == q.getField("c").getField("family"))

        def sure(p: Column) -> Column:
            return p.getField("c").getField("confirmed")

        def stays(p: Column) -> Column:
            whole = F.when(known(p), ~other(p, lambda q: same(p, q) & (sure(q) | ~sure(p)))).otherwise(~other(p, lambda q: F.lit(True)))
            line = ~known(p) | sure(p) | ~other(p, lambda q: same(p, q) & sure(q))
            return F.when(p.getField("wrapped"), whole).otherwise(line)

        return F.filter(j, stays)

    rows = df.select(F.col(id_col).alias("doc_id"), bind(judged, listed).alias("judged"))

    def summary(j: Column) -> Column:
        sure = F.array_sort(F.transform(F.filter(j, known), lambda p: F.struct((~p.getField("c").getField("confirmed")).alias("open"), (-p.getField("c").getField("score")).alias("minus"), p.getField("no").alias("no"), p.getField("c").getField("family").alias("family"))))
        listed = F.array_join(F.transform(j, lambda p: F.concat_ws(":", p.getField("no").cast("string"), F.when(known(p), p.getField("c").getField("family")).otherwise(UNKNOWN), F.round(p.getField("c").getField("score"), 4).cast("string"))), ",")
        return F.struct(F.get(sure, F.lit(0)).alias("best"), F.size(sure).cast("long").alias("n"), F.size(j).alias("all"), listed.alias("listed"))

    rows = rows.select("doc_id", bind(F.col("judged"), summary).alias("s"))
    best = F.col("s.best")
    licence = F.when(best.isNotNull(), best.getField("family")).when(F.col("s.all") > 0, F.lit(UNKNOWN))
    return rows.select("doc_id", licence.alias("licence"), (-best.getField("minus")).alias("score"), F.coalesce(~best.getField("open"), F.lit(False)).alias("confirmed"), F.col("s.n").alias("n_licence_paragraphs"), F.col("s.listed").alias("paragraphs"))
