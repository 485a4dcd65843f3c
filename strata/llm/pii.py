"""Personal data by aggregated weak supervision, in DataFrame functions only.

Candidates come from strict patterns (the base, whose spans always stay) and from looser
ones. Labelers vote on each candidate: the strict pattern, shape checks, gazetteers of words that
stand before or after personal data or other numbers, and the context's junk. The votes are counted by
pattern of votes (a bounded table); expectation maximisation over those counts estimates
how reliable each labeler is and how probable it makes each pattern. A logistic
regression on votes and shape features is trained on these soft labels, again on
counted patterns, and decides on the loose candidates.

Null texts are empty: no spans. Rows that repeat are handled one by one. Other columns
are ignored. An empty table gives an empty result. Offsets count code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Quantifiers are possessive and runs are entered at their start only, which
# finds the same matches as the plain forms, in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every match of the kind passes.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z]{2,}+){1,3}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\[?\.\]?\x20?[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![0-9A-Za-z.+-])[3-6][0-9]{3}+(?:[\x20.-]?[0-9]{4}+){2}+[\x20.-]?[0-9]{1,4}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}+[\x20.-])?(?:\([0-9]{2,4}+\)\x20?|[0-9]{2,4}+[\x20.-])[0-9]{3,4}+[\x20.-][0-9]{4}+(?![0-9A-Za-z])",
}
#: As HINT: every match of the loose pattern passes.
LOOSE_HINT = {
    "email": r"(?i)(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)",
    "ip": r"[0-9]\x20?\[?\.\]?\x20?[0-9]{1,3}\x20?\[?\.",
    "card": r"[3-6][0-9]{3}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}",
    "phone": r"[0-9)][\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}",
}
# Gazetteers: words near a candidate of the kind, and words near other numbers.
BEFORE = {
    "email": r"(?i)(?:e-?mails?|mail|contact|write|reach|correo|courriel|kontakt)\W{0,4}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|client|adresse|direcci[oó]n)\W{0,4}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta)\W{0,4}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono)\W{0,4}(?:\w+\W+){0,2}$",
}
OTHER = r"(?i)(?:version|ver|isbn|issn|order|invoice|id|serial|sku|ref|section|page|token|key|hash|build|release)\W{0,4}$"
JUNK = r"[#$%&*]{3}"
DOMAIN_END = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$"
LABELERS = ("strict", "shape", "context", "other", "junk", "alone")


def _after_zeros(x: Column) -> Column:
    return F.regexp_replace(x, r"^0+(?=.)", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    back = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.coalesce(F.try_to_number(F.substring(back, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    """The check that a base match of the kind must pass."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(_after_zeros(p)) <= 3) & (F.lpad(_after_zeros(p), 3, "0") <= "255"))
    if kind == "card":
        return (F.length(digits(x)).between(12, 19)) & luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches, leftmost and not overlapping; offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    empty = F.lit(None).cast("array<struct<start:int,end:int,match:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,end:int,match:string>>")).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc.getField("at") + F.char_length(x.getField("g"))).cast("int")
        end = (start + F.char_length(x.getField("m"))).cast("int")
        return F.struct(end.alias("at"), F.concat(acc.getField("out"), F.array(F.struct(start.alias("start"), end.alias("end"), x.getField("m").alias("match")))).alias("out"))

    return F.aggregate(F.transform(both, lambda x: F.struct(x.getField("m").alias("m"), x.getField("g").alias("g"))), zero, step, lambda acc: acc.getField("out"))


SPAN = "array<struct<start:int,end:int,kind:int,match:string,strict:boolean>>"


def _spans(text: Column, kind: str, strict: bool) -> Column:
    pattern, hint = (BASE, HINT) if strict else (LOOSE, LOOSE_HINT)
    no = KINDS.index(kind)
    found = matches(text, pattern[kind])
    if strict:
        found = F.filter(found, lambda m: passes(kind, m.getField("match")))
    as_span = F.transform(found, lambda m: F.struct(m.getField("start").alias("start"), m.getField("end").alias("end"), F.lit(no).alias("kind"), m.getField("match").alias("match"), F.lit(strict).alias("strict")))
    return F.when(text.rlike(hint[kind]), as_span).otherwise(F.array()).cast(SPAN)


def _votes(text: Column, s: Column) -> Column:
    """1 for, -1 against, 0 abstains, of each labeler, as a string like '+0-..'."""
    before = F.substring(text, F.greatest(s.getField("start") - 39, F.lit(1)), F.least(s.getField("start"), F.lit(40)))
    after = F.substring(text, s.getField("end") + 1, F.lit(12))
    match, kind = s.getField("match"), s.getField("kind")
    strict = F.when(s.getField("strict"), "+").otherwise("0")
    number = F.length(digits(match))
    good = {
        "email": match.rlike(DOMAIN_END), "ip": passes("ip", F.regexp_replace(match, r"[\[\]\x20]", "")), "card": number.between(13, 19) & luhn(digits(match)), "phone": number.between(9, 12),
    }
    shape = reduce(lambda acc, k: acc.when(kind == KINDS.index(k), good[k]), KINDS, F.when(F.lit(False), F.lit(False)))
    context = reduce(lambda acc, k: acc.when(kind == KINDS.index(k), before.rlike(BEFORE[k])), KINDS, F.when(F.lit(False), F.lit(False)))
    junk = before.rlike(JUNK) | after.rlike(JUNK)
    alone = F.when(before.rlike(r"(?:^|\s)$") & after.rlike(r"^(?:$|[\s,.;:!?])"), "+").otherwise("-")
    return F.concat(strict, F.when(shape, "+").otherwise("-"), F.when(context, "+").otherwise("0"), F.when(before.rlike(OTHER), "-").otherwise("0"), F.when(junk, "-").otherwise("0"), alone)


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, base (base spans) and more (loose candidates that overlap no base span), each with votes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(_spans(text, k, True) for k in KINDS))
    loose = F.concat(*(_spans(text, k, False) for k in KINDS))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.struct(base.alias("base"), loose.alias("loose")).alias("found"))

    def apart(s: Column) -> Column:
        return ~F.exists(F.col("found.base"), lambda b: (b.getField("start") < s.getField("end")) & (s.getField("start") < b.getField("end")))

    def voted(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), s.getField("kind").alias("kind"), _votes(F.col("text"), s).alias("votes")))

    return rows.select("doc_id", voted(F.col("found.base")).alias("base"), voted(F.filter(F.col("found.loose"), apart)).alias("more"))


Counts = dict[tuple[int, str], int]


def estimate(counts: Counts, rounds: int = 50) -> tuple[dict[tuple[int, str], float], list[dict[str, tuple[float, float]]]]:
    """(probability that a pattern of votes is personal data, each labeler's P(vote | class) for (yes, no)).

    Expectation maximisation with labelers independent given the class; the strict
    labeler starts as nearly always right, the others as better than chance.
    """
    start = {"+": (0.7, 0.3), "0": (0.5, 0.5), "-": (0.3, 0.7)}
    rates = [dict(start) for _ in LABELERS]
    rates[0] = {"+": (0.9, 0.02), "0": (0.1, 0.98), "-": (0.5, 0.5)}
    prior = 0.5
    posterior: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        for key in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for labeler, vote in zip(rates, key[1], strict=True):
                yes, no = yes + math.log(labeler[vote][0]), no + math.log(labeler[vote][1])
            posterior[key] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        total = sum(counts.values()) or 1
        all_yes = sum(posterior[k] * n for k, n in counts.items())
        prior = min(0.99, max(0.01, (all_yes + 1) / (total + 2)))
        for i in range(len(LABELERS)):
            for vote in "+0-":
                held = [(posterior[k], n) for k, n in counts.items() if k[1][i] == vote]
                yes, no = sum(p * n for p, n in held), sum((1 - p) * n for p, n in held)
                rates[i][vote] = ((yes + 2 * start[vote][0]) / (all_yes + 3), (no + 2 * start[vote][1]) / (total - all_yes + 3))
    return posterior, rates


def feature_names() -> list[str]:
    return ["bias", *(f"kind={k}" for k in KINDS), *(f"{n}{v}" for n in LABELERS[1:] for v in "+-")]


def features_of(key: tuple[int, str]) -> list[float]:
    """Those of a candidate; the strict vote is left out, so that the classifier must learn from the rest."""
    kind, votes = key
    return [1.0, *(float(kind == i) for i in range(len(KINDS))), *(float(v == w) for v in votes[1:] for w in "+-")]


def train(counts: Counts, posterior: dict[tuple[int, str], float], steps: int = 400, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on soft labels, by gradient descent over counted patterns."""
    import numpy as np

    keys = sorted(counts)
    if not keys:
        return [0.0] * len(feature_names())
    x = np.array([features_of(k) for k in keys])
    y = np.array([posterior[k] for k in keys])
    n = np.array([counts[k] for k in keys], dtype=float)
    # both classes weigh the same, however few candidates are not personal data
    n = n * (y / max(1e-9, (n * y).sum()) + (1 - y) / max(1e-9, (n * (1 - y)).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 1.0 * (x.T @ (n * (p - y)) + decay * w)
    return w.tolist()


def probability(s: Column, weights: list[float]) -> Column:
    """The classifier's probability of a candidate with kind and votes."""
    total = F.lit(weights[0])
    for i in range(len(KINDS)):
        total = total + F.when(s.getField("kind") == i, F.lit(weights[1 + i])).otherwise(F.lit(0.0))
    at = 1 + len(KINDS)
    for i in range(1, len(LABELERS)):
        vote = F.substring(s.getField("votes"), i + 1, 1)
        for v in "+-":
            total = total + F.when(vote == v, F.lit(weights[at])).otherwise(F.lit(0.0))
            at += 1
    return 1 / (1 + F.exp(-total))


def kind_name(no: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), no)


def joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), s.getField("kind").alias("kind"), s.getField("end").alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", kind_name(s.getField("kind")), s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")


def fit(held: DataFrame) -> list[float]:
    """The classifier's weights, from a table of candidates."""
    one = held.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.kind", "s.votes").count()
    counts = {(r["kind"], r["votes"]): r["count"] for r in one.collect()}  # at most kinds x 3 ** labelers rows
    return train(counts, estimate(counts)[0])


def decided(weights: list[float], threshold: float = 0.8) -> Column:
    """Of the columns base and more: the base spans and the loose ones that the classifier adds, none overlapping one before."""
    added = F.filter("more", lambda s: probability(s, weights) >= threshold)
    clear = F.aggregate(added, F.array().cast("array<struct<start:int,end:int,kind:int,votes:string>>"), lambda acc, s: F.when(F.exists(acc, lambda t: (t.getField("start") < s.getField("end")) & (s.getField("start") < t.getField("end"))), acc).otherwise(F.concat(acc, F.array(s))))
    return F.concat("base", clear)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, base and all: arrays of struct(start, end, kind, votes) of the base spans, and of those and the ones that the classifier adds."""
    held = materialize(candidates(df, id_col, text_col))
    return held.select("doc_id", "base", decided(fit(held), threshold).alias("all"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """df with each span of its text replaced by its kind in brackets; null texts stay null. Candidates are found once and kept with their rows."""
    names = df.columns
    held = materialize(candidates(df.select(F.struct(*names).alias("_row"), F.col(text_col).alias("_text")), "_row", "_text"))
    rows = held.select(F.col("doc_id").alias("_row"), decided(fit(held), threshold).alias("_all"))
    own = F.col("_row").getField(text_col)
    text = F.when(own.isNull() | (F.size("_all") == 0), own).otherwise(redact(own, F.col("_all")))
    return rows.select(*(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    found = find(df, id_col, text_col)

    def of_kind(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s.getField("kind") == no)).cast("long").alias(f"n_{KINDS[no]}")

    counts = map(of_kind, range(len(KINDS)))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, kind; any order) replaced by its kind in brackets; overlapping spans count from where the last one ended."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), s.getField("kind").alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at = acc.getField("at")
        fresh = s.getField("start") >= at
        gap = F.substring(text, at + 1, F.greatest(s.getField("start") - at, F.lit(0)))
        mark = F.when(fresh, F.concat(F.lit("["), kind_name(s.getField("kind")), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(at, s.getField("end")).alias("at"), F.concat(acc.getField("out"), F.array(gap, mark)).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc.getField("out"), ""), F.substring(text, acc.getField("at") + 1, F.lit(2147483647))))
