"""Sentence splitting with protected spans, natively.

A span (a link, an address, a version ..) is kept whole by writing the signs in it that could
end a sentence as noncharacters; after the split they are turned back. Spans are looked
for in one run of text without white space (or with that of a link) at a time, so the work
grows with the text and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import SPACE, hangul_ratio, let, sentences, trim_ws

# Spans in which a full stop ends no sentence, and what may not stand before and after them.
SPANS = [
    (r"!?\[[^\]]*+\]\([^)]*+\)", "", ""),
    (r"(?i)(?:[A-Z0-9_.*-]++/)*+[A-Z0-9_.*-]+\.(?:md|go|py|txt|yml|yaml|json|proto)(?![A-Z0-9_])", r"[\p{L}\p{Nd}._-]$", ""),
    (r"https?://[^\s\]>]++", "", ""),
    (r"[0-9]++\.[0-9]++\.[0-9]++(?:~[0-9]++\.[0-9]++\.[0-9]++)?+", r"[\p{L}\p{Nd}._]$", r"^[\p{Nd}.]"),
    (r"(?<![A-Za-z0-9_])v[0-9]+(?:\.[0-9]+)++", "", ""),
    (r"[0-9]++\.[0-9]++", "", ""),
    (r"(?i)(?<![A-Z0-9_])(?:e\.g\.|i\.e\.|etc\.)", "", ""),
]
LIST_MARK = r"(?m)^(\s{0,3}[0-9]+)\.(?=\s|\z)"
#: For each of SPANS, a sign that a text with such a span has (looked for before the span is).
SIGN_OF = [r"\]\(", r"(?i)\.(?:md|go|py|txt|yml|yaml|json|proto)", r"https?://", r"[0-9]\.[0-9]", r"v[0-9]++\.[0-9]", r"[0-9]\.[0-9]", r"(?i)(?:e\.g|i\.e|etc)\."]
#: Runs without white space, but for that within links; none of the spans (list marks are apart) goes over the border of two.
RUN = r"(?:\[[^\]]*+\]\([^)]*+\)|[^\s\[]++|\[++)++"
#: Texts and runs that may have a span: looked for from the sign that each has, as few signs are one.
MAY_PROTECT = r"(?i)[.:(](?:(?<=\]\()|(?<=https?:)//|(?<=[0-9]\.)[0-9]|(?<=\.)(?:md|go|py|txt|yml|yaml|json|proto)|(?<=[ei]\.)[ge]\.|(?<=etc\.))"

#: Signs at which texts are cut, and the noncharacters that stand for them in protected spans.
SIGNS = ".!?。！？…\n"
STAND_INS = "".join(chr(0xFDD0 + i) for i in range(len(SIGNS)))
CUT = chr(0xFDDF)
HAS_STAND_INS = f"[{STAND_INS[0]}-{STAND_INS[-1]}]"
ENDS = "[.!?。！？…]"
CLOSERS = r"[\"'”’»)\]]"
#: Words before a full stop that ends no sentence (fixed values).
TITLES = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|No|Fig|Inc|Ltd|Corp|approx|dept|al|cf"


def _found(s: Column, pattern: str, not_before: str, not_after: str) -> Column:
    """Spans (start, end; from 0) of a pattern in s, one after the other."""
    parts = F.arrays_zip(F.split(s, pattern, -1).alias("gap"), F.regexp_extract_all(s, F.lit(f"({pattern})"), 1).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        ok = p["hit"].isNotNull()
        if not_before:
            ok = ok & ~F.substring(s, F.greatest(start, F.lit(1)), F.when(start > 0, 1).otherwise(0)).rlike(not_before)
        if not_after:
            ok = ok & ~F.substring(s, end + 1, F.lit(1)).rlike(not_after)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.concat(acc["out"], F.when(ok, span).otherwise(none)).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def spans_of(s: Column) -> Column:
    """The spans (start, end) of a run that stay whole: the longest first, of equal ones the first, and none that overlaps one before; by place."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    every = F.flatten(F.array(*(F.when(s.rlike(sign), _found(s, *kind)).otherwise(none) for sign, kind in zip(SIGN_OF, SPANS, strict=True))))
    by_length = F.array_sort(F.transform(every, lambda x: F.struct((x["start"] - x["end"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"))))

    def step(acc: Column, x: Column) -> Column:
        over = F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(over, acc).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.array_sort(F.aggregate(by_length, F.array().cast("array<struct<start:int,end:int>>"), step))


def _shielded(s: Column) -> Column:
    return F.translate(s, SIGNS, STAND_INS)


def _protect_run(s: Column) -> Column:
    """A run with the signs in its spans written as their stand-ins, which leaves all places as they are."""

    def step(acc: Column, x: Column) -> Column:
        n = x["end"] - x["start"]
        return F.concat(F.substring(acc, F.lit(1), x["start"]), _shielded(F.substring(acc, x["start"] + 1, n)), F.substring(acc, x["end"] + 1, F.lit(2147483647)))

    return F.aggregate(spans_of(s), s, step)


def _each(s: Column, pattern: str, change) -> Column:
    """s with each match of a pattern changed."""
    parts = F.zip_with(F.split(s, pattern, -1), F.transform(F.regexp_extract_all(s, F.lit(f"({pattern})"), 1), change), lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    return F.array_join(parts, "")


def protect(text: Column) -> Column:
    """The text with the signs in its protected spans, and the stop of a list mark, written as stand-ins."""

    def by_run(marked: Column) -> Column:
        return F.when(marked.rlike(MAY_PROTECT), _each(marked, RUN, lambda run: F.when(run.rlike(MAY_PROTECT), let(run, _protect_run)).otherwise(run))).otherwise(marked)

    return let(F.regexp_replace(text, LIST_MARK, f"$1{STAND_INS[0]}"), by_run)


def restore(text: Column) -> Column:
    """Stand-ins turned back (those that were in the text already too)."""
    return F.translate(text, STAND_INS, SIGNS)


def unify(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), lambda s: trim_ws(restore(s))), lambda s: s != "")


def _kept_parts(text: Column) -> Column:
    """Parts with their ends: cut at white space behind an end, and at blank lines."""
    return _parts(F.regexp_replace(text, rf"({ENDS}){SPACE}+", f"$1{CUT}"), rf"{CUT}|\n{{2,}}")


def masked_sentences(text: Column, keep_ends: bool = False) -> Column:
    """The sentences of a text column, without their ends (or with them; then blank lines end sentences too); null texts have none."""

    def split(whole: Column) -> Column:
        special = whole.rlike(MAY_PROTECT) | whole.rlike(LIST_MARK) | whole.rlike(HAS_STAND_INS)
        if keep_ends:
            return let(F.when(special, protect(whole)).otherwise(whole), _kept_parts)
        return F.when(special, let(protect(whole), lambda t: _parts(t, f"{ENDS}+"))).otherwise(sentences(whole))

    return let(unify(text), split)


def segments(text: Column) -> Column:
    """A rule segmenter: sentences with their ends and the quotes or brackets that close behind them; lines end sentences too.

    No sentence ends within straight quotes on one line, after a title or an initial before a
    capital letter, or at dots that a small letter follows.
    """
    hidden = _each(text, "\"[^\"\n]*+\"", lambda q: F.concat(_shielded(F.substring(q, F.lit(1), F.greatest(F.length(q) - 2, F.lit(0)))), F.right(q, F.least(F.length(q), F.lit(2)))))
    quoted = F.when(text.contains('"'), hidden).otherwise(text)
    # both look back from the stop, as there are fewer stops than words
    calm = F.regexp_replace(quoted, rf"\.(?<=(?<![\p{{L}}\p{{N}}_])(?i:{TITLES})\.)(?=\s)", STAND_INS[0])
    calm = F.regexp_replace(calm, r"\.(?<=(?<![\p{L}\p{N}_.])\p{Lu}\.)(?=\s+\p{Lu})", STAND_INS[0])
    calm = F.regexp_replace(calm, r"\.{2,}(?=\s+\p{Ll})", STAND_INS[0] * 3)
    return F.when(quoted.isNotNull(), _parts(F.regexp_replace(calm, rf"({ENDS}{CLOSERS}{{0,3}}){SPACE}+", "$1\n"), r"\n+"))


def language_aware(text: Column, hangul_from: float = 0.12) -> Column:
    """Sentences with their ends; texts in which Hangul makes up less than `hangul_from` by the rules of `segments`, others at ends and blank lines. Protected spans stay whole."""
    return let(protect(unify(text)), lambda t: F.when(hangul_ratio(t) >= hangul_from, _kept_parts(t)).otherwise(segments(t)))
