"""Deterministic identifiers and hashes (native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import let, trim_ws


def sha_hex(s: Column) -> Column:
    """H1: SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(s.cast("binary"), 256)


def sha(s: Column) -> Column:
    return F.unhex(sha_hex(s))


def folded(hex16: Column) -> Column:
    """The absolute value of the signed 64-bit number that 16 hex digits spell; the greatest for the least."""
    n = F.conv(hex16, 16, -10).cast("decimal(20,0)")
    return F.least(F.abs(n), F.lit("9223372036854775807").cast("decimal(20,0)")).cast("bigint")


def keyword_id(keyword: Column) -> Column:
    """H2: of a keyword, in any case and with any white space around."""
    return folded(F.substring(sha_hex(F.concat(F.lit("kw:"), F.lower(trim_ws(keyword)))), 1, 16))


def clean_path(path: Column) -> Column:
    """A path without empty and . parts and without a slash at its end; .. parts take the one before."""
    slashed = F.translate(trim_ws(path), "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    held = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(slashed.startswith("/"), "/").otherwise(""), F.array_join(held, "/"))


def project_id(path: Column, prefix: str = "project:") -> Column:
    """H3: of a cleaned path; 0 for an empty one, never 0 otherwise."""

    def number(cleaned: Column) -> Column:
        n = folded(F.substring(sha_hex(F.concat(F.lit(prefix), cleaned)), 1, 16))
        return F.when(cleaned == "", F.lit(0).cast("bigint")).otherwise(F.greatest(n, F.lit(1).cast("bigint")))

    return let(clean_path(path), number)


def uuid_of(s: Column) -> Column:
    """H4: SHA-256 in the form of a name-based UUID (version 5, RFC variant)."""
    return let(sha_hex(s), _as_uuid)


def _as_uuid(h: Column) -> Column:
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80).cast("long")), 2, "0"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def natural_id(*parts: Column) -> Column:
    """A UUID of a natural key; parts are joined by a character that none of them should have."""
    return uuid_of(F.concat_ws("\x1f", *(p.cast("string") for p in parts)))


def idempotency_key(header: Column, path: Column) -> Column:
    """H6: of a request: its header, else of its path."""
    own = trim_ws(header)
    return F.when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit("hk:"), own)).otherwise(F.concat(F.lit("path:"), F.substring(sha_hex(trim_ws(path)), 1, 16)))


def unit(vector: Column) -> Column:
    """H8: a vector of length 1 in its direction; itself if it is 0."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))

    # neither the vector nor its length is computed again for each component
    return let(vector, scaled)


def line_hash(number: Column, content: Column) -> Column:
    """Of a line of code."""
    return F.sha2(F.concat_ws("|", number.cast("string"), content), 256)


#: H9. Sizes of embedding models by name.
VECTOR_SIZES = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}


def vector_size(model: str, default: int = 1536) -> int:
    return VECTOR_SIZES.get(model, default)


def vector_size_of(model: Column, default: int = 1536) -> Column:
    """H9 for a column of model names."""
    known = F.create_map(*(F.lit(x) for pair in VECTOR_SIZES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(model, F.lit(""))), F.lit(default))
