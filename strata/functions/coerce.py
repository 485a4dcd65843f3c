"""Loose JSON, metadata and settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_or_empty(s: Column) -> Column:
    """JSON as a variant; {} for null and for what is none."""
    return F.coalesce(F.try_parse_json(s), F.parse_json(F.lit("{}")))


def flat_metadata(s: Column) -> Column:
    """A JSON object as map<string,string> without nulls; inner objects and arrays stay JSON text. Empty for what is no object."""
    return F.map_filter(F.coalesce(F.from_json(s, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())


def merge_maps(old: Column, new: Column) -> Column:
    """old's entries, with new's where both have a key."""
    a = F.coalesce(old, F.create_map().cast("map<string,string>"))
    b = F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def positive_project(meta: Column, fallback: int | None = None) -> Column:
    """metadata's project_id if it is a number above 0, else the fallback."""
    own = F.try_cast(F.get(F.array(F.try_element_at(meta, F.lit("project_id"))), F.lit(0)), "bigint") if hasattr(F, "try_cast") else F.try_element_at(meta, F.lit("project_id")).try_cast("bigint")
    return F.coalesce(F.when(own > 0, own), F.lit(fallback).cast("bigint"))


def resolved(explicit: Column, meta: Column, env: Column, default: str) -> Column:
    """C7 for columns: the explicit value if there is one, else the metadata's if it isn't blank (trimmed), else the environment's, else the default."""
    held = F.nullif(F.trim(meta), F.lit(""))
    return F.coalesce(explicit, held, env, F.lit(default))


INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"


def hits_wanted(value: Column, default: int = 5) -> Column:
    """F16 for a text column: a whole number from 1 to 100; anything else counts as not given."""
    n = F.when(value.rlike(INTEGER), F.trim(value).cast("bigint"))
    return F.when(n.between(1, 100), n).otherwise(F.lit(default).cast("bigint"))


def project_asked(value: Column) -> Column:
    """F16 for a text column: struct(id, error): null and blank ask for no project, and what is no whole number is an error."""
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    n = F.when(value.rlike(INTEGER), F.trim(value).cast("bigint"))
    return F.struct(n.alias("id"), F.when(~blank & n.isNull(), "bad_request").alias("error"))


def first_set(*values: str | None, default: str = "") -> str:
    """The first that is neither None nor blank."""
    return next((v for v in values if v and v.strip()), default)


@dataclass(frozen=True)
class RetrievalSettings:
    host: str
    port: int
    collection: str
    vector_name: str | None
    embedding_model: str
    embedding_backend: str
    embedding_address: str


#: name: (key in metadata and environment, default)
SETTINGS = {
    "host": ("VECTOR_HOST", "localhost"),
    "port": ("VECTOR_PORT", "6333"),
    "collection": ("VECTOR_COLLECTION", "strata"),
    "vector_name": ("VECTOR_NAME", ""),
    "embedding_model": ("EMBEDDING_MODEL", "text-embedding-3-small"),
    "embedding_backend": ("EMBEDDING_BACKEND", "openai"),
    "embedding_address": ("EMBEDDING_ADDRESS", "http://localhost:18789"),
}


def resolve_settings(meta: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, **explicit: object) -> RetrievalSettings:
    """An argument that isn't None, else the project's metadata, else the environment, else the default; an explicit '' as vector_name means none."""
    out: dict[str, object] = {}
    for name, (key, default) in SETTINGS.items():
        if explicit.get(name) is not None:
            value = explicit[name]
        else:
            held = (meta or {}).get(key)
            text = "" if held is None else str(held).strip()
            value = text or (env or {}).get(key, default)
        out[name] = value
    out["port"] = int(str(out["port"]))
    out["vector_name"] = out["vector_name"] or None
    return RetrievalSettings(**out)  # type: ignore[arg-type]
