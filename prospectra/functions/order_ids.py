"""Order id lists: arrays inside the engine, literals only at its edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_EMPTY = ("", "none", "null", "nan")


def clean(ids: Column) -> Column:
    """Sorted distinct ids, trimmed, without blanks and words for nothing; null: empty."""
    plain = F.transform(F.coalesce(ids, F.array().cast("array<string>")), strip)
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & ~F.lower(x).isin(*_EMPTY))))


def union(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return clean(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def union_all(ids: Column) -> Column:
    """Aggregate: all ids of a group."""
    return clean(F.flatten(F.collect_set(F.coalesce(ids, F.array().cast("array<string>")))))


def parse(text: Column) -> Column:
    """``{a,"b,c"}``, ``['a', 'b']``, ``["a"]``, ``a, b`` or one id, to an array; quoted elements may hold commas."""
    t = strip(F.coalesce(text, F.lit("")))
    inner = F.regexp_replace(t, r"(?s)^[\{\[](.*)[\}\]]$", "$1")
    raw = F.regexp_extract_all(inner, F.lit(r"""(?s)\s*"(?:[^"\\]|\\.)*"|\s*'(?:[^'\\]|\\.)*'|[^,]+"""), F.lit(0))
    bare = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"""(?s)^(["'])(.*)\1$""", "$2"), r"\\(.)", "$1"))
    return clean(F.when(t.rlike(r"^[\{\[]"), bare).otherwise(F.array(t)))


def literal(ids: Column) -> Column:
    """Array literal of the database: every element quoted, backslash and quote escaped."""
    quoted = F.transform(clean(ids), lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'([\\"])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))
