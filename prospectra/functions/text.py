"""Text, id, number and time rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Trim Unicode white space, as ``trim`` trims only blanks."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def filled(x: Column) -> Column:
    """The text, or null where it is null or blank."""
    return F.nullif(strip(x), F.lit(""))


def keep_filled(items: Column) -> Column:
    """Array elements, trimmed, without blanks and nulls; null: empty."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")


def as_written(html: Column, read: list[str]) -> Column:
    """``html`` in which a reader finds every ``&`` as it is written, but for the references named in ``read``, with their semicolon."""
    return F.regexp_replace(html, f"&(?!(?:{'|'.join(read)});)", "&amp;")


def task_id(text: Column) -> Column:
    """``UNKNOWN`` for null or empty text, else the md5 of the trimmed text (blank text is not empty)."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(F.md5(strip(text).cast("binary")))


def lead_id(url: Column, name: Column, phone: Column) -> Column:
    """md5 of the trimmed url, or of ``name_phone`` where it is blank."""
    return F.md5(F.coalesce(filled(url), F.concat_ws("_", F.coalesce(name, F.lit("")), F.coalesce(phone, F.lit("")))).cast("binary"))


def priority_from_name(name: Column) -> Column:
    """The number after the last ``_`` of ``<name>_<n>.json``, kept within 1 and 10; else 1."""
    number = F.regexp_extract(F.regexp_replace(name, r"\.json$", ""), r"_\s*([+-]?\d+)\s*$", 1).try_cast("int")
    return F.when(number.isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), number)))


def safe_filename(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))


def grid_label(location: Column) -> Column:
    return F.when(location.startswith("Grid_"), F.lit("Target_Area_Export")).otherwise(location)


def tier_rank(status: Column) -> Column:
    return F.when(status == "Premium", 1).when(status == "Fallback", 2).otherwise(3)


def number_or_zero(x: Column) -> Column:
    """Integer part of a number with or without thousands commas; anything else: 0."""
    value = F.regexp_replace(strip(x.cast("string")), ",", "").try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) > 2147483647), 0).otherwise(value.cast("int"))


def first_number(x: Column) -> Column:
    """The first run of digits as an integer; none: 0."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(x.cast("string"), ",", ""), r"\d+", 0).try_cast("int"), F.lit(0))


def review_count(x: Column) -> Column:
    """``(1,234)`` to 1234; anything but digits inside: 0."""
    plain = F.translate(x, "(),", "")
    return F.when(plain.rlike("^[0-9]+$"), F.coalesce(plain.try_cast("int"), F.lit(0))).otherwise(0)


def rating_value(x: Column) -> Column:
    value = strip(x).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def one_line(x: Column) -> Column:
    """Text fit for a CSV cell: no NUL, line ends to blanks."""
    return F.regexp_replace(F.translate(x, "\0", ""), r"[\r\n]", " ")


def short_error(x: Column) -> Column:
    return F.left(x, F.lit(2000))


def iso_text(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))


def url_quote(x: Column) -> Column:
    """Form encoding that keeps ``~`` and encodes ``*``."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), [("%7E", "~"), ("*", "%2A")], F.url_encode(x))


def canonical_header(name: str) -> str:
    return name.strip().lstrip("﻿").strip().replace(" ", "_").lower()


def days_since(scraped: Column, now: Column) -> Column:
    """Whole days, 9999 where the date can't be read."""
    at = scraped.try_cast("timestamp")
    return F.coalesce(F.floor((now.cast("double") - at.cast("double")) / 86400).cast("int"), F.lit(9999))
