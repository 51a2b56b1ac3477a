"""Final rows: typed from text, with the list of columns that don't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order_ids import parse
from ..functions.text import one_line, strip
from ..schemas import LEAD

_TRUE, _FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")


def to_boolean(x: Column) -> Column:
    t = F.lower(strip(x))
    return F.when(t.isin(*_TRUE), True).when(t.isin(*_FALSE), False)


def to_integer(x: Column) -> Column:
    """Whole numbers, with or without thousands commas or a zero fraction."""
    t = F.regexp_replace(strip(x), ",", "")
    value = t.try_cast("double")
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.0*)?$") & (F.abs(value) <= 2147483647), value.cast("int"))


def to_real(x: Column) -> Column:
    value = F.regexp_replace(strip(x), ",", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_clock(x: Column) -> Column:
    """Timestamp with its clock kept and its offset dropped."""
    return F.regexp_replace(strip(x), r"\s*(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def to_json(x: Column, kind: str) -> Column:
    """Compact JSON text of the wanted kind (``[`` or ``{``), else null."""
    t = strip(x)
    return F.when(t.startswith(kind) & F.try_parse_json(t).isNotNull(), F.to_json(F.try_parse_json(t)))


def _value(f: T.StructField) -> Column | None:
    """The typed value of a text column, null where it doesn't fit; None for columns that any text fits."""
    raw = F.col(f"`{f.name}`")
    if f.name in ("tags", "raw_extracted"):
        return to_json(raw, "[" if f.name == "tags" else "{")
    rule = {T.BooleanType: to_boolean, T.IntegerType: to_integer, T.DoubleType: to_real, T.TimestampType: to_clock}.get(type(f.dataType))
    return None if rule is None else rule(raw)


def errors() -> Column:
    """Names of the columns whose value isn't blank and doesn't fit."""
    checks = [(f.name, v) for f in LEAD.fields if (v := _value(f)) is not None]
    return F.array_compact(F.array(*[F.when((F.coalesce(strip(F.col(f"`{n}`")), F.lit("")) != "") & v.isNull(), F.lit(n)) for n, v in checks]))


def typed(f: T.StructField) -> Column:
    """Blank values are empty text, or null in other types; blank JSON is an empty list or object.

    ``tags`` and ``raw_extracted`` stay JSON text, as at the sink.
    """
    raw, value = F.col(f"`{f.name}`"), _value(f)
    if f.name == "order_ids":
        return parse(raw).alias(f.name)
    if f.name in ("tags", "raw_extracted"):
        return F.coalesce(value, F.lit("[]" if f.name == "tags" else "{}")).alias(f.name)
    return (F.coalesce(one_line(raw), F.lit("")) if value is None else value).alias(f.name)


def check_columns(rows: DataFrame) -> None:
    """Missing or unexpected columns raise."""
    if missing := [c for c in LEAD.fieldNames() if c not in rows.columns]:
        raise ValueError(f"missing required columns: {missing}")
    if extra := [c for c in rows.columns if c not in LEAD.fieldNames()]:
        raise ValueError(f"unexpected columns: {extra}")


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, refused rows as they came with ``reason``). Missing or unexpected columns raise."""
    check_columns(rows)
    judged = rows.withColumn("_errors", errors())
    good = judged.where(F.size("_errors") == 0).select(*[typed(f) for f in LEAD.fields])
    return good, judged.where(F.size("_errors") > 0).drop("_errors").withColumn("reason", F.lit("final_schema_validation_failed"))
