"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (RE2 and Java agree on it); every other character belongs to a word.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Only a local master, where all run in one process, may go without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: computed once, no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; for a scan, the size of its files. No job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def in_low_share(key: Column, total: Column, wanted: int) -> Column:
    """Whether a signed 64-bit hash is among the lowest, such that about 8 * ``wanted`` of ``total`` rows are.

    Put before a search for the ``wanted`` lowest, it bounds what that gathers, whatever the number of tasks.
    """
    share = F.least(F.lit(1.0), F.lit(8.0 * wanted) / total)
    return (share >= 1.0) | (key.cast("double") < (share - 0.5) * F.lit(2.0**64))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that and one."""
    return df.limit(max_rows + 1).count() <= max_rows


#: Rows, and bytes of what varies in them, that are sent to all executors at most.
BROADCAST_IDS = 200_000
BROADCAST_BYTES = 16 << 20


def broadcast_ids(ids: DataFrame, weight: Column | None = None) -> DataFrame:
    """``ids``, computed already, marked for broadcast if its rows are few enough; else joins shuffle it.

    ``weight``: bytes of a row's arrays and texts, whose sum is bounded as well.
    """
    if not small_enough(ids, BROADCAST_IDS):
        return ids
    if weight is not None and (ids.agg(F.sum(weight)).first()[0] or 0) > BROADCAST_BYTES:
        return ids
    return F.broadcast(ids)


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, bound to it: after a join they stay apart from columns of equal names."""
    return [df[f"`{c}`"] for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so that loops inside don't evaluate it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_spaced(text: Column) -> Column:
    """Array of the maximal runs without white space; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def count_spaced(text: Column) -> Column:
    """Number of words of ``words_spaced`` as long, without making them."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.octet_length(F.regexp_replace(inner, f"[{SPACE}]*[^{SPACE}]+", "x")).cast("long")


def stage_dir(spark: SparkSession) -> str:
    """A new folder for a pipeline's intermediate tables, within the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}"
