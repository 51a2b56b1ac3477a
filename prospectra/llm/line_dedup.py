"""Line dedup: windows of three lines that occur earlier anywhere in the corpus are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_ids, cut, let, own_columns

LINES = 3


def _lines(text: Column) -> Column:
    """The lines of ``text`` that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """(_id, _mark, pos, hash) of each window; _mark tells rows of one id apart by text. Scans only id and text."""
    starts = F.sequence(F.lit(0), F.size("_lines") - lines)
    digest = F.transform(starts, lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("_lines", i + 1, lines)).cast("binary"))))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), _lines(F.col("text")).alias("_lines")).where(F.size("_lines") >= lines).select("_id", "_mark", F.posexplode(digest).alias("pos", "hash"))


def covered_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(_id, _mark, _gone): for each document with a later occurrence of a window, the covered line numbers.

    A window's first occurrence is the least (doc_id, hash of the text, position). Counting and finding the first are
    one partial aggregate, so a window in a third of all documents costs a row per task; only documents' own lines are
    gathered. The join back is on the window's hash with one row each on the repeated side, which AQE can split.
    """
    windows = _windows(docs, lines)
    at = F.struct("_id", "_mark", "pos")
    repeated = windows.groupBy("hash").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").select("hash", "first")
    later = windows.join(repeated, "hash").where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_mark").agg(F.collect_set("pos").alias("at")).select("_id", "_mark", F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (lines - 1))))).alias("_gone"))


def _without(lines: Column, gone: Column) -> Column:
    """The text left of ``lines`` without those at the numbers ``gone``; one pass over a set, for any number of both."""
    return let(lines, lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), gone), lambda i: F.get(a, i)), "\n"))


def dedup_lines(docs: DataFrame, lines: int = LINES, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` rid of later occurrences of windows of ``lines`` consecutive lines, and two counts.

    A line without a word is not counted as a line. Covered positions of all later windows merge, also where they
    overlap. A document that loses nothing keeps its text as it is; another keeps its remaining lines, joined by one
    newline, or the empty text. Documents of fewer lines have no window. Null text stays null; null ids come first in
    order; rows that repeat id and text count as one occurrence and are treated alike. Added columns, unless ``counts``
    is false: ``_n_lines`` and ``_n_removed`` (long), which replace columns of these names. All others pass through
    unchanged, whatever their names.
    """
    # few documents lose lines: the texts then stay where they are
    gone = broadcast_ids(cut(covered_lines(docs, lines)), 4 * F.size("_gone"))
    joined = docs.join(gone, F.xxhash64(docs.text).eqNullSafe(gone["_mark"]) & docs.doc_id.eqNullSafe(gone["_id"]), "left")
    at = gone["_gone"]
    left = F.when(at.isNull(), docs.text).otherwise(_without(_lines(docs.text), at)).alias("text")
    added = {"_n_lines": F.size(_lines(docs.text)), "_n_removed": F.coalesce(F.size(at), F.lit(0))} if counts else {}
    own = [left if name == "text" else column for name, column in zip(docs.columns, own_columns(docs)) if name not in added]
    return joined.select(*own, *[value.cast("long").alias(name) for name, value in added.items()])


ORACLE = r"""
WITH l AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
h AS (SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS win FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS r FROM h),
c AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS gone FROM f WHERE r > 1 GROUP BY doc_id)
SELECT l.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM l LEFT JOIN c ON l.doc_id = c.doc_id
"""
