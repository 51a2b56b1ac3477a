"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_spaced, cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Rows that one key range of one source holds on average at most.
RANGE_ROWS = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows to one row per source: source_size and target.

    Sources by code point, null last, take the weights in turn and share all words by weight. A target stops at
    ``max_epochs`` times its source's size; the excess goes to the others by weight until none is above. Filled in
    order of capacity per unit of weight, that is one pass: the level is set by the first source it doesn't fill. The
    windows without a partition run over one row per source.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("room", F.col("source_size") * F.lit(max_epochs)).withColumn("place", F.row_number().over(Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())))
    up = Window.orderBy("place")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    open_level = F.min(F.when(F.col("weight") * F.col("level") < F.col("room"), F.struct("place", "level"))).over(every)["level"]
    return per.withColumn("open_level", open_level).select("source", "source_size", F.least(F.col("room").cast("double"), F.coalesce(F.col("weight") * F.col("open_level"), F.col("room").cast("double"))).alias("target"))


def random_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of ``docs``.

    Each source's rows stand in the order of a hash of the id. The whole epochs of a source's budget (its target,
    rounded) give every document that many times; the rest goes to the first documents in that order, and the one at
    the cut gives a part, so each source's taken words equal its budget. The order is cut into even ranges of the
    hash: sums per range, then a prefix over ranges, then a prefix inside each range, so no task holds a source.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null ids share one key. Rows with equal ids
    stand by size; equal rows are interchangeable. An empty table gives no rows. Reruns agree.
    """
    sizes = cut(docs.select("doc_id", "source", count_spaced(F.col("text")).alias("size")))
    ranges = -(-max(1, sizes.count()) // range_rows)
    key = random_key(F.col("doc_id"))
    placed = sizes.withColumn("key", key).withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)))
    per = source_targets(sizes, weights, max_epochs).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("range").alias("_range"), "source_size", "target", "budget", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = ordered.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    left = F.col("budget") - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long").alias("taken"))


ORACLE = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((r - 1) % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS room FROM p),
q AS (SELECT *, row_number() OVER (ORDER BY room / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(room) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
o AS (SELECT arg_min(level, place) FILTER (WHERE weight * level < room) AS open_level FROM l),
t AS (SELECT source, source_size, least(room, coalesce(weight * (SELECT open_level FROM o), room)) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
d AS (SELECT s.doc_id, s.size, b.source_size, b.target, b.budget,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(budget - (budget // source_size) * source_size - before, size)) END::BIGINT AS taken
FROM d
"""
