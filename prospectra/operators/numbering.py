"""Consecutive numbers of sorted rows without a window over a group: ranges, runs within them, and what each range takes over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch_dir


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row of a sorted range its range, its run of equal keys (column 0) and its place in that run."""
    part = TaskContext.get().partitionId()
    run, place, last = -1, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = run < 0 or key[0].as_py() != last
        runs = run + np.cumsum(new)
        start = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))
        # rows before the first new key of the batch go on with the run of the batch before
        places = np.where(start < 0, place + np.arange(batch.num_rows), np.arange(batch.num_rows) - start)
        run, place, last = int(runs[-1]), int(places[-1]) + 1, key[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(places.astype(np.int64))], names=[*batch.schema.names, "_range", "_run", "_place"])


def numbered(rows: DataFrame, within: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their number, from 0, among those of equal ``within`` by ``order``; nulls are equal, ties keep some order.

    Rows are dealt to even ranges of (within, order), so a group of any size is spread. A range numbers its own runs as it
    streams by; only its first run may go on from the range before, so the driver gets one row per range, adds up what
    each takes over, and sends that back. The ranges are written once, so both passes see the same rows.
    """
    spark = rows.sparkSession
    key = F.to_json(F.struct(*[F.col(c) for c in within]), {"ignoreNullFields": "false"}) if within else F.lit("")
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(key.alias("_key"), *[F.col(f"`{c}`") for c in rows.columns])
    dealt = keyed.repartitionByRange(ranges, "_key", *by).sortWithinPartitions("_key", *by)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    path = scratch_dir(spark)
    dealt.mapInArrow(_runs, f"{fields}, _range int, _run bigint, _place bigint").write.parquet(path)
    done = spark.read.parquet(path)
    at = F.struct("_run", "_place")
    edges = done.groupBy("_range").agg(F.min_by("_key", at).alias("first"), F.max_by("_key", at).alias("last"), F.max("_run").alias("runs"), (F.max_by("_place", at) + 1).alias("tail")).orderBy("_range").collect()
    carry, before, tail = [], None, 0
    for e in edges:
        over = tail if before is not None and e["first"] == before else 0
        carry.append((e["_range"], over))
        before, tail = e["last"], e["tail"] + (over if e["runs"] == 0 else 0)
    taken = F.broadcast(spark.createDataFrame(carry, "_range int, _over bigint"))
    number = F.col("_place") + F.when(F.col("_run") == 0, F.col("_over")).otherwise(0)
    return done.join(taken, "_range").select(*[F.col(f"`{c}`") for c in rows.columns], number.alias(name))
