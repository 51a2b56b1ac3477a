"""Registered queries of incremental runs: keyed stream state and the lead store, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lead_store import LeadStore
from ..sources.shared import scratch_dir
from ..streaming import state
from .catalogue import _LEADS_SQL, _MATCH_SQL, _lead_tables, register, table
from .more import _lead_rows

#: Where the events are cut into batches.
_CUTS = ["2024-01-11", "2024-01-21"]


def in_batches(spark: SparkSession, rows: DataFrame, at: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` makes of a stream of ``rows``: each batch arrives and is processed by a run that starts where the last ended.

    Keyed state has as many parts as there are cores, fixed with the first run, as every part costs each batch a task.
    """
    folder, name = scratch_dir(spark), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        return _run_batches(spark, rows, at, step, folder)
    finally:
        spark.conf.set(name, before)


def _run_batches(spark: SparkSession, rows: DataFrame, at: str, step: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    edges = [None, *map(F.lit, _CUTS), None]
    out = None
    for low, high in zip(edges, edges[1:]):
        inside = (F.lit(True) if low is None else F.col(at) >= low.cast("timestamp")) & (F.lit(True) if high is None else F.col(at) < high.cast("timestamp"))
        rows.where(inside).write.mode("append").parquet(f"{folder}/in")
        out = step(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def task_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events of tasks, tasks): a task per user; clicks claim, views submit, purchases fail; two workers take turns."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "submit").when(F.col("event_type") == "purchase", "fail")
    events = e.select((F.concat(F.lit("t"), "user_id")).alias("task_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), kind.alias("event"), F.concat(F.lit("w"), k % 2).alias("worker_id"), (k % 4 != 0).alias("retryable")).where("event IS NOT NULL")
    u = F.col("user_id")
    tasks = e.select("user_id").distinct().where(u % 7 != 0).select(F.concat(F.lit("t"), u).alias("task_id"), F.when(u % 5 == 0, "COMPLETED").otherwise("PENDING").alias("status"), F.lit(None).cast("string").alias("worker_id"), F.lit(0).alias("attempt_count"), F.when(u % 3 == 0, 2).otherwise(4).alias("max_attempts"), F.lit(None).cast("timestamp").alias("lease_until"))
    return events, tasks


@register(
    """WITH RECURSIVE e AS (SELECT event_id, user_id AS u, ts, event_type AS kind, 'w' || (event_id % 2) AS w, event_id % 4 <> 0 AS again, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view', 'purchase')),
f AS (SELECT user_id AS u, 0::BIGINT AS k, CASE WHEN user_id % 5 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS st, NULL::VARCHAR AS wk, 0 AS n, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 4 END AS most, NULL::TIMESTAMP AS lease, NULL::BIGINT AS event_id, NULL::VARCHAR AS answer FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0)
  UNION ALL
  SELECT u, k, CASE WHEN kind = 'click' THEN CASE WHEN can THEN 'PROCESSING' ELSE s END WHEN NOT held THEN s WHEN kind = 'view' THEN 'COMPLETED' WHEN again AND n < most THEN 'PENDING' ELSE 'FAILED' END,
    CASE WHEN kind = 'click' AND can THEN w WHEN kind = 'purchase' AND held THEN NULL ELSE wk END, CASE WHEN kind = 'click' AND can THEN n + 1 ELSE n END, most,
    CASE WHEN kind = 'click' AND can THEN ts + INTERVAL 2 DAY WHEN kind <> 'click' AND held THEN NULL ELSE lease END, event_id,
    CASE WHEN kind = 'click' THEN CASE WHEN can THEN 'claimed' ELSE 'conflict' END WHEN kind = 'view' THEN CASE WHEN s = 'COMPLETED' THEN 'idempotent' WHEN held THEN 'completed' ELSE 'conflict' END
      WHEN held THEN CASE WHEN again AND n < most THEN 'PENDING' ELSE 'FAILED' END WHEN s IN ('COMPLETED', 'FAILED') THEN s ELSE 'conflict' END
  FROM (SELECT *, n < most AND (s = 'PENDING' OR (s = 'PROCESSING' AND lease < ts)) AS can, s = 'PROCESSING' AND wk = w AS held FROM (
    SELECT f.u, e.k, e.kind, e.w, e.again, e.ts, e.event_id, f.wk, f.n, f.most, f.lease, CASE WHEN f.st = 'PROCESSING' AND f.lease < e.ts AND f.n >= f.most THEN 'FAILED' ELSE f.st END AS s FROM f JOIN e ON e.u = f.u AND e.k = f.k + 1)))
SELECT event_id, answer, st AS status, n::INT AS attempt_count FROM f WHERE k > 0
UNION ALL SELECT event_id, 'not_found', NULL, NULL FROM events WHERE user_id % 7 = 0 AND event_type IN ('click', 'view', 'purchase')"""
)
def task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the task state machine to a stream of events in three batches, from the task table as it was."""
    events, tasks = task_events(spark, sf_dir)
    answers = in_batches(spark, events, "at", lambda stream: state.run_tasks(stream, tasks, lease_seconds=2 * 86400))
    return answers.where("event_id IS NOT NULL").select("event_id", "answer", "status", "attempt_count")


@register("SELECT user_id::VARCHAR AS id, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id, min_by(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events WHERE user_id % 4 <> 0 GROUP BY user_id")
def seeded_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user that the buffer doesn't hold, by a stream in three batches without a watermark."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    buffered = e.where("user_id % 4 = 0").select(F.col("user_id").cast("string").alias("id")).distinct()
    return in_batches(spark, rows, "at", lambda stream: state.first_seen_stream(stream, "id", ["at", "event_id"], buffered)).select("id", "event_id", "event_type")


@register(
    """WITH e AS (SELECT event_id, 'd' || user_id AS domain, CASE WHEN event_id % 2 = 0 THEN 'mx' ELSE 'ssl' END AS kind, ts, event_type IN ('click', 'signup') AS put FROM events)
SELECT g.event_id, g.domain, CASE WHEN p.ts >= g.ts - INTERVAL 60 HOUR THEN 'p' || p.event_id END AS payload, coalesce(p.ts >= g.ts - INTERVAL 60 HOUR, false) AS hit
FROM (SELECT * FROM e WHERE NOT put) g ASOF LEFT JOIN (SELECT * FROM e WHERE put) p ON g.domain = p.domain AND g.kind = p.kind AND g.ts >= p.ts"""
)
def cached_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored checks of a domain asked for and written in a stream of three batches, with a time to live of 60 hours."""
    e = table(spark, sf_dir, "events")
    put = F.col("event_type").isin("click", "signup")
    rows = e.select(F.concat(F.lit("d"), "user_id").alias("domain"), F.when(F.col("event_id") % 2 == 0, "mx").otherwise("ssl").alias("check_type"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.when(put, "put").otherwise("get").alias("event"), F.when(put, F.concat(F.lit("p"), "event_id")).alias("payload"))
    return in_batches(spark, rows, "at", lambda stream: state.cache_stream(stream, ttl_days=2.5)).select("event_id", "domain", "payload", "hit")


@register(
    f"""WITH {_LEADS_SQL}, {_MATCH_SQL}, r AS (
SELECT m.id, coalesce(nullif(s.url, ''), m.url) AS url, coalesce(nullif(s.phone, ''), m.phone) AS phone, coalesce(nullif(s.name, ''), m.name) AS name, coalesce(s.category, m.category) AS category
FROM m LEFT JOIN b ON m.id = b.m_id LEFT JOIN s ON s.id = b.s_id UNION ALL SELECT id, url, phone, name, category FROM a)
SELECT id, url, phone, CASE WHEN id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 50 = 1 AND c_custkey % 3 <> 0) THEN 'z' || id ELSE name END AS name, category FROM r"""
)
def stored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads merged into the bucketed store: a batch that runs twice, as after a failure, and a small one with repeated ids."""
    master, staging = (_lead_rows(x) for x in _lead_tables(spark, sf_dir))
    store = LeadStore(spark, scratch_dir(spark), buckets=8)
    store.apply(master, 0)
    for _ in range(2):
        store.apply(staging, 1)
    few, k = table(spark, sf_dir, "customer").where("c_custkey % 50 = 1 AND c_custkey % 3 <> 0"), F.col("c_custkey").cast("string")
    named = lambda name, day: few.select(k.alias("id"), F.lit("").alias("url"), F.lit("").alias("phone"), F.concat(F.lit(name), k).alias("name"), F.lit(day).cast("timestamp").alias("last_updated_date"))
    store.apply(_lead_rows(named("z", "2024-02-02").unionByName(named("y", "2024-02-01"))), 2)
    return store.leads().select("id", "url", "phone", "name", "category")
