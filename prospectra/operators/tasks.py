"""The task state machine as transforms of snapshots: state(t) and events to state(t+1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_error
from .orders import chunk_of

EXHAUSTED = "maximum attempts exceeded"
MAX_PARSE_ATTEMPTS = 5


def expire_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks whose lease ran out with no attempt left fail."""
    gone = (F.col("status") == "PROCESSING") & (F.col("lease_until") < now) & (F.col("attempt_count") >= F.col("max_attempts"))
    return tasks.withColumns({"last_error": F.when(gone, F.coalesce("last_error", F.lit(EXHAUSTED))).otherwise(F.col("last_error")), "updated_at": F.when(gone, now).otherwise(F.col("updated_at")), "status": F.when(gone, "FAILED").otherwise(F.col("status"))})


def can_claim(now: Column) -> Column:
    open_now = (F.col("status") == "PENDING") | ((F.col("status") == "PROCESSING") & (F.col("lease_until") < now))
    return (F.col("attempt_count") < F.col("max_attempts")) & open_now


def rank_claims(tasks: DataFrame, n: int, now: Column) -> DataFrame:
    """(task_id, place) of the ``n`` tasks next in line: priority, then age, then id.

    The limit comes first, a top-n that each task of Spark keeps for itself, so the window sees ``n`` rows.
    """
    order = [F.desc("priority"), "created_at", "task_id"]
    top = tasks.where(can_claim(now)).select("task_id", "priority", "created_at").orderBy(*order).limit(n)
    return top.select("task_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


def claim_tasks(tasks: DataFrame, workers: list[str], now: Column, lease_seconds: int = 900) -> DataFrame:
    """The n-th worker gets the n-th task in line; no task goes to two. Expired tasks fail first."""
    current = expire_tasks(tasks, now)
    names = F.array(*[F.lit(w) for w in workers])
    won = rank_claims(current, len(workers), now).select(F.col("task_id").alias("_task"), F.get(names, F.col("place") - 1).alias("_worker"))
    both = current.join(won, current.task_id == F.col("_task"), "left")
    hit = F.col("_task").isNotNull()
    changes = {"worker_id": F.col("_worker"), "attempt_count": F.col("attempt_count") + 1, "lease_until": now + F.make_dt_interval(secs=F.lit(lease_seconds)), "started_at": F.coalesce("started_at", now), "updated_at": now, "status": F.lit("PROCESSING")}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_task", "_worker")


def submit_tasks(tasks: DataFrame, submissions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, answers) for submissions (task_id, worker_id). A lease that ran out meanwhile doesn't matter.

    answer: completed, idempotent (it was before), not_found or conflict.
    """
    s = submissions.select(F.col("task_id").alias("_task"), F.col("worker_id").alias("_worker")).distinct()
    judged = s.join(tasks.select("task_id", "status", "worker_id"), F.col("_task") == F.col("task_id"), "left")
    answer = F.when(F.col("task_id").isNull(), "not_found").when(F.col("status") == "COMPLETED", "idempotent").when((F.col("status") == "PROCESSING") & (F.col("worker_id") == F.col("_worker")), "completed").otherwise("conflict")
    answers = judged.select(F.col("_task").alias("task_id"), F.col("_worker").alias("worker_id"), answer.alias("answer"))
    done = answers.where("answer = 'completed'").select(F.col("task_id").alias("_done")).distinct()
    both = tasks.join(done, tasks.task_id == F.col("_done"), "left")
    hit = F.col("_done").isNotNull()
    changes = {"status": F.lit("COMPLETED"), "completed_at": now, "updated_at": now, "lease_until": F.lit(None).cast("timestamp")}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_done"), answers


def fail_tasks(tasks: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Failures (task_id, worker_id, reason, retryable) of their own workers: back to PENDING while attempts are left, without a worker."""
    f = failures.groupBy("task_id", "worker_id").agg(F.min(F.struct("retryable", "reason")).alias("f")).select(F.col("task_id").alias("_task"), F.col("worker_id").alias("_worker"), "f.*")
    both = tasks.join(f, (tasks.task_id == F.col("_task")) & (tasks.worker_id == F.col("_worker")), "left")
    hit = F.col("_task").isNotNull() & (F.col("status") == "PROCESSING")
    again = F.col("retryable") & (F.col("attempt_count") < F.col("max_attempts"))
    changes = {"last_error": short_error(F.col("reason")), "updated_at": now, "lease_until": F.lit(None).cast("timestamp"), "worker_id": F.lit(None).cast("string"), "status": F.when(again, "PENDING").otherwise("FAILED")}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_task", "_worker", "retryable", "reason")


def fail_answers(tasks: DataFrame, failures: DataFrame) -> DataFrame:
    """(task_id, worker_id, answer) for failures, judged on the tasks before them: PENDING or FAILED, the state of a task
    that has ended already, not_found, or conflict where the worker doesn't hold the task."""
    f = failures.groupBy("task_id", "worker_id").agg(F.min("retryable").alias("_retryable")).select(F.col("task_id").alias("_task"), F.col("worker_id").alias("_worker"), "_retryable")
    judged = f.join(tasks.select("task_id", "status", "worker_id", "attempt_count", "max_attempts"), F.col("_task") == F.col("task_id"), "left")
    held = (F.col("status") == "PROCESSING") & F.col("worker_id").eqNullSafe(F.col("_worker"))
    after = F.when(F.col("_retryable") & (F.col("attempt_count") < F.col("max_attempts")), "PENDING").otherwise("FAILED")
    answer = F.when(F.col("task_id").isNull(), "not_found").when(held, after).when(F.col("status").isin("COMPLETED", "FAILED"), F.col("status")).otherwise("conflict")
    return judged.select(F.col("_task").alias("task_id"), F.col("_worker").alias("worker_id"), answer.alias("answer"))


def can_parse(now: Column) -> Column:
    waiting = (F.col("parse_status") == "PENDING") | ((F.col("parse_status") == "PROCESSING") & (F.col("parse_lease_until") < now))
    return (F.col("status") == "COMPLETED") & waiting


def parse_batch(tasks: DataFrame, now: Column, n: int = 20) -> DataFrame:
    """The next pages to parse, the oldest first."""
    return tasks.where(can_parse(now)).orderBy("completed_at", "task_id").limit(n)


def start_parse(tasks: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """A batch goes to PROCESSING under a lease of an hour."""
    both = tasks.join(batch.select(F.col("task_id").alias("_b")), F.col("task_id") == F.col("_b"), "left")
    hit = F.col("_b").isNotNull()
    changes = {"parse_attempts": F.col("parse_attempts") + 1, "parse_lease_until": now + F.make_dt_interval(hours=F.lit(1)), "updated_at": now, "parse_status": F.lit("PROCESSING")}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_b")


def finish_parse(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Outcomes (task_id, error or null): COMPLETED, or back to PENDING, or FAILED at the fifth attempt."""
    o = outcomes.groupBy("task_id").agg(F.max("error").alias("_error")).withColumnRenamed("task_id", "_b")
    both = tasks.join(o, F.col("task_id") == F.col("_b"), "left")
    hit = F.col("_b").isNotNull()
    status = F.when(F.col("_error").isNull(), "COMPLETED").when(F.col("parse_attempts") >= MAX_PARSE_ATTEMPTS, "FAILED").otherwise("PENDING")
    changes = {"parse_status": status, "parse_lease_until": F.lit(None).cast("timestamp"), "last_error": F.coalesce(short_error(F.col("_error")), F.col("last_error")), "updated_at": now}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_b", "_error")


def can_enrich(now: Column) -> Column:
    return (F.col("data_status") == "RAW") | ((F.col("data_status") == "ENRICHING") & (F.col("enrichment_lease_until") < now))


def enrich_batch(leads: DataFrame, now: Column, n: int = 25) -> DataFrame:
    return leads.where(can_enrich(now)).orderBy("id").limit(n)


def start_enrich(leads: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    both = leads.join(batch.select(F.col("id").alias("_b")), F.col("id") == F.col("_b"), "left")
    hit = F.col("_b").isNotNull()
    return both.withColumns({"data_status": F.when(hit, "ENRICHING").otherwise(F.col("data_status")), "enrichment_lease_until": F.when(hit, now + F.make_dt_interval(hours=F.lit(1))).otherwise(F.col("enrichment_lease_until"))}).drop("_b")


def roll_back_enrich(leads: DataFrame, failed: DataFrame) -> DataFrame:
    """Claimed leads whose batch failed become RAW again."""
    both = leads.join(failed.select(F.col("id").alias("_b")).distinct(), F.col("id") == F.col("_b"), "left")
    hit = F.col("_b").isNotNull() & (F.col("data_status") == "ENRICHING")
    return both.withColumns({"enrichment_lease_until": F.when(~hit, F.col("enrichment_lease_until")), "data_status": F.when(hit, "RAW").otherwise(F.col("data_status"))}).drop("_b")


def recover_orphans(tasks: DataFrame, worker_id: str) -> DataFrame:
    """What a worker left PROCESSING when it stopped is PENDING again."""
    hit = (F.col("status") == "PROCESSING") & (F.col("worker_id") == worker_id)
    return tasks.withColumns({"lease_until": F.when(~hit, F.col("lease_until")), "status": F.when(hit, "PENDING").otherwise(F.col("status"))})


def task_status(tasks: DataFrame, task_id: str) -> str:
    """Status of one task; an unknown id raises."""
    row = tasks.where(F.col("task_id") == task_id).select("status").first()
    if row is None:
        raise KeyError(task_id)
    return row["status"]


def tickets(tasks: DataFrame, size: int = 2) -> DataFrame:
    """Tasks in tickets of ``size``, counted within each order."""
    return chunk_of(tasks, ["task_key"], size, ["order_id"])


def contract_errors(columns: list[str]) -> Column:
    """Names of the bounds that a row breaks."""
    text = lambda c, low, high: F.when(~F.coalesce(F.length(c).between(low, high), F.lit(low == 0)), F.lit(c))
    bounds = {"task_key": (1, 256), "target_url": (1, 4096), "task_type": (0, 64), "worker_id": (1, 128), "version": (0, 128), "hostname": (0, 255), "reason": (1, 2000)}
    checks = [text(c, *b) for c, b in bounds.items() if c in columns]
    if "minimum_reviews" in columns:
        checks.append(F.when(F.col("minimum_reviews") < 0, F.lit("minimum_reviews")))
    return F.array_compact(F.array(*checks))


def batch_errors(batches: DataFrame, least: int = 1, most: int = 1000) -> DataFrame:
    """Requests (request_id, one row a task, task_key null for none) outside of 1 to 1000 tasks."""
    return batches.groupBy("request_id").agg(F.count("task_key").alias("n")).where(~F.col("n").between(least, most))
