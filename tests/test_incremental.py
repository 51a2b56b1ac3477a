"""Keyed stream state against the batch transforms, and the lead store: what a batch writes, replays, clean-up."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prospectra.operators import merge, tasks
from prospectra.operators.lead_store import LeadStore
from prospectra.schemas import LEAD, LEAD_COLUMNS, TASK
from prospectra.streaming import state

NOW = datetime(2024, 3, 1)


def micros(at):
    return None if at is None else pd.Timestamp(at).value // 1000


def test_one_step_is_the_batch_transform(spark):
    """300 tasks in every state get one submission or failure each, by a step and by the transforms of the whole table."""
    rng = random.Random(2)
    rows, events = [], []
    for k in range(300):
        status = rng.choice(["PENDING", "PROCESSING", "PROCESSING", "COMPLETED", "FAILED"])
        worker = rng.choice(["a", "b"]) if status in ("PROCESSING", "COMPLETED") else None
        lease = NOW + timedelta(minutes=rng.choice([-9, 9])) if status == "PROCESSING" else None
        attempts = rng.randint(0, 3)
        rows.append({**dict.fromkeys(TASK.fieldNames()), "task_id": f"t{k}", "status": status, "worker_id": worker, "attempt_count": attempts, "max_attempts": 3, "lease_until": lease})
        events.append((f"t{k}", rng.choice(["submit", "fail"]), rng.choice(["a", "b"]), rng.random() < 0.7))
    table = tasks.expire_tasks(spark.createDataFrame(rows, TASK), F.lit(NOW)).cache()
    sent = spark.createDataFrame(events, "task_id string, event string, worker_id string, retryable boolean")
    submissions, failures = sent.where("event = 'submit'"), sent.where("event = 'fail'").withColumn("reason", F.lit("r"))
    after, answers = tasks.submit_tasks(table, submissions, F.lit(NOW))
    after = tasks.fail_tasks(after, failures, F.lit(NOW))
    want = {r["task_id"]: (r["status"], r["worker_id"], r["attempt_count"]) for r in after.collect()}
    told = {r["task_id"]: r["answer"] for r in answers.select("task_id", "answer").union(tasks.fail_answers(table, failures).select("task_id", "answer")).collect()}
    machine = state.TaskMachine(900, 3)
    for row, (task_id, event, worker, retryable) in zip(rows, events):
        given = (row["status"], row["worker_id"], row["attempt_count"], row["max_attempts"], micros(row["lease_until"]), None)
        answer, task = machine.step(given, SimpleNamespace(at=NOW, event=event, worker_id=worker, retryable=retryable))
        assert (answer, (task[0], task[1], task[2])) == (told[task_id], want[task_id]), (given, event, worker, retryable)
    table.unpersist()


EVENTS = "task_id string, event_id bigint, at timestamp, event string, worker_id string, retryable boolean"


def run(spark, tmp_path, batches, schema, step):
    """Each batch is a run of its own that goes on from the checkpoint of the one before."""
    out = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = step(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_tasks_over_restarts(spark, tmp_path):
    at = lambda m: NOW + timedelta(minutes=m)
    event = lambda task, k, m, kind, worker="w": (task, k, at(m), kind, worker, True)
    start = spark.createDataFrame([("a", "PENDING", None, 0, 1, None), ("b", "PENDING", None, 0, 2, None), ("c", "PROCESSING", "w", 1, 1, at(-5))], "task_id string, status string, worker_id string, attempt_count int, max_attempts int, lease_until timestamp")
    batches = [
        [event("a", 1, 0, "claim"), event("b", 2, 1, "claim"), event("b", 3, 2, "fail"), event("x", 4, 2, "claim")],
        [event("b", 6, 30, "claim", "v"), event("a", 7, 31, "submit"), event("b", 5, 29, "submit", "v")],
        # 8 is older than what b has seen: in a later batch it changes nothing
        [event("b", 8, 20, "fail", "v"), event("b", 9, 40, "submit", "v"), event("c", 10, 41, "submit")],
    ]
    got = run(spark, tmp_path, batches, EVENTS, lambda stream: state.run_tasks(stream, start, delay="1 hour"))
    assert {r["event_id"]: (r["answer"], r["status"]) for r in got if r["event_id"] is not None} == {
        1: ("claimed", "PROCESSING"), 2: ("claimed", "PROCESSING"), 3: ("PENDING", "PENDING"), 4: ("not_found", None), 5: ("conflict", "PENDING"), 6: ("claimed", "PROCESSING"),
        7: ("conflict", "FAILED"), 8: ("late", "PROCESSING"), 9: ("completed", "COMPLETED"), 10: ("conflict", "FAILED"),
    }


def test_a_lease_ends_by_its_timer(spark, tmp_path):
    at = lambda m: NOW + timedelta(minutes=m)
    start = spark.createDataFrame([("a", "PENDING", None, 0, 1, None), ("b", "PENDING", None, 0, 1, None)], "task_id string, status string, worker_id string, attempt_count int, max_attempts int, lease_until timestamp")
    batches = [[("a", 1, at(0), "claim", "w", True), ("b", 2, at(0), "claim", "w", True), ("b", 3, at(1), "submit", "w", True)], [("b", 4, at(60), "submit", "w", True)]]
    got = run(spark, tmp_path, batches, EVENTS, lambda stream: state.run_tasks(stream, start))
    assert [(r["task_id"], r["at"], r["status"]) for r in got if r["answer"] == "expired"] == [("a", at(15), "FAILED")]
    assert {r["event_id"]: r["answer"] for r in got if r["event_id"] is not None} == {1: "claimed", 2: "claimed", 3: "completed", 4: "idempotent"}


def test_first_seen_with_a_seed(spark, tmp_path):
    seen = spark.createDataFrame([("s",), ("s",), ("",), (None,)], "id string")
    batches = [[("a", 2, "x"), ("a", 1, "y"), ("s", 0, "z"), ("", 1, "q"), (None, 1, "q")], [("a", 0, "late"), ("b", 5, "b"), ("b", 5, "b")]]
    got = run(spark, tmp_path, batches, "id string, n int, v string", lambda stream: state.first_seen_stream(stream, "id", ["n", "v"], seen))
    assert sorted(map(tuple, got)) == [("a", 1, "y"), ("b", 5, "b")]


def test_cache_lives_as_long_as_its_last_put(spark, tmp_path):
    at = lambda h: NOW + timedelta(hours=h)
    put = lambda k, h, v: ("d", "mx", k, at(h), "put", v)
    get = lambda k, h: ("d", "mx", k, at(h), "get", None)
    batches = [[get(1, -1), put(2, 0, "a"), get(3, 24), put(4, -2, "old")], [get(5, 25), put(6, 30, "b"), get(7, 54)], [get(8, 54.1)]]
    got = run(spark, tmp_path, batches, "domain string, check_type string, event_id bigint, at timestamp, event string, payload string", lambda stream: state.cache_stream(stream, ttl_days=1))
    assert {r["event_id"]: (r["payload"], r["hit"]) for r in got} == {1: ("old", True), 3: ("a", True), 5: (None, False), 7: ("b", True), 8: (None, False)}


def leads(spark, rows):
    return spark.createDataFrame([{**dict.fromkeys(LEAD_COLUMNS), **r} for r in rows], LEAD)


def rows_of(df):
    return sorted(map(repr, df.select("id", "url", "phone", "name").collect()))


@pytest.fixture(scope="module")
def many():
    return [{"id": f"{k}", "url": f"u{k}" if k % 3 else "", "phone": f"p{k}", "name": f"n{k}"} for k in range(400)]


def test_a_small_batch_writes_few_buckets(spark, tmp_path, many):
    store = LeadStore(spark, str(tmp_path / "s"), 64)
    assert store.leads().count() == 0
    store.apply(leads(spark, many), 0)
    # by id, by a known url under another id, by a known phone with a blank url, and a new lead
    batch = leads(spark, [{"id": "7", "name": "by id", "url": "u7b"}, {"id": "new1", "url": "u100", "name": "by url"}, {"id": "new2", "url": "", "phone": "p200", "name": "by phone"}, {"id": "new3", "url": "u-new", "phone": "p-new", "name": "added"}])
    wrote = store.apply(batch, 1)
    assert wrote["leads"] <= 7 and wrote["url"] <= 3 and wrote["phone"] <= 1
    want = merge.merge_leads(leads(spark, many), batch)
    assert rows_of(store.leads()) == rows_of(want) and want.count() == 401
    # the moved url is found under its new value, no longer under the old one
    store.apply(leads(spark, [{"id": "other", "url": "u7b", "name": "moved"}, {"id": "free", "url": "u7", "name": "free"}]), 2)
    after = {r["id"]: r["name"] for r in store.leads().collect()}
    assert after["7"] == "moved" and after["free"] == "free" and "other" not in after


def test_a_replayed_batch_changes_nothing(spark, tmp_path, many):
    store = LeadStore(spark, str(tmp_path / "s"), 8)
    store.apply(leads(spark, many[:50]), 0)
    one, two = leads(spark, [{"id": "3", "name": "x", "url": "moved"}, {"id": "z", "url": "uz", "name": "z"}]), leads(spark, [{"id": "zz", "url": "uz", "name": "again"}])
    store.apply(one, 1)
    store.apply(two, 2)
    first = rows_of(store.leads())
    store.apply(two, 2)
    assert rows_of(store.leads()) == first
    # a batch that stopped before its manifest leaves readers the state before it
    leads(spark, [{"id": "torn"}]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(str(tmp_path / "s" / "leads" / "v=3"))
    assert rows_of(store.leads()) == first
    assert store.vacuum(keep=1) > 0 and rows_of(store.leads()) == first
    assert (tmp_path / "s" / "leads" / "v=3").exists() and store.vacuum(keep=1) == 0
