"""Keyed state in streams: the task state machine, first-seen rows and a cache with a time to live.

Each keeps its state by key under ``transformWithState``, so batches touch only the keys that have rows, and a restarted
stream goes on where its checkpoint ended. Most keys have few rows in a batch, so they come as rows: a pandas frame for
each key costs far more than its rows. All decisions follow the rows' own times, never the clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store in place of the default; another that the session names stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, STORE)


_EPOCH, _MICRO = datetime(1970, 1, 1), timedelta(microseconds=1)


def _micros(at: datetime) -> int:
    since = (at if at.tzinfo is None else at.astimezone(timezone.utc).replace(tzinfo=None)) - _EPOCH
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


# --- tasks ------------------------------------------------------------------------------------------------------------

ANSWERS = "task_id string, event_id bigint, at timestamp, event string, answer string, status string, attempt_count int, worker_id string"
#: Of an event, by place, as names cost more than all else that is done with a row; ``run_tasks`` puts them in this order.
_EVENT_COLUMNS = ["task_id", "event_id", "at", "event", "worker_id", "retryable"]
_EVENT, _IN_ORDER = itemgetter(1, 2, 3, 4, 5), itemgetter(1, 0)
ANSWER = Row("task_id", "event_id", "at", "event", "answer", "status", "attempt_count", "worker_id")


class TaskMachine(StatefulProcessor):
    """One task: claims, submissions and failures in the order of their times, and the end of a lease by a timer.

    An event that is older than one the task has seen changes nothing and is answered ``late``.
    """

    def __init__(self, lease_seconds: int, max_attempts: int):
        self.lease, self.most = lease_seconds * 1_000_000, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, worker_id string, attempts int, most int, lease bigint, last bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        row = initialState
        lease = None if row.lease_until is None else _micros(row.lease_until)
        most = self.most if row.max_attempts is None else row.max_attempts
        self.state.update((row.status, row.worker_id, row.attempt_count or 0, most, lease, None))
        if row.status == "PROCESSING" and lease is not None:
            self.handle.registerTimer(-(-lease // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        task = self.state.get()
        timers = set()
        for event_id, at, event, worker_id, retryable in sorted(map(_EVENT, rows), key=_IN_ORDER):
            if task is None:
                answer = "not_found"
            else:
                now = _micros(at)
                if task[5] is not None and now < task[5]:
                    answer = "late"
                else:
                    answer, task = self.stepped(tuple(task), now, event, worker_id, retryable)
                    if answer == "claimed":
                        timers.add(-(-task[4] // 1000))
            yield ANSWER(key[0], event_id, at, event, answer, task and task[0], task and task[2], task and task[1])
        if task is not None:
            self.state.update(tuple(task))
        for due in timers:
            self.handle.registerTimer(due)

    def ended(self, task: tuple, now: int) -> tuple:
        """The task at ``now``: with its lease over and no attempt left it has failed."""
        status, worker, attempts, most, lease, last = task
        over = status == "PROCESSING" and lease is not None and lease < now and attempts >= most
        return ("FAILED", worker, attempts, most, lease, last) if over else task

    def step(self, task: tuple, e) -> tuple[str, tuple]:
        return self.stepped(task, _micros(e.at), e.event, e.worker_id, e.retryable)

    def stepped(self, task: tuple, now: int, event: str, worker_id: str, retryable: bool | None) -> tuple[str, tuple]:
        status, worker, attempts, most, lease, _ = self.ended(task, now)
        held = status == "PROCESSING" and worker == worker_id
        if event == "claim":
            free = status == "PENDING" or (status == "PROCESSING" and lease is not None and lease < now)
            if free and attempts < most:
                return "claimed", ("PROCESSING", worker_id, attempts + 1, most, now + self.lease, now)
            answer = "conflict"
        elif event == "submit":
            answer = "idempotent" if status == "COMPLETED" else "completed" if held else "conflict"
            if held:
                status, lease = "COMPLETED", None
        elif held:
            again = bool(retryable) and attempts < most
            status, worker, lease = ("PENDING" if again else "FAILED"), None, None
            answer = status
        else:
            answer = status if status in ("COMPLETED", "FAILED") else "conflict"
        return answer, (status, worker, attempts, most, lease, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        # a lease that was replaced or given back has a later end or none
        if before is not None and before[0] == "PROCESSING" and before[4] is not None and before[4] <= now:
            after = self.ended(before, now + 1)
            self.state.update(after)
            yield ANSWER(key[0], None, _EPOCH + before[4] * _MICRO, "lease_end", "expired", after[0], after[2], after[1])

    def close(self) -> None:
        pass


def run_tasks(events: DataFrame, tasks: DataFrame, lease_seconds: int = 900, max_attempts: int = 4, delay: str = "0 seconds") -> DataFrame:
    """Answers (ANSWERS) to a stream of ``events`` (task_id, event_id, at, event, worker_id, retryable), with the task after each.

    event: claim, submit or fail. ``tasks`` (task_id, status, worker_id, attempt_count, max_attempts, lease_until) is the state
    before the first batch; events of other tasks are answered ``not_found``. A lease that ends within the watermark gives
    a row without an event id, answered ``expired``; with no attempt left its task has failed.
    """
    use_state_store(events.sparkSession)
    start = tasks.select("task_id", "status", "worker_id", "attempt_count", "max_attempts", "lease_until")
    return events.select(_EVENT_COLUMNS).withWatermark("at", delay).groupBy("task_id").transformWithState(
        statefulProcessor=TaskMachine(lease_seconds, max_attempts), outputStructType=ANSWERS, outputMode="append", timeMode="EventTime", initialState=start.groupBy("task_id")
    )


# --- first seen -------------------------------------------------------------------------------------------------------


class FirstSeen(StatefulProcessor):
    """The first row of a key; a key of the initial state has been seen."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            # the least row so far, nulls last, so a key with many rows isn't gathered
            yield min(rows, key=lambda r: [(r[c] is None, r[c]) for c in self.order])
        else:
            for _ in rows:
                pass

    def close(self) -> None:
        pass


def first_seen_stream(rows: DataFrame, key: str, order: list[str], seen: DataFrame) -> DataFrame:
    """Rows of a stream whose ``key`` no earlier batch and no row of ``seen`` (key) had; of one batch's the first by ``order``.

    There is no watermark: state grows by one flag a key. Rows with a blank key are dropped.
    """
    use_state_store(rows.sparkSession)
    some = lambda df: df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return some(rows).groupBy(key).transformWithState(
        statefulProcessor=FirstSeen(order), outputStructType=rows.schema, outputMode="append", timeMode="None", initialState=some(seen).select(key).distinct().groupBy(key)
    )


# --- cache with a time to live ----------------------------------------------------------------------------------------


_CALL_COLUMNS, _CALL = ["domain", "check_type", "event_id", "at", "event", "payload"], itemgetter(2, 3, 4, 5)
CHECK = Row("domain", "check_type", "event_id", "payload", "hit")


class TtlCache(StatefulProcessor):
    """The last value put under a key, while it is younger than the time to live."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "payload string, at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, changed = self.value.get(), False
        for event_id, at, event, payload in sorted(map(_CALL, rows), key=_IN_ORDER):
            now = _micros(at)
            if event == "put":
                if held is None or now >= held[1]:
                    held, changed = (payload, now), True
            else:
                fresh = held is not None and 0 <= now - held[1] <= self.ttl
                yield CHECK(*key, event_id, held[0] if fresh else None, fresh)
        if changed:
            self.value.update(held)
            self.handle.registerTimer(-(-(held[1] + self.ttl) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.value.get()
        if held is not None and held[1] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, ttl_days: float = 80, delay: str = "0 seconds") -> DataFrame:
    """(domain, check_type, event_id, payload, hit) of each ``get`` in a stream of events (domain, check_type, event_id, at, event,
    payload), where event is put or get.

    A get sees the last put before it, unless that is older than the time to live. A put out of order doesn't replace a
    newer one. State leaves when its time is over in the watermark, so it holds the live keys alone.
    """
    use_state_store(events.sparkSession)
    out = T.StructType([T.StructField("domain", T.StringType()), T.StructField("check_type", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("hit", T.BooleanType())])
    return events.select(_CALL_COLUMNS).withWatermark("at", delay).groupBy("domain", "check_type").transformWithState(
        statefulProcessor=TtlCache(round(ttl_days * 86400)), outputStructType=out, outputMode="append", timeMode="EventTime"
    )
