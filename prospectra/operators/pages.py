"""What the page cache holds for each task, and set operations on what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_ids import union
from ..functions.text import days_since

MAX_AGE_DAYS = 80


def cache_state(found: Column, header: Column, scraped: Column, now: Column, max_age: int = MAX_AGE_DAYS) -> Column:
    """missing, legacy_no_header, stale or hit. ``header``: the first line's comment; unreadable JSON: corrupt."""
    return (
        F.when(~found, "missing")
        .when(header.isNull(), "legacy_no_header")
        .when(F.try_parse_json(header).isNull(), "corrupt")
        .when(days_since(scraped, now) > max_age, "stale")
        .otherwise("hit")
    )


def classify_cache(tasks: DataFrame, pages: DataFrame, now: Column, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """``tasks`` (task_key, order_id ...) with ``cache_state``, ``scrape`` (whether to fetch) and the page's new order ids.

    ``pages``: key, header_json and order_ids, one row a key.
    """
    known = pages.select(F.col("key").alias("task_key"), "header_json", F.col("order_ids").alias("_ids"), F.lit(True).alias("_found"))
    joined = tasks.join(known, "task_key", "left")
    state = cache_state(F.coalesce("_found", F.lit(False)), F.col("header_json"), F.get_json_object("header_json", "$.scraped_date"), now, max_age)
    out = joined.withColumn("cache_state", state)
    return out.withColumns({"scrape": F.col("cache_state") != "hit", "order_ids": F.when(F.col("cache_state") == "hit", union(F.col("_ids"), F.array("order_id"))).otherwise(F.array("order_id"))}).drop("header_json", "_ids", "_found")


def not_in(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done. Put below any Python step: Catalyst moves no join past one."""
    return rows.join(done.select(key), key, "left_anti")


def pending_pages(tasks: DataFrame, pages: DataFrame, progress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to parse of tasks not in the progress log, and tasks without a page, which stay open."""
    todo = not_in(tasks, progress.withColumnRenamed("value", "task_key"), "task_key")
    named = pages.withColumnRenamed("key", "task_key")
    return todo.join(named, "task_key"), todo.join(named.select("task_key"), "task_key", "left_anti")


def fresh_checks(cache: DataFrame, now: Column, max_days: int = MAX_AGE_DAYS) -> DataFrame:
    """The last write per (domain, check_type), while younger than ``max_days``."""
    last = cache.groupBy("domain", "check_type").agg(F.max_by("payload", F.struct("updated_at", "payload")).alias("payload"), F.max("updated_at").alias("updated_at"))
    return last.where(now.cast("double") - F.col("updated_at").cast("double") <= max_days * 86400)


def lookup_check(rows: DataFrame, cache: DataFrame, check_type: str, column: str) -> DataFrame:
    """``rows`` (with ``domain``) plus the stored payload of one check; AQE sends the cache out only if it is small."""
    own = cache.where(F.col("check_type") == check_type).select("domain", F.col("payload").alias(column))
    return rows.join(own, "domain", "left")


def stuck_urls(locks: DataFrame, now: Column, max_seconds: int = 300) -> DataFrame:
    """URLs whose lock is older than ``max_seconds``: to be marked dead."""
    return locks.where(now.cast("double") - F.col("locked_at").cast("double") > max_seconds).select("url").distinct()
