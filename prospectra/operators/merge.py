"""Merging new records into tables by explicit rules per column. Tables are snapshots: each merge returns a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_ids import union, union_all
from ..functions.text import filled
from ..schemas import LEAD_COLUMNS, TEXT_COLUMNS

#: Columns that the phone-keyed merge updates.
PHONE_MERGE_TEXT = ["emails", "alternative_phones", "linkedin", "facebook", "twitter", "instagram"]


def prefer_text(new: Column, old: Column) -> Column:
    """The new text unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, whatever its size is estimated at.

    A few columns of a wide table in files are estimated at their share of the widths, which for leads of mostly nulls is a
    small part of their bytes, so sides of any size would pass for small and go through the driver.
    """
    return side.hint("merge")


def staging_rule(column: str) -> Column:
    """The merged value of one lead column, from ``s`` (staging) and ``m`` (master)."""
    new, old = F.col(f"s.{column}"), F.col(f"m.{column}")
    if column == "id":
        return old
    if column == "order_ids":
        return union(old, new)
    if column == "first_seen_date":
        return F.coalesce(old, new)
    if column == "last_updated_date":
        return new
    return prefer_text(new, old) if column in TEXT_COLUMNS else F.coalesce(new, old)


def match_leads(master: DataFrame, staging: DataFrame) -> DataFrame:
    """(m_id, s_id) by id, else url, else phone: one staging row for each matched master row.

    The disjunction is three equi-joins; a phone matches only where the staging url is blank. Of several matches the
    kind counts first, then the latest update, then the id. Staging is reduced to its best row per id, url and phone
    before it is joined, so a shared value makes one pair per master row. Blank urls and phones join nothing, so no join
    key is hot for want of a value.
    """
    m = master.select(F.col("id").alias("m_id"), F.col("url").alias("m_url"), F.col("phone").alias("m_phone"))
    s = staging.select(F.col("id").alias("s_id"), F.col("url").alias("s_url"), F.col("phone").alias("s_phone"), F.col("last_updated_date").alias("at"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    newest = F.max_by("s_id", F.struct(F.coalesce(F.unix_micros("at"), F.lit(0)), "s_id")).alias("s_id")
    sides = [("m_id", s.select("s_id", F.col("s_id").alias("v"), "at")), ("m_url", s.select("s_id", F.col("s_url").alias("v"), "at").where(some("v"))), ("m_phone", s.where(~some("s_url")).select("s_id", F.col("s_phone").alias("v"), "at").where(some("v")))]
    kinds = [m.where(F.col(c).isNotNull()).join(shuffled(rows.groupBy("v").agg(newest)), F.col(c) == F.col("v")).select("m_id", "s_id", F.lit(k).alias("kind")) for k, (c, rows) in enumerate(sides)]
    return reduce(DataFrame.union, kinds).groupBy("m_id").agg(F.min_by("s_id", "kind").alias("s_id"))


def unmatched_leads(master: DataFrame, staging: DataFrame, legacy: bool = False) -> DataFrame:
    """Staging rows to insert: chained anti-joins by id, url and phone.

    A phone holds a row back only where it could update, that is with a blank url; with ``legacy`` it always does, so
    a known phone under a new url is neither updated nor inserted.
    """
    some = F.coalesce(F.col("url"), F.lit("")) != ""
    left = staging.join(shuffled(master.select("id")), "id", "left_anti").join(shuffled(master.where(some).select("url").distinct()), "url", "left_anti").select(staging.columns)
    phones = master.where(F.coalesce(F.col("phone"), F.lit("")) != "").select(F.col("phone").alias("_phone")).distinct()
    on = (F.col("phone") == F.col("_phone")) if legacy else (F.col("phone") == F.col("_phone")) & ~some
    return left.join(shuffled(phones), on, "left_anti")


def latest_per_id(staging: DataFrame) -> DataFrame:
    """``staging`` with the latest row of each id, ties by all other columns; rows without an id can't be told apart and stay."""
    named = staging.where("id IS NOT NULL")
    return last_write(named, ["id"], "last_updated_date").unionByName(staging.where("id IS NULL"))


def merge_leads(master: DataFrame, staging: DataFrame, legacy: bool = False) -> DataFrame:
    """Staging into master: matched rows by rule, others of master as they are, unmatched ones of staging added.

    ``id`` is a key of master and stays one: of staging rows that repeat an id the latest counts, for updates and inserts.
    """
    columns = [c for c in LEAD_COLUMNS if c in master.columns]
    staging = latest_per_id(staging)
    pairs = match_leads(master, staging)
    joined = master.alias("m").join(shuffled(pairs).alias("p"), F.col("m.id") == F.col("p.m_id"), "left").join(shuffled(staging).alias("s"), F.col("s.id") == F.col("p.s_id"), "left")
    updated = joined.select(*[F.when(F.col("p.s_id").isNull(), F.col(f"m.{c}")).otherwise(staging_rule(c)).alias(c) for c in columns])
    return updated.unionByName(unmatched_leads(master, staging, legacy).select(*columns))


def merge_by_phone(master: DataFrame, staging: DataFrame) -> DataFrame:
    """The older merge on phone alone: eleven columns are updated; rows without a phone are always added."""
    some = F.coalesce(F.col("phone"), F.lit("")) != ""
    latest = staging.where(some).groupBy("phone").agg(F.max_by(F.struct(*[c for c in staging.columns if c != "phone"]), F.struct(F.coalesce(F.unix_micros("last_updated_date"), F.lit(0)), "id")).alias("s"))
    joined = master.alias("m").join(shuffled(latest).alias("x"), F.col("m.phone") == F.col("x.phone"), "left")

    def rule(c: str) -> Column:
        old, new = F.col(f"m.{c}"), F.col(f"x.s.{c}") if c != "phone" else F.col("x.phone")
        if c in PHONE_MERGE_TEXT:
            return prefer_text(new, old)
        if c in ("data_status", "last_updated_date"):
            return new
        if c == "first_seen_date":
            return F.coalesce(old, new)
        if c == "order_ids":
            return union(old, new)
        return F.coalesce(new, old) if c == "scraped_date" else old

    updated = joined.select(*[F.when(F.col("x.phone").isNull(), F.col(f"m.{c}")).otherwise(rule(c)).alias(c) for c in master.columns])
    known = master.where(some).select("phone").distinct()
    return updated.unionByName(staging.where(some).join(shuffled(known), "phone", "left_anti").select(*master.columns)).unionByName(staging.where(~some).select(*master.columns))


def upsert_raw_leads(leads: DataFrame, parsed: DataFrame, now: Column | None = None, keep_enriching: bool = True) -> DataFrame:
    """Parsed rows into leads by id. A known lead keeps what it has but for order ids, keyword, location and status.

    The status stays ENRICHED, else becomes RAW; ENRICHING stays too unless ``keep_enriching`` is off, as an enrichment
    under way would be lost. Without ``now`` the parsed row's own date is the time of the update. Several parsed rows of one id: the first seen counts, with all their order ids.
    """
    rest = [c for c in parsed.columns if c not in ("id", "order_ids")]
    new = parsed.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("scraped_date", *[F.col(c).cast("string") for c in ("url", "name") if c in rest])).alias("n"), union_all(F.col("order_ids")).alias("n_orders")).select(F.col("id").alias("n_id"), "n", "n_orders")
    both = leads.join(new, leads.id == new.n_id, "full")
    is_new, is_old = leads.id.isNull(), F.col("n_id").isNull()
    stay = ["ENRICHED", "ENRICHING"] if keep_enriching else ["ENRICHED"]

    def rule(c: str) -> Column:
        old = leads[c]
        fresh = F.col(f"n.{c}") if c in rest else F.lit(None).cast(leads.schema[c].dataType)
        if c == "id":
            return F.coalesce(old, F.col("n_id"))
        if c == "order_ids":
            return F.when(is_old, old).otherwise(union(old, F.col("n_orders")))
        if c == "data_status":
            return F.when(is_new, "RAW").when(is_old | old.isin(*stay), old).otherwise("RAW")
        if c in ("search_keyword", "search_location"):
            return F.when(is_old, old).otherwise(F.coalesce(prefer_text(fresh, old), fresh))
        if c == "task_id":
            return F.coalesce(old, fresh)
        if c == "first_seen_date":
            return F.when(is_new, F.col("n.scraped_date")).otherwise(old)
        if c == "last_updated_date":
            return F.when(is_new, F.col("n.scraped_date")).when(is_old, old).otherwise(F.col("n.scraped_date") if now is None else now)
        return F.when(is_new, fresh).otherwise(old)

    return both.select(*[rule(c).alias(c) for c in leads.columns])


def enqueue_tasks(tasks: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, counts): new keys are added, known ones take the least minimum_reviews and the union of order ids.

    ``incoming``: contract rows with order_id and ``position`` (order of arrival). counts: inserted, duplicates.
    """
    once = incoming.groupBy("task_key").agg(
        F.min_by(F.struct("target_url", "task_type", "search_keyword", "search_location", "query_type"), "position").alias("n"),
        F.min("minimum_reviews").alias("n_min"),
        F.array_sort(F.collect_set(filled(F.col("order_id")))).alias("n_orders"),
        F.count("*").alias("n_rows"),
    ).withColumnRenamed("task_key", "n_key")
    both = tasks.join(once, tasks.task_key == once.n_key, "full")
    is_new, touched = tasks.task_key.isNull(), F.col("n_key").isNotNull()
    start = {"task_id": F.md5(F.col("n_key").cast("binary")), "task_key": F.col("n_key"), "order_ids": F.col("n_orders"), "minimum_reviews": F.col("n_min"), "priority": F.lit(0), "status": F.lit("PENDING"), "attempt_count": F.lit(0), "max_attempts": F.lit(4), "created_at": now, "updated_at": now, "parse_status": F.lit("PENDING"), "parse_attempts": F.lit(0)}
    start |= {c: F.col(f"n.{c}") for c in ("target_url", "task_type", "search_keyword", "search_location", "query_type")}
    known = {"order_ids": union(tasks.order_ids, F.col("n_orders")), "minimum_reviews": F.least(tasks.minimum_reviews, F.col("n_min")), "updated_at": now}
    out = both.select(*[F.when(is_new, start.get(c, F.lit(None)).cast(tasks.schema[c].dataType)).when(touched, known.get(c, tasks[c])).otherwise(tasks[c]).alias(c) for c in tasks.columns])
    counts = once.join(tasks.select("task_key"), once.n_key == tasks.task_key, "left").agg(F.count_if(F.col("task_key").isNull()).alias("inserted"), F.coalesce(F.sum(F.col("n_rows") - F.col("task_key").isNull().cast("int")), F.lit(0)).alias("duplicates"))
    return out, counts


def propagate_order_ids(leads: DataFrame, tasks: DataFrame) -> DataFrame:
    """Leads take on the order ids of their task."""
    ids = tasks.select(F.col("task_id").alias("_task"), F.col("order_ids").alias("_ids"))
    return leads.join(ids, leads.task_id == F.col("_task"), "left").withColumn("order_ids", F.when(F.col("_task").isNull(), F.col("order_ids")).otherwise(union(F.col("order_ids"), F.col("_ids")))).drop("_task", "_ids")


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row per key, as a partial aggregate rather than a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*").select(*rows.columns)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key; rows with a blank key are dropped."""
    rest = [c for c in rows.columns if c not in keys]
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in keys])
    return rows.where(whole).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*keys, "r.*").select(*rows.columns)


def worker_heartbeats(workers: DataFrame, beats: DataFrame) -> DataFrame:
    """Latest version and time per worker; the host name only from heartbeats that carry one."""
    rows = workers.select("worker_id", "version", "hostname", "last_seen_at").unionByName(beats.select("worker_id", "version", "hostname", F.col("at").alias("last_seen_at")))
    return rows.groupBy("worker_id").agg(
        F.max_by("version", F.struct("last_seen_at", "version")).alias("version"),
        F.max_by("hostname", F.when(filled(F.col("hostname")).isNotNull(), F.struct("last_seen_at", "hostname"))).alias("hostname"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def config_value(config: DataFrame, key: str, default: str = "v1.0.0") -> DataFrame:
    """(value) of one setting, or its default; always one row."""
    return config.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def update_required(beats: DataFrame, target: str) -> DataFrame:
    return beats.withColumns({"target_version": F.lit(target), "update_required": ~F.col("version").eqNullSafe(F.lit(target))})


def write_back(leads: DataFrame, enriched: DataFrame, now: Column, columns: list[str]) -> DataFrame:
    """Enrichment results into leads that still are ENRICHING: they become ENRICHED and lose the lease.

    ``data_status`` tells the state; the tier that enrichment found stays in ``tier``.
    """
    e = enriched.select(F.col("id").alias("_id"), F.col("data_status").alias("_tier"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = leads.join(e, leads.id == F.col("_id"), "left")
    done = F.col("_id").isNotNull() & (F.col("data_status") == "ENRICHING")
    out = {c: F.when(done, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    out |= {"tier": F.when(done, F.col("_tier")).otherwise(F.col("tier") if "tier" in leads.columns else F.lit(None).cast("string")), "last_updated_date": F.when(done, now).otherwise(F.col("last_updated_date"))}
    out |= {"enrichment_lease_until": F.when(~done, F.col("enrichment_lease_until")), "data_status": F.when(done, "ENRICHED").otherwise(F.col("data_status"))}
    return both.withColumns(out).drop("_id", "_tier", *[f"_{c}" for c in columns])


def check_batch(claimed: DataFrame, enriched: DataFrame) -> None:
    """Raise unless the enriched rows are exactly the claimed ones, one each."""
    odd = claimed.select("id", F.lit(1).alias("c")).unionByName(enriched.select("id", F.lit(-1).alias("c"))).groupBy("id").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where("c <> 0 OR n <> 2 OR id IS NULL")
    if not odd.isEmpty():
        raise ValueError("the enriched batch doesn't match the claimed rows")
