"""Sources: orders, tickets, pages, CSV buffers, lists and snapshots. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_header, keep_filled, strip
from ..schemas import ORDER, PAGE_HEADER
from .uploads import read_gzip


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Order documents, one JSON object a file. Defaults fill gaps; an order without anything to search gets ``rejected``."""
    raw = spark.read.schema(T.StructType([*ORDER.fields, T.StructField("_broken", T.StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    return clean_orders(raw.withColumn("source_file", F.col("_metadata.file_name")))


def clean_orders(raw: DataFrame) -> DataFrame:
    lists = {c: keep_filled(F.col(c)) for c in ("keywords", "locations", "direct_queries")}
    defaults = {"order_id": "0000", "client_name": "UnknownClient", "minimum_reviews": 0, "max_leads_required": 1000, "step_size": 0.01, "zoom": 14}
    out = raw.withColumns({**lists, **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}})
    return out.withColumn("rejected", (F.size("keywords") + F.size("locations") + F.size("direct_queries")) == 0)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of ticket files: a bare list, or a list under ``tasks`` or ``queries``; old and new key names."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_name").alias("ticket"))
    listed = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.tasks", "$.queries")])
    return text.select("ticket", F.posexplode(listed).alias("position", "t")).select("ticket", "position", *normalized_task(F.col("t")))


def normalized_task(task: Column) -> list[Column]:
    """The columns of a task document (variant, whose keys are told apart by case), under old or new key names."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get(task, f"$.{n}", "string"), F.lit("")) for n in names])
    return [
        pick("task_key", "hash_id").alias("task_key"), F.coalesce(pick("task_type", "type"), F.lit("text_search")).alias("task_type"), pick("target_url").alias("target_url"),
        pick("search_keyword", "Search_Keyword").alias("search_keyword"), pick("search_location", "Search_Location").alias("search_location"),
        pick("order_id").alias("order_id"), pick("query_type").alias("query_type"), F.coalesce(pick("minimum_reviews").try_cast("int"), F.lit(0)).alias("minimum_reviews"),
    ]


def after_position(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks of each ticket after its last completed ``position``; a ticket without one starts over."""
    last = done.groupBy("ticket").agg(F.max("position").alias("_last"))
    return tasks.join(last, "ticket", "left").where(F.col("position") > F.coalesce("_last", F.lit(-1))).drop("_last")


def parse_header(json: Column) -> Column:
    """Struct of a page's header text: a single order id is a list of one, numbers may be quoted; not a JSON object: null."""
    v = F.try_parse_json(json)
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    one = F.nullif(text("order_ids"), F.lit(""))
    ids = F.coalesce(F.try_variant_get(v, "$.order_ids", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    fields = {"order_ids": ids, "minimum_reviews": text("minimum_reviews").try_cast("int")}
    return F.when(F.startswith(F.trim(json), F.lit("{")) & v.isNotNull(), F.struct(*[fields.get(f.name, text(f.name)).alias(f.name) for f in PAGE_HEADER]))


def split_page(value: Column, lenient: bool = False) -> tuple[Column, Column]:
    """(header struct, body) of a stored page. The header is a JSON comment on the first line.

    The body is all after the first line; with ``lenient`` the first line is kept unless it starts a comment.
    """
    first, has_more = F.substring_index(value, "\n", 1), F.instr(value, "\n") > 0
    line = strip(first)
    header = F.when(line.startswith("<!--") & line.endswith("-->"), parse_header(F.regexp_extract(line, r"(?s)^<!--(.*)-->$", 1)))
    rest = F.when(has_more, F.substring(value, F.length(first) + 2, F.length(value))).otherwise("")
    return header, F.when(~value.startswith("<!--"), value).otherwise(rest) if lenient else rest


def read_pages(spark: SparkSession, path: str, lenient: bool = False, **limits: int) -> DataFrame:
    """Stored pages (plain or gzip): file, key (name up to the first dot), header and html. Pages beyond a limit (maxBytes,
    maxUncompressed) and unsound ones are left out; ``read_gzip`` tells why."""
    raw = read_gzip(spark, path, plain=True, **limits).where("refused IS NULL").select("key", F.col("content").alias("value"), F.substring_index("path", "/", -1).alias("file"))
    header, body = split_page(F.col("value"), lenient)
    return raw.select("file", "key", header.alias("header"), body.alias("html"))


def pages_for_tasks(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Uploaded pages (key = task_id, body without a header) with a header made of the task."""
    made = F.struct(
        F.col("task_key").alias("hash_id"), F.coalesce("order_ids", F.array().cast("array<string>")).alias("order_ids"), "query_type", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_date"),
        F.col("search_keyword").alias("Search_Keyword"), F.col("search_location").alias("Search_Location"), F.coalesce("minimum_reviews", F.lit(0)).alias("minimum_reviews"),
    )
    return pages.drop("header").join(tasks, pages.key == tasks.task_id).select("task_id", "task_key", made.alias("header"), "html")


def read_uploads(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """Gzip uploads: key (of their task), size, uncompressed, refused (why, or null) and html (null if refused)."""
    return read_gzip(spark, path, **limits).select("key", "size", "uncompressed", "refused", F.col("content").alias("html"))


def read_buffer(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with quoted cells over several lines; a byte order mark in the header and NUL bytes are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    return raw.select(*[F.translate(F.regexp_replace(c, "^﻿", ""), "\0", "").alias(c) for c in columns])


def canonical_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[canonical_header(c) for c in df.columns])


def same_header(df: DataFrame, expected: list[str]) -> bool:
    """Whether the columns are the expected ones in order."""
    return df.columns == expected


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a text list: trimmed lines without blanks; blocklists and progress logs."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


def completed_ids(master: DataFrame, buffered: DataFrame, version: int = 1) -> DataFrame:
    """(id) already enriched in this version, or present in the sync buffer."""
    done = master.where(F.col("id").isNotNull() & (F.col("enrichment_version") >= version)).select("id")
    return done.union(buffered.where(F.col("id").isNotNull() & (F.col("id") != "")).select("id")).distinct()
