"""Sinks: validated rows, quarantine, verified loads, exports and run summaries."""

from __future__ import annotations

import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.order_ids import literal
from ..functions.text import iso_text, number_or_zero, one_line, safe_filename
from ..operators.validate import check_columns, errors, typed
from ..schemas import LEAD, LEAD_COLUMNS
from .named_files import write_named
from .uploads import verdict


def append_leads(leads: DataFrame, path: str) -> None:
    """Append to the processing table; the task commit protocol makes it all or nothing."""
    leads.write.mode("append").parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays to database literals, structs to JSON, text to one line."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if f.name == "order_ids" and kind == "array":
            c = literal(c)
        elif kind in ("array", "struct", "map"):
            c = F.to_json(c)
        elif kind == "string":
            c = one_line(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_final(valid: DataFrame, path: str) -> None:
    """The 38 columns in their order, as CSV."""
    csv_ready(valid.select(*LEAD_COLUMNS)).write.mode("append").csv(path, header=True, escape='"')


def quarantine_rows(df: DataFrame, reason: str | Column) -> DataFrame:
    """(reason, row_json) of refused rows."""
    return df.select((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row_json"))


def load_verified(df: DataFrame, path: str) -> int:
    """Replace a staging table and compare row counts of what was sent and what is there; else raise."""
    sent = Observation()
    df.observe(sent, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path).count()
    if stored != sent.get["n"]:
        raise ValueError(f"staging has {stored} rows, {sent.get['n']} were sent")
    return stored


def page_text(header: Column, body: Column) -> Column:
    """A stored page: its header (a struct or JSON text) as a comment on the first line, then the body."""
    return F.concat(F.lit("<!--"), header, F.lit("-->\n"), F.coalesce(body, F.lit("")))


def with_order_id(value: Column, order_id: Column) -> Column:
    """A stored page whose header lists ``order_id`` too, other keys kept; a page without a readable header: null."""
    first = F.substring_index(value, "\n", 1)
    line = F.trim(F.rtrim(first), F.lit(" \t\r"))
    text = F.when(line.startswith("<!--") & line.endswith("-->"), F.substring(line, 5, F.length(line) - 7))
    v = F.try_parse_json(text)
    one = F.nullif(F.try_variant_get(v, "$.order_ids", "string"), F.lit(""))
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.try_variant_get(v, "$.order_ids", "array<string>"), F.when(one.isNotNull(), F.array(one)), none)
    all_ids = F.when(F.array_contains(ids, order_id), ids).otherwise(F.concat(ids, F.array(order_id)))
    # the other members as they are, each as its own JSON
    rest = F.filter(F.map_entries(F.from_json(F.to_json(v), "map<string,variant>")), lambda e: e["key"] != "order_ids")
    members = F.transform(rest, lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.lit("\1"), F.to_json(e["value"])))
    plain = F.transform(members, lambda m: F.concat(F.regexp_replace(F.split_part(m, F.lit("\1"), F.lit(1)), r'^\{"k":(.*)\}$', "$1"), F.lit(":"), F.split_part(m, F.lit("\1"), F.lit(2))))
    header = F.concat(F.lit("{"), F.array_join(F.concat(plain, F.array(F.concat(F.lit('"order_ids":'), F.to_json(all_ids)))), ","), F.lit("}"))
    body = F.when(F.instr(value, "\n") > 0, F.substring(value, F.length(first) + 2, F.length(value))).otherwise("")
    return F.when(text.isNotNull() & v.isNotNull(), page_text(header, body))


def write_pages(pages: DataFrame, path: str) -> None:
    """Stored pages (key, value) as a table, replaced whole by the commit of the job."""
    pages.select("key", "value").write.mode("overwrite").parquet(path)


def gzip_verdict(uploads: DataFrame, max_uncompressed: int = 1 << 30) -> DataFrame:
    """(upload_id, refused, uncompressed) of uploads (upload_id, content): every member is unpacked piece by piece.

    refused: null, not_gzip for bytes that aren't whole and sound gzip data, or too_large_uncompressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(io.BytesIO(x.as_py() or b""), max_uncompressed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["upload_id", "refused", "uncompressed"])

    kind = uploads.schema["upload_id"].dataType.simpleString()
    return uploads.select("upload_id", "content").mapInArrow(run, f"upload_id {kind}, refused string, uncompressed bigint")


def upload_verdict(compressed: Column, uncompressed: Column, head: Column, max_bytes: int = 256 << 20, max_uncompressed: int = 1 << 30) -> Column:
    """Why an upload is refused, or null: not gzip, too large packed, too large unpacked. ``head``: its first bytes."""
    return F.when(F.hex(F.substring(head, 1, 2)) != "1F8B", "not_gzip").when(compressed > max_bytes, "too_large").when(uncompressed > max_uncompressed, "too_large_uncompressed")


def latest_uploads(uploads: DataFrame) -> DataFrame:
    """The last accepted upload of each task replaces earlier ones."""
    return uploads.where("refused IS NULL").groupBy("task_id").agg(F.max_by(F.struct(*[c for c in uploads.columns if c != "task_id"]), F.struct("received_at", "upload_id")).alias("u")).select("task_id", "u.*")


def csv_line(columns: list[Column]) -> Column:
    """One line of CSV, with its line end."""
    return F.concat(F.to_csv(F.struct(*columns), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}), F.lit("\n"))


def write_export(ranked: DataFrame, path: str, order_id: str, client_name: str) -> str:
    """Delivery of an order: ``<order>_<client>/<keyword>/<location>.csv`` for each search and ``<order>_Master.csv``.

    Files start with a byte order mark and a header, rows stand best first (tier, reviews, id); the tier and status aren't
    told, the master file has a category. Names are made safe for files; searches whose safe names are equal share a
    file. All files come from one pass over ``ranked``, whose size the order's limit bounds. Returns the folder.
    """
    safe = lambda name: "".join(c for c in name if c.isalpha() or c.isnumeric() or c in " _-").strip()
    folder = f"{path.rstrip('/')}/{safe(order_id)}_{safe(client_name)}"
    ready = csv_ready(ranked)
    master = [c for c in ready.columns if c not in ("data_status", "tier")]
    single = [c for c in master if c not in ("search_keyword", "search_location")]
    head = lambda columns: F.lit("\ufeff" + ",".join(columns) + "\n")
    one = F.struct(F.concat(safe_filename(F.col("search_keyword")), F.lit("/"), safe_filename(F.col("search_location")), F.lit(".csv")).alias("name"), csv_line([F.col(c) for c in single]).alias("data"), head(single).alias("head"))
    category = F.concat("search_keyword", F.lit(" in "), "search_location").alias("Category")
    whole = F.struct(F.lit(f"{safe(order_id)}_Master.csv").alias("name"), csv_line([*[F.col(c) for c in master], category]).alias("data"), head([*master, "Category"]).alias("head"))
    best = {"_tier": F.col("tier") if "tier" in ranked.columns else F.lit(0), "_reviews": -number_or_zero(F.col("reviews")) if "reviews" in ranked.columns else F.lit(0)}
    rows = ready.withColumns(best).select("_tier", "_reviews", F.col("id").alias("_id"), F.explode(F.array(one, whole)).alias("f")).select("f.*", "_tier", "_reviews", "_id")
    write_named(rows, folder, order=["_tier", "_reviews", "_id"])
    return folder


#: Names that columns have in the older row form.
OLD_NAMES = {
    "search_keyword": "Search_Keyword", "search_location": "Search_Location", "phone_type": "Phone_Type", "scraped_date": "Scraped_Date", "emails": "Emails",
    "alternative_phones": "Alternative_Phones", "linkedin": "LinkedIn", "facebook": "Facebook", "twitter": "Twitter", "instagram": "Instagram",
    "data_status": "Data_Status", "found_web_mobile": "Found_Web_Mobile",
}


def old_rows(leads: DataFrame) -> DataFrame:
    """Leads in the older row form: 26 columns under their old names, times as text, no nulls in ids and numbers."""
    given = {c: iso_text(F.col(c)) for c in ("scraped_date", "first_seen_date", "last_updated_date")}
    given |= {"order_ids": F.coalesce("order_ids", F.array().cast("array<string>")), "rating": F.coalesce("rating", F.lit(0.0)), "reviews": F.coalesce("reviews", F.lit(0))}
    return leads.select(*[given.get(c, F.col(c)).alias(OLD_NAMES.get(c, c)) for c in LEAD_COLUMNS[:26]])


#: What may become of a processed row, besides being refused by the sink.
OUTCOMES = ("offline", "online", "skipped_completed", "blocklisted", "dead", "needs_render", "failed")


def run_counters(outcome: Column, refused: Column) -> list[Column]:
    """The ten counters of a run, for ``agg`` or ``observe``: all rows, each outcome, and what the sink took and refused."""
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(outcome == n).alias(n) for n in OUTCOMES], F.count_if(refused).alias("quarantined"), F.count_if(~refused).alias("writer_puts")]


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counters over processed rows (``outcome`` names what became of each)."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == n).alias(n) for n in (*OUTCOMES, "quarantined", "writer_puts")])


def judged_rows(rows: DataFrame) -> DataFrame:
    """name, data, head, outcome and refused of final ``rows`` (the 38 columns as text, and ``outcome``): lines of CSV for those
    that fit, of JSON with reason and columns for the others, in files of the task that makes them."""
    own = rows.drop("outcome")
    check_columns(own)
    judged = rows.select(*LEAD_COLUMNS, F.col("outcome") if "outcome" in rows.columns else F.lit(None).cast("string").alias("outcome"), errors().alias("_errors"))
    refused = F.size("_errors") > 0
    bad = F.concat(F.to_json(F.struct(F.lit("final_schema_validation_failed").alias("reason"), F.col("_errors").alias("columns"), F.struct(*LEAD_COLUMNS).alias("row")), {"ignoreNullFields": "false"}), F.lit("\n"))
    kinds = {f.name: f for f in LEAD.fields}
    # as text the literal of ids, times and JSON are what the table takes
    cells = [literal(typed(kinds[c])) if c == "order_ids" else typed(kinds[c]).cast("string") for c in LEAD_COLUMNS]
    part = F.lpad(F.spark_partition_id().cast("string"), 5, "0")
    name = F.when(refused, F.concat(F.lit("quarantine/part-"), part, F.lit(".jsonl"))).otherwise(F.concat(F.lit("final/part-"), part, F.lit(".csv")))
    head = F.when(~refused, F.lit(",".join(LEAD_COLUMNS) + "\n"))
    return judged.select(name.alias("name"), F.when(refused, bad).otherwise(csv_line([c.alias(n) for c, n in zip(cells, LEAD_COLUMNS)])).alias("data"), head.alias("head"), "outcome", refused.alias("refused"))


def write_judged(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes rows that fit to ``<path>/final`` and the others to ``<path>/quarantine``, from one computation; the run's counters.

    The counters are observed on the rows as they are written, so nothing is read or computed twice. All files appear
    together or, if the job fails, none.
    """
    watched = Observation()
    made = judged_rows(rows).observe(watched, *run_counters(F.col("outcome"), F.col("refused")))
    # a task has one file of each kind and holds both open, so its rows stream by unsorted
    write_named(made, path, together=False, at_once=2)
    return dict(watched.get)


class BatchCounters(StreamingQueryListener):
    """Keeps the counters that each batch of a stream observed under ``name``, by batch number."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches[event.progress.batchId] = seen.asDict()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def archive_buffer(df: DataFrame, path: str, at: datetime) -> str | None:
    """Keeps a processed buffer beside itself under the time of the run; where it is, or None for a buffer without a row."""
    if df.isEmpty():
        return None
    kept = f"{path.rstrip('/')}_{at:%Y%m%d_%H%M%S}"
    df.write.mode("error").parquet(kept)
    return kept


def status_row(df: DataFrame, stage: str, message: str, at: Column) -> DataFrame:
    """(order_id, stage, message, updated_at) of each order."""
    return df.select("order_id", F.lit(stage).alias("stage"), F.lit(message).alias("message"), at.alias("updated_at")).distinct()
