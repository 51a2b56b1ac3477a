"""Incremental runs: first-seen dedup within a watermark, and leads merged batch by batch into their store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.lead_store import LeadStore
from ..operators.leads import dedup_leads, parse_pages
from ..operators.merge import upsert_raw_leads


def dedup_stream(rows: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """The first arrival per key within the watermark; state leaves with it."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def merge_stream(pages: DataFrame, store: LeadStore, checkpoint: str, keep: int = 3) -> StreamingQuery:
    """Parsed pages into a store of leads: each batch rewrites the buckets that its leads are in.

    A batch that runs again gives the same store again, as it starts from the manifest before it and all its times are the
    rows' own, so every batch takes effect once. Folders that the newest ``keep`` manifests don't name are removed.
    """

    def step(batch: DataFrame, number: int) -> None:
        store.apply(dedup_leads(parse_pages(batch)), number, upsert_raw_leads)
        store.vacuum(keep)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
