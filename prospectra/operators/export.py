"""Filter, rank and cut the leads of an order for delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grid_label, number_or_zero, tier_rank


def deliverable(order_id: Column) -> Column:
    """Of the order, valid, and with a known status other than Dead."""
    return F.array_contains("order_ids", order_id) & F.col("is_valid") & (F.col("lead_status") != "Dead")


def best_per_url(leads: DataFrame) -> DataFrame:
    """One row per url: best tier, most reviews, least id; rows without a url count as one.

    The best row is a partial aggregate, so each task sends one row a url, also for the many rows without one.
    """
    ranked = leads.withColumns({"tier": tier_rank(F.col("data_status")), "reviews": number_or_zero(F.col("reviews"))})
    best = F.min_by(F.struct(*ranked.columns), F.struct("tier", -F.col("reviews"), "id"))
    return ranked.groupBy(F.coalesce("url", F.lit("")).alias("_url")).agg(best.alias("r")).select("r.*")


def export_order(leads: DataFrame, order_id: str, max_leads: int = 1000) -> DataFrame:
    """The best ``max_leads`` rows of one order, grid places relabelled."""
    own = leads.where(deliverable(F.lit(order_id))).withColumn("search_location", grid_label(F.col("search_location")))
    return best_per_url(own).orderBy("tier", F.desc("reviews"), "id").limit(max_leads)


def delivered_counts(rows: DataFrame) -> DataFrame:
    """Counts per (keyword, location), by tier."""
    return rows.groupBy("search_keyword", "search_location").agg(F.count("*").alias("delivered"), F.count_if(F.col("data_status") == "Premium").alias("premium"), F.count_if(F.col("data_status") == "Fallback").alias("fallback"))
