"""Cached result pages to lead rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact
from ..functions.order_ids import clean
from ..functions.text import filled, lead_id, one_line, rating_value, review_count, strip
from .cards import page_cards
from .merge import first_seen


def category(info: Column) -> Column:
    """The first piece of card information that reads like a category: over three characters, no digit."""
    named = F.filter(info, lambda s: (s != "") & (s != "·") & ~s.contains("Open") & ~s.contains("Close"))
    plain = F.transform(named, lambda s: strip(F.split_part(s, F.lit("·"), F.lit(1))))
    return F.coalesce(F.get(F.filter(plain, lambda s: (F.length(s) > 3) & ~s.rlike(r"(?U)\d")), 0), F.lit(""))


def card_rows(pages: DataFrame) -> DataFrame:
    """One row a card of ``pages`` (header, html): all columns, before filters. ``header`` fills keyword, location, ids.

    Cards that couldn't be read are left out; ``broken_cards`` lists them.
    """
    cards = page_cards(pages).where("c.error IS NULL")
    head = lambda f, d: F.coalesce(F.col(f"header.{f}"), F.lit(d))
    phone = contact.local_phone(F.coalesce("c.phone", F.nullif(F.regexp_extract("c.text", contact.CARD_PHONE, 0), F.lit(""))))
    rows = cards.select(
        "*", head("Search_Keyword", "Unknown").alias("search_keyword"), head("Search_Location", "Unknown").alias("search_location"),
        clean(F.col("header.order_ids")).alias("order_ids"), head("query_type", "Unknown").alias("query_type"),
        F.coalesce(filled(F.col("c.label")), "c.title", F.lit("")).alias("name"), F.col("c.href").alias("url"),
        contact.unwrap_redirect(F.col("c.website")).alias("website"), rating_value(F.coalesce("c.rating", F.lit("0"))).alias("rating"),
        review_count(F.coalesce("c.reviews", F.lit(""))).alias("reviews"), category(F.col("c.info")).alias("category"),
        phone.alias("p"), F.col("header.scraped_date").try_cast("timestamp").alias("scraped_date"), F.col("c.text").alias("card_text"),
    )
    return rows.select(
        lead_id(F.col("url"), F.col("name"), F.col("p.number")).alias("id"), "search_keyword", "search_location", "order_ids", "query_type",
        one_line(F.col("name")).alias("name"), one_line(F.col("url")).alias("url"), one_line(F.col("website")).alias("website"), "rating", "reviews",
        one_line(F.col("category")).alias("category"), F.col("p.number").alias("phone"), F.col("p.type").alias("phone_type"), "scraped_date",
        "card_text", F.coalesce("header.minimum_reviews", F.lit(0)).alias("minimum_reviews"), *[c for c in ("task_id", "file") if c in pages.columns],
    )


def broken_cards(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` but html, card_no and error of each card that couldn't be read."""
    return page_cards(pages).where("c.error IS NOT NULL").select(*[c for c in pages.columns if c != "html"], "c.card_no", "c.error")


def usable_card() -> Column:
    """Not closed for good or for now, reviews enough, and a website or a phone."""
    return ~F.col("card_text").rlike(contact.CLOSED_WORDS) & (F.col("reviews") >= F.col("minimum_reviews")) & ((F.col("website") != "") | (F.col("phone") != ""))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Usable lead rows of all cards."""
    return card_rows(pages).where(usable_card()).drop("card_text", "minimum_reviews")


def dedup_leads(leads: DataFrame, buffered: DataFrame | None = None) -> DataFrame:
    """The first seen row per id, without ids that the buffer holds and rows without one."""
    new = leads if buffered is None else leads.join(buffered.select("id"), "id", "left_anti").select(leads.columns)
    return first_seen(new, ["id"], ["scraped_date"])
