"""Lead enrichment from stored pages of the lead's own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact
from ..functions.text import filled
from .html import page_struct

VERSION = 1
NETWORKS = ("linkedin", "facebook", "twitter", "instagram")


def defaults(leads: DataFrame, now: Column) -> DataFrame:
    """The columns that enrichment fills, at their start values; columns that are there stay."""
    text = {c: F.lit("") for c in ("emails", "alternative_phones", *NETWORKS, "data_status", "lead_status", "domain_state", "ssl_status")}
    start = text | {"found_web_mobile": F.lit("No"), "is_valid": F.lit(True), "first_seen_date": F.col("scraped_date"), "last_updated_date": now, "dead_email": F.lit(False), "enriched_at": F.lit(None).cast("timestamp"), "enrichment_version": F.lit(None).cast("int"), "http_status": F.lit(None).cast("int"), "mobile_friendly": F.lit(False), "has_contact_info": F.lit(False), "quality_score": F.lit(0), "tags": F.array().cast("array<string>"), "last_checked_at": F.lit(None).cast("timestamp"), "raw_extracted": F.lit(None).cast("struct<title:string,meta_description:boolean,has_reviews:boolean>")}
    return leads.withColumns({c: v for c, v in start.items() if c not in leads.columns})


def fill_ids(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, refused rows): a blank id becomes the key of the website; without one the row is refused."""
    key = F.coalesce(filled(F.col("id")), F.nullif(contact.url_key(F.col("website")), F.lit("")))
    keyed = leads.withColumn("id", key)
    return keyed.where("id IS NOT NULL"), keyed.where("id IS NULL")


def split_blocked(leads: DataFrame, blocklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads to look at, leads without a website or with a dead one). Both sides are compared as normalized urls."""
    dead = blocklist.select(contact.with_scheme(F.col("value")).alias("_dead")).distinct()
    joined = leads.join(dead, contact.with_scheme(F.col("website")) == F.col("_dead"), "left")
    out = F.col("_dead").isNotNull() | filled(F.col("website")).isNull()
    return joined.where(~out).drop("_dead"), joined.where(out).drop("_dead")


def close_blocked(leads: DataFrame, now: Column) -> DataFrame:
    return leads.withColumns({"data_status": contact.fallback_tier(F.col("phone_type"), F.col("emails")), "enriched_at": now, "enrichment_version": F.lit(VERSION)})


def page_findings(pages: DataFrame) -> DataFrame:
    """What each page (id, page_no, base_url, html) tells: emails, phones, socials, contact links and facts."""
    facts = pages.select("id", "page_no", "base_url", page_struct("html").alias("f"))
    mails = F.array_compact(F.transform(F.col("f.links"), lambda x: contact.clean_email(contact.mailto_address(x["href"]))))
    return facts.select(
        "id", "page_no", F.array_distinct(F.concat(contact.emails_of(F.col("f.text")), mails)).alias("emails"),
        contact.phones_of(F.col("f.text"), "Mobile").alias("mobiles"), contact.phones_of(F.col("f.text"), "Landline").alias("landlines"),
        *[contact.last_social(F.col("f.links"), n).alias(n) for n in NETWORKS], contact.contact_links(F.col("f.links"), F.col("base_url")).alias("contact_links"),
        F.col("f.has_viewport").alias("mobile_friendly"),
        F.struct(F.col("f.title").alias("title"), F.col("f.has_description").alias("meta_description"), (F.lower("f.text").rlike(r"\breviews?\b") | F.col("f.has_review_type")).alias("has_reviews")).alias("raw_extracted"),
    )


def per_lead(findings: DataFrame, most_pages: int = 3) -> DataFrame:
    """Findings of a lead's pages together: page 0 is the home page, then at most two contact pages.

    Pages after the first that, with those before it, gives an email and a mobile number add nothing. Of the socials
    the first that isn't empty stays; of the facts the last page's that tells one. At most ``most_pages`` rows meet in a group.
    """
    pages = F.array_sort(F.collect_list(F.struct("page_no", "emails", "mobiles", "landlines", *NETWORKS, "mobile_friendly", "raw_extracted")))
    grouped = findings.where(F.col("page_no") < most_pages).groupBy("id").agg(pages.alias("p"))
    enough = lambda k: (F.size(F.flatten(F.transform(F.slice("p", 1, k), lambda x: x["emails"]))) > 0) & (F.size(F.flatten(F.transform(F.slice("p", 1, k), lambda x: x["mobiles"]))) > 0)
    used = F.filter(F.col("p"), lambda x, i: (i == 0) | ~enough(i))
    all_of = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform("u", lambda x: x[name]))))
    first = lambda name: F.coalesce(F.get(F.filter(F.transform("u", lambda x: x[name]), lambda v: v != ""), 0), F.lit(""))
    last = lambda name: F.try_element_at(F.array_compact(F.transform("u", lambda x: x["raw_extracted"][name])), F.lit(-1))
    rows = grouped.select("id", used.alias("u"))
    return rows.select("id", *[all_of(n).alias(n) for n in ("emails", "mobiles", "landlines")], *[first(n).alias(n) for n in NETWORKS], F.get("u", 0)["mobile_friendly"].alias("mobile_friendly"), F.struct(*[last(n).alias(n) for n in ("title", "meta_description", "has_reviews")]).alias("raw_extracted"))


def drop_dead_mail(emails: DataFrame, mx: DataFrame) -> DataFrame:
    """(id, email) without addresses whose domain has a stored verdict of no mail server; unknown domains stay."""
    dead = mx.where(~F.col("has_mx")).select(F.col("domain").alias("_domain"))
    return emails.join(dead, contact.email_domain(F.col("email")) == F.col("_domain"), "left_anti")


def enrich(leads: DataFrame, findings: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Leads with what was found on their pages. ``checks``: id, http_status, ssl_status, domain_state, stored results.

    Emails join those the lead has; a social link that was found replaces, none keeps the old. A 404 or no answer
    makes the lead Dead with a fallback tier.
    """
    f = findings.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in findings.columns if c != "id"])
    c = checks.select(F.col("id").alias("_cid"), F.col("http_status").alias("_http"), F.col("ssl_status").alias("_ssl"), F.col("domain_state").alias("_domain"))
    both = leads.join(f, leads.id == F.col("_id"), "left").join(c, leads.id == F.col("_cid"), "left")
    none = F.array().cast("array<string>")
    old = F.filter(F.transform(F.split(F.coalesce("emails", F.lit("")), ","), F.trim), lambda e: e != "")
    emails = F.array_sort(F.array_distinct(F.concat(F.coalesce("_emails", none), old)))
    mobiles, landlines = F.coalesce("_mobiles", none), F.coalesce("_landlines", none)
    socials = {n: F.coalesce(F.nullif(F.col(f"_{n}"), F.lit("")), F.col(n), F.lit("")) for n in NETWORKS}
    dead = F.coalesce(F.col("_http") == 404, F.lit(False)) | (F.col("_http").isNull() & F.col("_cid").isNotNull())
    some_social = F.greatest(*[F.length(v) for v in socials.values()]) > 0
    reviews = F.coalesce(F.col("_raw_extracted.has_reviews"), F.lit(False))
    has_contact = (F.size(emails) > 0) | (F.size(mobiles) > 0) | (F.size(landlines) > 0)
    tier = F.when(dead, contact.fallback_tier(F.col("phone_type"), F.col("emails"))).otherwise(contact.contact_tier(F.size(mobiles) > 0, F.col("phone_type"), F.size(emails) > 0))
    return both.withColumns(
        socials
        | {
            "emails": F.array_join(emails, ", "), "alternative_phones": F.array_join(F.concat(mobiles, landlines), ", "),
            "found_web_mobile": F.when(F.size(mobiles) > 0, "Yes").otherwise("No"), "data_status": tier,
            "lead_status": F.when(dead, "Dead").otherwise(F.coalesce("lead_status", F.lit(""))), "http_status": F.col("_http"),
            "ssl_status": F.coalesce("_ssl", F.lit("")), "domain_state": F.coalesce("_domain", F.lit("unknown")),
            "mobile_friendly": F.coalesce("_mobile_friendly", F.lit(False)), "has_contact_info": has_contact, "raw_extracted": F.col("_raw_extracted"),
            "quality_score": contact.quality_score(F.col("_http"), has_contact, F.col("_ssl"), F.col("_mobile_friendly"), some_social | reviews),
            "tags": contact.page_tags(F.coalesce("_ssl", F.lit("")), F.coalesce("_domain", F.lit("")), some_social, reviews),
            "enriched_at": now, "last_checked_at": now, "last_updated_date": now, "enrichment_version": F.lit(VERSION),
        }
    ).select(leads.columns)
