"""Column rules against small statements of the rule."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prospectra.functions import contact, order_ids, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def phone_rule(raw: str) -> tuple[str, str]:
    digits = re.sub(r"[^0-9]", "", raw)
    number = digits.lstrip("0")
    while number.startswith("91") and len(number) > 10:
        number = number[2:]
    if not digits or number.startswith("18"):
        return "", ""
    if re.fullmatch("[6-9][0-9]{9}", number):
        return number, "Mobile"
    if re.fullmatch("[1-5][0-9]{9}", number):
        return "0" + number, "Landline"
    return number, "Unknown"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+- ()9181", max_size=20), min_size=40, max_size=60))
def test_local_phone_follows_the_rule(spark, raws):
    rows = spark.createDataFrame([(r,) for r in raws], "r string").select("r", contact.local_phone(F.col("r")).alias("p")).collect()
    assert [(r["p"]["number"], r["p"]["type"]) for r in rows] == [phone_rule(r["r"]) for r in rows]


def test_phone_cases(spark):
    cases = {"": ("", ""), "0000": ("", "Unknown"), "91919876543210": ("9876543210", "Mobile"), "18001234567": ("", ""), "022 2345 6789": ("02223456789", "Landline")}
    for raw, want in cases.items():
        assert tuple(one(spark, contact.local_phone(F.col("r")), r=raw)) == want
    assert one(spark, contact.scraped_phone(F.col("r")), r="+91 98765-43210")["number"] == "+91 9876543210"
    assert one(spark, contact.scraped_phone(F.col("r")), r="+44 9876543210") is None


def test_emails_and_links(spark):
    assert one(spark, F.array_join(contact.emails_of(F.col("t")), ","), t="a@b.co A@B.co logo@2x.png") == "a@b.co"
    assert one(spark, contact.mailto_address(F.col("h")), h="mailto:x@y.zz?subject=1") == "x@y.zz"
    assert one(spark, contact.social_network(F.col("h")), h="https://netflix.com/") == "twitter"
    assert one(spark, contact.social_network(F.col("h")), h="https://facebook.com/sharer") is None
    assert one(spark, contact.unwrap_redirect(F.col("h")), h="/url?q=https://a.b/&sa=1") == "https://a.b/"
    assert one(spark, contact.url_key(F.col("u")), u="https://www.A.b/c/?x#y") == one(spark, contact.url_key(F.col("u")), u="a.b/c")
    assert one(spark, contact.url_key(F.col("u")), u="  ") == ""
    assert one(spark, contact.resolve(F.col("b"), F.col("h")), b="https://a.b/c/d?x", h="e") == "https://a.b/c/e"


def test_text_rules(spark):
    assert one(spark, text.task_id(F.col("x")), x="") == "UNKNOWN"
    assert one(spark, text.task_id(F.col("x")), x="  ") == "d41d8cd98f00b204e9800998ecf8427e"
    for name, want in {"a_7.json": 7, "a_99.json": 10, "a_0.json": 1, "a.json": 1, "a_x.json": 1}.items():
        assert one(spark, text.priority_from_name(F.col("x")), x=name) == want
    assert one(spark, text.review_count(F.col("x")), x="(1,234)") == 1234
    assert one(spark, text.rating_value(F.col("x")), x="n/a") == 0
    assert one(spark, text.url_quote(F.col("x")), x="a b*~") == "a+b%2A~"
    assert one(spark, text.number_or_zero(F.col("x")), x="1,204.9") == 1204
    assert text.canonical_header("﻿Search Keyword ") == "search_keyword"


def test_order_ids(spark):
    for raw, want in {"{a,b}": ["a", "b"], "['b', 'a']": ["a", "b"], '{"a,b",c}': ["a,b", "c"], "x": ["x"], "": [], "{}": [], "None": [], "[null, 'a', 'a']": ["a"]}.items():
        assert one(spark, order_ids.parse(F.col("x")), x=raw) == want
    assert one(spark, order_ids.literal(order_ids.parse(F.col("x"))), x="[b, a]") == '{"a","b"}'


def test_scores(spark):
    score = contact.quality_score(F.lit(200), F.lit(True), F.lit("valid"), F.lit(True), F.lit(True))
    assert spark.range(1).select(score.alias("x")).first()["x"] == 90
    now = F.lit("2024-03-01").cast("timestamp")
    assert one(spark, contact.domain_state(F.col("p"), now), p='{"status": ["clientHold"]}') == "suspended"
    assert one(spark, contact.domain_state(F.col("p"), now), p='{"status": ["on hold"], "events": [{"eventAction": "registrar expiration", "eventDate": "2020-01-01T00:00:00Z"}]}') == "exists"
    assert one(spark, contact.whois_state(F.lit(""), F.col("p"), now), p="Domain for sale") == "parked"
    assert one(spark, contact.ssl_state(F.col("p"), now), p="2024-01-01") == "expired"
