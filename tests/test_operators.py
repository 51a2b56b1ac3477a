from __future__ import annotations

import gzip
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prospectra.operators import enrich, export, leads, merge, orders, pages, tasks, validate
from prospectra.operators.lead_store import LeadStore
from prospectra.schemas import LEAD, LEAD_COLUMNS, TASK
from prospectra.sources import readers, sinks
from prospectra.streaming import jobs

NOW = datetime(2024, 3, 1)
CARD = (
    '<div class="Nv2PK"><a class="hfpxzc" href="https://m/1" aria-label="Corner Bakery & Co"></a><a data-value="Website" href="/url?q=https://corner.test&x=1">w</a>'
    '<span class="MW4etd">4.5</span><span class="UY7F9">(12)</span><div class="W4Efsd"><span>Bakery · Street</span></div><span class="UsdlK">098765 43210</span></div>'
)


def now():
    return F.lit(NOW)


def page(spark, html, least=0):
    head = '{"Search_Keyword": "bread", "Search_Location": "Pune", "order_ids": ["o1"], "scraped_date": "2024-02-01 00:00:00", "minimum_reviews": %d}' % least
    return spark.createDataFrame([(f"<!--{head}-->\n{html}",)], "value string").select(readers.split_page(F.col("value"))[0].alias("header"), readers.split_page(F.col("value"))[1].alias("html"))


def test_card_to_lead(spark):
    row = leads.parse_pages(page(spark, CARD)).first()
    assert (row["name"], row["website"], row["reviews"], row["rating"], row["phone"], row["phone_type"], row["category"]) == ("Corner Bakery & Co", "https://corner.test", 12, 4.5, "9876543210", "Mobile", "Bakery")
    assert row["order_ids"] == ["o1"] and row["search_keyword"] == "bread"


def test_cards_dropped(spark):
    assert leads.parse_pages(page(spark, CARD, least=13)).count() == 0
    assert leads.parse_pages(page(spark, CARD.replace("Bakery", "Permanently closed"))).count() == 0
    assert leads.parse_pages(page(spark, '<div role="article"><a class="hfpxzc" href="u">x</a></div>')).count() == 0


def test_orders(spark):
    raw = spark.createDataFrame([(None, None, [" tea ", ""], ["a", "b"], None, "[1.0, 2.0, 1.01, 2.0]", None, None, None, None), ("x", "c", None, [], None, None, 1, 2, 0.5, 3)], "order_id string, client_name string, keywords array<string>, locations array<string>, direct_queries array<string>, bounding_box string, minimum_reviews int, max_leads_required int, step_size double, zoom int")
    made = orders.expand_orders(readers.clean_orders(raw)).collect()
    assert sorted(r["query_type"] for r in made) == ["Grid", "Grid", "Matrix", "Matrix"]
    assert {r["search_location"] for r in made if r["query_type"] == "Grid"} == {"Grid_1.0000_2.0000", "Grid_1.0100_2.0000"}
    boxes = spark.createDataFrame([('{"south": 1, "west": 2, "north": 3, "east": 4}',), ("[1,2,3]",), ("nonsense",), (None,)], "b string").select(orders.bounding_box(F.col("b")).alias("x")).collect()
    assert [r["x"] is None for r in boxes] == [False, True, True, True]


def task_rows(spark, rows):
    return spark.createDataFrame([{**dict.fromkeys(TASK.fieldNames()), **r} for r in rows], TASK)


def test_fifty_workers_claim_fifty_tasks(spark):
    rows = [{"task_id": f"t{k:02}", "status": "PENDING", "attempt_count": 0, "max_attempts": 4, "priority": k % 3, "created_at": NOW} for k in range(60)]
    rows.append({"task_id": "gone", "status": "PROCESSING", "attempt_count": 4, "max_attempts": 4, "priority": 9, "lease_until": NOW - timedelta(1), "created_at": NOW})
    out = tasks.claim_tasks(task_rows(spark, rows), [f"w{k}" for k in range(50)], now()).collect()
    held = [r for r in out if r["status"] == "PROCESSING"]
    assert len(held) == 50 == len({r["worker_id"] for r in held}) and len(out) == 61
    assert [r["status"] for r in out if r["task_id"] == "gone"] == ["FAILED"]


def test_submit_fail_parse(spark):
    t = task_rows(spark, [{"task_id": "a", "status": "PROCESSING", "worker_id": "w", "attempt_count": 1, "max_attempts": 2}, {"task_id": "b", "status": "COMPLETED", "worker_id": "w", "parse_status": "PROCESSING", "parse_attempts": 5}])
    state, answers = tasks.submit_tasks(t, spark.createDataFrame([("a", "w"), ("b", "w"), ("c", "w"), ("a", "x")], "task_id string, worker_id string"), now())
    assert {(r["task_id"], r["worker_id"]): r["answer"] for r in answers.collect()} == {("a", "w"): "completed", ("b", "w"): "idempotent", ("c", "w"): "not_found", ("a", "x"): "conflict"}
    assert {r["status"] for r in state.collect()} == {"COMPLETED"}
    failed = tasks.fail_tasks(t, spark.createDataFrame([("a", "w", "r" * 3000, True)], "task_id string, worker_id string, reason string, retryable boolean"), now())
    row = failed.where("task_id = 'a'").first()
    assert row["status"] == "PENDING" and len(row["last_error"]) == 2000
    done = tasks.finish_parse(t, spark.createDataFrame([("b", "bad html")], "task_id string, error string"), now()).where("task_id = 'b'").first()
    assert done["parse_status"] == "FAILED"


def test_enqueue(spark):
    t = task_rows(spark, [{"task_id": "1", "task_key": "k1", "minimum_reviews": 5, "order_ids": ["a"], "status": "PENDING"}])
    new = spark.createDataFrame([("k1", "u", "t", "", "", "q", "b", 3, 0), ("k2", "u", "t", "", "", "q", "", 1, 1), ("k2", "v", "t", "", "", "q", "c", 2, 2)], "task_key string, target_url string, task_type string, search_keyword string, search_location string, query_type string, order_id string, minimum_reviews int, position int")
    out, counts = merge.enqueue_tasks(t, new, now())
    rows = {r["task_key"]: r for r in out.collect()}
    assert (rows["k1"]["minimum_reviews"], rows["k1"]["order_ids"]) == (3, ["a", "b"])
    assert (rows["k2"]["target_url"], rows["k2"]["order_ids"], rows["k2"]["minimum_reviews"]) == ("u", ["c"], 1)
    assert tuple(counts.first()) == (1, 2)


def lead_rows(spark, rows):
    return spark.createDataFrame([{**dict.fromkeys(LEAD_COLUMNS), **r} for r in rows], LEAD)


def test_merge_cases(spark):
    master = lead_rows(spark, [{"id": "1", "url": "u1", "phone": "p1", "name": "old", "order_ids": ["a"], "first_seen_date": NOW - timedelta(9)}, {"id": "2", "url": "u2", "phone": "p2", "name": "two"}])
    staging = lead_rows(spark, [{"id": "1", "url": "u1", "phone": "", "name": "", "order_ids": ["b"], "first_seen_date": NOW, "last_updated_date": NOW}, {"id": "9", "url": "", "phone": "p2", "name": "by phone", "last_updated_date": NOW}, {"id": "8", "url": "new", "phone": "p2", "name": "gap", "last_updated_date": NOW}])
    out = {r["id"]: r for r in merge.merge_leads(master, staging).collect()}
    assert (out["1"]["name"], out["1"]["order_ids"], out["1"]["first_seen_date"]) == ("old", ["a", "b"], NOW - timedelta(9))
    assert out["2"]["name"] == "by phone" and set(out) == {"1", "2", "8"}
    assert {r["id"] for r in merge.merge_leads(master, staging, legacy=True).collect()} == {"1", "2"}
    again = merge.merge_leads(merge.merge_leads(master, staging), staging)
    assert {r["id"]: r["name"] for r in again.collect()} == {r["id"]: r["name"] for r in out.values()}


def test_validation(spark):
    good = dict.fromkeys(LEAD_COLUMNS, "") | {"id": "1", "rating": "4.5", "reviews": "1,200", "is_valid": "t", "scraped_date": "2024-01-02T03:04:05+05:30", "tags": '["a"]', "order_ids": "{a,b}"}
    bad = good | {"rating": "inf", "reviews": "many", "raw_extracted": "{x"}
    rows = spark.createDataFrame([good, bad]).select(*LEAD_COLUMNS)
    valid, refused = validate.split_valid(rows)
    row = valid.first()
    assert (row["rating"], row["reviews"], row["is_valid"], str(row["scraped_date"]), row["order_ids"]) == (4.5, 1200, True, "2024-01-02 03:04:05", ["a", "b"])
    assert refused.count() == 1 and '"rating":"inf"' in sinks.quarantine_rows(refused.drop("reason"), "final_schema_validation_failed").first()["row_json"]


def test_cache_states(spark):
    t = spark.createDataFrame([("a", "o"), ("b", "o"), ("c", "o"), ("d", "o"), ("e", "o")], "task_key string, order_id string")
    p = spark.createDataFrame([("b", None, []), ("c", "{x", []), ("d", '{"scraped_date": "2023-12-11 00:00:00"}', []), ("e", '{"scraped_date": "2023-12-12 00:00:00"}', ["z"])], "key string, header_json string, order_ids array<string>")
    out = {r["task_key"]: (r["cache_state"], r["order_ids"]) for r in pages.classify_cache(t, p, now()).collect()}
    assert out == {"a": ("missing", ["o"]), "b": ("legacy_no_header", ["o"]), "c": ("corrupt", ["o"]), "d": ("stale", ["o"]), "e": ("hit", ["o", "z"])}


def test_enrichment(spark):
    html = '<title>T</title><meta name="viewport"><p>Call +91 98765 43210 or a@b.co</p><a href="/contact">Contact</a><a href="mailto:c@d.ee?x=1">m</a><a href="https://x.com/q">x</a><p>reviews</p>'
    site = spark.createDataFrame([("1", 0, "https://b.co/", html)], "id string, page_no int, base_url string, html string")
    found = enrich.page_findings(site)
    assert found.first()["contact_links"] == ["https://b.co/contact"]
    base = enrich.defaults(lead_rows(spark, [{"id": "1", "website": "https://b.co/", "phone_type": "Landline", "emails": "z@z.zz"}]), now())
    checks = spark.createDataFrame([("1", 200, "valid", "exists")], "id string, http_status int, ssl_status string, domain_state string")
    row = enrich.enrich(base, enrich.per_lead(found), checks, now()).first()
    assert (row["emails"], row["alternative_phones"], row["data_status"], row["quality_score"], row["twitter"]) == ("a@b.co, c@d.ee, z@z.zz", "+91 9876543210", "Premium", 90, "https://x.com/q")
    assert row["tags"] == ["ssl:valid", "domain:exists", "has_social_links", "has_reviews"]


def test_export(spark):
    rows = lead_rows(spark, [{"id": str(k), "url": f"u{k % 2}", "order_ids": ["o"], "is_valid": True, "lead_status": s, "data_status": d, "reviews": k, "search_location": "Grid_1"} for k, (s, d) in enumerate([("", "Ghost"), ("", "Premium"), ("", "Premium"), ("Dead", "Premium"), (None, "Premium")])])
    assert [(r["id"], r["search_location"]) for r in export.export_order(rows, "o").collect()] == [("2", "Target_Area_Export"), ("1", "Target_Area_Export")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"tasks": [{"hash_id": "ticket-17", "type": "grid_url", "target_url": "u", "Search_Keyword": "bread", "minimum_reviews": 5}]}')
    row = readers.read_tickets(spark, str(tmp_path / "t.json")).first()
    assert (row["task_key"], row["task_type"], row["search_keyword"], row["minimum_reviews"]) == ("ticket-17", "grid_url", "bread", 5)
    (tmp_path / "b.txt").write_text(" a \n\nb\n")
    assert [r["value"] for r in readers.read_lines(spark, str(tmp_path / "b.txt")).collect()] == ["a", "b"]
    assert sinks.load_verified(spark.range(5), str(tmp_path / "s")) == 5
    refused = spark.createDataFrame([(bytearray(b"\x1f\x8b"), 3, 9), (bytearray(b"xx"), 3, 9), (bytearray(b"\x1f\x8b"), 5, 9)], "h binary, c long, u long").select(sinks.upload_verdict(F.col("c"), F.col("u"), F.col("h"), max_bytes=4).alias("x"))
    assert [r["x"] for r in refused.collect()] == [None, "not_gzip", "too_large"]


def test_header_write_back(spark):
    pages_ = spark.createDataFrame([('<!--{"k": {"a": [1, "x,y"]}, "order_ids": "o1", "t": "q\\"r"}-->\nbody\nmore',), ('<!--{"order_ids": ["o1", "o2"]}-->',), ("plain",), ("<!--{x-->\nb",)], "value string")
    out = [r["v"] for r in pages_.select(sinks.with_order_id(F.col("value"), F.lit("o2")).alias("v")).collect()]
    assert out[2:] == [None, None] and json.loads(out[1][4:-4]) == {"order_ids": ["o1", "o2"]}
    head, body = out[0].split("\n", 1)
    assert body == "body\nmore" and json.loads(head[4:-3]) == {"k": {"a": [1, "x,y"]}, "order_ids": ["o1", "o2"], "t": 'q"r'}


def test_gzip_uploads(spark):
    whole = gzip.compress(b"a" * 5000)
    rows = [("ok", whole), ("two", whole + gzip.compress(b"b")), ("cut", whole[:-9]), ("text", b"\x1f\x8btext"), ("empty", b""), ("bad", whole[:-6] + b"000000")]
    got = {r["upload_id"]: (r["refused"], r["uncompressed"]) for r in sinks.gzip_verdict(spark.createDataFrame(rows, "upload_id string, content binary")).collect()}
    assert got["ok"] == (None, 5000) and got["two"] == (None, 5001) and {got[k][0] for k in ("cut", "text", "empty", "bad")} == {"not_gzip"}
    assert sinks.gzip_verdict(spark.createDataFrame(rows[:1], "upload_id string, content binary"), 4000).first()["refused"] == "too_large_uncompressed"


def test_failed_task_has_no_worker(spark):
    t = task_rows(spark, [{"task_id": k, "status": "PROCESSING", "worker_id": "w", "attempt_count": 1, "max_attempts": 2} for k in "ab"] + [{"task_id": "c", "status": "COMPLETED", "worker_id": "w"}])
    sent = spark.createDataFrame([("a", "w", "r", True), ("b", "w", "r", False), ("c", "w", "r", True), ("a", "x", "r", True), ("d", "w", "r", True)], "task_id string, worker_id string, reason string, retryable boolean")
    assert {r["task_id"]: (r["status"], r["worker_id"]) for r in tasks.fail_tasks(t, sent, now()).collect()} == {"a": ("PENDING", None), "b": ("FAILED", None), "c": ("COMPLETED", "w")}
    assert {(r["task_id"], r["worker_id"]): r["answer"] for r in tasks.fail_answers(t, sent).collect()} == {("a", "w"): "PENDING", ("b", "w"): "FAILED", ("c", "w"): "COMPLETED", ("a", "x"): "conflict", ("d", "w"): "not_found"}


def test_batch_mismatch_raises(spark):
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id string")
    merge.check_batch(ids("a", "b"), ids("b", "a"))
    for other in (ids("a"), ids("a", "b", "b"), ids("a", "c")):
        with pytest.raises(ValueError):
            merge.check_batch(ids("a", "b"), other)
    with pytest.raises(KeyError):
        tasks.task_status(task_rows(spark, [{"task_id": "a", "status": "PENDING"}]), "b")
    assert tasks.task_status(task_rows(spark, [{"task_id": "a", "status": "PENDING"}]), "a") == "PENDING"


def test_merge_stream_runs_batch_by_batch(spark, tmp_path):
    """Two batches of pages: one lead comes twice, the store holds both after the second."""
    card = "<div class='Nv2PK'><a class='hfpxzc' href='https://maps/{0}' aria-label='Shop {0}'></a><span class='UY7F9'>(9)</span><a data-value='Website' href='https://s{0}.com'></a></div>"
    rows = lambda *k: spark.createDataFrame([("".join(card.format(x) for x in k),)], "html string").selectExpr("named_struct('hash_id', 'h', 'order_ids', array('o%s'), 'query_type', 'q', 'scraped_date', '2024-01-0%s 00:00:00', 'Search_Keyword', 'k', 'Search_Location', 'l', 'minimum_reviews', 0) AS header" % (k[0], k[0]), "html")
    query = None
    for k in ((1,), (2, 1)):
        rows(*k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows(1).schema).parquet(str(tmp_path / "in"))
        query = jobs.merge_stream(stream, LeadStore(spark, str(tmp_path / "store"), 8), str(tmp_path / "ck"))
        query.awaitTermination()
    out = {r["name"]: r for r in LeadStore(spark, str(tmp_path / "store"), 8).leads().collect()}
    assert set(out) == {"Shop 1", "Shop 2"} and out["Shop 1"]["order_ids"] == ["o1", "o2"]


def test_contract_bounds(spark):
    rows = spark.createDataFrame([("", "u", 0), ("k" * 257, "u", -1), ("k", "u", 1)], "task_key string, target_url string, minimum_reviews int")
    assert [r["e"] for r in rows.select(tasks.contract_errors(rows.columns).alias("e")).collect()] == [["task_key"], ["task_key", "minimum_reviews"], []]


def test_merge_keeps_one_row_an_id(spark):
    row = lambda **k: {**dict.fromkeys(LEAD_COLUMNS), **k}
    master = spark.createDataFrame([row(id="1", name="old", order_ids=["a"])], LEAD)
    staged = [row(id="1", name="late", last_updated_date=NOW, order_ids=["b"]), row(id="1", name="early", last_updated_date=NOW - timedelta(1)), row(id="2", name="y", url="u", last_updated_date=NOW), row(id="2", name="x", url="v", last_updated_date=NOW - timedelta(2)), row(id="2", name="w")]
    out = {r["id"]: r for r in merge.merge_leads(master, spark.createDataFrame(staged, LEAD)).collect()}
    assert merge.merge_leads(master, spark.createDataFrame(staged, LEAD)).count() == 2
    assert out["1"]["name"] == "late" and out["1"]["order_ids"] == ["a", "b"] and (out["2"]["name"], out["2"]["url"]) == ("y", "u")
