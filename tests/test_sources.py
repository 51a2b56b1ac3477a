"""Upload source, named-file writer and card table function: limits, broken input, commits."""

from __future__ import annotations

import gzip
import io
import subprocess
import sys
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prospectra.operators import cards, leads
from prospectra.sources import files, named_files, readers, sinks, uploads


def test_verdicts_of_gzip_data():
    whole, two = gzip.compress(b"abc" * 1000), gzip.compress(b"a") + b"\0\0" + gzip.compress(b"b" * 9)
    given = {
        whole: (None, 3000), two: (None, 10), b"": ("not_gzip", 0), b"plain": ("not_gzip", 0), whole[:-4]: ("not_gzip", 3000),
        whole + b"junk": ("not_gzip", 3000), whole[:40] + b"x" + whole[41:]: None, b"\x1f\x8babc": ("not_gzip", 0), gzip.compress(b""): (None, 0),
    }
    for data, want in given.items():
        got = uploads.verdict(io.BytesIO(data), 3000)
        assert got == want if want else got[0] == "not_gzip", data[:10]
    assert uploads.verdict(io.BytesIO(whole), 2999)[0] == "too_large_uncompressed"
    assert uploads.verdict(io.BytesIO(b"plain"), 10, plain=True) == (None, 5)
    assert uploads.verdict(io.BytesIO(b"plain"), 4, plain=True)[0] == "too_large_uncompressed"


def test_a_bomb_is_refused_in_little_memory(tmp_path):
    pack = zlib.compressobj(9, zlib.DEFLATED, 31)
    piece = bytes(1 << 24)
    bomb = tmp_path / "bomb.html.gz"
    with bomb.open("wb") as out:
        for _ in range(128):
            out.write(pack.compress(piece))
        out.write(pack.flush())
    assert bomb.stat().st_size < 4 << 20
    code = (
        "import resource, sys; from prospectra.sources.uploads import GzipReader, PackedFiles;"
        f"r = GzipReader({{'path': '{tmp_path}'}}); rows = [b.to_pylist() for p in r.partitions() for b in r.read(p)];"
        "print(rows[0][0]['refused'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    root = str(Path(__file__).resolve().parent.parent)
    why, megabytes = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root).stdout.split()
    assert why == "too_large_uncompressed" and int(megabytes) < 300


def test_upload_source(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"t{k}.html.gz").write_bytes(gzip.compress(f"<p>{k}é</p>".encode() + (b"\xff" if k == 7 else b"") + b" " * (k * 10)))
    (tmp_path / "bad.html.gz").write_bytes(b"\x1f\x8bnothing")
    (tmp_path / "plain.html").write_text("<!--{\"hash_id\": \"h\"}-->\nbody")
    (tmp_path / "_hidden.gz").write_bytes(b"x")
    got = {r["key"]: r for r in uploads.read_gzip(spark, str(tmp_path), maxBytes=400, maxUncompressed=300, partitionBytes=1000, openCost=0).collect()}
    assert len(got) == 42 and got["bad"]["refused"] == got["plain"]["refused"] == "not_gzip"
    assert {k for k, r in got.items() if r["refused"] == "too_large_uncompressed"} == {f"t{k}" for k in range(40) if k * 10 + len(f"<p>{k}é</p>".encode()) + (k == 7) > 300}
    assert got["t7"]["content"].startswith("<p>7é</p>�") and got["t3"]["uncompressed"] == len(got["t3"]["content"].encode())
    assert len(files.packed(files.list_files(str(tmp_path)), 1000, 0)) > 1
    pages = {r["key"]: r for r in readers.read_pages(spark, str(tmp_path), lenient=True).collect()}
    assert pages["plain"]["html"] == "body" and pages["plain"]["header"]["hash_id"] == "h" and "bad" not in pages
    empty = tmp_path / "none"
    empty.mkdir()
    assert uploads.read_gzip(spark, str(empty)).count() == 0
    assert uploads.read_gzip(spark, str(tmp_path), content=False).where("content IS NOT NULL").count() == 0


def test_packing():
    sizes = [("a", 5), ("b", 5), ("c", 30), ("d", 1), ("e", 1)]
    assert [[n for n, _ in g] for g in files.packed(iter(sizes), 12, 1)] == [["a", "b"], ["c"], ["d", "e"]]
    assert files.packed(iter([]), 10, 1) == []


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 3}/f{i % 5}.txt", f"{i}\n", i) for i in range(100)], "name string, data string, at int").withColumn("head", F.lit("top\n"))
    named_files.write_named(rows, str(tmp_path / "out"), order=["at"])
    made = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert len(made) == 15 and not list((tmp_path / "out").glob("_attempt*"))
    assert made["k1/f2.txt"] == "top\n" + "".join(f"{i}\n" for i in range(100) if i % 3 == 1 and i % 5 == 2)
    named_files.write_named(rows.limit(1), str(tmp_path / "out"), overwrite=True)
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 1


def test_named_files_of_a_failed_job_leave_nothing(spark, tmp_path):
    twice = spark.createDataFrame([("f", "a"), ("f", "b")], "name string, data string").repartition(2)
    with pytest.raises(Exception, match="DuplicateFile|together"):
        named_files.write_named(twice.unionByName(twice), str(tmp_path / "a"), together=False)
    broken = spark.range(0, 50, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 40, F.raise_error(F.lit("no"))).otherwise("x").alias("data"))
    with pytest.raises(Exception, match="no"):
        named_files.write_named(broken, str(tmp_path / "b"), together=False)
    with pytest.raises(Exception, match="not a file name"):
        named_files.write_named(spark.createDataFrame([("../f", "a")], "name string, data string"), str(tmp_path / "c"))
    assert not list(files.list_files(str(tmp_path)))


def test_delivery_files(spark, tmp_path):
    rows = [("1", "tea", "a/b", "x, \"y\"", 5, "Premium", 1), ("2", "tea", "a/b", None, 9, "Fallback", 2), ("3", "tea", "a/b", "z", 7, "Premium", 1), ("4", "été", "c", "line\nline", 0, "Premium", 1)]
    folder = sinks.write_export(spark.createDataFrame(rows, "id string, search_keyword string, search_location string, name string, reviews int, data_status string, tier int"), str(tmp_path), "o:1", "C & D")
    made = {str(p.relative_to(folder)): p.read_text("utf-8") for p in Path(folder).rglob("*.csv")}
    assert made["tea/ab.csv"].startswith("﻿id,name,reviews\n") or made.get("tea/a b.csv", "").startswith("﻿id,name,reviews\n")
    group = next(v for k, v in made.items() if k.startswith("tea/"))
    assert group.split("\n")[1:] == ["3,z,7", '1,"x, ""y""",5', "2,,9", ""]
    assert made["o1_Master.csv"].split("\n")[0] == "﻿id,search_keyword,search_location,name,reviews,Category" and made["o1_Master.csv"].count("\n") == 5


CARD = '<div class="Nv2PK"><a class="hfpxzc" href="https://m/%d" aria-label="Shop %d"></a><span class="UY7F9">(12)</span><div class="W4Efsd"><span>Bakery</span></div></div>'


def test_unclosed_cards_take_little_time():
    began = time.time()
    rows = list(cards.card_rows("<div class='Nv2PK'>x<span class='UY7F9'>y" * 3000))
    assert len(rows) == 3000 and {r[1] for r in rows} == {"x y"} and time.time() - began < 1
    nested = list(cards.card_rows("<div class='Nv2PK'>a<div class='Nv2PK'>b</div>c</div>"))
    assert [r[1] for r in nested] == ["a b c", "b"]
    assert [r[1] for r in cards.card_rows("<div role=article>r</div>")] == ["r"] and list(cards.card_rows(None)) == []


def test_a_broken_card_costs_itself_alone(spark, monkeypatch):
    whole = cards._span

    def failing(reader, element, end):
        text = whole(reader, element, end)
        if "broken" in text:
            raise ValueError("can't be read")
        return text

    monkeypatch.setattr(cards, "_span", failing)
    rows = list(cards.card_rows(CARD % (1, 1) + "<div class='Nv2PK'>broken</div>" + CARD % (2, 2)))
    assert [r[-1] for r in rows] == [None, "ValueError: can't be read", None] and [r[0] for r in rows] == [0, 1, 2]
    assert [r[2] for r in rows] == ["https://m/1", None, "https://m/2"]
    monkeypatch.undo()
    pages = spark.createDataFrame([(None, CARD % (1, 1)), (None, ""), (None, None)], "header struct<Search_Keyword: string, Search_Location: string, order_ids: array<string>, query_type: string, scraped_date: string, minimum_reviews: int>, html string")
    assert leads.broken_cards(pages).count() == 0 and [r["name"] for r in leads.card_rows(pages).collect()] == ["Shop 1"]


def test_judged_rows_are_written_and_counted_in_one_pass(spark, tmp_path):
    from prospectra.schemas import LEAD_COLUMNS

    row = lambda k, **v: {**dict.fromkeys(LEAD_COLUMNS, ""), "id": str(k), **v}
    rows = [{**row(k, rating="4.5" if k % 4 else "bad", name='a, "b"\nc', order_ids="{x,y}"), "outcome": "online" if k % 3 else "dead"} for k in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*LEAD_COLUMNS, "outcome"])).repartition(3)
    seen = sinks.write_judged(df, str(tmp_path / "out"))
    assert (seen["total"], seen["quarantined"], seen["writer_puts"], seen["online"], seen["dead"], seen["offline"]) == (40, 10, 30, 26, 14, 0) and len(seen) == 10
    good = readers.read_buffer(spark, str(tmp_path / "out" / "final"), LEAD_COLUMNS).collect()
    assert {int(r["id"]) for r in good} == {k for k in range(40) if k % 4} and {r["order_ids"] for r in good} == {'{"x","y"}'}
    bad = spark.read.schema("reason string, columns array<string>, row struct<id: string, rating: string>").json(str(tmp_path / "out" / "quarantine")).collect()
    assert {(int(r["row"]["id"]), r["columns"][0], r["row"]["rating"]) for r in bad} == {(k, "rating", "bad") for k in range(0, 40, 4)}
    with pytest.raises(ValueError, match="unexpected"):
        sinks.write_judged(df.withColumn("more", F.lit(1)), str(tmp_path / "no"))


def test_counters_of_a_streams_batches(spark, tmp_path):
    listener = sinks.BatchCounters("run")
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame([("online", False), ("dead", True)], "outcome string, refused boolean").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("outcome string, refused boolean").parquet(str(tmp_path / "in"))
        watched = stream.observe("run", *sinks.run_counters(F.col("outcome"), F.col("refused")))
        watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        end = time.time() + 20
        while not listener.batches and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.batches[0] | {} == {"total": 2, "online": 1, "dead": 1, "quarantined": 1, "writer_puts": 1, **dict.fromkeys(("offline", "skipped_completed", "blocklisted", "needs_render", "failed"), 0)}


def test_archived_buffer(spark, tmp_path):
    from datetime import datetime

    kept = sinks.archive_buffer(spark.range(3), str(tmp_path / "b"), datetime(2024, 3, 1, 2, 3, 4))
    assert kept.endswith("b_20240301_020304") and spark.read.parquet(kept).count() == 3
    assert sinks.archive_buffer(spark.range(0), str(tmp_path / "b"), datetime(2024, 3, 1)) is None
