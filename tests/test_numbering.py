"""Consecutive numbers, tiled grids and numbering plans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from prospectra.functions import contact
from prospectra.operators import numbering, orders


def test_numbers_within_groups(spark):
    """A group of a third of all rows, one row groups, null keys and repeated rows, against a plain count."""
    rng = random.Random(4)
    rows = [("hot" if k % 3 == 0 else rng.choice([f"g{rng.randrange(40)}", None]), rng.randrange(500), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    seen: dict = {}
    want = {}
    for g, v, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + 1
    got = numbering.numbered(df, ["g"], ["v", "k"])
    assert {r["k"]: r["place"] for r in got.collect()} == want and got.columns == ["g", "v", "k", "place"]
    whole = [r["k"] for r in numbering.numbered(df, [], [F.desc("v"), "k"]).orderBy("place").collect()]
    assert whole == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert numbering.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_no_range_holds_much_more_than_its_share(spark):
    df = spark.range(0, 40_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        keyed = df.repartitionByRange(16, "g", "id")
        sizes = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 40_000 / 16
        last = numbering.numbered(df, ["g"], ["id"]).groupBy("g").agg(F.max("place").alias("m"), F.count("*").alias("n"))
        assert last.where("m <> n - 1").count() == 0 and last.count() == 501
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_large_box_keeps_all_tasks_busy(spark):
    box = '{"south": 0, "west": 0, "north": 10, "east": 10}'
    order = spark.createDataFrame([("o", ["k"], box, 0.01, 14, 0)], "order_id string, keywords array<string>, bounding_box string, step_size double, zoom int, minimum_reviews int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in orders.grid_points(order).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1001 * 1001 and len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / 4
    line = order.withColumn("bounding_box", F.lit('{"south": 1, "west": 2, "north": 1, "east": 2.05}'))
    assert sorted((r["_lat"], r["_lng"]) for r in orders.grid_points(line, tile=2).collect()) == [(1.0, round(2 + k / 100, 2)) for k in range(6)]
    turned = order.withColumn("bounding_box", F.lit('{"south": 3, "west": 2, "north": 1, "east": 4}'))
    assert orders.grid_points(turned).count() == 0


def test_numbering_plans(spark):
    cases = {
        "+44 20 7946 0958": ("GB", "44", "2079460958", "valid"), "0044 20 7946 0958": ("GB", "44", "2079460958", "valid"), "+351 912 345 678": ("PT", "351", "912345678", "valid"), "+852 1234": ("HK", "852", "1234", "too_short"),
        "+1 (212) 555-01234": ("US", "1", "21255501234", "too_long"), "+999 123": (None, None, "999123", "unknown"), "098765 43210": ("IN", "91", "9876543210", "valid"), "12": ("IN", "91", "12", "too_short"), "+": None, "": None, "none": None,
        "+33 1 23 45 67 89": ("FR", "33", "123456789", "valid"), "+65 6123 4567": ("SG", "65", "61234567", "valid"), "+49 30 1": (None, None, "49301", "unknown"),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string").select("raw", contact.country_number(F.col("raw")).alias("n"))
    got = {r["raw"]: r["n"] and tuple(r["n"]) for r in df.collect()}
    assert got == {**cases, None: None}
    assert len(contact.NUMBERING_PLANS) >= 20
