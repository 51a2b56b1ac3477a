"""Order expansion: keyword and location pairs, direct queries, coordinate grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import task_id, url_quote
from .numbering import numbered

GRID_URL = "https://www.google.com/maps/search/"
_EXTRA = ["order_id", "minimum_reviews"]


def bounding_box(box: Column) -> Column:
    """struct(min_lat, min_lng, max_lat, max_lng) of a JSON box: an object in three spellings, or a list of four; else null."""
    v = F.try_parse_json(box)
    pick = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", "double") for n in names])
    as_object = F.struct(
        pick("min_lat", "minLat", "south").alias("min_lat"), pick("min_lng", "minLng", "west").alias("min_lng"),
        pick("max_lat", "maxLat", "north").alias("max_lat"), pick("max_lng", "maxLng", "east").alias("max_lng"),
    )
    items = F.try_variant_get(v, "$", "array<double>")
    as_list = F.struct(*[F.get(items, i).alias(n) for i, n in enumerate(("min_lat", "min_lng", "max_lat", "max_lng"))])
    out = F.when(F.size(items) == 4, as_list).when(items.isNull(), as_object)
    whole = out["min_lat"].isNotNull() & out["min_lng"].isNotNull() & out["max_lat"].isNotNull() & out["max_lng"].isNotNull()
    return F.when(whole, out)


def _task(df: DataFrame, query: Column, keyword: Column, location: Column, kind: str, source: str, url: Column | None = None, key: Column | None = None) -> DataFrame:
    return df.select(
        task_id(query if key is None else key).alias("task_key"), F.lit(kind).alias("task_type"), (query if url is None else url).alias("target_url"),
        keyword.alias("search_keyword"), location.alias("search_location"), F.lit(source).alias("query_type"), *_EXTRA, "_order",
    )


def matrix_tasks(orders: DataFrame) -> DataFrame:
    """``<keyword> in <location>`` for every pair of an order."""
    pairs = orders.select("*", F.posexplode("keywords").alias("_k", "_kw")).select("*", F.posexplode("locations").alias("_l", "_loc")).withColumn("_order", F.struct(F.lit(0).alias("a"), F.col("_k").alias("b"), F.col("_l").alias("c"), F.lit(0).alias("d")))
    return _task(pairs, F.concat("_kw", F.lit(" in "), "_loc"), F.col("_kw"), F.col("_loc"), "text_search", "Matrix")


def direct_tasks(orders: DataFrame) -> DataFrame:
    rows = orders.select("*", F.posexplode("direct_queries").alias("_k", "_q")).withColumn("_order", F.struct(F.lit(1).alias("a"), F.col("_k").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")))
    return _task(rows, F.col("_q"), F.col("_q"), F.lit("Direct"), "text_search", "Direct")


#: Points on a side of a tile.
TILE = 64


def _steps(low: Column, high: Column, step: Column) -> Column:
    """Number of the points of one axis, both ends included; none for a box turned round."""
    n = F.bround((high - low) / step).cast("int") + 1
    return F.when((step > 0) & (n > 0), n).otherwise(0)


def grid_points(orders: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per point of each order's box, with ``_lat`` and ``_lng``.

    A box is cut into tiles first and those are dealt out, so one large box keeps all tasks busy.
    """
    boxed = orders.withColumn("_box", bounding_box(F.col("bounding_box"))).where("_box IS NOT NULL")
    bounds = {side: (F.col(f"_box.min_{side}"), F.col(f"_box.max_{side}")) for side in ("lat", "lng")}
    sized = boxed.withColumns({f"_n_{side}": _steps(low, high, F.col("step_size")) for side, (low, high) in bounds.items()} | {f"_from_{side}": low for side, (low, _) in bounds.items()}).drop("_box")
    starts = lambda side: F.when(F.col(f"_n_{side}") > 0, F.sequence(F.lit(0), F.col(f"_n_{side}") - 1, F.lit(tile)))
    inside = lambda side, first: F.sequence(F.col(first), F.least(F.col(first) + (tile - 1), F.col(f"_n_{side}") - 1))
    tiles = sized.select("*", F.explode(starts("lat")).alias("_i0")).select("*", F.explode(starts("lng")).alias("_j0"))
    dealt = tiles.repartition("order_id", "_i0", "_j0")
    cells = dealt.select("*", F.explode(inside("lat", "_i0")).alias("_i")).select("*", F.explode(inside("lng", "_j0")).alias("_j"))
    at = lambda side, k: F.bround(F.col(f"_from_{side}") + F.col(k) * F.col("step_size"), 6)
    return cells.withColumns({"_lat": at("lat", "_i"), "_lng": at("lng", "_j")}).drop("_n_lat", "_n_lng", "_from_lat", "_from_lng", "_i0", "_j0")


def grid_tasks(orders: DataFrame) -> DataFrame:
    """A map search for every point and keyword; orders without a box or keywords have none."""
    points = grid_points(orders).select("*", F.posexplode("keywords").alias("_k", "_kw")).withColumn("_order", F.struct(F.lit(2).alias("a"), F.col("_i").alias("b"), F.col("_j").alias("c"), F.col("_k").alias("d")))
    url = F.concat(F.lit(GRID_URL), url_quote(F.col("_kw")), F.format_string("/@%.4f,%.4f,", "_lat", "_lng"), F.col("zoom").cast("string"), F.lit("z"))
    place = F.format_string("Grid_%.4f_%.4f", "_lat", "_lng")
    return _task(points, url, F.col("_kw"), place, "grid_url", "Grid", url=url, key=url)


def expand_orders(orders: DataFrame) -> DataFrame:
    """All tasks of all orders, duplicates included."""
    usable = orders.where("NOT rejected") if "rejected" in orders.columns else orders
    return matrix_tasks(usable).unionByName(direct_tasks(usable)).unionByName(grid_tasks(usable))


def query_map(tasks: DataFrame) -> DataFrame:
    """One task per key: the last made."""
    rest = [c for c in tasks.columns if c not in ("task_key", "_order")]
    return tasks.groupBy("task_key").agg(F.max_by(F.struct(*rest), F.struct("order_id", "_order")).alias("t")).select("task_key", "t.*")


def chunk_of(tasks: DataFrame, order_by: list[Column | str], size: int, within: list[str]) -> DataFrame:
    """``chunk`` numbers of ``size`` rows, counted within groups; a group of any size is spread over tasks."""
    return numbered(tasks, within, order_by, "chunk").withColumn("chunk", F.expr(f"chunk div {size}"))


def pick_order(pending: DataFrame) -> DataFrame:
    """The pending order of highest priority, ties by name."""
    return pending.orderBy(F.desc("priority"), "name").limit(1)
