"""A store of leads that a batch changes in place: buckets by id, with side indexes from url and phone to id.

A batch reads only the buckets its rows can touch, which the indexes name, and writes only those. Written buckets are new
folders; a manifest, written last, tells each bucket's newest one. So readers see a batch whole or not at all, and a batch
that runs again, after a failure or not, starts from the same manifest and gives the same store.

    <root>/<kind>/v=<batch>/bucket=<n>     kind: leads, url or phone
    <root>/manifest/v=<batch>              kind, bucket, version, of all buckets
    <root>/batch/v=<batch>                 the batch's own rows
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..schemas import LEAD
from ..sources.files import open_store
from .merge import merge_leads, shuffled

INDEX = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.StringType())])
MANIFEST = "kind string, bucket int, version bigint"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class LeadStore:
    """``buckets`` bounds what the driver holds: the numbers of the buckets of one batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, schema: T.StructType = LEAD):
        self.spark, self.root, self.buckets, self.schema = spark, root.rstrip("/"), buckets, schema

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # --- versions ---

    def manifest(self, before: int | None = None) -> dict[tuple[str, int], int]:
        """The version of each bucket as of the last batch (below ``before``)."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, v bigint").parquet(f"{self.root}/manifest")
        except AnalysisException:
            return {}
        rows = rows if before is None else rows.where(F.col("v") < before)
        last = rows.agg(F.max("v")).first()[0]
        return {} if last is None else {(r["kind"], r["bucket"]): r["version"] for r in rows.where(F.col("v") == last).collect()}

    def read_buckets(self, kind: str, versions: dict[tuple[str, int], int], wanted: set[int] | None = None) -> DataFrame:
        schema = self.schema if kind == "leads" else INDEX
        paths = [f"{self.root}/{kind}/v={v}/bucket={b}" for (k, b), v in sorted(versions.items()) if k == kind and (wanted is None or b in wanted)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def leads(self) -> DataFrame:
        """All leads as of the last batch."""
        return self.read_buckets("leads", self.manifest())

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r["b"] for r in keys.select(self.bucket(F.col("key")).alias("b")).distinct().collect()}

    def _write(self, kind: str, rows: DataFrame, key: str, version: int, touched: set[int]) -> set[int]:
        """Writes the rows of the touched buckets; a bucket left without rows has no folder and leaves the manifest."""
        path = f"{self.root}/{kind}/v={version}"
        # buckets stay whole: one task writes one file of each, AQE may join small ones
        rows.withColumn("bucket", self.bucket(F.col(key))).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.parquet(path) if touched else None
        return {r["bucket"] for r in written.select("bucket").distinct().collect()} if written is not None and "bucket" in written.columns else set()

    def vacuum(self, keep: int = 2) -> int:
        """Removes folders that none of the newest ``keep`` manifests names, and those manifests' elders; the number of folders."""
        store, at = open_store(self.root)
        folders = lambda path: [i.path for i in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.type == pafs.FileType.Directory]
        number = lambda path: int(path.rsplit("=", 1)[1])
        manifests = sorted(folders(f"{at}/manifest"), key=number)
        named = [(k, b, v) for m in manifests[-keep:] for (k, b), v in self.manifest(before=number(m) + 1).items()]
        held = {f"{at}/{k}/v={v}/bucket={b}" for k, b, v in named}
        newest = number(manifests[-1]) if manifests else -1
        gone = manifests[:-keep]
        for kind in ("leads", "url", "phone"):
            # a batch that runs meanwhile is newer than the newest manifest
            gone += [b for v in folders(f"{at}/{kind}") if number(v) <= newest for b in folders(v) if b not in held]
        gone += [b for b in folders(f"{at}/batch") if number(b) < newest]
        for path in gone:
            store.delete_dir(path)
        return len(gone)

    # --- batches ---

    def apply(self, staging: DataFrame, version: int, merge: Merge = merge_leads) -> dict[str, int]:
        """Merges ``staging`` into the store as batch ``version``; counts of the buckets it wrote, by kind.

        ``merge`` (master, staging) may match rows by id, url and phone and must keep ids and give one row for each; rows of
        staging without an id don't count. The batch is written to the store first, so its source is read once.
        """
        old = self.manifest(before=version)
        path = f"{self.root}/batch/v={version}"
        staging.where("id IS NOT NULL").write.mode("overwrite").parquet(path)
        staging = self.spark.read.schema(staging.schema).parquet(path)
        keys = {"url": staging.select(F.col("url").alias("key")), "phone": staging.where("coalesce(url, '') = ''").select(F.col("phone").alias("key"))}
        ids = [staging.select(F.col("id").alias("key"))]
        for kind, rows in keys.items():
            some = rows.where("coalesce(key, '') <> ''").distinct()
            index = self.read_buckets(kind, old, self._touched(some))
            ids.append(index.join(shuffled(some), "key", "left_semi").select(F.col("id").alias("key")))
        touched = {"leads": self._touched(reduce(DataFrame.union, ids))}
        before = self.read_buckets("leads", old, touched["leads"])
        new = {("leads", b): version for b in self._write("leads", merge(before, staging), "id", version, touched["leads"])}
        after = self.read_buckets("leads", new)
        for kind in ("url", "phone"):
            pairs = lambda rows: rows.select(F.col(kind).alias("key"), "id").where("coalesce(key, '') <> ''")  # noqa: B023, E731
            gone, come = pairs(before).join(shuffled(pairs(after)), ["key", "id"], "left_anti"), pairs(after).join(shuffled(pairs(before)), ["key", "id"], "left_anti")
            touched[kind] = self._touched(gone.union(come).select("key"))
            kept = self.read_buckets(kind, old, touched[kind]).join(shuffled(gone), ["key", "id"], "left_anti")
            new |= {(kind, b): version for b in self._write(kind, kept.union(come), "key", version, touched[kind])} if touched[kind] else {}
        versions = {k: v for k, v in old.items() if k[1] not in touched[k[0]]} | new
        self.spark.createDataFrame([(k, b, v) for (k, b), v in versions.items()], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return {kind: len(b) for kind, b in touched.items()}
