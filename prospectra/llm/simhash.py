"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_ids, cut, own_columns
from .components import connected_components

#: Widths of the five blocks of a 64-bit fingerprint; two fingerprints that differ in at most two bits agree on three.
BLOCKS = (13, 13, 13, 13, 12)
#: A bucket with more fingerprints than this is split further before its pairs are formed.
BUCKET = 32
SEED = 42
_PIECE = 1 << 15


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included; a shorter text is one shingle; no word: none.

    ``bytes.lower`` and ``bytes.split`` work on A-Z and on the six ASCII white space characters alone.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), dtype="<u8", count=n)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text, from XXH64 of its word shingles; no word: 0."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _PIECE):
        ones += np.unpackbits(hashes[k : k + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; whole texts, one row at a time within Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bits(value: Column, spans: list[tuple[int, int]]) -> Column:
    """The bits of ``value`` inside the spans (start, width), others zero."""
    mask = sum(((1 << width) - 1) << start for start, width in spans)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _spans(widths: tuple[int, ...], start: int = 0) -> list[tuple[int, int]]:
    out = []
    for width in widths:
        out.append((start, width))
        start += width
    return out


def close_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct ``prints`` (fp) to all pairs (u, v), u < v, that differ in at most ``distance`` bits.

    Five blocks: a pair within two bits agrees on at least three, so it shares one of ten keys of 38 bits or more. A
    bucket with more than BUCKET fingerprints is split again: its members differ in 26 bits at most, cut into four
    parts of which a pair shares two. Such a bucket has at most 2**14 different fingerprints, whatever the input, so
    no pairing grows with the square of a group. Nothing is capped or dropped.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the blocks guarantee pairs within two bits")
    spans = _spans(BLOCKS)
    choices = list(combinations(range(5), 3))
    keyed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _bits(F.col("fp"), [spans[i] for i in chosen]).alias("key")) for k, chosen in enumerate(choices)])).alias("b"),
    ).select("fp", "b.part", "b.key")
    crowded = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("part", "key", F.lit(True).alias("crowded"))
    marked = keyed.join(crowded, ["part", "key"], "left")

    def finer(chosen: tuple[int, ...], k: int) -> Column:
        rest = []
        for i in (i for i in range(5) if i not in chosen):
            start, width = spans[i]
            rest += [(start, width // 2), (start + width // 2, width - width // 2)]
        return F.array(*[F.struct(F.lit(100 * k + j + 100).alias("part"), (_bits(F.col("fp"), [spans[i] for i in chosen] + [rest[x] for x in two])).alias("key")) for j, two in enumerate(combinations(range(4), 2))])

    split = reduce(lambda other, k: F.when(F.col("part") == k, finer(choices[k], k)).otherwise(other), range(1, len(choices)), finer(choices[0], 0))
    buckets = marked.select("fp", F.explode(F.when(F.col("crowded"), split).otherwise(F.array(F.struct("part", "key")))).alias("b")).select("fp", "b.part", "b.key")
    left, right = buckets.withColumnRenamed("fp", "u"), buckets.withColumnRenamed("fp", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return left.join(right, (left.part == right.part) & (left.key == right.key) & (F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat an id each get a row. A null id
    gets a row and never names a component while the component has another id. Copies meet as one fingerprint before
    any pairing; only different fingerprints within ``distance`` bits are linked. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    groups = connected_components(close_pairs(firsts.select("fp"), distance))
    placed = firsts.join(groups, firsts.fp == groups.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(named, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that carry their component's least doc_id, one row for each such id; columns unchanged, whatever
    their names.

    Rows without an id cannot be told apart and stay.
    """
    return keep_named(docs, near_duplicates(docs.select("doc_id", "text"), shingle, distance))


def keep_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component_id in ``found`` (doc_id, component_id, a row for each of ``docs``)."""
    gone = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_dup_id")).agg(F.min(F.col("doc_id") != F.col("component_id")).alias("_dup"), F.count("*").alias("_n"))
    odd = broadcast_ids(cut(gone.where("_dup or _n > 1")))
    marked = docs.join(odd, docs.doc_id == odd["_dup_id"], "left")
    once = marked.where((odd["_n"] > 1) & ~odd["_dup"]).select(own_columns(docs)).dropDuplicates(["doc_id"])
    return marked.where(odd["_dup"].isNull()).select(own_columns(docs)).unionByName(once)
