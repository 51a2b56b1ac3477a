"""Near-dedup of whole documents: SimHash links, and a wide pass for documents whose sets of word shingles are alike.

Pairs of similarity 0.8 differ in about 15% of the bits of a SimHash, so blocks on which they must agree are too short
to prune anything. In the wide pass blocks are hashes of minima of the shingle set, which such pairs share far more
often, and every candidate is verified by the stored hashes of both shingle sets. Texts are read once; what moves are
classes of equal texts, block keys and hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_ids, cut, stage_dir
from .components import connected_components
from .simhash import close_pairs, fingerprint

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks and minima in each: a pair of similarity 0.8 shares no block with probability (1 - 0.8**5)**24 = 0.00007.
BLOCKS = 24
ROWS = 5
#: A bucket that isn't one group after its centre has met it forms all pairs up to this size, and beyond it in tiles.
BUCKET = 32
#: Documents and bytes of shingle hashes on one side of a tile, on average.
TILE_ROWS = 512
TILE_BYTES = 16 << 20
_COLUMNS = 1 << 13
_PIECE = 1 << 13
_RNG = np.random.default_rng(42)
_ODD32 = _RNG.integers(0, 1 << 31, BLOCKS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD64 = _RNG.integers(0, 1 << 63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hash of each word asked for; forgets all when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        return self.setdefault(word, xxhash.xxh3_64_intdigest(word))


def _scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes], shingle: int = SHINGLE, hashes: WordHashes | None = None) -> np.ndarray:
    """The different word shingles of a text as sorted 32-bit hashes; fewer words are one shingle, none is the empty set."""
    if not words:
        return np.zeros(0, np.uint32)
    known = WordHashes() if hashes is None else hashes
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            mixed = mixed * np.uint64(_STEP) + h[k : k + n]
    return np.unique((_scrambled(mixed) >> np.uint64(32)).astype(np.uint32))


def block_keys(members: np.ndarray) -> np.ndarray:
    """BLOCKS signed 64-bit keys of a shingle set, none of the empty one."""
    if not len(members):
        return np.zeros(0, np.int64)
    least = np.full(len(_ODD32), np.iinfo(np.uint32).max, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(members), _PIECE):
            np.minimum(least, np.multiply.outer(_ODD32, members[k : k + _PIECE]).min(axis=1), out=least)
        rows = least.reshape(BLOCKS, ROWS).astype(np.uint64) + np.uint64(1)
        return _scrambled((rows * _ODD64[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BLOCKS, dtype=np.uint64) * _ODD64[ROWS]).view(np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = _shared(a, b)
    return both > 0 and both >= similarity * (len(a) + len(b) - both)


def jaccard(a: bytes | None, b: bytes | None, shingle: int = SHINGLE) -> float:
    x, y = (shingle_set(t.lower().split() if t else [], shingle) for t in (a, b))
    both = _shared(x, y)
    return both / max(1, len(x) + len(y) - both)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (hash of the text), cls (128-bit hash of its words), fp (SimHash), keys and bag.

    ``bag`` holds the shingle set's hashes. Written to the shared folder once; later steps read only the columns they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(2):
                    data = (text.as_py() or b"").lower()
                    words = data.split()
                    bag = shingle_set(words, shingle, known)
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words)), fingerprint(data), block_keys(bag), bag.tobytes()))
                cls, fp, keys, bags = zip(*rows)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array(fp, pa.int64()), lists, pa.array(bags, pa.binary())], names=["doc_id", "mark", "cls", "fp", "keys", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, mark bigint, cls binary, fp bigint, keys array<bigint>, bag binary")
    path = f"{stage_dir(docs.sparkSession)}/signatures"
    made.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def simhash_links(classes: DataFrame) -> DataFrame:
    """(u, v): classes that SimHash ties. Equal fingerprints hang on their least class; close ones tie those."""
    firsts = cut(classes.groupBy("fp").agg(F.min("cls").alias("lead"), F.count("*").alias("n")))
    several = broadcast_ids(cut(firsts.where("n > 1").select("fp", "lead")))
    equal = classes.select("fp", "cls").join(several, "fp").where("cls <> lead").select(F.col("lead").alias("u"), F.col("cls").alias("v"))
    pairs = close_pairs(firsts.select("fp"))
    lead = firsts.select("fp", "lead")
    close = pairs.join(lead.withColumnsRenamed({"fp": "u", "lead": "a"}), "u").join(lead.withColumnsRenamed({"fp": "v", "lead": "b"}), "v")
    return equal.union(close.select("a", "b"))


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are alike; each side's hashes are joined to the pair."""
    both = pairs.join(bags.select(F.col("cls").alias("v"), F.col("bag").alias("b")), "v").join(bags.select(F.col("cls").alias("u"), F.col("bag").alias("a")), "u").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alike(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), similarity) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["u", "v"]).filter(pa.array(found, pa.bool_()))

    return both.mapInArrow(run, "u binary, v binary")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], left_groups: list, right_groups: list, similarity: float) -> list[tuple[int, int]]:
    """(i, j) of alike sets of different groups, as few as tie the same groups together.

    Shared hashes are counted for all pairs at once, as products of 0/1 matrices over the hashes that occur twice.
    """
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    values, inverse, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.full(len(values), -1, np.int64)
    twice = np.flatnonzero(counts > 1)
    column[twice] = np.arange(len(twice))
    at, row = column[inverse], np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, len(twice), _COLUMNS):
        a, b = np.searchsorted(at, [first, first + _COLUMNS])
        dense = np.zeros((len(left) + len(right), min(_COLUMNS, len(twice) - first)), np.float32)
        dense[row[a:b], at[a:b] - first] = 1.0
        both += dense[: len(left)] @ dense[len(left) :].T
    near = (both > 0) & (both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both))
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = root(left_groups[i]), root(right_groups[j])
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def _tiled(crowded: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between different groups of the same crowded bucket, from all its pairs, tile by tile.

    A bucket of n documents is dealt to n / TILE_ROWS parts by a hash; each two of them meet in a task. So each row
    moves once per part and no task holds more than two parts, whatever the bucket's size.
    """
    held = crowded.select("key", "cls", "component").join(bags, "cls")
    parts = crowded.join(bags.select("cls", F.octet_length("bag").alias("size")), "cls").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_BYTES)).cast("int").alias("parts"))
    dealt = held.join(broadcast_ids(cut(parts)), "key").withColumn("own", F.pmod(F.xxhash64("cls", "key"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "component", "bag")

    def run(table: pa.Table) -> pa.Table:
        own, first = table["own"].to_numpy(), table["i"][0].as_py()
        cls, groups = table["cls"].to_pylist(), table["component"].to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint32) for x in table["bag"]]
        left = np.flatnonzero(own == first).tolist()
        right = np.flatnonzero(own != first).tolist() if first != table["j"][0].as_py() else left
        found = tile_links([sets[k] for k in left], [sets[k] for k in right], [groups[k] for k in left], [groups[k] for k in right], similarity) if left and right else []
        return pa.table({"u": pa.array([cls[left[i]] for i, _ in found], pa.binary()), "v": pa.array([cls[right[j]] for _, j in found], pa.binary())})

    return tiles.groupBy("key", "i", "j").applyInArrow(run, "u binary, v binary")


def _undecided(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` (key, cls, n) of buckets that hold more than one group, with their component."""
    placed = members.join(broadcast_ids(groups), F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return cut(placed.join(broadcast_ids(cut(mixed)), "key"))


def similar_groups(classes: DataFrame, bags: DataFrame, links: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component): the groups of ``classes`` (cls, keys) that ``links`` (u, v) and alike shingle sets tie together.

    ``bags`` (cls, bag) may repeat a class. A link counts if the two share a bucket. Each document first meets the most
    central one of each of its buckets: the one whose own buckets are the largest, which is the original of a crowd of
    edits. Only buckets that hold several groups after that go on: all pairs of different groups in small ones, tiles
    in large ones. So the groups are those that all pairs of all buckets would give, whatever a bucket's size; tiles are
    quadratic in crowds of documents that share blocks and neither they nor their centre tie.
    """
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    common = broadcast_ids(cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")))
    members = cut(keyed.join(common, "key").select("key", "cls", "n"))
    weights = members.groupBy("cls").agg(F.sum("n").alias("weight"))
    bags = cut(bags.join(broadcast_ids(cut(weights.select("cls"))), "cls", "left_semi").dropDuplicates(["cls"]))
    centres = members.join(weights, "cls").groupBy("key").agg(F.max_by("cls", F.struct("weight", "cls")).alias("centre"))
    met = cut(members.join(centres, "key").where("cls <> centre").select(F.col("centre").alias("u"), F.col("cls").alias("v")).distinct())
    groups = cut(connected_components(links.union(_verified(met, bags, similarity))))
    open_ = _undecided(members, groups)
    few = open_.where(F.col("n") <= BUCKET)
    other = few.select("key", F.col("cls").alias("v"), F.col("component").alias("_component"))
    pairs = few.join(other, "key").where("component <> _component AND cls < v").select(F.col("cls").alias("u"), "v").distinct()
    tried = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = cut(_verified(pairs.join(tried, ["u", "v"], "left_anti"), bags, similarity).union(_tiled(open_.where(F.col("n") > BUCKET), bags, similarity)))
    if more.isEmpty():
        return groups
    return cut(connected_components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)))


def _groups(docs: DataFrame, shingle: int, similarity: float, simhash: bool) -> DataFrame:
    """(doc_id, mark, component) for each row of ``docs``."""
    signed = signatures(docs.select("doc_id", "text"), shingle)
    classes = cut(signed.select("cls", "fp", "keys").dropDuplicates(["cls"]))
    links = simhash_links(classes) if simhash else classes.select(F.col("cls").alias("u"), F.col("cls").alias("v")).limit(0)
    groups = broadcast_ids(similar_groups(classes, signed.select("cls", "bag"), links, similarity))
    empty = F.lit(xxhash.xxh3_128_digest(b""))
    # texts without words are copies of each other for SimHash alone
    return signed.join(groups, F.col("cls") == F.col("node"), "left").select("doc_id", "mark", F.coalesce("component", "cls").alias("component"), (F.col("cls") == empty).alias("blank"))


def _keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``rows`` (doc_id, mark, component) puts in a group with a lesser (doc_id, mark)."""
    named = cut(rows.where(F.col("doc_id").isNotNull()).select("doc_id", "mark", "component"))
    at = F.struct("doc_id", "mark")
    firsts = named.groupBy("component").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    judged = named.join(broadcast_ids(cut(firsts)), "component")
    gone = judged.where(at != F.col("first")).select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone")).distinct()
    twice = judged.where(at == F.col("first")).groupBy(F.col("doc_id").alias("_twice_id"), F.col("mark").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    gone, twice = broadcast_ids(cut(gone)), cut(twice)
    left = docs.join(gone, (docs.doc_id == gone["_gone_id"]) & (F.xxhash64(docs.text) == gone["_gone"]), "left_anti")
    if twice.isEmpty():
        return left
    twice = broadcast_ids(twice)
    same = (left.doc_id == twice["_twice_id"]) & (F.xxhash64(left.text) == twice["_twice"])
    once = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(once)


def similar_ids(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id): the documents that share a group of alike shingle sets with one of a lesser id."""
    rows = _groups(docs.where("doc_id is not null"), shingle, similarity, simhash=False).where("not blank")
    firsts = rows.groupBy("component").agg(F.min("doc_id").alias("first"))
    return rows.join(firsts, "component").where("doc_id <> first").select(F.col("doc_id").alias("id")).distinct()


def drop_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the first row of each group of alike shingle sets, by (doc_id, hash of the text); columns unchanged,
    whatever their names.

    Null and empty texts have no shingle and are like nothing. Rows without an id can't be told apart and stay. Of rows
    that repeat id and text one stays; rows of one id with different texts are judged each. An empty table gives no rows.
    """
    return _keep_first(docs, _groups(docs, shingle, similarity, simhash=False).where("not blank"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the first row of each group, by (doc_id, hash of the text), that links of SimHash and those of alike
    shingle sets make together; columns unchanged, whatever their names.

    Null and empty texts are copies of each other. Rows without an id stay. Of rows that repeat id and text one stays;
    rows of one id with different texts are judged each. Very long texts count whole. An empty table gives no rows.
    """
    return _keep_first(docs, _groups(docs, shingle, similarity, simhash=True))
