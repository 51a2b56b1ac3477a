"""LM scoring with a weighted backoff automaton: trigrams smoothed towards bigrams and unigrams, failure arcs, one traversal.

The model is as large as the corpus, so it is never sent anywhere whole. Documents are dealt into chunks by a hash.
Each chunk asks for just the n-grams that its documents hold: it sends their sorted keys, with its own training counts,
to shards of the key space (first shuffle). A shard adds the counts up and answers each chunk with the totals in the
order asked (second shuffle; no keys). The chunk builds its part of the automaton from the totals and scores its
documents. Requests are compressed blocks, so a frequent word costs one entry per chunk and no task holds a hot key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, planned_bytes

#: Pseudo-counts (Dirichlet smoothing) of the unigrams behind a word's state, and of the bigrams behind a pair's state;
#: chosen by the likelihood of one fold of the training documents, learned from the others.
STRENGTHS = (1000.0, 10.0)
#: Bytes of input files per chunk and per shard at least.
CHUNK_BYTES = 6 << 20
SHARD_BYTES = 10 << 20
#: Each chunk sends one message to each shard. Chunks and shards of the root of the input's bytes times this keep a
#: message at about 4 KB: 6 MB chunks up to 50 GB of input, 29 MB at 1 TB, 290 MB at 100 TB.
MESSAGE_BYTES = 800
#: Spark's stand-in for a size that it can't tell is larger than this.
UNKNOWN_BYTES = 1 << 60
_BEGIN, _END = 0, 1
_SHARD_BITS = np.uint64(32)
#: Low bits of hashes that keys do without, which makes messages shorter. Of 10^13 distinct n-grams, the other 58 bits
#: take an unseen one for a seen one with a probability of 0.00004.
_DROPPED = np.uint64(4)
_KIND = np.uint64(3)
_KIND_CONTEXT, _KIND_WORD, _KIND_PAIR, _KIND_TRIPLE = (np.uint64(k) for k in range(4))


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers to zstd over their byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        out = a * np.uint64(0x9E3779B97F4A7C15) + b
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _key(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    return ((hashes >> _DROPPED) & ~_KIND) | kind


@dataclass
class Grams:
    """Words, pairs and triples of a chunk: their keys in order and, for them one after another, each key's place there.

    Of each position, the pair and the triple that end there (-1: none). Of pairs, both words; of triples, the pair
    that they begin with and the pair that they end with.
    """

    keys: np.ndarray
    place: np.ndarray
    pair_at: np.ndarray
    triple_at: np.ndarray
    first: np.ndarray
    second: np.ndarray
    context: np.ndarray
    lower: np.ndarray


@dataclass
class Chunk:
    """Token sequences of some documents: begin, words, end, one after another."""

    symbols: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Chunk:
        number = count(2)
        ids: defaultdict[bytes, int] = defaultdict(number.__next__)
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split() if text else []
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words) + 2)
        ends = np.cumsum(np.array(sizes, dtype=np.int64))
        symbols = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        starts = ends - np.array(sizes, dtype=np.int64)
        for part, a, b in zip(parts, starts.tolist(), ends.tolist()):
            symbols[a] = _BEGIN
            symbols[a + 1 : b - 1] = part
            symbols[b - 1] = _END
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter([digest(b"", 1), digest(b"", 2), *map(digest, ids)], np.uint64, len(ids) + 2)
        return cls(symbols, starts, hashes)

    def grams(self) -> Grams:
        n, inner = np.uint64(len(self.hashes)), self.symbols[1:] != _BEGIN
        codes = self.symbols[:-1][inner].astype(np.uint64) * n + self.symbols[1:][inner].astype(np.uint64)
        pairs, inverse = np.unique(codes, return_inverse=True)
        pair_at = np.full(len(self.symbols), -1, np.int32)
        pair_at[1:][inner] = inverse
        del codes, inverse
        inner = (pair_at[:-1] >= 0) & (pair_at[1:] >= 0)
        codes = pair_at[:-1][inner].astype(np.uint64) * n + self.symbols[1:][inner].astype(np.uint64)
        triples, inverse = np.unique(codes, return_inverse=True)
        triple_at = np.full(len(self.symbols), -1, np.int32)
        triple_at[1:][inner] = inverse
        del codes, inverse
        first, second = (x.astype(np.int32) for x in np.divmod(pairs, n))
        context, last = (x.astype(np.int32) for x in np.divmod(triples, n))
        lower = np.zeros(len(triples), np.int32)
        lower[triple_at[1:][inner]] = pair_at[1:][inner]
        words = _key(self.hashes, _KIND_WORD)
        words[_BEGIN] = (words[_BEGIN] & ~_KIND) | _KIND_CONTEXT
        two = _mixed(self.hashes[first], self.hashes[second])
        three = _mixed(two[context], self.hashes[last])
        keys = np.concatenate((words, _key(two, _KIND_PAIR), _key(three, _KIND_TRIPLE)))
        del two, three
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        return Grams(keys[order], place, pair_at, triple_at, first, second, context, lower)

    def counted(self, train: np.ndarray, grams: Grams) -> np.ndarray:
        """Occurrences of each key in the documents to learn from."""
        used = np.repeat(train, np.diff(np.append(self.starts, len(self.symbols))))
        out = np.empty(len(grams.keys), np.int64)
        out[grams.place] = np.concatenate(
            (
                np.bincount(self.symbols[used], minlength=len(self.hashes)),
                np.bincount(grams.pair_at[used & (grams.pair_at >= 0)], minlength=len(grams.first)),
                np.bincount(grams.triple_at[used & (grams.triple_at >= 0)], minlength=len(grams.context)),
            )
        )
        return out


class Automaton:
    """States: the root, one for each known word and for the begin, and one for each pair seen in training.

    A pair's state has arcs for the triples seen in training and a failure arc to the state of its second word; a word's
    state has arcs for the pairs seen and a failure arc to the root, which reads any word. A failure arc weighs the mass
    that its state leaves to what it has no arc for.
    """

    def __init__(self, totals: np.ndarray, grams: Grams, tokens: int, types: int, strengths: tuple[float, float]):
        """``totals``: training counts of the words, pairs and triples of ``grams``, one after another."""
        one, two = strengths
        n = len(totals) - len(grams.first) - len(grams.context)
        words, pairs, triples = np.split(totals, [n, n + len(grams.first)])
        root = (words + 1.0) / (tokens + types + 1.0)
        root[_BEGIN] = 1.0
        self.root = np.log10(root)
        self.known = words > 0
        self.fail_word = np.where(self.known, np.log10(one / (words + one)), 0.0)
        self.pair = (pairs > 0) & self.known[grams.first]
        after_word = (pairs + one * root[grams.second]) / (words[grams.first] + one)
        self.arc_pair = np.log10(after_word)
        self.fail_pair = np.where(self.pair, np.log10(two / (pairs + two)), 0.0)
        # the last one stands for no triple: the word after a begin
        self.triple = np.append((triples > 0) & self.pair[grams.context], False)
        self.arc_triple = np.append(np.log10((triples + two * after_word[grams.lower]) / (pairs[grams.context] + two)), 0.0)

    def walk(self, symbols: np.ndarray, starts: np.ndarray, grams: Grams) -> np.ndarray:
        """Log-probabilities of all texts: each is read once from left to right, side by side, longest first."""
        lengths = np.diff(np.append(starts, len(symbols)))
        order = np.argsort(-lengths, kind="stable")
        begins, falling = starts[order], -lengths[order]
        total = np.zeros(len(starts))
        # the state: that of a pair, else of a word, else the root; and what its failure arcs weigh
        deep, near = np.zeros(len(starts), bool), np.full(len(starts), self.known[_BEGIN])
        fail_deep, fail_near = np.zeros(len(starts)), np.full(len(starts), self.fail_word[_BEGIN])
        for step in range(1, int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -step))
            at = begins[:live] + step
            symbol, pair, triple = symbols[at], grams.pair_at[at], grams.triple_at[at]
            seen = self.pair[pair]
            lower = np.where(near[:live] & seen, self.arc_pair[pair], fail_near[:live] + self.root[symbol])
            total[:live] += np.where(deep[:live] & self.triple[triple], self.arc_triple[triple], fail_deep[:live] + lower)
            deep[:live], fail_deep[:live] = seen, self.fail_pair[pair]
            near[:live], fail_near[:live] = self.known[symbol], self.fail_word[symbol]
        out = np.empty(len(starts))
        out[order] = total
        return out


def _request(shards: int):
    def run(batch: pa.Table) -> pa.Table:
        chunk = Chunk.of([x.as_py() for x in batch["text"]])
        grams = chunk.grams()
        keys, counts = grams.keys, chunk.counted(batch["train"].to_numpy(), grams)
        cuts = np.searchsorted(((keys >> (_SHARD_BITS - _DROPPED)) * np.uint64(shards)) >> _SHARD_BITS, np.arange(shards + 1, dtype=np.uint64))
        rows = []
        for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            rows.append((s, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b])))
        chunk_id = batch["chunk"][0].as_py()
        return pa.table({"chunk": pa.array([chunk_id] * shards, pa.int32()), "shard": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _answer(batch: pa.Table) -> pa.Table:
    deltas = [_unpack(x.as_py()) for x in batch["keys"]]
    keys = np.concatenate([np.cumsum(d, dtype=np.uint64) for d in deltas])
    counts = np.concatenate([_unpack(x.as_py()) for x in batch["counts"]])
    distinct, inverse = np.unique(keys, return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    words = ((distinct & _KIND) == _KIND_WORD) & (totals > 0)
    bounds = np.cumsum([0, *map(len, deltas)])
    n = len(deltas)
    return pa.table(
        {
            "chunk": batch["chunk"],
            "shard": batch["shard"],
            "tokens": pa.array([int(totals[words].sum())] * n, pa.int64()),
            "types": pa.array([int(words.sum())] * n, pa.int64()),
            "totals": pa.array([_pack(totals[inverse[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
        }
    )


def _score(strengths: tuple[float, float]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk.of([x.as_py() for x in docs["text"]])
        grams = chunk.grams()
        answers = answers.sort_by("shard")
        totals = np.concatenate([_unpack(x.as_py()) for x in answers["totals"]]).astype(np.int64)[grams.place]
        tokens, types = (sum(x.as_py() for x in answers[c]) for c in ("tokens", "types"))
        symbols, starts = chunk.symbols, chunk.starts
        machine = Automaton(totals, grams, tokens, types, strengths)
        score = machine.walk(symbols, starts, grams)
        base, known = machine.root.copy(), machine.known.astype(np.int64)
        base[_BEGIN], known[_BEGIN] = 0.0, 0
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(~docs["train"].to_numpy()),
                "n_tokens": pa.array(np.diff(np.append(starts, len(symbols))) - 1, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known[symbols], starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(starts), tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base[symbols], starts)),
                "score": pa.array(score),
            }
        )

    return run


def score(docs: DataFrame, strengths: tuple[float, float] = STRENGTHS, hold_mod: int = 7, hold_at: int = 2, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Learns all n-grams of the rows whose crc32(doc_id) modulo ``hold_mod`` is not ``hold_at``; scores every whole text.
    The model's trigrams are smoothed by ``strengths`` towards bigrams, these towards the base's unigrams. A null text
    is the empty text: one token, the end. A null id counts as the empty id. Repeated rows count each. If
    no row is to be learned from, every count is 0. Very long texts count whole. An empty table gives no rows.
    """
    size = planned_bytes(docs)
    if size >= UNKNOWN_BYTES:
        chunks = shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:
        least = isqrt(size * MESSAGE_BYTES)
        chunks, shards = max(16, -(-size // max(chunk_bytes, least))), max(16, -(-size // max(shard_bytes, least)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), (crc_mod(F.col("doc_id"), hold_mod) != hold_at).alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    # a task for each chunk and for each shard, whatever the session's number of shuffle partitions
    held = held.repartitionById(chunks, "chunk")
    asked = held.groupBy("chunk").applyInArrow(_request(shards), "chunk int, shard int, keys binary, counts binary")
    told = asked.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_answer, "chunk int, shard int, tokens bigint, types bigint, totals binary")
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return held.groupBy("chunk").cogroup(told.repartitionById(chunks, "chunk").groupBy("chunk")).applyInArrow(_score(strengths), out)
