"""Periodic runs of words: a grid of positions per period, matched both ways by suffix arrays and range minima."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, let, words_spaced

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words that are indexed at once on average; a longer text is indexed alone.
_WORDS = 1 << 17
#: Grid positions that are looked up at once.
_GRID = 1 << 20


class Matches:
    """How far the suffixes of a sequence of numbers agree: suffix array, common prefixes of neighbours, range minima.

    Every text in the sequence must end in a number that occurs nowhere else, so no match leaves its text.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        first = np.bincount(symbols)
        rank = (np.cumsum(first) - first)[symbols].astype(np.int32)
        levels = [rank]
        left = np.flatnonzero(first[symbols] > 1).astype(np.int32)
        width = 1
        while len(left):
            rank = rank.copy()
            key = rank[left].astype(np.int64) * (n + 1) + rank[left + width]
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            old = rank[left]
            at = np.arange(len(left), dtype=np.int32)
            new_key = np.r_[True, key[1:] != key[:-1]]
            new_rank = np.r_[True, old[1:] != old[:-1]]
            same = np.maximum.accumulate(np.where(new_key, at, 0))
            rank[left] = old + same - np.maximum.accumulate(np.where(new_rank, at, 0))
            last = np.r_[new_key[1:], True]
            levels.append(rank)
            left = left[~(new_key & last)]
            width *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int32)
        suffixes[rank] = np.arange(n, dtype=np.int32)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            step = np.where(levels[k][a] == levels[k][b], np.int32(1 << k), np.int32(0))
            a += step
            b += step
            common[1:] += step
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= n:
            least, width = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(least[:-width], least[width:]))

    def length(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal symbols from positions ``a`` and ``b`` on, which differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        out = np.empty(len(a), np.int32)
        level = np.log2(high - low + 1).astype(np.int32)
        for k in np.unique(level).tolist():
            these = np.flatnonzero(level == k)
            least = self.minima[k]
            out[these] = np.minimum(least[low[these]], least[high[these] - (1 << k) + 1])
        return out


def _grid(sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, j, p) for every period p that fits ``exponent`` times into a text and every j with (j+1)p inside it."""
    text = np.repeat(np.arange(len(sizes)), sizes // exponent)
    starts = np.cumsum(sizes // exponent) - sizes // exponent
    p = np.arange(len(text)) - starts[text] + 1
    n = (sizes[text] - 1) // p
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _GRID, side="right")))
        part = n[at:to]
        which = np.repeat(np.arange(at, to), part)
        yield text[which], np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part), p[which]
        at = to


def find_runs(texts: list[np.ndarray], symbols: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """For each text (numbers below ``symbols``), its runs as rows (start, length, period), by start, then period.

    A run of period p and at least 3p words covers two neighbours jp and (j+1)p of the grid, whose words are equal; how
    far both agree forward and backward gives its ends. Of the grid positions inside a run the first alone reports it.
    A multiple of the least period gives the same stretch, so of equal stretches the least period stays.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.empty(int((sizes + 1).sum()), np.int64)
    ends = starts + sizes
    inner = np.ones(len(joined), bool)
    inner[ends] = False
    joined[inner] = np.concatenate(texts) if len(texts) else []
    joined[ends] = symbols + np.arange(len(texts))
    found = []
    index = None
    for text, j, p in _grid(sizes, min_exponent):
        a = starts[text] + j * p
        near = np.flatnonzero(joined[a] == joined[a + p])
        if not len(near):
            continue
        if index is None:
            # a text's end mark stands behind it in either direction
            back = np.empty_like(joined)
            back[:-1], back[-1] = joined[:-1][::-1], joined[-1]
            index = Matches(joined), Matches(back)
        text, j, p, a = text[near], j[near], p[near], a[near]
        forward = index[0].length(a, a + p)
        behind = len(joined) - 2 - (a - 1)
        backward = np.zeros(len(a), np.int32)
        inside = np.flatnonzero(j > 0)
        backward[inside] = index[1].length(behind[inside], behind[inside] - p[inside])
        length = forward + backward + p
        good = np.flatnonzero((backward < p) & (length >= np.maximum(min_length, min_exponent * p)))
        found.append(np.stack([text[good], j[good] * p[good] - backward[good], length[good], p[good]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return np.split(rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(1, len(texts)))) if len(texts) else []


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed (the text without repeats) per row.

    Words stand between ASCII white space. A run is a stretch of at least ``min_length`` words and ``min_exponent`` (2 or
    more) times its least period that no neighbouring word extends; all but its first period goes from the text, and the
    words left are joined by one space. Null and empty texts have no run and collapse to the empty text. A null id is
    kept as it is, rows that repeat an id or are equal get a row each, other columns aren't read. An empty table gives no rows.
    Texts are read whole, each by one task; short ones are indexed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids: defaultdict[bytes, int] = defaultdict(count().__next__)
                words, texts, first, total = [], [], at, 0
                while at < batch.num_rows and total < _WORDS:
                    own = (batch.column(1)[at].as_py() or b"").split()
                    words.append(own)
                    texts.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
                    total += len(own)
                    at += 1
                found = find_runs(texts, len(ids), min_length, min_exponent)
                left = []
                for own, runs in zip(words, found):
                    left.append(b" ".join(map(own.__getitem__, np.flatnonzero(kept_words(len(own), runs)).tolist()) if len(runs) else own))
                flat = np.concatenate(found).astype(np.int64)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), lists, pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in a tenth of the rows the words from one place on repeat, as the query's contract puts it.

    Rows without an id, whose number isn't defined, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")).otherwise("")

    chosen = F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 10) == 0)
    return docs.select("doc_id", F.when(chosen, let(words_spaced(F.col("text")), planted)).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the count of its runs, the one of the greatest exponent, and digests of runs and text.

    Exponents are compared exactly, by products of whole numbers. Nulls and empty texts as in ``collapse_runs``.
    """
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda top, x: F.when(top.isNull() | better(x, top), x).otherwise(top))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    found = collapse_runs(with_planted_runs(docs)).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
