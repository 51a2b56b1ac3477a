"""Numbered tokens of a batch of texts and rolling hashes of byte strings, for the numpy models."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np

_BASE = 0x100000001B3
_WORD = (1 << 64) - 1


def numbered(texts: Iterable[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct lower-cased tokens between white space, and each text as numbers of them; null: no token."""
    ids: defaultdict[str, int] = defaultdict(count().__next__)
    out = []
    for text in texts:
        tokens = text.lower().split() if text else []
        out.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
    return list(ids), out


def by_length(items: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, bytes as a matrix) for all items of each length over 0."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        if len(part) and (n := int(lengths[part[0]])):
            yield part, np.frombuffer(b"".join([items[k] for k in part.tolist()]), np.uint8).reshape(-1, n)


def prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Rolling hash of each row's prefixes, by length from 0."""
    out = np.zeros((matrix.shape[1] + 1, len(matrix)), np.uint64)
    columns = np.ascontiguousarray(matrix.T).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(matrix.shape[1]):
            out[j + 1] = out[j] * np.uint64(_BASE) + columns[j] + np.uint64(1)
    return out


def span_hashes(prefixes: np.ndarray, start: int, end: int) -> np.ndarray:
    """Hash of the bytes from start to end of every row, the length mixed in; for any text the same as for a row of it."""
    n = end - start
    with np.errstate(over="ignore"):
        raw = prefixes[end] - prefixes[start] * np.uint64(pow(_BASE, n, 1 << 64))
        return mixed(raw ^ np.uint64(n * 0x9E3779B97F4A7C15 & _WORD))


def window_hashes(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length up to ``longest``: (length, ``span_hashes`` of every stretch of so many bytes of one text)."""
    columns = data.astype(np.uint64) + np.uint64(1)
    raw = np.zeros(len(data) + 1, np.uint64)
    for n in range(1, min(longest, len(data)) + 1):
        with np.errstate(over="ignore"):
            raw = raw[:-1] * np.uint64(_BASE) + columns[n - 1 :]
            yield n, mixed(raw ^ np.uint64(n * 0x9E3779B97F4A7C15 & _WORD))


def mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return keys ^ (keys >> np.uint64(29))


class Table:
    """Numbers of distinct 64-bit keys by their upper bits; every key is found, whatever shares its slot."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.start = np.searchsorted(self.keys >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.start).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that isn't in the table."""
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        first, last = self.start[slot], self.start[slot + 1]
        out = np.full(len(keys), -1, np.int32)
        for d in range(self.depth):
            open_at = np.flatnonzero(first + d < last)
            if not len(open_at):
                break
            at = first[open_at] + d
            hit = self.keys[at] == keys[open_at]
            out[open_at[hit]] = self.ids[at[hit]]
        return out
