"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, in_low_share
from .tokens import by_length, mixed, numbered, prefix_hashes, span_hashes

#: Labelled documents per label that the model is fitted on, those least in a hash of the id.
SAMPLE_DOCS = 1500
BUCKETS_LOG2 = 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Epochs with mean pooling, where every word of a text learns, and then with max pooling, where only those that win do.
MEAN_EPOCHS = 3
EPOCHS = 5
BATCH = 32
RATE = 0.1
#: Share of the words that a text loses at random in the first epoch of max pooling, less in each, none in the last: so
#: other words win the filters each time.
HIDE = 0.5
#: Byte lengths of the pieces that are hashed besides the whole word; the word is bounded by < and >.
PIECES = (4, 6)
#: A longer run without white space is read as several words, one after another, of so many characters.
UNIT_CHARS = 32
_NOISE = regex.compile(r"[^\p{L}\p{N}]+")


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each token, one after another, and where each begins: the word, and its byte pieces."""
    words = [b"<" + (t if t.isalnum() else _NOISE.sub("", t)).encode() + b">" for t in tokens]
    owners, buckets = [], []
    shift = np.uint64(64 - BUCKETS_LOG2)
    for part, matrix in by_length(words):
        prefixes = prefix_hashes(matrix)
        length = matrix.shape[1]
        spans = [(0, length)]
        if length > 2:
            spans += [(a, a + n) for n in PIECES for a in range(length - n + 1)]
        for a, b in spans:
            owners.append(part)
            buckets.append((mixed(span_hashes(prefixes, a, b)) >> shift).astype(np.int32))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(words)))


def words_of(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct words, and each text as numbers of them; long runs stand as their units, so all of a text is read."""
    tokens, docs = numbered(texts)
    long = [k for k, t in enumerate(tokens) if len(t) > UNIT_CHARS]
    if not long:
        return tokens, docs
    known = {t: k for k, t in enumerate(tokens)}
    units = {k: np.array([known.setdefault(u, len(known)) for a in range(0, len(tokens[k]), UNIT_CHARS) if (u := tokens[k][a : a + UNIT_CHARS])], np.int32) for k in long}
    is_long = np.zeros(len(tokens), bool)
    is_long[long] = True
    out = []
    for ids in docs:
        at = np.flatnonzero(is_long[ids])
        parts, last = [], 0
        for k in at.tolist():
            parts += [ids[last:k], units[int(ids[k])]]
            last = k + 1
        out.append(np.concatenate([*parts, ids[last:]]) if parts else ids)
    return list(known), out


@dataclass
class Network:
    """Embeddings of buckets; filters of each width over ``width`` words, the text padded at its end; the largest
    response of each filter over the text, cut at zero; a logistic unit; and a scale and shift that calibrate it."""

    embed: np.ndarray
    kernels: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray  # (all filters)
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return cls(
            rng.normal(0, 0.1, (1 << BUCKETS_LOG2, DIM)).astype(np.float32),
            [rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(n, np.float32),
            rng.normal(0, 0.3, n).astype(np.float32),
        )

    def words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's embedding, the mean of its buckets' (times the root of their number); and its buckets."""
        buckets, starts = features(tokens)
        if not len(starts):
            return np.zeros((0, DIM), np.float32), buckets, starts
        sizes = np.diff(np.append(starts, len(buckets)))
        out = np.empty((len(starts), DIM), np.float32)
        for a in range(0, len(starts), 20_000):  # bounds what is gathered at once
            b = min(a + 20_000, len(starts))
            end = starts[b] if b < len(starts) else len(buckets)
            out[a:b] = np.add.reduceat(self.embed[buckets[starts[a] : end]], starts[a:b] - starts[a], axis=0)
        return out / np.sqrt(sizes)[:, None].astype(np.float32), buckets, starts

    def responses(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Per width and offset: what each token adds to each filter. The last row is the padding's."""
        padded = np.vstack((vectors, np.zeros((1, DIM), np.float32)))
        return [[padded @ k[j] for j in range(len(k))] for k in self.kernels]

    def pooled(self, parts: list[list[np.ndarray]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over one text, and where it is. A text without words is padding alone."""
        n = max(1, len(ids))
        row = np.full(n + max(WIDTHS) - 1, len(parts[0][0]) - 1, np.int64)
        row[: len(ids)] = ids
        best, where = [], []
        for offsets in parts:
            y = offsets[0][row[:n]]
            for j in range(1, len(offsets)):
                y = y + offsets[j][row[j : j + n]]
            at = y.argmax(axis=0)
            best.append(y[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best), np.concatenate(where)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        tokens, docs = words_of(texts)
        parts = self.responses(self.words(tokens)[0])
        out = np.empty(len(docs))
        for k, ids in enumerate(docs):
            out[k] = np.maximum(self.pooled(parts, ids)[0] + self.bias, 0) @ self.out + self.out_bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -40, 40)))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adagrad on the logistic loss, from a random start, both labels weighing the same."""
    net = Network.new(seed)
    rng = np.random.default_rng(seed)
    tokens, docs = words_of(texts)
    buckets, starts = features(tokens)
    ends = np.append(starts[1:], len(buckets))
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    params = {"embed": net.embed, "bias": net.bias, "out": net.out, **{f"k{i}": k for i, k in enumerate(net.kernels)}}
    squares = {name: np.full_like(p, 1e-2) for name, p in params.items()}
    bias_square = 1e-2
    for epoch in range(-MEAN_EPOCHS, epochs):
        mean = epoch < 0
        hide = 0.0 if mean else HIDE * (1 - epoch / max(1, epochs - 1))
        for batch in np.array_split(rng.permutation(len(docs)), -(-len(docs) // BATCH)):
            seen = {k: docs[k][rng.random(len(docs[k])) >= hide] for k in batch.tolist()}
            used = np.unique(np.concatenate([*seen.values(), np.zeros(0, np.int32)]))
            sizes = (ends - starts)[used]
            flat = buckets[np.repeat(starts[used] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())] if len(used) else np.zeros(0, np.int32)
            norm = np.sqrt(np.maximum(sizes, 1)).astype(np.float32)
            vectors = np.add.reduceat(net.embed[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / norm[:, None] if len(used) else np.zeros((0, DIM), np.float32)
            parts = [] if mean else net.responses(vectors)
            grads = {name: np.zeros_like(p) for name, p in params.items() if name != "embed"}
            d_vectors = np.zeros((len(used) + 1, DIM), np.float32)
            padded = np.vstack((vectors, np.zeros((1, DIM), np.float32)))
            d_bias = 0.0
            for k in batch:
                ids = np.searchsorted(used, seen[int(k)])
                if mean:  # the sum over the root of the length; offsets of a filter see the same words but for the ends
                    total = vectors[ids].sum(axis=0) / max(1, len(ids)) ** 0.5
                    best = np.concatenate([total @ kernel.sum(axis=0) for kernel in net.kernels])
                else:
                    best, where = net.pooled(parts, ids)
                hidden = best + net.bias
                active = np.maximum(hidden, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.out_bias, -30, 30)))
                d = float((p - labels[k]) * weight[k] / len(batch))
                d_bias += d
                grads["out"] += d * active
                d_hidden = d * net.out * (hidden > 0)
                grads["bias"] += d_hidden
                if mean:
                    for i, kernel in enumerate(net.kernels):
                        g = d_hidden[i * FILTERS : (i + 1) * FILTERS]
                        grads[f"k{i}"] += np.outer(total, g)[None]
                        np.add.at(d_vectors, ids, kernel.sum(axis=0) @ g / max(1, len(ids)) ** 0.5)
                    continue
                row = np.append(ids, np.full(max(WIDTHS), len(used)))
                for i, kernel in enumerate(net.kernels):
                    own = slice(i * FILTERS, (i + 1) * FILTERS)
                    g, at = d_hidden[own], where[own]
                    for j in range(len(kernel)):
                        who = row[at + j]
                        grads[f"k{i}"][j] += padded[who].T * g
                        np.add.at(d_vectors, who, (kernel[j] * g).T)
            hot = np.flatnonzero(np.abs(d_vectors[:-1]).sum(axis=1))
            if len(hot):
                first, own = np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes[hot]
                spread = flat[np.repeat(first[hot] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())]
                rows, inverse = np.unique(spread, return_inverse=True)
                g = np.zeros((len(rows), DIM), np.float32)
                np.add.at(g, inverse, np.repeat(d_vectors[hot] / norm[hot, None], sizes[hot], axis=0))
                squares["embed"][rows] += g * g
                net.embed[rows] -= RATE * g / np.sqrt(squares["embed"][rows])
            for name, g in grads.items():
                squares[name] += g * g
                params[name] -= RATE * g / np.sqrt(squares[name])
            bias_square += d_bias**2
            net.out_bias -= RATE * d_bias / bias_square**0.5
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, langs: list[str | None], weights: np.ndarray) -> None:
    """Platt's scale and shift on documents that trained nothing, and for each language the threshold of best F1."""
    a, b = 1.0, 0.0
    n1, n0 = (weights * labels).sum(), (weights * (1 - labels)).sum()
    if n1 and n0:
        target = np.where(labels == 1, 1 - 1 / (n1 + 2), 1 / (n0 + 2))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            g = weights * (p - target)
            w = weights * p * (1 - p) + 1e-9
            h = np.array([[(w * logits * logits).sum() + 1e-6, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, [(g * logits).sum(), g.sum()])
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    scores = 1 / (1 + np.exp(-np.clip(net.scale * logits + net.shift, -40, 40)))
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        s, y, w = scores[own], labels[own], weights[own]
        if (y == 1).sum() < 5 or (y == 0).sum() < 5:
            continue
        order = np.argsort(-s)
        hits, taken = np.cumsum((w * y)[order]), np.cumsum(w[order])
        best = int(np.argmax(2 * hits / (taken + (w * y).sum())))
        after = s[order][best + 1] if best + 1 < len(s) else 0.0
        net.thresholds[lang] = float((s[order][best] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, hold_mod: int = 5, hold_at: int = 0) -> Network:
    """Fit on up to ``sample_docs`` labelled documents of each label whose crc32(doc_id) modulo ``hold_mod`` isn't ``hold_at``.

    Ids are chosen from ``labels`` alone, by a hash, so no text is shuffled; then their texts are fetched. A third of
    them only calibrates. Rows with a null label or id are left out; of an id's several labels the largest counts, of its
    texts the least.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), hold_mod) != hold_at)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    low = lambda t: usable.where((F.col("toxic") == t) & in_low_share(order, F.lit(totals.get(t, 1)), sample_docs)).orderBy(order).limit(sample_docs)
    ids = low(0).union(low(1))
    found = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d"), F.first("toxic").alias("toxic")).select("doc_id", "d.text", "d.lang", "toxic")
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    if len({r["toxic"] for r in rows}) < 2:
        net = Network.new()
        net.out[:] = 0
        net.out_bias = -4.0 if not any(r["toxic"] for r in rows) else 4.0
        return net
    texts, y = [r["text"] or "" for r in rows], np.array([r["toxic"] for r in rows])
    share = np.array([totals[t] / max(1, (y == t).sum()) for t in y]) / (sum(totals.values()) / len(y))
    part = np.arange(len(y)) % 3 == 0
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    net = train([t for t, p in zip(texts, part) if not p], y[~part])
    held = part if part.any() else ~part
    calibrate(net, net.logits([t for t, p in zip(texts, held) if p]), y[held], [r["lang"] for r, p in zip(rows, held) if p], share[held])
    return net


def score(docs: DataFrame, net: Network, hold_mod: int = 5, hold_at: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and flagged for each row of ``docs``.

    Whole texts. ``flagged`` compares the same score with the threshold of the row's language (0.5 for one without).
    Null and empty texts have the score of no words. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", (crc_mod(F.col("doc_id"), hold_mod) == hold_at).alias("held_out"), "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 2000):
                part = batch.slice(k, 2000)
                values = net.scores(part.column(2).to_pylist())
                limits = np.array([net.thresholds.get(x, 0.5) for x in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(values >= limits)], names=["doc_id", "held_out", "score", "predicted", "flagged"])

    return held.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, flagged boolean")


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``fit``, then ``score``: one row per row of ``docs``, repeated rows each.

    Without labels of both kinds among the rows to learn from, all documents get one score. Equal texts have equal
    scores, whatever their other columns. Very long texts, and runs without white space, count whole.
    """
    return score(docs, fit(docs, labels, sample_docs))
