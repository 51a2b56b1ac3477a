"""Language ID: per-language piece probabilities over a fixed vocabulary, summed over all segmentations of a text."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_ids, crc_mod, cut, in_low_share, unused
from .tokens import Table, by_length, numbered, prefix_hashes, span_hashes, window_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents per language that the model is fitted on, those least in a hash of the id.
SAMPLE_DOCS = 300
ROUNDS = 3
#: Units (runs of letters) up to this many bytes are summed side by side; longer ones are rescaled on their way.
SHORT_BYTES = 64
#: Bytes of text whose tokens are numbered and scored together.
SLICE_BYTES = 4 << 20
_RESCALE = 32
_SEGMENT = 1 << 12
#: Bytes of long units that are summed side by side.
_BESIDE = 1 << 18
_SMOOTH = 0.02
#: Every byte is scaled by this, so that products over a short unit stay within the range of doubles.
_SCALE = 1000.0
_LETTERS = regex.compile(r"\p{L}+")


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """All the vocabulary's byte strings and all single bytes, so any text has a segmentation."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})


def piece_keys(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for part, matrix in by_length(pieces):
        out[part] = span_hashes(prefix_hashes(matrix), 0, matrix.shape[1])
    return out


def piece_reach(pieces: list[bytes]) -> np.ndarray:
    """For each two bytes, as one number, the length of the longest piece that begins so; pieces of one byte may begin anywhere."""
    out = np.ones(1 << 16, np.int64)
    for p in pieces:
        if len(p) > 1:
            at = p[0] * 256 + p[1]
            out[at] = max(out[at], len(p))
    return out


def units_of(token: str) -> list[bytes]:
    """The runs of letters in a token, each with a leading space."""
    return [b" " + run.encode() for run in _LETTERS.findall(token)]


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) of stretches of ``texts`` of about ``most`` characters, one text at least."""
    first = total = 0
    for k, text in enumerate(texts):
        total += len(text or "") + 64
        if total >= most:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Model:
    """probs: per piece and language, times _SCALE for each byte."""

    def __init__(self, langs: list[str], keys: np.ndarray, lengths: np.ndarray, probs: np.ndarray, reach: np.ndarray | None = None):
        self.langs, self.keys, self.lengths, self.probs = langs, keys, lengths, probs
        self.longest = int(lengths.max(initial=1))
        self.reach = np.full(1 << 16, self.longest, np.int64) if reach is None else reach
        self.table: Table | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _found(self, prefixes: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.table = Table(self.keys)
        ids = self.table.find(span_hashes(prefixes, start, end))
        rows = np.flatnonzero(ids >= 0)
        return rows, ids[rows]

    def _arcs(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, where the arcs of each end begin) of all pieces in ``data``, by end."""
        if self.table is None:
            self.table = Table(self.keys)
        own = np.frombuffer(data, np.uint8)
        reach = self.reach[own.astype(np.int64) * 256 + np.append(own[1:], 0)]
        starts, ends, pieces = [], [], []
        for n, hashes in window_hashes(own, self.longest):
            may = np.flatnonzero(reach[: len(hashes)] >= n)
            ids = self.table.find(hashes[may])
            rows = may[ids >= 0]
            starts.append(rows)
            ends.append(rows + n)
            pieces.append(ids[ids >= 0])
        start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.argsort(end, kind="stable")
        return start[order], piece[order], np.searchsorted(end[order], np.arange(len(data) + 2))

    def _alone(self, data: bytes) -> np.ndarray:
        """``forward`` of one long unit: segment by segment, so what is held doesn't grow with it."""
        total, ring = np.zeros(len(self.langs)), np.ones((1, len(self.langs)))
        for first in range(0, len(data), _SEGMENT):
            back = min(first, self.longest)
            part = data[first - back : first + _SEGMENT]
            start, piece, at = self._arcs(part)
            alpha = np.zeros((len(part) + 1, len(self.langs)))
            alpha[: back + 1] = ring[-back - 1 :]
            for end in range(back + 1, len(part) + 1):
                a, b = at[end], at[end + 1]
                alpha[end] = (alpha[start[a:b]] * self.probs[piece[a:b]]).sum(axis=0)
                if end % _RESCALE == 0:
                    low = max(0, end - self.longest)
                    most = alpha[low : end + 1].max(axis=0)
                    alpha[low : end + 1] /= most
                    total += np.log(most)
            ring = alpha[-self.longest - 1 :]
        return total + np.log(ring[-1]) - len(data) * np.log(_SCALE)

    def _side_by_side(self, units: list[bytes]) -> np.ndarray:
        """``forward`` of long units of any lengths: one step adds up the arcs that end at one place of every unit."""
        sizes = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(sizes) - sizes
        start, piece, at = self._arcs(b"".join(units))
        end = np.repeat(np.arange(len(at) - 1), np.diff(at))
        unit = np.searchsorted(first, start, side="right") - 1
        inside = end <= first[unit] + sizes[unit]
        start, end, piece, unit = start[inside], end[inside], piece[inside], unit[inside]
        place = end - first[unit]
        order = np.lexsort((unit, place))
        unit, piece, place = unit[order], piece[order], place[order]
        # a unit's places have one slot more than bytes
        source = start[order] + unit
        alpha = np.zeros((int(sizes.sum()) + len(units), len(self.langs)))
        alpha[first + np.arange(len(units))] = 1.0
        total = np.zeros((len(units), len(self.langs)))
        steps = np.searchsorted(place, np.arange(1, int(sizes.max()) + 2))
        for k in range(1, len(steps)):
            own = slice(steps[k - 1], steps[k])
            who = unit[own]
            edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            alive = who[edge]
            slot = first[alive] + alive + k
            alpha[slot] = np.add.reduceat(alpha[source[own]] * self.probs[piece[own]], edge, axis=0)
            if k % _RESCALE == 0:
                recent = np.maximum(slot[:, None] - np.arange(self.longest + 1), (first[alive] + alive)[:, None])
                values = alpha[recent]
                most = values.max(axis=1)
                alpha[recent] = values / most[:, None]
                total[alive] += np.log(most)
        return total + np.log(alpha[first + np.arange(len(units)) + sizes]) - sizes[:, None] * np.log(_SCALE)

    def _long(self, units: list[bytes]) -> np.ndarray:
        """``forward`` of units over SHORT_BYTES: those of like lengths side by side, by bounded numbers of bytes."""
        out = np.zeros((len(units), len(self.langs)))
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        at = 0
        while at < len(order):
            to, held = at, 0
            while to < len(order) and (to == at or held + len(units[order[to]]) <= _BESIDE):
                held += len(units[order[to]])
                to += 1
            group = order[at:to]
            if len(group) == 1:
                out[group[0]] = self._alone(units[group[0]])
            else:
                out[group] = self._side_by_side([units[k] for k in group])
            at = to
        return out

    def _expect_alone(self, data: bytes, counts: np.ndarray, expected: np.ndarray) -> None:
        """Adds one long unit's expected counts of pieces."""
        start, piece, at = self._arcs(data)
        n = len(data)
        alpha, beta = np.zeros((2, n + 1, len(self.langs)))
        up, down = np.zeros((2, n + 1, len(self.langs)))  # logs of what each place was divided by
        alpha[0] = beta[n] = 1.0
        for end in range(1, n + 1):
            own = slice(at[end], at[end + 1])
            up[end] = up[end - 1]
            alpha[end] = (alpha[start[own]] * np.exp(up[start[own]] - up[end]) * self.probs[piece[own]]).sum(axis=0)
            up[end] += np.log(alpha[end])
            alpha[end] = 1.0
        ends = np.repeat(np.arange(n + 1), np.diff(at))
        order = np.argsort(start, kind="stable")
        leaving = np.searchsorted(start[order], np.arange(n + 1))
        for begin in range(n - 1, -1, -1):
            own = order[leaving[begin] : leaving[begin + 1]]
            down[begin] = down[begin + 1]
            beta[begin] = (beta[ends[own]] * np.exp(down[ends[own]] - down[begin]) * self.probs[piece[own]]).sum(axis=0)
            down[begin] += np.log(beta[begin])
            beta[begin] = 1.0
        np.add.at(expected, piece, np.exp(up[start] + down[ends] - up[n]) * self.probs[piece] * counts)

    def forward(self, units: list[bytes]) -> np.ndarray:
        """Natural log of each unit's probability in each language, over all segmentations."""
        out = np.zeros((len(units), len(self.langs)))
        long = [k for k, u in enumerate(units) if len(u) > SHORT_BYTES]
        if long:
            out[long] = self._long([units[k] for k in long])
        for part, matrix in by_length([b"" if len(u) > SHORT_BYTES else u for u in units]):
            n, length = matrix.shape
            prefixes = prefix_hashes(matrix)
            alpha = np.zeros((length + 1, n, len(self.langs)))
            alpha[0] = 1.0
            for end in range(1, length + 1):
                for start in range(max(0, end - self.longest), end):
                    rows, ids = self._found(prefixes, start, end)
                    alpha[end, rows] += alpha[start, rows] * self.probs[ids]
            out[part] = np.log(alpha[length]) - length * np.log(_SCALE)
        return out

    def refit(self, units: list[bytes], counts: np.ndarray) -> None:
        """One round of expectation and maximisation. counts: of each unit in each language."""
        expected = np.zeros_like(self.probs)
        for part, matrix in by_length(units):
            n, length = matrix.shape
            if length > SHORT_BYTES:
                for k in part.tolist():
                    self._expect_alone(units[k], counts[k], expected)
                continue
            prefixes = prefix_hashes(matrix)
            alpha, beta = np.zeros((2, length + 1, n, len(self.langs)))
            alpha[0] = beta[length] = 1.0
            edges = []
            for end in range(1, length + 1):
                for start in range(max(0, end - self.longest), end):
                    rows, ids = self._found(prefixes, start, end)
                    edges.append((start, end, rows, ids))
                    alpha[end, rows] += alpha[start, rows] * self.probs[ids]
            for start, end, rows, ids in reversed(edges):
                beta[start, rows] += beta[end, rows] * self.probs[ids]
            share = counts[part] / alpha[length]
            for start, end, rows, ids in edges:
                np.add.at(expected, ids, alpha[start, rows] * self.probs[ids] * beta[end, rows] * share[rows])
        self._normalise(expected)

    def _normalise(self, counts: np.ndarray) -> None:
        counts = counts + _SMOOTH
        self.probs = counts / counts.sum(axis=0) * _SCALE ** self.lengths[:, None]

    @classmethod
    def fit(cls, langs: list[str], pieces: list[bytes], tokens: list[str], token_counts: np.ndarray, rounds: int = ROUNDS) -> Model:
        index: dict[bytes, int] = {}
        rows, weights = [], []
        for token, weight in zip(tokens, token_counts):
            for unit in units_of(token):
                rows.append(index.setdefault(unit, len(index)))
                weights.append(weight)
        units = list(index)
        counts = np.zeros((len(units), len(langs)))
        if rows:
            np.add.at(counts, np.array(rows), np.array(weights))
        model = cls(langs, piece_keys(pieces), np.fromiter(map(len, pieces), np.float64, len(pieces)), np.zeros((len(pieces), len(langs))), piece_reach(pieces))
        first = np.zeros_like(model.probs)
        for part, matrix in by_length(units):  # to begin with, every occurrence of a piece counts
            if matrix.shape[1] > SHORT_BYTES:
                for k in part.tolist():
                    np.add.at(first, model._arcs(units[k])[1], counts[k])
                continue
            prefixes = prefix_hashes(matrix)
            for end in range(1, matrix.shape[1] + 1):
                for start in range(max(0, end - model.longest), end):
                    found, ids = model._found(prefixes, start, end)
                    np.add.at(first, ids, counts[part[found]])
        model._normalise(first)
        for _ in range(rounds):
            model.refit(units, counts)
        return model

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability (equal priors) of each text; ``und`` and 0 if it has no letter."""
        tokens, docs = numbered(texts)
        units, owner = [], []
        for k, token in enumerate(tokens):
            own = units_of(token)
            units += own
            owner += [k] * len(own)
        scores, letters = np.zeros((len(tokens), len(self.langs))), np.zeros(len(tokens), bool)
        if units:
            np.add.at(scores, np.array(owner), self.forward(units))
            letters[np.array(owner)] = True
        names, values = [], np.zeros(len(docs))
        for k, ids in enumerate(docs):
            if not self.langs or not letters[ids].any():
                names.append("und")
                continue
            total = scores[ids].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            names.append(self.langs[best])
            values[k] = share[best] / share.sum()
        return names, values


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, token, n) of texts, split as for scoring."""
    for batch in batches:
        held: Counter[tuple[str, str]] = Counter()
        langs = batch.column(0).to_pylist()
        names, docs = numbered(batch.column(1).to_pylist())
        for lang, ids in zip(langs, docs):
            for k, n in zip(*np.unique(ids, return_counts=True)):
                held[lang, names[k]] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "token", "n"])


def fit(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, hold_mod: int = 3, hold_at: int = 1) -> Model:
    """Fit on up to ``sample_docs`` documents per language, of those whose crc32(doc_id) modulo ``hold_mod`` isn't ``hold_at``.

    Executors count the sample's tokens; the driver gets one row for each token and language of the bounded sample.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), hold_mod) != hold_at))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    totals = broadcast_ids(cut(usable.groupBy("lang").agg(F.count("*").alias("total"))))
    low = usable.select("doc_id", "lang").join(totals, "lang").where(in_low_share(F.xxhash64("doc_id"), F.col("total"), sample_docs))
    chosen = low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).select("doc_id").distinct()
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counted = sample.select("lang", "text").mapInArrow(_token_counts, "lang string, token string, n bigint").groupBy("lang", "token").agg(F.sum("n").alias("count")).collect()
    langs = sorted({r["lang"] for r in counted})
    tokens = sorted({r["token"] for r in counted})
    at_lang, at_token = {x: k for k, x in enumerate(langs)}, {x: k for k, x in enumerate(tokens)}
    table = np.zeros((len(tokens), len(langs)))
    for r in counted:
        table[at_token[r["token"]], at_lang[r["lang"]]] = r["count"]
    return Model.fit(langs, load_pieces(path), tokens, table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and, as its last two columns, ``_lang_pred`` and ``_score``: every whole text, by batches.

    Names that ``docs`` has taken get another underscore behind them. All columns of ``docs`` pass through.

    Null text and text without a letter: ``und`` with score 0; so too for all if the model has learned no language.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(unused(docs, "_lang_pred"), T.StringType()), T.StructField(unused(docs, "_score"), T.DoubleType())])
    names = [f.name for f in schema.fields]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                texts = rows.column(at).to_pylist()
                for a, b in slices(texts):
                    langs, scores = model.predict(texts[a:b])
                    yield pa.RecordBatch.from_arrays([*rows.slice(a, b - a).columns, pa.array(langs, pa.string()), pa.array(scores)], names=names)

    # by number, as mapInArrow looks columns up by unquoted names
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(run, schema)


def predictions(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, hold_mod: int = 3, hold_at: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``.

    Null and empty texts and those without a letter are ``und`` with score 0. Rows without id or language teach nothing;
    of rows that repeat id and language the least text teaches, all are predicted. Very long texts and runs of letters
    count whole. Languages of equal probability: the first by name. An empty table gives no rows.
    """
    model = fit(docs, path, sample_docs, hold_mod, hold_at)
    held = docs.select("doc_id", (crc_mod(F.col("doc_id"), hold_mod) == hold_at).alias("held_out"), "text")
    return identify(held, model).select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is told with ``least_score`` or more; columns unchanged, whatever their names."""
    found = identify(docs, fit(docs, **options))
    lang, score = (F.col(c) for c in found.columns[-2:])
    return found.where((lang != "und") & (score >= least_score)).drop(lang, score)
