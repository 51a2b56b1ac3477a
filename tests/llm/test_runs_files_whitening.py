"""Periodic runs, token files and whitening against brute force, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import uuid
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectra.llm import id_coder, periodic, token_files, whitening

DOCS = "doc_id bigint, text string, lang string, runs string, ids string, file string, n_tokens string, collapsed string, tie string"


def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice(["a", "b", "straße", "Été", "x1", "don't", "…", "日本"]) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 12])
        rows.append([k * 7, rng.choice([" ", "\n", " \t\x0b"]).join(words), "en"])
    rows += [[None, "a b " * 20, "en"], [None, None, None], [1000, None, "de"], [1001, "", "en"], [1002, " \n\t\x0b\x0c\r ", "en"], [1003, "word " * 30_000, "en"], [1003, "word", "en"], [1004, " a b\u0085c <|endoftext|> é" * 40, "en"]]
    rows += [list(rows[5]), list(rows[5]), list(rows[-1])]
    return [[*r, "r", "i", "f", "n", "c", "t"] for r in rows]


def brute_runs(words, min_length=24, min_exponent=3):
    found = {}
    for p in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(min_length, min_exponent * p) and i > start:
                found.setdefault((start, i - start + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute_runs(words) if len(set(words)) > 1 or len(words) < 24 else [(0, len(words), 1)]
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_runs_of_every_kind():
    rng = random.Random(11)
    for min_length, min_exponent in ((24, 3), (4, 2), (6, 3), (9, 4)):
        for _ in range(60):
            texts = []
            for _ in range(rng.randint(1, 5)):
                words: list[int] = []
                while rng.random() < 0.8 and len(words) < 120:
                    words += [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 4, 5, 30])
                texts.append(words[:120])
            got = periodic.find_runs([np.array(t, np.int64) for t in texts], 60, min_length, min_exponent)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(t, min_length, min_exponent) for t in texts]
    assert periodic.find_runs([], 0) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_matches_are_common_prefixes(texts):
    joined = np.array([x for k, t in enumerate(texts) for x in [*t, 3 + k]], np.int64)
    index = periodic.Matches(joined)
    pairs = [(a, b) for a in range(len(joined)) for b in range(len(joined)) if a != b]

    def common(a, b):
        n = 0
        while max(a, b) + n < len(joined) and joined[a + n] == joined[b + n]:
            n += 1
        return n

    if pairs:
        a, b = map(np.array, zip(*pairs))
        assert index.length(a, b).tolist() == [common(*p) for p in pairs]


def test_run_digests(spark):
    rows = corpus()
    got = periodic.run_digests(spark.createDataFrame(rows, DOCS)).collect()
    assert ordered(got) == ordered(brute_digest(r[0], r[1]) for r in rows)
    assert sum(r["n_runs"] for r in got) > 20
    empty = periodic.run_digests(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_collapsed_text(spark):
    got = periodic.collapse_runs(spark.createDataFrame([(1, "x " + "a b c " * 10 + "y")], "doc_id int, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 30, 3)] and got["collapsed"] == "x a b c y"


@pytest.mark.parametrize("vocab", [1, 2, 17, 300, 49_408, 100_000])
def test_blocks_come_back(vocab):
    rng = np.random.default_rng(vocab)
    blocks = [rng.integers(0, vocab, n) for n in (0, 1, 2, 700, 33)] + [np.zeros(900, int), np.full(5, vocab - 1), np.tile(rng.integers(0, vocab, 7), 90), np.minimum((rng.pareto(1.0, 800) * 3).astype(int), vocab - 1)]
    codes = id_coder.encode_blocks(blocks, vocab)
    back = id_coder.decode_blocks(codes, np.array([len(b) for b in blocks]), vocab)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    # each block alone gives the same code, so the model is reset
    assert [id_coder.encode_blocks([b], vocab)[0] for b in blocks] == codes
    noise = id_coder.decode_blocks([bytes(len(c)) for c in codes], np.array([len(b) for b in blocks]), vocab)
    assert all((b < vocab).all() for b in noise)
    assert len(codes[7]) < 200  # 630 ids of period 7


def tokenizer():
    return open(public_tokenizers.path(token_files.TOKENIZER), encoding="utf-8").read()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\u0085 'sΣςÉ")), max_size=40), max_size=4))
def test_words_alone_give_the_texts_ids(texts):
    loaded = Tokenizer.from_str(tokenizer())
    assert token_files.words_alone(tokenizer())
    got = token_files.WordIds(loaded).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [loaded.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_hold_the_ids(spark):
    rows, loaded = corpus(), Tokenizer.from_str(tokenizer())
    docs = spark.createDataFrame(rows, DOCS)
    got = token_files.round_trip(docs).orderBy("start").collect()
    want = {}
    for r in rows:
        ids = loaded.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == starts[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    assert token_files.round_trip(spark.createDataFrame([], DOCS)).count() == 0


def test_many_files_and_damage(spark, tmp_path):
    rows = [(k, f"some text {k} " * (k % 9)) for k in range(300)]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    token_files.write_corpus(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer(), file_ids=500)
    parts = sorted(p for p in (tmp_path / path).iterdir() if p.name.startswith("part-"))
    assert len(parts) > 5
    assert token_files.file_digest(spark, path).agg(F.count("*"), F.max(F.col("start") + F.col("n_tokens"))).first()[0] == 300
    data = bytearray(max(parts, key=lambda p: p.stat().st_size).read_bytes())
    frames = list(token_files.frames_of(bytes(data)))
    assert sum(len(x) for x in token_files.decode_frames(frames)) == sum(int(f.sizes.sum()) for f in frames)
    for at in (0, 30, len(data) - 12):
        hurt = bytearray(data)
        hurt[at] ^= 0x55
        with pytest.raises(token_files.DamagedFile):
            list(token_files.decode_frames(list(token_files.frames_of(bytes(hurt)))))
    with pytest.raises(token_files.DamagedFile):
        list(token_files.frames_of(bytes(data[:-20])))


VECTORS = "vec_id bigint, embedding array<float>, label int, x string, n string, whitened string"


def vectors():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) * 3
    rows = [[k, [float(np.float32(c)) for c in v], 1] for k, v in enumerate(base)]
    rows += [[900, None, 1], [901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1], [902, [float("nan")] + [0.0] * 5, 1], [903, [float("inf")] + [0.0] * 5, 1], [904, [], 1], [905, [1.0, 2.0], 1], [None, rows[3][1], None], list(rows[4]), list(rows[4])]
    return [[*r, "x", "n", "w"] for r in rows]


def brute_whiten(rows, most=16):
    kept = [(r[0], [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in r[1]]) for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and np.isfinite(c) for c in r[1])]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    moved = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(moved.T @ moved / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    out = []
    for vec_id, x in kept:
        exact = [n * c - s for c, s in zip(x, sums)]
        out.append((vec_id, n, sum(c * c for c in exact), np.abs(np.array([float(Fraction(c, n)) for c in exact]) @ axes / np.sqrt(values)), values / values.sum()))
    return out


def test_whitening(spark):
    rows = vectors()
    got = {}
    for r in whitening.whitened_components(spark.createDataFrame(rows, VECTORS)).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    want = brute_whiten(rows)
    assert sum(map(len, got.values())) == 6 * len(want)
    for vec_id, n, deviation, whitened, explained in want:
        for k in range(6):
            for r in got[(vec_id, k + 1)]:
                assert (r["n"], r["deviation"]) == (n, deviation)
                assert abs(abs(r["whitened"]) - whitened[k]) < 1e-9 and abs(r["explained"] - explained[k]) < 1e-9 and r["identity_error"] < 1e-9
    assert len(got[(4, 1)]) == 3


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["n"], r["deviation"], r["whitened"]) for r in whitening.whiten(one).collect()] == [(1, 0, []), (1, 0, [])]
    assert whitening.whitened_components(one).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 5.0, float(2 * k)]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whitened_components(flat).collect()} == {1}


def test_huge_entries(spark):
    rows = [(k, [s * 3.0e38, float(k)]) for k, s in enumerate((1, -1, 1, -1))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 4 and all(np.isfinite(r["whitened"]).all() for r in got)
