"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from prospectra.llm import components, decontam, html_blocks, langid, line_dedup, lm_automaton, mixing, near_copies, quality, simhash, toxicity, url_trust

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, key string, fp string"
#: Names that the operators use inside; pass-through operators must keep them apart.
CLASHES = "_id _mark _key _gone _gone_id _dup_id _dup _n _lang_pred _score score id u v item hits".split()
WORDS = {"en": "the of and to in is was that for with", "de": "der die und das von mit ist ein nicht auf"}
SPACE = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        lines = [" ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "x", "ly"]) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 9))]
        rows.append([k, "\n".join(lines), lang, f"s{k % 3 if k % 2 else 0}", 1, "h", "k", "f"])
    rows[10][1] = rows[4][1]
    rows[11][1] = rows[5][1] + "\n" + rows[7][1]
    rows[12][1] = rows[4][1].upper()
    rows += [[60, None, None, None, None, None, None, None], [61, "", "en", "s0", 0, "h", "k", "f"], [62, " \n\t ", "de", None, 0, "h", "k", "f"], [63, "123 !!!", "en", "s1", 0, "h", "k", "f"], [None, "a null id here", "en", "s1", 0, "h", "k", "f"], [64, "É é ß word " * 4000, None, "s2", 0, "h", "k", "f"], [65, "same\nsame\nsame\nsame\nsame", "en", "s2", 0, "h", "k", "f"]]
    rows.append(list(rows[3]))
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


def held(doc_id, n, at):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n == at


def key(row):
    return tuple((x is not None, x) for x in row)


def test_simhash_links_all(docs, rows):
    def print_of(text):
        words = re.findall(SPACE, lower(text))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [print_of(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in combinations(range(len(rows)), 2):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                group[a] = group[b] = min(group[a], group[b])
    want = sorted(((r[0], f"{p:016x}", min((x[0] for x, g in zip(rows, group) if g == group[k] and x[0] is not None), default=None)) for k, (r, p) in enumerate(zip(rows, prints))), key=key)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key) == want


def test_crowded_buckets_lose_no_pair(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted(r)) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()}
    assert got == {tuple(sorted((a, b))) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_components_of_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100}


def test_keep_one(docs):
    ids = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert 10 not in ids and 12 not in ids and 4 in ids and None in ids and len(ids) == len(set(ids))
    assert simhash.keep_one(docs).columns == docs.columns


def test_similar_documents(spark, docs):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = {}
    for k in range(400):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 150))] if k % 2 else list(base)
        if k % 2 == 0:  # a crowd of near copies and half copies
            for at in rng.sample(range(300), rng.choice([1, 2, 4, 30])):
                words[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(words)
    texts |= {400 + k: texts[k].upper() + " end" for k in range(1, 80, 2)} | {500: "", 501: None, 502: "one two", 503: "One  two"}

    def shingles(text):
        w = re.findall(SPACE, lower(text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    near = [(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0]
    table = spark.createDataFrame([*texts.items(), (None, base[0]), (None, base[0])], "doc_id bigint, text string").repartition(4)
    kept = [r["doc_id"] for r in near_copies.drop_similar(table).collect()]
    left = set(kept) - {None}
    assert kept.count(None) == 2 and {500, 501, 502} <= left and 503 not in left
    assert not [p for p in near if left >= set(p)]
    group = {k: k for k in texts}
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    assert left == {k for k in texts if group[k] == k}
    assert near_copies.drop_similar(docs.where("doc_id <> 3")).columns == docs.columns
    assert near_copies.drop_similar(docs.limit(0)).count() == 0


def test_crowded_bucket_without_copies(spark):
    """A bucket of many documents that share a block and are not similar, and one late pair that is."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = {k: " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(40)]) for k in range(120)}
    texts[500] = texts[77] + " end"
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert [r["id"] for r in near_copies.similar_ids(table).collect()] == [500]


def test_star_in_crowded_buckets(spark):
    """Edits of one text, each similar to it and not to each other: one group, though the original may go in the first round."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = {300: " ".join(base)}
    for k in range(300):  # five edits take 25 of 296 shingles: about 0.84 to the original, 0.72 to each other
        words = list(base)
        for at in rng.sample(range(10, 290, 6), 5):
            words[at] = f"x{k}.{at}"
        texts[k] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert [r["doc_id"] for r in near_copies.drop_similar(table).collect()] == [0]
    assert [r["doc_id"] for r in near_copies.keep_one(table).collect()] == [0]


def test_links_of_removed_documents(spark):
    """A document that SimHash ties to another still ties the one it resembles itself."""
    words = [f"w{k}" for k in range(300)]
    texts = {2: words, 3: words + ["q", "r"], 4: words + ["q", "r"] + [f"y{k}" for k in range(73)]}
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id bigint, text string")
    print_of = {k: simhash.fingerprint(" ".join(t).encode()) for k, t in texts.items()}
    assert bin((print_of[2] ^ print_of[3]) & (1 << 64) - 1).count("1") <= 2 and near_copies.jaccard(*(" ".join(texts[k]).encode() for k in (2, 4))) < 0.8 <= near_copies.jaccard(*(" ".join(texts[k]).encode() for k in (3, 4)))
    assert [r["doc_id"] for r in near_copies.keep_one(table).collect()] == [2]


def test_clashing_names(spark, docs, rows):
    wide = docs.withColumns({c: F.lit(f"v{k}") for k, c in enumerate(CLASHES)}).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(1, rows[8][1])], "item_id bigint, text string")
    for stage in (langid.keep_identified, lambda d: line_dedup.dedup_lines(d, counts=False), simhash.keep_one, near_copies.drop_similar, lambda d: decontam.decontaminate(d, bench)):
        base, table = docs.where("doc_id <> 3"), wide.where("doc_id <> 3")
        out = stage(table)
        assert out.columns == wide.columns
        got = out.collect()
        assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(map(tuple, stage(base).collect()), key=key)
        assert all(tuple(r)[8:] == (*(f"v{k}" for k in range(len(CLASHES))), 1) for r in got) and got


def test_line_dedup_of_one_long_text(spark):
    text = "\n".join(f"line {k % 30_000}" for k in range(60_000))
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, text, 5)], "doc_id bigint, text string, _n_lines int")).collect()[0]
    assert (out["_n_lines"], out["_n_removed"]) == (60_000, 30_000) and out["text"] == "\n".join(f"line {k}" for k in range(30_000))


def test_line_dedup(docs, rows):
    lines = {(r[0], r[1]): [x for x in (r[1] or "").split("\n") if re.search(SPACE, x)] for r in rows}
    order = sorted(lines, key=lambda k: (k[0] is not None, k[0] or 0))
    seen, want = {}, {}
    for k in order:
        gone = set()
        for i in range(len(lines[k]) - 2):
            window = tuple(lines[k][i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.setdefault(window, k)
        want[k[0]] = (k[1] if not gone else "\n".join(x for i, x in enumerate(lines[k]) if i not in gone), len(lines[k]), len(gone))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_removed"]) for r in out.collect()}
    assert got == want and sum(x[2] for x in want.values()) > 0


def test_decontamination(spark, docs, rows):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    texts = {1: " ".join(rows[7][1].split()[3:30]), 2: "word É", 3: None, 4: "...", 5: " ".join(rows[9][1].split()[:12]) + " and then something else entirely that is new", 6: rows[8][1]}
    bench = spark.createDataFrame(list(texts.items()) + [(6, rows[8][1])], "item_id bigint, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.contamination(docs, bench).collect()}
    for r in rows:
        words = re.findall(word, lower(r[1]))
        hit, items = set(), set()
        for item, text in texts.items():
            w = re.findall(word, lower(text))
            n = min(10, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(words) - n + 1 if grams else 0):
                if tuple(words[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    items.add(item)
        assert out[r[0]] == (len(words), len(hit), len(items)), r[0]
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in out.items() if not v[1]}
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_repetitive_texts(spark):
    """Thousands of equal words on both sides, ties everywhere, null and repeated items: as by plain windows, and fast."""
    docs = [(1, "la " * 3000), (2, "la " * 9 + "end"), (3, "x " * 500 + "la " * 10), (4, None), (4, None), (None, "a b c d"), (5, "one two three four five six seven eight nine ten " * 300), (6, "a b c d e")]
    bench = [(7, "la " * 1000), (7, "la " * 1000), (8, None), (None, "b c"), (9, "three four five six seven eight nine ten one two three"), (10, "c d e"), (11, "")]
    table, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    began = time.time()
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.contamination(table, items).collect()}
    took = time.time() - began

    def expect(text):
        w, hit, found = (text or "").split(), set(), set()
        for item, t in bench:
            v = (t or "").split()
            n = min(10, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(item)
        return len(w), len(hit), len(found)

    assert got == {(k, *expect(t)) for k, t in docs}
    assert took < 60


def lm_probability(h, w, counts, types, total, strengths):
    """The smoothed probability of ``w`` behind the history ``h`` (two words, one, none), by recursion."""
    if not h:
        return (counts[(w,)] + 1) / (total + types + 1)
    seen = sum(c for g, c in counts.items() if len(g) == len(h) + 1 and g[:-1] == h)
    lower = lm_probability(h[1:], w, counts, types, total, strengths)
    return (counts[(*h, w)] + strengths[len(h) - 1] * lower) / (seen + strengths[len(h) - 1]) if seen else lower


def test_lm_score(docs, rows):
    tokens = lambda t: [*re.findall(SPACE, lower(t)), None]
    counts, followed = Counter(), Counter()
    for r in rows:
        if not held(r[0], 7, 2):
            w = ["<s>", *tokens(r[1])]
            for n in (1, 2, 3):
                counts.update(tuple(w[i : i + n]) for i in range(n == 1, len(w) - n + 1))
    for g, c in counts.items():
        followed[g[:-1]] += c
    n, v = followed[()], sum(len(g) == 1 for g in counts)
    one, two = lm_automaton.STRENGTHS
    got = sorted(lm_automaton.score(docs).collect(), key=lambda r: key((r["doc_id"],)))
    for r, g in zip(sorted(rows, key=lambda r: key((r[0],))), got):
        w, score, base = ["<s>", *tokens(r[1])], 0.0, 0.0
        for i in range(1, len(w)):
            p = (counts[(w[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            p = (counts[w[i - 1], w[i]] + one * p) / (followed[(w[i - 1],)] + one)
            if i > 1:
                p = (counts[tuple(w[i - 2 : i + 1])] + two * p) / (followed[tuple(w[i - 2 : i])] + two)
            score += math.log10(p)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(r[0], 7, 2), len(w) - 1, sum(counts[(x,)] > 0 for x in w[1:]), n)
        assert g["base_score"] == pytest.approx(base, abs=1e-6) and g["score"] == pytest.approx(score, abs=1e-6)


def test_lm_states_and_failure_arcs():
    """Texts walked by the automaton against the recursion, held-out ones with unknown words and pairs among them."""
    texts, train = ["a b a b a", "b b", "", "a b c a b", "b b a", "x b a q a b a"], np.array([1, 1, 1, 1, 0, 0], bool)
    chunk = lm_automaton.Chunk.of([t.encode() for t in texts])
    grams = chunk.grams()
    totals = chunk.counted(train, grams)[grams.place].astype(float)
    n = len(chunk.hashes)
    machine = lm_automaton.Automaton(totals, grams, int(totals[1:n].sum()), int((totals[1:n] > 0).sum()), (7.0, 2.0))
    counts = Counter()
    for t in [t for t, k in zip(texts, train) if k]:
        w = ["<s>", *t.split(), None]
        for size in (1, 2, 3):
            counts.update(tuple(w[i : i + size]) for i in range(size == 1, len(w) - size + 1))
    total, types = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    for t, got in zip(texts, machine.walk(chunk.symbols, chunk.starts, grams)):
        w = ["<s>", *t.split(), None]
        assert got == pytest.approx(sum(math.log10(lm_probability(tuple(w[max(i - 2, 0) : i]), w[i], counts, types, total, (7.0, 2.0))) for i in range(1, len(w))))
    # each state's probabilities, one unknown word's among them, sum to one
    words = [g[0] for g in counts if len(g) == 1] + ["unknown"]
    for h in [(), ("a",), ("a", "b"), ("<s>", "b"), ("q", "b"), ("q",)]:
        assert sum(lm_probability(h, w, counts, types, total, (7.0, 2.0)) for w in words) == pytest.approx(1)


def test_lm_copies_of_training_texts_score_higher(spark):
    """A held-out text that training holds too, word for word, scores above the same words in another order."""
    rng = np.random.default_rng(3)
    word = [f"w{k}" for k in range(400)]
    train = [i for i in range(400) if not held(i, 7, 2)]
    known = [" ".join(rng.choice(word, 30)) for _ in train]
    tested = [i for i in range(400, 500) if held(i, 7, 2)]
    copies = [(i, known[k]) for k, i in enumerate(tested)]
    mixed = [(i + 10_000_000, " ".join(rng.permutation(t.split()))) for i, t in copies if held(i + 10_000_000, 7, 2)]
    out = {r["doc_id"]: r["score"] for r in lm_automaton.score(spark.createDataFrame([*zip(train, known), *copies, *mixed], "doc_id bigint, text string")).collect()}
    for i, _ in mixed:
        assert out[i - 10_000_000] > out[i] + 5


def test_mixing(docs, rows):
    out = mixing.mix(docs, range_rows=7).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(SPACE, r[1] or ""))
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1, 5]))
    target, left, open_now = {}, float(sum(sizes.values())), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_now) for s in open_now}
        over = {s for s in open_now if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_now -= over
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]])
    assert {s: taken[s] for s in sizes} == {s: math.floor(target[s] + 0.5) for s in sizes}
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=key) == sorted(map(tuple, out), key=key)


def test_quality_counts(docs, rows):
    got = sorted((tuple(r)[:6] for r in quality.judge(docs).collect()), key=key)
    want = []
    for r in rows:
        t = r[1] or ""
        w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want, key=key)


def test_quality_fences(spark):
    clean = [(k, " ".join(f"word{(k * 7 + j * j) % 97}a" for j in range(80)), "en", f"s{k % 2}") for k in range(400)]
    junk = [(1000, " ".join(f"word{j}***" for j in range(80)), "en", "s0"), (1001, " ".join("w" * 40 + str(j) for j in range(80)), "en", "s1")]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(out[k] for k in range(400)) and not out[1000] and not out[1001]


def test_url_rules_and_trust(spark):
    rules = [url_trust.Rule("com", "/en/", "block"), url_trust.Rule("a.com", "/en/7", "allow"), url_trust.Rule("bad.org", "/", "block"), url_trust.Rule("good.org", "/", "allow")]
    rows = [(1, "http://X.A.com/en/71?q", None), (2, "http://b.com/en/1#f", ""), (3, None, "<a href=x>"), (4, "no scheme", ""), (5, "http://bad.org/x", ""), (6, "http://fan.net/1", '<a href="http://bad.org/x">'), (7, "http://good.org/", '<a href="//peer.net/">'), (8, "http://peer.net/", '<a href="http://bad.org/">'), (9, "http://notacom/en/", ""), (9, "http://notacom/en/", ""), (10, "HTTP://Q.org", None)]
    out = {r["page_id"]: r for r in url_trust.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules).collect()}
    assert [(out[k]["host"], out[k]["path"], out[k]["rule"], out[k]["verdict"]) for k in (1, 2, 3, 4, 5)] == [("x.a.com", "/en/71", "a.com/en/7", "allow"), ("b.com", "/en/1", "com/en/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("bad.org", "/x", "bad.org/", "block")]
    assert out[9]["rule"] is None and out[9]["verdict"] == "allow" and out[10]["host"] == "q.org"
    assert out[6]["distrust"] == pytest.approx(0.85 / 2) and out[8]["trust"] == pytest.approx(0.85)


@pytest.mark.parametrize("hot_parts", [1000, 4])
def test_url_verdicts_by_brute_force(spark, hot_parts):
    """Random pages, a third of them of one host: links counted, both ranks solved as linear systems, verdicts compared."""
    rng = random.Random(8)
    hosts = [f"h{k}.{'good' if k % 4 == 0 else 'bad' if k % 4 == 1 else 'net'}" for k in range(12)]
    rules = [url_trust.Rule("good", "/a", "allow"), url_trust.Rule("bad", "/a", "block")]
    rows = []
    for k in range(150):
        host = hosts[2] if k % 3 == 0 else rng.choice(hosts)
        links = "".join(f'<a href="http://{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, 3))) + "text " * (50_000 if k == 7 else 3)
        rows.append((k, f"http://{host}/{rng.choice('ab')}{k}", links if k % 20 else None))
    rows += [rows[5], (150, None, links), (151, "", None)]
    at = {h: k for k, h in enumerate(hosts)}
    links, n, seeds = np.zeros((12, 12)), np.zeros(12), np.zeros((2, 12))
    for _, url, html in rows:
        if not url:
            continue
        _, _, host, path = url.split("/")
        n[at[host]] += 1
        for kind, (suffix, _) in enumerate([("good", 0), ("bad", 0)]):
            seeds[kind, at[host]] += host.endswith("." + suffix) and path.startswith("a")
        for to in re.findall(r'href="http://([^/]+)/', html or ""):
            if to != host:
                links[at[host], at[to]] += 1
    share = links / np.maximum(1, links.sum(axis=1, keepdims=True))
    back = share / np.maximum(1e-300, share.sum(axis=0, keepdims=True))
    trust = np.linalg.solve(np.eye(12) - 0.85 * share.T, seeds[0] / np.maximum(1, n))
    distrust = np.linalg.solve(np.eye(12) - 0.85 * back, seeds[1] / np.maximum(1, n))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("x"), "n": F.lit(1), "_host": F.lit("y"), "trust": F.lit(2.0)})
    got = sorted(map(tuple, url_trust.judge(table, rules, hot_parts=hot_parts).select("page_id", "rule", "verdict", "trust", "distrust").collect()), key=key)
    want, verdicts = [], Counter()
    for k, url, _ in rows:
        host, path = url.split("/")[2:] if url else ("", "")
        t, d = (trust[at[host]], distrust[at[host]]) if host else (0.0, 0.0)
        assert not host or abs(d - t - 0.5) > 1e-2
        suffix = host[host.find(".") + 1 :]
        rule = f"{suffix}/a" if suffix in ("good", "bad") and path[0] == "a" else None
        want.append((k, rule, {"good/a": "allow", "bad/a": "block"}.get(rule, "block" if d - t >= 0.5 else "allow"), t, d))
        verdicts[want[-1][2], rule is None] += 1
    assert len(verdicts) == 4
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=2e-3)


def test_propagation_matches_dense(spark):
    rng = random.Random(5)
    edges = {(a, b) for a in range(12) for b in rng.sample(range(12), 3) if a != b}
    degree = Counter(a for a, _ in edges)
    table = spark.createDataFrame([(str(a), str(b), 1 / degree[a]) for a, b in edges], "src string, dst string, share double")
    got = {r["host"]: r["rank"] for r in url_trust.propagate(table, spark.createDataFrame([("0", 1.0)], "host string, mass double"), rounds=60).collect()}
    m = np.zeros((12, 12))
    for a, b in edges:
        m[b, a] = 0.85 / degree[a]
    want = np.linalg.solve(np.eye(12) - m, np.eye(12)[0])
    assert max(abs(got.get(str(k), 0) - want[k]) for k in range(12)) < 1e-3


def test_propagation_settles_on_a_cycle(spark):
    """Two hosts that link only to each other: exact rank of the seed is 1 / (1 - 0.85**2), and a limit is an error."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, share double").coalesce(1)
    seeds = spark.createDataFrame([("a", 1.0)], "host string, mass double").coalesce(1)
    got = {r["host"]: r["rank"] for r in url_trust.propagate(edges, seeds).collect()}
    assert got["a"] == pytest.approx(1 / (1 - 0.85**2), abs=1e-3) and got["b"] == pytest.approx(0.85 / (1 - 0.85**2), abs=1e-3)
    with pytest.raises(ValueError):
        url_trust.propagate(edges, seeds, rounds=3)


def test_html():
    page = '<html><head><title>t</title><style>a</style></head><body><header>Site</header><nav>menu</nav><div class="cookie-notice">we use</div><div id="c"><h1>Head &amp; tail</h1><p>First <b>bold</b>\n text of the page which is long enough to surge over the rest.<p>Second&nbsp;one.</p><ul><li>x<li>y</ul></div><div class="sidebar">side</div><div class="comments">me</div><form>f</form><script>s</script><footer>f</footer>'
    assert html_blocks.main_text(page) == "Head & tail\nFirst bold text of the page which is long enough to surge over the rest.\nSecond one.\nx\ny"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav>a</nav>") == ""
    assert html_blocks.main_text("<article>ok</article>") == "ok" and html_blocks.main_text("a < b") == "a < b"
    assert len(html_blocks.main_text("<div>" * 3000 + "x" * 100_000)) == 100_000


def test_line_blocks_follow_the_distribution():
    """Stretches against their definition: lines between dives whose windows reach the surge, from line to line."""
    rng = random.Random(6)
    for _ in range(300):
        weights = [float(rng.choice([0, 0, 0, rng.randint(1, 30), rng.randint(30, 120)])) for _ in range(rng.randint(0, 25))]
        window, surge = rng.choice([1, 2, 3]), rng.choice([1.0, 40.0, 80.0, 500.0])
        total = lambda k: sum(weights[max(0, k) : k + window])  # noqa: E731, B023
        top = min(surge, max(map(total, range(len(weights))), default=0))
        keep = set()
        for k, w in enumerate(weights):
            if not w:
                continue
            # all lines that can be reached from this one without a dive in between
            low = high = k
            while low > 0 and total(low - 1) > 0:
                low -= 1
            while high + 1 < len(weights) and total(high + 1) > 0:
                high += 1
            if max(map(total, range(low, high + 1))) >= top > 0:
                keep.add(k)
        got = html_blocks.stretches(weights, window, surge)
        assert {k for a, b in got for k in range(a, b) if weights[k]} == keep
        assert all(weights[a] and weights[b - 1] for a, b in got) and got == sorted(got)


def test_article_tags_are_only_a_prior():
    rng = random.Random(7)
    for _ in range(40):
        paragraphs = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(2, 12))]
        links = "".join(f"<li><a href=/{k}>menu {k}</a></li>" for k in range(6))
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        marked = f"<body><ul>{links}</ul><article><h1>Title</h1>{body}</article><div class='related-posts'>more</div></body>"
        plain = re.sub("</?article>", "", marked)
        assert html_blocks.main_text(marked) == html_blocks.main_text(plain) == "\n".join(["Title", *paragraphs])
    assert html_blocks.main_text("<article>one</article><p>" + "x" * 100 + "</p>") == "one\n" + "x" * 100
    assert html_blocks.main_text("<div><article>a teaser</article></div>" + "<p><a href=x>only a link</a></p>" * 4 + f"<div>{'main text ' * 20}</div>") == ("main text " * 20).strip()


def test_dives_without_telling_names():
    """Menus, adverts and footers go by the distribution alone, short closing paragraphs stay."""
    paragraphs = [f"<p>{'some running text of the page ' * 6}no. {k}.</p>" for k in range(5)] + ["<p>Short end.</p>"] * 4
    text = "\n".join(re.sub("</?p>", "", p) for p in paragraphs)
    menu = "".join(f"<div>Entry {k}</div>" for k in range(6))
    assert html_blocks.main_text(menu + "".join(paragraphs) + menu) == text
    assert html_blocks.main_text(f"<div class=x1>{'buy this now, ' * 4}</div><article><h1>Head</h1>{''.join(paragraphs)}</article><div>(c) somebody, all rights</div>") == "Head\n" + text
    # a list inside the text, and two short lines at an end, are no menu
    inside = "".join(paragraphs[:3]) + menu + "".join(paragraphs[3:])
    assert html_blocks.main_text(inside).count("Entry") == 6 and html_blocks.main_text("<p>by me</p><p>today</p>" + paragraphs[0]).startswith("by me\ntoday\n")
    # names weigh against lines, a heading weighs what follows it
    assert html_blocks.weights_of([("x" * 9, 2, html_blocks.AROUND), ("ab", 0, html_blocks.HEADING), ("y" * 30, 0, html_blocks.PLAIN), ("z" * 4, 0, html_blocks.INSIDE)]) == [-7.0, 30.0, 30.0, 8.0]
    assert html_blocks.typical([1.0, 1.0, 50.0, 40.0, -9.0]) == 50.0 and html_blocks.typical([]) == 0.0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_pages_without_class_words(spark, monkeypatch):
    """With the words for classes emptied the distribution takes out the adverts, so F1 of words stays over 0.97."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    article = lambda page: re.search("<article>(.*?)</article>", page, re.S)[1]
    want = [Counter(" ".join(line for line, *_ in html_blocks.lines_of(article(p))).split()) for p in pages]
    monkeypatch.setattr(html_blocks, "_ODD", frozenset())
    got = [Counter(html_blocks.main_text(p).split()) for p in pages]
    f1 = [2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())) for a, b in zip(want, got)]
    decided = sum(len([1 for k, line in enumerate(lines) if line[2] != html_blocks.AROUND]) > len(html_blocks.kept_lines(lines)) for lines in map(html_blocks.lines_of, pages))
    assert sum(f1) / len(f1) > 0.97 and decided > 0.9 * len(pages)


def test_broken_markup_takes_time_in_proportion():
    began = time.time()
    for page in ("<div>" * 20_000 + "</p>" * 20_000, "<noscript>" * 20_000, "<svg>x" * 20_000, "<title>x" * 20_000, "<span class=ad>" * 20_000 + "</b>" * 20_000, "<div>" * 20_000 + "</section>" * 20_000):
        html_blocks.main_text(page)
    assert time.time() - began < 6 * 0.5


def test_html_edges(spark):
    cases = {
        "<div class='ad-free-article'><p>text</p></div><div class='related-work'>more</div>": "text\nmore",
        "<div class='ad-slot'>x</div><div class='site-footer'>y</div><div id='comments'><p>z</p></div><p>real</p>": "real",
        f"<p>{'y' * 90}</p><nav><ul><li>a<li>b<li>c</ul></nav><p>closing</p>": "y" * 90 + "\nclosing",
        "<p>a <button>Click</button> b</p>": "a b",
        "<html><head><title>Leak<body><p>text": "text",
        "<p>a <a href=x>link <b>bold</a> more</b> end</p>": "a link bold more end",
        "": "",
        "<nav>only</nav>": "",
        "a < b &amp; c": "a < b & c",
    }
    for page, want in cases.items():
        assert html_blocks.main_text(page) == want, page
    long = "<p>" + "</p><p>".join(f"line {k} <b>of</b> a long page" for k in range(30_000)) + "</p>"
    assert html_blocks.main_text(long) == "\n".join(f"line {k} of a long page" for k in range(30_000))
    assert html_blocks.main_text("<div>" * 5000 + "deep") == "deep"
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, text string, n_chars string")
    assert html_blocks.extract(empty).collect() == []
    wide = spark.createDataFrame([(1, "u", "<p>x</p>", "clash", "clash")], empty.schema)
    assert tuple(html_blocks.extract(wide).collect()[0]) == (1, "u", "x", 1)


def test_html_query(spark):
    out = html_blocks.extract(spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>é</p>")], "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "é", 1), (1, "", 0), (1, "", 0)]


def test_language_id(docs, rows):
    out = sorted(langid.predictions(docs).collect(), key=lambda r: key((r["doc_id"],)))
    for r, g in zip(sorted(rows, key=lambda r: key((r[0],))), out):
        assert g["held_out"] == held(r[0], 3, 1) and 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (not any(c.isalpha() for c in r[1] or ""))
        if r[0] is not None and r[0] < 60:
            assert g["lang_pred"] == r[2]


def test_language_id_by_brute_force(spark, tmp_path):
    """Training and prediction over a small vocabulary, summed over the lattice position by position in plain Python."""
    rng = random.Random(4)
    vocabulary = [b" a", b"ab", b"abc", b"ca", b"bb", b" ca", b"aab", b"\xc3\xa9"]
    path = tmp_path / "pieces"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(vocabulary)))
    letters = {"x": "aaabcé", "y": "abbccc", None: "abc"}
    rows = []
    for k in range(40):
        lang = ("x", "y", None)[k % 3] if k % 5 else "y"
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) + rng.choice(["", "", "-a", "1"]) for _ in range(rng.randint(1, 6))]
        rows.append((k, " ".join(words).upper() if k % 7 == 0 else "\n".join(words), lang))
    rows += [(40, None, "x"), (41, "12 !", "y"), (42, "ab " * 200, "x"), rows[1]]
    pieces = sorted(set(vocabulary) | {bytes([b]) for b in range(256)})

    def units(text):
        return [(" " + u).encode() for u in re.findall(r"[a-zé]+", (text or "").lower())]

    counts = {"x": Counter(), "y": Counter()}
    for k, text, lang in set(rows):
        if lang and not held(k, 3, 1):
            counts[lang].update(units(text))

    def lattice(unit, probs):
        alpha, beta = [1.0] + [0.0] * len(unit), [0.0] * len(unit) + [1.0]
        arcs = [(a, b) for b in range(1, len(unit) + 1) for a in range(b) if unit[a:b] in probs]
        for a, b in arcs:
            alpha[b] += alpha[a] * probs[unit[a:b]]
        for a, b in sorted(arcs, reverse=True):
            beta[a] += probs[unit[a:b]] * beta[b]
        return alpha, beta, arcs

    def normal(expected):
        total = sum(expected.values()) + langid._SMOOTH * len(pieces)
        return {p: (expected[p] + langid._SMOOTH) / total for p in pieces}

    models = {}
    for lang, own in counts.items():
        first = Counter()
        for unit, n in own.items():
            for b in range(1, len(unit) + 1):
                for a in range(b):
                    first[unit[a:b]] += n * (unit[a:b] in pieces)
        probs = normal(first)
        for _ in range(langid.ROUNDS):
            expected = Counter()
            for unit, n in own.items():
                alpha, beta, arcs = lattice(unit, probs)
                for a, b in arcs:
                    expected[unit[a:b]] += n * alpha[a] * probs[unit[a:b]] * beta[b] / alpha[-1]
            probs = normal(expected)
        models[lang] = probs
    got = sorted(map(tuple, langid.predictions(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), path=str(path)).collect()))
    for (k, text, _), g in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        own = units(text)
        x, y = (sum(math.log(lattice(u, models[lang])[0][-1]) for u in own) for lang in "xy")
        want = ("und", 0.0) if not own else ("x", 1 / (1 + math.exp(y - x))) if x >= y else ("y", 1 / (1 + math.exp(x - y)))
        assert g[:3] == (k, held(k, 3, 1), want[0]) and g[3] == pytest.approx(want[1], abs=1e-6)


def test_forward_sums_segmentations():
    pieces = sorted({b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab"})
    rng = np.random.default_rng(1)
    probs = rng.random((len(pieces), 2))
    lengths = np.array([len(p) for p in pieces], float)
    model = langid.Model(["x", "y"], langid.piece_keys(pieces), lengths, probs * langid._SCALE ** lengths[:, None])

    def total(rest: bytes) -> np.ndarray:
        return np.ones(2) if not rest else sum((probs[k] * total(rest[len(p) :]) for k, p in enumerate(pieces) if rest.startswith(p)), np.zeros(2))

    units = [b" abab", b"ab", b" ba", b"aabb"]
    assert np.allclose(model.forward(units), np.log([total(u) for u in units]))
    assert np.allclose([model._alone(u) for u in units], model.forward(units))


def test_long_runs_are_summed_whole(monkeypatch):
    """A run of letters longer than a segment: the same sum as by logarithms over the whole lattice, the same expected counts."""
    rng = np.random.default_rng(5)
    pieces = sorted({b" ", b"a", b"b", b"ab", b"abba", b"ba", b"bbbaaabab"})
    probs, lengths = rng.random((len(pieces), 2)), np.array([len(p) for p in pieces], float)
    data = b" " + bytes(rng.choice(np.frombuffer(b"ab", np.uint8), 9000))

    def build():
        return langid.Model(["x", "y"], langid.piece_keys(pieces), lengths, probs * langid._SCALE ** lengths[:, None])

    want = np.zeros((len(data) + 1, 2))
    for end in range(1, len(data) + 1):
        arcs = [(end - len(p), k) for k, p in enumerate(pieces) if data.endswith(p, 0, end)]
        want[end] = np.logaddexp.reduce([want[a] + np.log(probs[k]) for a, k in arcs])
    assert np.allclose(build().forward([data])[0], want[-1])
    short = [data[:40], b" " + data[50:90]]
    one, other = build(), build()
    one.refit(short, np.array([[1.0, 2.0], [3.0, 1.0]]))
    monkeypatch.setattr(langid, "SHORT_BYTES", 5)
    other.refit(short, np.array([[1.0, 2.0], [3.0, 1.0]]))
    assert np.allclose(one.probs, other.probs)


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["nastify", "nastyish", "horrid"]))
        rows.append((k, " ".join(text), "en"))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "xx"), (0, rows[0][1], "en")], "doc_id bigint, text string, lang string")
    out = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")).collect()
    test = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert len(out) == 403 and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in test) / len(test) > 0.9
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.where("predicted = 1").count() == 0


def test_toxicity_learns_from_a_random_start():
    """Held-out AUC of the network on words of its own, with long texts around them."""
    rng = random.Random(12)
    words, bad = [f"w{k}" for k in range(800)], ["nastify", "nastyish", "horridly", "vile"]

    def sample(n):
        texts, y = [], []
        for k in range(n):
            text = [rng.choice(words) for _ in range(rng.randint(50, 400))]
            if k % 2:
                text.insert(rng.randrange(len(text)), rng.choice(bad))
            texts.append(" ".join(text))
            y.append(k % 2)
        return texts, np.array(y)

    texts, y = sample(600)
    net = toxicity.train(texts, y)
    texts, y = sample(200)
    order = np.argsort(np.argsort(net.logits(texts)))
    assert (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5 >= 0.95


def test_toxicity_forward_by_hand():
    """Scores against plain loops; a run without white space counts to its end, an equal beginning doesn't make it equal."""
    net = toxicity.Network.new(3)
    net.bias = np.random.default_rng(4).normal(0, 0.5, len(net.bias)).astype(np.float32)
    texts = ["a b c d", "one", "", None, "x" * 40 + "tail", "x" * 40 + "other " + "word " * 300, "é ß 漢字" * 30]

    def vector(word):
        buckets, _ = toxicity.features([word])
        return net.embed[buckets].sum(axis=0) / np.sqrt(len(buckets))

    for text, got in zip(texts, net.logits(texts)):
        words = [t[k : k + toxicity.UNIT_CHARS] for t in (text or "").lower().split() for k in range(0, len(t), toxicity.UNIT_CHARS)]
        rows = [vector(w) for w in words] or [np.zeros(toxicity.DIM)]
        rows += [np.zeros(toxicity.DIM)] * 2
        best = [max(sum(rows[t + j] @ k[j, :, f] for j in range(len(k))) for t in range(max(1, len(words)))) for k in net.kernels for f in range(toxicity.FILTERS)]
        assert abs(got - (np.maximum(np.array(best) + net.bias, 0) @ net.out)) < 1e-3
    long = ["y" * 15_000 + "a", "y" * 15_000 + "b" * 50]
    assert net.logits(long)[0] != net.logits(long)[1]


def brute_verdicts(rows, got):
    """base_failed and kept of (doc_id, text, lang, source) from plain loops: sketches of log bins, leaning on the language's and on all."""
    ratios, failed = {}, {}
    for k, text, lang, source in rows:
        g = got[k]
        lines = len([x for x in (text or "").split("\n") if re.search(SPACE, x)])
        n = max(1, g["n_words"])
        ratios[k] = {"symbols_per_word": g["n_symbols"] / n, "dup_line_share": g["n_dup_lines"] / max(1, lines), "repeat_share": g["n_repeat_words"] / n, "mean_word": g["word_chars"] / n, "per_word": 1 / n, "per_line": 1 / max(1, lines)}
        failed[k] = g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"]
    bin_of = lambda x: None if x < quality.LEAST else math.ceil(math.log(x) / math.log(quality.GROWTH))
    good = [r for r in rows if not failed[r[0]]]
    names = [*quality.RATIOS, "per_word", "per_line"]
    every = {c: Counter(bin_of(ratios[r[0]][c]) for r in good) for c in names}
    fence = {}
    for lang, source in {(r[2], r[3]) for r in good}:
        of_lang = [r[0] for r in good if r[2] == lang]
        own = [r[0] for r in good if (r[2], r[3]) == (lang, source)]
        q = {}
        for c in names:
            joint, p, n_lang = Counter(bin_of(ratios[k][c]) for k in own), quality.PRIOR, len(of_lang)
            for b, x in Counter(bin_of(ratios[k][c]) for k in of_lang).items():
                joint[b] += p * x / (n_lang + p)
            for b, x in every[c].items():
                joint[b] += p * p * x / len(good) / (n_lang + p)
            bins, total = sorted(joint, key=lambda b: (b is not None, b)), sum(joint.values())
            upto = np.cumsum([joint[b] for b in bins]) / total
            at = lambda share, upper: (lambda b: 0.0 if b is None else quality.GROWTH ** (b - (not upper)))(bins[int(np.argmax(upto >= share))])  # noqa: E731, B023
            q[c] = at(0.25, False), at(0.5, True), at(0.75, True)
        for c, (event, times, low) in quality.RATIOS.items():
            reach = quality.REACH * max(q[c][2] - q[c][0], times * q[event][1])
            fence[lang, source, c] = (q[c][0] - reach if low else -1.0, q[c][2] + reach)
    inside = lambda k, lang, source: all(fence[lang, source, c][0] <= ratios[k][c] <= fence[lang, source, c][1] for c in quality.RATIOS)
    return {k: (failed[k], not failed[k] and inside(k, lang, source)) for k, _, lang, source in rows}, fence


def test_quality_verdicts_by_brute_force(spark):
    rng = random.Random(15)
    rows = []
    for k in range(500):
        n = rng.choice([0, 30, 60, 90, 200])
        words = [rng.choice(["alpha", "be", "gammas", "d", "epsilon"]) + str(rng.randrange(3000)) + rng.choice([""] * 20 + ["###"]) for _ in range(n)]
        if k % 17 == 0:
            words = words[:20] * 6 + words
        if k % 23 == 0:
            words = [w + "$$$*" for w in words]
        text = " ".join(words) if k % 5 else "\n".join(" ".join(words[a : a + 5]) for a in range(0, n, 5))
        rows.append((k, text if k % 50 else None, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r.asDict() for r in quality.judge(docs).collect()}
    assert got == {r["doc_id"]: r.asDict() for r in quality.judge(docs.repartition(7)).collect()}
    want, _ = brute_verdicts(rows, got)
    assert {k: (g["base_failed"], g["kept"]) for k, g in got.items()} == want
    assert 0 < sum(g["kept"] for g in got.values()) < sum(not f for f, _ in want.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_quality_fences_of_the_given_tables(spark):
    """The groups of the test tables: verdicts by plain loops, and fences that differ between languages and sources."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = {r["doc_id"]: r.asDict() for r in quality.judge(docs).collect()}
    want, fence = brute_verdicts(rows, got)
    assert {k: (g["base_failed"], g["kept"]) for k, g in got.items()} == want
    for c in quality.RATIOS:
        assert len({fence[x][1] for x in fence if x[2] == c}) > 1


def test_empty_tables(spark, empty):
    bench, labels = spark.createDataFrame([(1, "a b")], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int")
    for out in (simhash.near_duplicates(empty), simhash.keep_one(empty), line_dedup.dedup_lines(empty), decontam.contamination(empty, bench), lm_automaton.score(empty), mixing.mix(empty), quality.judge(empty), langid.predictions(empty), langid.keep_identified(empty), toxicity.toxicity(empty, labels), url_trust.judge(spark.createDataFrame([], "page_id bigint, url string, html string"), [])):
        assert out.count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    spark.createDataFrame([(1, " ".join(rows[20][1].split()[:30]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    current = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
    ids = [r["doc_id"] for r in current.collect()]
    assert not {12, 20, 60, 61, 62, 63} & set(ids) and {1, 2, 4} <= set(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=key) == sorted(map(tuple, current.collect()), key=key)


def test_pipeline_of_empty_tables(spark, tmp_path, empty):
    """No documents at all, or documents without a benchmark: every stage runs, on its predecessor's rows."""
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_clashing_columns(spark, docs, tmp_path):
    """Columns of the names that operators use inside pass through all stages but the last with their values."""
    wide = docs.where("doc_id < 60").withColumns({c: F.concat_ws("-", F.lit(c), F.col("doc_id")) for c in [*CLASHES, "a.b", "component", "mark", "cls", "range", "size", "target"]})
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, current, str(tmp_path))
        assert out.columns == wide.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
    kept = current.collect()
    assert len(kept) > 50 and all(r[c] == f"{c}-{r['doc_id']}" for r in kept for c in CLASHES)
    assert len(corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path)).collect()) == len(kept)
