"""Steps whose cost must not grow faster than their input: what a task holds, what goes to the driver, what a key costs."""

from __future__ import annotations

import time
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectra.llm import token_files
from prospectra.operators import merge
from prospectra.operators.lead_store import LeadStore
from prospectra.schemas import LEAD, LEAD_COLUMNS
from prospectra.sources import named_files
from prospectra.streaming import state


def test_two_files_of_a_task_are_written_side_by_side(spark, tmp_path):
    """Rows of a file needn't be next to each other, so they needn't be sorted."""
    rows = spark.range(0, 600, numPartitions=3).select(F.concat_ws("-", F.lit("f"), F.spark_partition_id(), F.col("id") % 2).alias("name"), F.concat("id", F.lit("\n")).alias("data"), F.lit("top\n").alias("head"))
    named_files.write_named(rows, str(tmp_path / "out"), together=False, at_once=2)
    made = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert made == {f"f-{p}-{k}": "top\n" + "".join(f"{i}\n" for i in range(p * 200, p * 200 + 200) if i % 2 == k) for p in range(3) for k in range(2)}


def test_an_id_costs_little_to_write_and_read():
    """The range coder took about 1.5 microseconds an id both ways; its frames are still read, beside others."""
    rng = np.random.default_rng(4)
    ids = [np.minimum(rng.pareto(1.0, 4000) * 9, 49_000).astype(np.uint32) for _ in range(200)]
    before = time.process_time()
    data = token_files.encode_frame(list(range(200)), ids, 49_408) + b"\n"
    back = list(token_files.decode_frames(list(token_files.frames_of(data))))
    assert time.process_time() - before < 0.4
    assert np.array_equal(back[0], np.concatenate(ids))
    old = token_files.encode_frame([None, 7], ids[:2], 49_408, dense=True) + b"\n"
    wide = token_files.encode_frame([8], [ids[3] + np.uint32(70_000)], 200_000) + b"\n"
    frames = list(token_files.frames_of(old + data + wide))
    assert [f.dense for f in frames] == [True, False, False] and frames[0].doc_ids.to_pylist() == [None, 7]
    assert [x.tolist() for x in token_files.decode_frames(frames)] == [np.concatenate(ids[:2]).tolist(), back[0].tolist(), (ids[3] + 70_000).tolist()]


def test_a_batch_of_leads_is_not_broadcast(spark, tmp_path):
    """Sizes of a few columns of wide files are estimated far too low, so no join of a merge may rest on them."""
    leads = lambda rows: spark.createDataFrame([{**dict.fromkeys(LEAD_COLUMNS), **r} for r in rows], LEAD)
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = runs().size()
    store = LeadStore(spark, str(tmp_path / "s"), 4)
    store.apply(leads([{"id": f"{k}", "url": f"u{k}", "phone": f"p{k % 3}"} for k in range(20)]), 0)
    store.apply(leads([{"id": "1", "url": "new"}, {"id": "x", "url": "", "phone": "p2"}, {"id": "y", "url": "uy", "phone": "p2"}]), 1)
    merge.merge_by_phone(store.leads(), leads([{"id": "z", "phone": "p1"}])).collect()
    assert store.leads().count() == 21
    after = runs()
    plans = [after.apply(k).physicalPlanDescription() for k in range(before, after.size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_frequent_words_are_remembered():
    """A memory of words that is full forgets the rare ones; all words' ids are those of each by itself."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    known = token_files.WordIds(tokenizer, most=300)
    often, odd = [f"Ofté{k}" for k in range(40)], ["a\u00a0b", "ΣΑΣ", "e\u0301x", "İ", "<|endoftext|>'s", "it's", "\u0085", "\u200b", "x" * 300, "ﬁ", "\u1e9b\u0323"]
    for part in range(30):
        text = " ".join([*often, *odd[part % 3 :], *(f"w{part}x{k}" for k in range(50))])
        assert known.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(known.number) <= 300 and (part < 2 or all(w.encode() in known.number for w in often))


def test_pieces_of_words_are_remembered():
    """Words in capitals and before a comma cost no new encoding; ids of all words are those of the tokenizer."""
    with open(public_tokenizers.path(token_files.TOKENIZER), encoding="utf-8") as definition:
        text = definition.read()
    tokenizer, rng = Tokenizer.from_str(text), np.random.default_rng(3)
    known = token_files.PieceIds(tokenizer, token_files.piece_tokenizer(text), most=4000)
    stems = sorted({"".join(rng.choice(list("aeioulrsténdüß"), 9)) for _ in range(500)})
    many = " ".join(f"{w} {w.title()} {w}, {w.upper()}!! {w}'s ({w})" for w in stems)
    assert known.encode([many.encode()])[0].tolist() == tokenizer.encode(many, add_special_tokens=False).ids
    assert len(known.pieces.number) < 2 * len(stems) + 10 and not known.words.number
    chars = [*map(chr, range(1, 0x180)), "…", "\u0301", "İ", "Σ", "日", "\u2003", "'", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"]
    texts = [f"{c} a{c} {c}a É{c}É 1{c}2 '{c}'S we'{c} {c}{c} .{c}." for c in chars] + ["", " \n", *("".join(rng.choice([*chars, " "], 40)) for _ in range(3000))]
    whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in known.encode([t.encode() for t in texts])] == whole
    assert [known.encode([t.encode()])[0].tolist() for t in texts[::9]] == whole[::9]
    assert isinstance(token_files._known(text), token_files.PieceIds)
    assert token_files.piece_tokenizer(text.replace('"NFC"', '"NFKC"')) is None


def test_rows_of_a_key_are_read_by_place():
    """Looking a row's values up by name cost more than all else that is done with it, so plain tuples must do."""
    held = lambda value: SimpleNamespace(get=lambda: value, update=lambda v: None)
    handle, at = SimpleNamespace(registerTimer=lambda due: None), datetime(2024, 3, 1)
    cache, task = state.TtlCache(60), state.TaskMachine(900, 3)
    cache.handle = task.handle = handle
    cache.value, task.state = held(None), held(("PENDING", None, 0, 3, None, None))
    assert [tuple(r) for r in cache.handleInputRows(("d", "mx"), iter([("d", "mx", 2, at, "get", None), ("d", "mx", 1, at, "put", "v")]), None)] == [("d", "mx", 2, "v", True)]
    answers = task.handleInputRows(("t",), iter([("t", 2, at, "submit", "w", True), ("t", 1, at, "claim", "w", True)]), None)
    assert [(r.event_id, r.answer) for r in answers] == [(1, "claimed"), (2, "completed")]
