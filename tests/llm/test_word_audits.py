"""Divergence audit, tokenizer alignment and anchor dedup against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import corpus, frame, prose, same, tuples

from tidepanel.llm import alignment, anchors, divergence

# ---- divergence ------------------------------------------------------------------------------


def audited(seed=3, n=160):
    rng = random.Random(seed)
    words = [prose(rng, 1) for _ in range(40)] + ["Été", "x1y", "ÀB", "naïve-word"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "é", None, "B"])))
    rows += [(n, None, "en", "quiet"), (n, "", "zz", "lone"), (n + 1, "one two", "zz", "other"), (None, None, None, None)]
    return rows + [rows[0]] * 3 + [(n + 2, "The the THE " * 5000, "en", "a")]


DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("min_docs, top", [(30, 50), (2, 3), (1000, 50)])
def test_divergence(session, min_docs, top):
    rows = audited()
    docs = frame(session, rows, DOCS).withColumns({"term": F.lit("t"), "n": F.lit("clash"), "value": F.lit(1)})
    same(divergence.audit(docs, min_docs, top), brute.divergence([r[1:] for r in rows], min_docs, top))


def test_divergence_in_many_shards_and_merges(session, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_CELLS", 20)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 10)
    monkeypatch.setattr(divergence, "SLICE", 200)
    rows = audited(5, 90)
    got = divergence.audit(frame(session, rows, DOCS), 5, 10)
    same(got, brute.divergence([r[1:] for r in rows], 5, 10))


def test_divergence_of_nothing(session):
    assert divergence.audit(frame(session, [], DOCS)).count() == 0
    got = divergence.audit(frame(session, [(1, None, None, None), (2, "a b", None, "s")], DOCS))
    assert tuples(got) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_shares_are_exact_for_huge_counts():
    for count, total in ((10**14 + 7, 3 * 10**15 + 1), (0, 17), (8 * 10**15, 8 * 10**15 + 5), (5, 10)):
        want = 1 + 10**9 * (count + 5) // total
        assert divergence.shares(np.array([count]), np.array([total]))[0] == want


# ---- alignment -------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(8)
    texts = [t for _, t in corpus(2, 12)][:30]
    texts += [
        "plain words", "plain words", " leading", "trailing ", "two  spaces\n\nand\ttabs", "<|endoftext|> <s> </s> <unk> <0x41>",
        "emoji 👩‍👩‍👧 中文字符 ünïcödé ﬁ", "lower▁bar", "▁", " ", "\n", "a", "\x00\x01", "null \x00 inside", "x" * 5000,
        "".join(rng.choices("abcdefghij", k=3000)), " " * 700 + "end", "it's we'll 'quoted' 12,345.67", "​﻿ nbsp",
        " ".join(prose(rng, 3) for _ in range(900)), "", None,
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "plain words"), (5, "plain words"), (5, "again")]


def aligned(docs):
    return alignment.align(docs)[0]


def test_alignment(session):
    rows = odd_texts()
    same(aligned(frame(session, rows)), brute.alignment(rows, alignment.A_FILE, alignment.B_FILE))


def test_alignment_in_parts_lanes_and_batches(session, monkeypatch):
    for name, value in (("PART", 100), ("MERGE", 700), ("BATCH", 4000), ("LANE", 16), ("LOOK", 8)):
        monkeypatch.setattr(alignment, name, value)
    rows = odd_texts()
    same(aligned(frame(session, rows)), brute.alignment(rows, alignment.A_FILE, alignment.B_FILE))


def test_alignment_rows_stay_short(session, monkeypatch):
    monkeypatch.setattr(alignment, "ENTRIES", 50)
    rng = random.Random(4)
    rows = [(i, prose(rng, 20)) for i in range(300)]
    docs = frame(session, rows).coalesce(1)
    stored = alignment.aligned(docs, alignment.A_FILE, alignment.B_FILE, "doc_id", "text").collect()
    own, entries = [r for r in stored if r["at"] is not None], [r for r in stored if r["at"] is None]
    assert sorted(r["doc"] for r in own) == list(range(300)) and len({r["batch"] for r in stored}) == 1
    assert all(len(r["at"]) <= r["n_links"] for r in own)
    assert len(entries) > 2 and max(len(r["pair"]) for r in entries) == 50


def test_alignment_with_counts_in_many_arrow_batches(session, monkeypatch):
    monkeypatch.setattr(alignment, "ENTRIES", 5)
    monkeypatch.setattr(alignment, "BATCH", 4000)
    rows, name = odd_texts(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = session.conf.get(name)
    session.conf.set(name, "7")
    try:
        same(aligned(frame(session, rows)), brute.alignment(rows, alignment.A_FILE, alignment.B_FILE))
    finally:
        session.conf.set(name, was)


def test_alignment_merge_holds_little_memory():
    import tracemalloc

    with open(alignment.A_FILE, "rb") as a, open(alignment.B_FILE, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    rng = random.Random(12)
    words = [prose(rng, 1) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(600)]
    assert sum(map(len, texts)) > 1.2e6
    tracemalloc.start()
    try:
        aligner.batch(texts)
        assert tracemalloc.get_traced_memory()[1] < 130e6
    finally:
        tracemalloc.stop()


def test_pair_table(session):
    rows = [(1, "one two"), (2, "one two one"), (3, "")]
    pairs = alignment.align(frame(session, rows))[1].collect()
    assert {r["n"] for r in pairs} == {2} and all(r["best"] for r in pairs)


def test_alignment_of_nothing(session):
    docs, pairs = alignment.align(frame(session, []))
    assert docs.count() == 0 and pairs.count() == 0
    assert tuples(aligned(frame(session, [(1, None)]))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_parts_join_to_the_text():
    text = "ab cd  ef\ngh " * 50 + "ij ▁kl mn"
    parts = alignment.parts_of(text, 20)
    assert len(parts) > 20 and " ".join(parts) == text


def test_fast_ids_are_those_of_the_file():
    from tokenizers import Tokenizer

    with open(alignment.A_FILE, "rb") as file:
        fast = alignment.ByteLevel(file.read())
    slow = Tokenizer.from_file(alignment.A_FILE)
    slow.encode_special_tokens = True
    for _, text in odd_texts():
        assert fast.encode(" " + (text or "")) == slow.encode(" " + (text or ""), add_special_tokens=False).ids


# ---- pipeline stages on unusual tables --------------------------------------------------------


@pytest.mark.parametrize("rows, kept", [([], 0), ([
    (None, None, None, None, None), (None, "", None, None, None), (1, "a b c", None, None, 3), (1, "a b c", None, None, 3),
    (2, None, "en", None, 0),
], None)])
def test_stages_on_empty_and_odd_tables(session, rows, kept):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = session.createDataFrame(rows, session.read.parquet(f"{sf}/documents.parquet").schema)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(session, docs, sf)
        assert set(docs.columns) <= set(out.columns)
        counts[name] = out.count()
    if kept is not None:
        assert set(counts.values()) == {kept}
    else:
        assert (counts["near_copies"], counts["decontamination"], counts["sharding"]) == (2, 5, 5)


# ---- anchors ---------------------------------------------------------------------------------


def cut(df, window=13):
    return anchors.remove_passages(df, window).select("doc", "n_words", "n_removed", F.sha2("kept", 256))


@pytest.mark.parametrize("window", [13, 5, 2, 1, 40])
def test_anchors(session, window):
    rows = corpus()
    same(cut(frame(session, rows), window), brute.passages(rows, window))


def shared(seed=6):
    """Passages at every offset, repeated inside documents, with words that are frequent everywhere."""
    rng = random.Random(seed)
    passage, ruler = prose(rng, 30).split(), ["="] * 60
    rows = []
    for i in range(60):
        own = prose(rng, rng.randint(0, 20)).split()
        low, high = sorted(rng.sample(range(31), 2))
        body = own + passage[low:high] + prose(rng, rng.randint(0, 9)).split() + passage * (i % 3) + ruler[: rng.randint(0, 60)]
        rows.append((i if i % 7 else i // 14, rng.choice([" ", "\t", "\n ", "\x0b"]).join(body)))
    return rows + [(None, " ".join(passage)), (None, "new " + " ".join(passage)), (3, " ".join(passage)), (3, " ".join(passage)), (4, None), (5, "")]


@pytest.mark.parametrize("seed", [6, 7])
def test_anchors_with_repeated_and_null_ids(session, seed):
    rows = shared(seed)
    same(cut(frame(session, rows)), brute.passages(rows))


def test_anchors_in_small_batches_and_many_buckets(session, monkeypatch):
    monkeypatch.setattr(anchors, "SETTLE", 400)
    monkeypatch.setattr(anchors, "BUCKET", 300)
    rows = shared(9)
    same(cut(frame(session, rows)), brute.passages(rows))


def test_anchor_spans_and_long_texts(session):
    rng = random.Random(2)
    passage = prose(rng, 20)
    long = prose(rng, 150_000) + " " + passage + " " + "y" * 3_000_000 + " " + prose(rng, 9)
    rows = [(1, "a b " + passage), (2, long), (3, "q " + passage + " r")]
    out = {r["doc"]: r for r in anchors.remove_passages(frame(session, rows)).collect()}
    assert [(s["start"], s["end"]) for s in out[2]["spans"]] == [(150_000, 150_020)]
    assert out[3]["kept"] == "q r" and out[1]["spans"] == [] and out[2]["n_words"] == 150_030


def test_anchors_of_nothing(session):
    assert anchors.remove_passages(frame(session, [])).count() == 0
