"""Packing against the tokenizer's library, best fit over everything at once, and the least number of sequences there can be."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import bag, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebar.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
OUT = ["doc_id", "piece", "start", "length", "ids_crc32"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_pieces(rows, length, end=2):
    library = Tokenizer.from_file(PATH)
    out = []
    for d, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        at, n = 0, (len(ids) - 1) % length + 1
        for k in range(-(-len(ids) // length)):
            out.append((d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, n = at + n, length
    return out


def sequences(got, length):
    """How many sequences there are, after each was found gapless from 0, without overlap, and no longer than length."""
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at and n >= 1
            at += n
        assert at <= length
    return len(held)


def best_fit_over_all(sizes, length):
    """Plain best fit, largest first."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(length - s)
    return len(room)


@pytest.mark.parametrize("length", [1024, 64, 7, 1])
def test_pack(docs, rows, length):
    got = packing.pack(docs, PATH, length).collect()
    expected = brute_pieces(rows, length)
    assert bag(r[:5] for r in got) == bag(expected)
    assert sequences(got, length) == best_fit_over_all([n for *_, n, _ in expected], length)


def test_a_tree_of_rounds(spark, monkeypatch):
    """Leaves of 60 pieces, nodes of three children: four levels give nearly the sequences of best fit over everything."""
    monkeypatch.setattr(packing, "LEAF", 60)
    monkeypatch.setattr(packing, "FAN", 3)
    monkeypatch.setattr(packing, "HANDED_ON", 20)
    rng = random.Random(5)
    rows = [(k, " ".join(prose(rng, rng.choice([3, 20, 60, 150, 230]))), "en", "s", 0) for k in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert bag(r[:5] for r in got) == bag(brute_pieces(rows, 1024))
    sizes = [r.length for r in got]
    n = sequences(got, 1024)
    print("sequences", n, "best fit", best_fit_over_all(sizes, 1024), "at least", -(-sum(sizes) // 1024))
    assert n <= 1.02 * best_fit_over_all(sizes, 1024) + 1
    assert len({r.sequence_id >> 57 for r in got if r.sequence_id % 2}) > 2


def test_sizes_that_hardly_fit(spark, monkeypatch):
    """All pieces over half a sequence: as many sequences as pieces, and nodes hand on no more than their limit."""
    monkeypatch.setattr(packing, "LEAF", 40)
    monkeypatch.setattr(packing, "HANDED_ON", 5)
    rows = [(k, "a b c d e f", "en", "s", 0) for k in range(500)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 8).collect()
    assert len(got) == 500 and sequences(got, 8) == 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80))
def test_best_fit(sizes):
    own = packing.best_fit(np.array(sorted(sizes, reverse=True)), 30)
    fill = Counter()
    for s, b in zip(sorted(sizes, reverse=True), own.tolist()):
        fill[b] += s
    assert max(fill.values()) <= 30 and len(fill) == best_fit_over_all(sizes, 30)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 9)), min_size=1, max_size=60), st.integers(0, 10), st.randoms())
def test_a_round_hangs_on_no_order_and_loses_nothing(items, keep, rng):
    def run(items):
        r = np.zeros(len(items), packing.RECORD)
        r["length"], r["doc_id"] = [s for s, _ in items], [d for _, d in items]
        at = [r[k : k + 1].tobytes() for k in range(len(items))]
        rows = pa.table([pa.array([17] * len(items), pa.int64()), pa.nulls(len(items), pa.int64()), pa.array(r["length"]), pa.array(at, pa.binary())], schema=packing._BINS)
        return packing.round_of(rows, 16, 1, 2, keep).to_pylist()

    out = run(items)
    members = np.concatenate([np.frombuffer(b["members"], packing.RECORD) for b in out])
    assert bag((int(r["length"]), int(r["doc_id"])) for r in members) == bag(items)
    assert all(b["fill"] == np.frombuffer(b["members"], packing.RECORD)["length"].sum() <= 16 for b in out)
    open_ = [b for b in out if b["sequence_id"] is None]
    assert len(open_) <= keep and all(b["fill"] < 15 and b["node"] == 17 // packing.FAN for b in open_)
    assert len({b["sequence_id"] for b in out} - {None}) == len(out) - len(open_)
    shuffled = list(items)
    rng.shuffle(shuffled)
    assert run(shuffled) == out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aZé中 \t\n ᠎.,'s1<|endoftext|>", max_size=60) | st.text(max_size=40))
def test_ids_are_the_library_s(text):
    library = Tokenizer.from_file(PATH)
    for t in (text, text + " " + text, " " + text, "x" + text.replace("\n", ", ")):
        assert np.frombuffer(ENCODER.ids([t, "a b", t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


ENCODER = packing.Encoder(PATH)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "GENERATION", 10_000)
    monkeypatch.setattr(packing, "TOGETHER", 7)
    e = packing.Encoder(PATH)
    rng = random.Random(1)
    library = Tokenizer.from_file(PATH)
    for _ in range(20):
        texts = [" ".join(prose(rng, 30, 10**6)) + ", é; " + "y" * 500 + "\n ok." for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [library.encode(t).ids for t in texts]
        for m in (e.known, e.after_space):
            assert len(m.now) + len(m.before) < 300 and not any(len(k) > packing.PIECE for k in m.before)


def test_cuts():
    assert packing.cut(1, 1024) == [0] and packing.cut(1024, 1024) == [0] and packing.cut(1025, 1024) == [0, 1] and packing.cut(3000, 1024) == [0, 952, 1976]


def test_packing_of_nothing_and_of_long_texts(spark, none):
    assert packing.pack(none, PATH).count() == 0
    rows = [(None, " ".join(f"v{k % 977}" for k in range(60_000)), "en", "s", 0), (2, "x" * 300_000, "en", "s", 0), (2, None, "en", "s", 0), (2, None, "en", "s", 0)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert bag(r[:5] for r in got) == bag(brute_pieces(rows, 1024))
    assert sequences(got, 1024) <= -(-sum(r.length for r in got) // 1024) + 1


def test_one_repeated_row_spreads_over_leaves(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAF", 100)
    monkeypatch.setattr(packing, "HANDED_ON", 20)
    d = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same row").alias("text"))
    got = packing.pack(d, PATH, 64).collect()
    assert len(got) == 1000 and sequences(got, 64) <= -(-sum(r.length for r in got) // 64) + 3
    assert max(Counter(r.sequence_id >> 25 for r in got).values()) < 300
