"""Ranked search against scoring every document in full."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import bag, prose
from pyspark.sql import functions as F

from tidebar.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_scores(texts, items):
    """For each item the score of each text above 0."""
    each = [brute_terms(t) for t in texts]
    n_docs, total = sum(map(bool, each)), sum(map(len, each))
    counts, df = [Counter(e) for e in each], Counter()
    for c in counts:
        df.update(c.keys())
    for item in items:
        out = {}
        for k, c in enumerate(counts):
            m = 10 + 90 * len(each[k]) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(brute_terms(item)) if c[t])
            if score > 0:
                out[k] = score
        yield out


def brute_ranked(rows, items, k=10):
    out = []
    for (i, _), scores in zip(items, brute_scores([r[1] for r in rows], [t for _, t in items])):
        best = sorted(((-s, rows[d][0] is None, rows[d][0] or 0) for d, s in scores.items()))[:k]
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(best, 1)]
    return out


ITEMS = [(1, "w1 w2 w3 W300 other"), (2, None), (3, "nothing of that kind"), (4, "one two three"), (4, "Line HERE last"), (None, "w0"), (7, "é x ab ende"), (8, "w5 w5 w5, w6; w7\x00w8"), (9, ""), (1, "w1 w2 w3 W300 other")]


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("item", "block", "rank", "score", "doc_id")))


@pytest.mark.parametrize("shard_docs", [7, 8192])
def test_ranked(spark, docs, rows, shard_docs, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    got = lexical.ranked(docs, items_of(spark, ITEMS)).collect()
    assert bag(got) == bag(brute_ranked(rows, ITEMS))


def test_blocks_of_items_give_the_same(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)
    assert bag(lexical.ranked(docs, items_of(spark, ITEMS), 3).collect()) == bag(brute_ranked(rows, ITEMS, 3))


def test_of_nothing(spark, docs, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(docs, nothing).count() == 0
    assert lexical.ranked(none, items_of(spark, ITEMS)).count() == 0


def test_terms():
    for t in ("Ab-c d_e É1x\x7fy\x00z `q{r}~ sİ", "", "中 文,1.5 x", "A" * 10):
        assert [x.decode() for x in lexical.terms(t)] == brute_terms(t)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_terms_of_any_text(text):
    text = text.encode(errors="ignore").decode()
    assert [x.decode() for x in lexical.terms(text)] == brute_terms(text)


def shards_of(texts, items, size):
    """Shards as the index has them, and the statistics of all."""
    built = []
    for a in range(0, len(texts), size):
        b = lexical.Builder(items.vocabulary)
        for k, t in enumerate(texts[a : a + size], a):
            b.add(k, t)
        built.append(b.shard())
    rows = pa.Table.from_batches(built).to_pylist()
    n, total = (sum(r[c] for r in rows) for c in ("with_terms", "n_terms"))
    df = Counter()
    for r in rows:
        df.update(dict(zip(r["term"], r["df"])))
    return [lexical.Shard(r, n, total) for r in rows], np.array([lexical.weight(n, df[t]) for t in range(len(items.vocabulary))], np.int64)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([1, 3, 9, 40]), st.integers(2, 60))
def test_maxscore_finds_the_best_in_any_shards(seed, k, size, vocabulary):
    rng = random.Random(seed)
    texts = [" ".join(prose(rng, rng.choice([0, 1, 5, 40]), vocabulary)) for _ in range(40)]
    asked = [" ".join(prose(rng, rng.randint(1, 12), vocabulary)) for _ in range(4)]
    items = lexical.Items.of(list(enumerate(asked)))
    shards, weights = shards_of(texts, items, size)
    for wanted, scores in zip(items.terms, brute_scores(texts, asked)):
        best = lexical.Best(k)
        for s in shards:
            places, found = lexical.maxscore(s, wanted, weights, k, best.least())
            assert all(scores[int(d)] == x for d, x in zip(s.ids[places], found))
            best.add(found, s.ids[places], s.nulls[places])
        assert [(-a, d) for a, _, d in best.rows.tolist()] == sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_common_terms_are_not_read_through_once_rare_ones_have_set_the_threshold():
    """After a first shard with good matches, a shard without them is left after a look at its bounds, and in one with
    few, only candidates are probed."""
    rng = random.Random(2)
    good = [f"rare unusual common {k}" for k in range(30)]
    plain = ["common " * rng.randint(1, 3) + f"filler {k}" for k in range(400)]
    items = lexical.Items.of([(0, "common rare unusual")])
    shards, weights = shards_of(good + plain + ["rare common filler"] + plain[:99], items, 100)
    best = lexical.Best(10)
    best.add(*(lambda p, s: (s, shards[0].ids[p], shards[0].nulls[p]))(*lexical.maxscore(shards[0], items.terms[0], weights, 10, 1)))
    assert all(len(lexical.maxscore(s, items.terms[0], weights, 10, best.least())[0]) == 0 for s in shards[1:])
    assert not any(s.scores.any() for s in shards[1:4])  # nothing but bounds was looked at


def test_long_texts(spark):
    big = " ".join(f"v{k % 997}" for k in range(200_000))
    rows = [(1, big, "en", "s", 0), (2, big + " needle", "en", "s", 0), (3, "x" * 500_000, "en", "s", 0), (None, "needle", "en", "s", 0)]
    items = [(1, "needle v5"), (2, "x" * 500_000), (3, "v1 v2 v3")]
    assert bag(lexical.ranked(spark.createDataFrame(rows, SCHEMA), items_of(spark, items)).collect()) == bag(brute_ranked(rows, items))


def test_items_of_string_ids(spark, docs, rows):
    items = [("a", "w1 w2"), ("b", "one two")]
    got = lexical.ranked(docs, spark.createDataFrame(items, "item_id string, text string"), 2).collect()
    assert bag(got) == bag(brute_ranked(rows, items, 2))
