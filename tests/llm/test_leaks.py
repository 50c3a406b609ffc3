"""Benchmark items that stand in a text with blocks moved or ends edited, against every window."""

import random

from llm_helpers import bag
from test_text import SCHEMA, brute_leaks

from tidebar.llm import decontaminate


def leaks_and_brute(spark, texts, items):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.leaks(docs, bench).collect()]
    return got, list(brute_leaks(rows, items))


def test_moved_blocks_and_edited_ends(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    item = [fresh(n) for n in (60, 59, 30, 45)]
    lead, tail = fresh(100), fresh(30)
    texts = [lead + item[0][48:] + item[0][:48] + tail]
    texts += [lead[:k] + w[-c:] + w[:-c] + tail for k, w in enumerate(item) for c in (5, 9)]
    texts += [lead + w[1:20] + fresh(c) + w[20:-1] + tail for w in item for c in (0, 1, 2)]
    texts += [lead + item[2] + fresh(9) + item[2] + tail, item[3][40:] + item[3][:40], lead + item[1][50:] + item[1][:50]]
    texts = [" ".join(t) for t in texts]
    got, expected = leaks_and_brute(spark, texts + texts[:1], [(k, " ".join(w)) for k, w in enumerate(item)])
    assert bag(got) == bag(expected) and any(d == 0 for d, *_ in got)


def test_texts_that_begin_or_end_within_an_item(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    item = [fresh(n) for n in (60, 40, 17)]
    texts = [" ".join(t) for w in item for k in (2, len(w) // 6, len(w) // 3) for t in (w[k:] + fresh(50), fresh(50) + w[:-k], w[k:], w[:-k], w[k:-2] + fresh(9))]
    got, expected = leaks_and_brute(spark, texts, [(k, " ".join(w)) for k, w in enumerate(item)])
    assert bag(got) == bag(expected)
    assert {(0, 0), (1, 0), (5, 0), (6, 0)} <= {(d, i) for d, i, _ in got}  # both ends alike, by up to ten words of sixty


def test_items_shorter_than_a_shingle(spark):
    texts = ["a b c d e f g h", "x A  b", "b c d e", "h g f e d", "q", "a", "z z z z z z a b c", "", None]
    got, expected = leaks_and_brute(spark, texts, [(1, "a"), (2, "c D"), (3, "a b c"), (4, "b c d e"), (5, "z z z z"), (6, "d e f g h"), (7, "")])
    assert bag(got) == bag(expected) and (0, 3, 1.0) in got


def test_long_items_at_the_threshold(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    items = [fresh(90 + k % 40) for k in range(120)]
    cut = lambda w: (len(w) - 4) // 7  # noqa: E731  # that many words fewer leave 0.75 or little more
    texts = [" ".join(w[: -cut(w)] + fresh(cut(w))) for w in items]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert bag((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == bag((k, k) for k in range(120))
