import hashlib
import random
from collections import Counter

import pytest
from llm_helpers import bag

from tidebar.llm import ngram_jaccard, substring_dedup, suffix_dedup
from tidebar.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().split()


# --- substring dedup


def brute_substring(rows, n=13):
    last = 1 << 63
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, last), last if d is None else d)
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (last if d is None else d):
                gone[i : i + n] = [True] * n
        yield d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()


@pytest.mark.parametrize("length, period", [(13, 7), (13, 3), (5, 3), (30, 13)])
def test_substring_dedup(docs, rows, length, period):
    got = substring_dedup.digest(substring_dedup.substring_dedup(docs, length=length, period=period, block_bytes=3000)).collect()
    assert bag(got) == bag(brute_substring(rows, length))


def test_covers_are_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.substring_dedup(none).collect() == []


# --- suffix dedup


def brute_suffix(rows, n=200):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[i : i + n] for _, b in texts for i in range(len(b) - n + 1))
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("length", [200, 144])
def test_suffix_dedup(docs, rows, length):
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, length=length, block_bytes=3000)).collect()
    assert bag(got) == bag(brute_suffix(rows, length))


def test_suffix_dedup_across_slices(spark, monkeypatch):
    """Texts longer than a slice, with repeats that lie over its edges."""
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ", k=70_000))
    b = "".join(rng.choices("abcdefgh ", k=66_000))
    rows = [(1, a + b[65_000:66_000] + a[3_000:3_450], "", "", 0), (2, b + "z" * 900, "", "", 0), (3, b[65_400:65_640], "", "", 0)]
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA))).collect()
    assert bag(got) == bag(brute_suffix(rows))


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.suffix_dedup(none).collect() == []


# --- n-gram Jaccard


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_roots(rows):
    """Of each row: its set's size, and the number of a row that stands for its component."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def brute_components(rows):
    roots = brute_roots(rows)
    least = {}
    for (d, *_), (_, r) in zip(rows, roots):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    for (d, *_), (n, r) in zip(rows, roots):
        yield d, n, least[r] if n else d


def test_jaccard_components(docs, rows):
    assert bag(ngram_jaccard.jaccard_components(docs, block_bytes=3000).collect()) == bag(brute_components(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_sets_near_the_threshold(spark, seed):
    """Chains of edits: sizes from 1 to 90 words, many pairs near 75 %, sizes over the edges of bands."""
    rng = random.Random(seed)
    rows = []
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 24, 30, 40, 64, 90):
        text = [f"t{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            rows.append((len(rows), " ".join(text), "", "", 0))
            edit = rng.random()
            if edit < 0.35 and len(text) > 1:
                del text[-rng.randint(1, max(1, len(text) // 8)) :]
            elif edit < 0.7:
                text = text + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(1, 1 + len(text) // 8))]
            else:
                text[rng.randrange(len(text))] = f"t{rng.randrange(10**6)}"
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), block_bytes=5000).collect()
    assert bag(got) == bag(brute_components(rows))


def test_keep_one(docs, rows):
    kept = ngram_jaccard.keep_one(docs, block_bytes=3000)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    comps = {}
    for (d, t, *_), (n, r) in zip(rows, brute_roots(rows)):
        comps.setdefault(r if n else (d, t), set()).add((d, t))
    assert len(got) == len(comps) and all(len(c & set(got)) == 1 for c in comps.values())
    assert all(min((x is None, x or 0) for x, _ in c) == next((d is None, d or 0) for d, t in got if (d, t) in c) for c in comps.values())


def test_jaccard_of_nothing(none):
    assert ngram_jaccard.jaccard_components(none).collect() == []
    assert ngram_jaccard.keep_one(none).collect() == []


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 95: 90, 90: 90, 200: 199, 199: 199}


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(3)
    cases = [[], [(5, 5), (None, 1)], [(i, i + 1) for i in range(60)], [(9, i) for i in range(20, 40)], [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], [(-i, i) for i in range(1, 9)] + [(3, -8)], [(i, j) for i in range(8) for j in range(i)]]
    for links in cases:
        least = {x: x for link in links if None not in link and link[0] != link[1] for x in link}
        for _ in least:  # the plainest way: hand the smaller name on until nothing changes
            for a, b in (link for link in links if link[0] in least and link[1] in least):
                least[a] = least[b] = min(least[a], least[b])
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted((r.node, r.root) for r in got) == sorted(least.items())
