"""The filter audit against applying the filters one after another, order by order."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from llm_helpers import bag
from pyspark.sql import functions as F

from tidebar.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_failures(rows):
    """(doc_id, part, set of failed filters) of each row, from its text and the ids of equal texts."""
    ids = {}
    for d, t, *_ in rows:
        if d is not None:
            ids[t or ""] = min(d, ids.get(t or "", d))
    out = []
    for d, t, _, part, *_ in rows:
        t = t or ""
        ws = WORD.findall(t)
        failed = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > ids[t]}
        out.append((d, part or "", {f for f, x in failed.items() if x}))
    return out


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))
    judged = brute_failures(rows)
    out, removals = [], Counter()
    for part in {p for _, p, _ in judged}:
        mine = [(d, f) for d, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                removals[part, letter] += len(gone)
                fails = sum(letter in f for _, f in mine)
                out.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
    return [(*r, removals[r[0], r[1][r[2] - 1]]) for r in out]


LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, 1, 0), (3, 0, 1), (40, 1, None), (41, None, 1), (44, 1, 0), (50, 1, 1), (58, 1, 1), (63, 1, 0), (None, 1, 1), (999, 1, 1)]


def test_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").select("*", *(F.lit("x").alias(c) for c in ("good", "of", "part", "least")))
    got = filter_audit.audit(docs, labels).select(*filter_audit.OUT).collect()
    assert bag(got) == bag(brute_audit(rows, LABELS))
    assert {r.part for r in got} >= {""} and len(got) == 600 * len({r[3] or "" for r in rows})


@pytest.mark.parametrize("seed", range(2))
def test_audit_of_many_combinations(spark, seed):
    """Every set of failures occurs, in copies within and across parts, with repeated and null ids."""
    rng = random.Random(seed)
    texts = []
    for s in range(16):
        ws = [f"w{k}" for k in range(60)] if s & 2 == 0 else ["same"] * 60
        ws = ws[:20] if s & 1 else ws
        texts.append(" ".join(w.upper() if s & 4 else w for w in ws) + (" #" if s & 8 else ""))
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), "en", rng.choice(["a", "b", "", None]), 0) for _ in range(200)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = bag((d, p, "".join(sorted(f))) for d, p, f in brute_failures(rows))
    flags = filter_audit.failures(d).collect()
    assert bag((r.doc_id, r.part, "".join(f for f in "ABCDE" if r[f])) for r in flags) == judged
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(*filter_audit.OUT).collect()
    assert bag(got) == bag(brute_audit(rows, labels))


def test_shapley_shares_every_removal(spark):
    """Over all orders the filters' removals sum to 120 times the rows that fail anything."""
    rng = random.Random(3)
    rows = [("p", *(rng.random() < 0.4 for _ in range(5))) for _ in range(300)]
    d = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean, D boolean, E boolean")
    got = filter_audit.interactions(d, "ABCDE", F.col("A"), F.col("B")).where("filter_order = 'ABCDE'").collect()
    assert sum(r.shapley for r in got) == 120 * sum(any(r[1:]) for r in rows)
    assert sum(r.removed for r in got) == sum(any(r[1:]) for r in rows) and min(r.kept for r in got) == sum(not any(r[1:]) for r in rows)


def test_fewer_filters(spark):
    d = spark.createDataFrame([("p", True, False), ("p", True, True), ("q", False, False)], "part string, x boolean, y boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interactions(d, "xy", F.lit(False), F.lit(False)).collect()}
    assert got["p", "xy", 1] == (0, 2, 0, 1, 3) and got["p", "yx", 2] == (0, 1, 1, 1, 3) and got["p", "xy", 2] == (0, 0, 1, 0, 1) and got["q", "yx", 1] == (1, 0, 0, 0, 0)


def test_audit_of_nothing(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_long_texts(spark):
    rows = [(1, "w " * 500_000, "en", "s", 0), (2, "w " * 500_000, "en", "s", 0), (3, " ".join(map(str, range(200_000))), "en", "s", 0), (4, "A" * 1_000_000, "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert bag((r.doc_id, "".join(f for f in "ABCDE" if r[f])) for r in filter_audit.failures(d).collect()) == bag([(1, "B"), (2, "BE"), (3, ""), (4, "AC")])
