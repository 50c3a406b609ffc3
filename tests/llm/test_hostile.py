"""Odd inputs for every operator and stage: null and repeated ids and rows, very long texts, clashing names on every table,
empty tables; and how much the exchanges carry as inputs grow."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import CLASH, bag, prose
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_substring, brute_suffix
from test_text import brute_leaks, brute_statistics

import corpus_pipeline
from tidebar.llm import chat, decontaminate, mixing, ngram_jaccard, packed, quality_model, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts
from tidebar.llm.packed import Elements

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_rows():
    """Texts of up to a million characters, one of them twice, with and without spaces."""
    rng = random.Random(4)
    a = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))
    return [(1, a, "en", "s", 0), (2, a + " tail", "en", "s", 0), (3, "x" * 300_000, "en", None, 0), (None, "short one", "en", "s", 0), (None, "short one", "en", "s", 0)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, SCHEMA)


def test_long_texts_in_dedup(long_docs, long_rows):
    assert bag(substring_dedup.digest(substring_dedup.substring_dedup(long_docs)).collect()) == bag(brute_substring(long_rows))
    assert bag(ngram_jaccard.jaccard_components(long_docs).collect()) == bag(brute_components(long_rows))
    some = long_docs.where("doc_id <> 3 or doc_id is null")
    assert bag(suffix_dedup.digest(suffix_dedup.suffix_dedup(some)).collect()) == bag(brute_suffix([r for r in long_rows if r[0] != 3]))


def test_long_texts_elsewhere(spark, long_docs, long_rows):
    import public_tokenizers

    assert bag(quality_rules.statistics(long_docs).select("doc_id", *quality_rules.BASE, "base_failed").collect()) == bag((d, *brute_statistics(t)) for d, t, *_ in long_rows)
    counts = token_counts.token_counts(long_docs.where("doc_id <> 3"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert all(r.n_bytes == len(long_rows[r.doc_id - 1][1]) and r.over_limit for r in counts)
    words = long_rows[0][1].split()
    items = [(1, " ".join(words[500:540])), (2, " ".join(words[-30:]))]
    found = decontaminate.leaks(long_docs, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "start_word").collect()
    assert bag(found) == bag([(d, i, s) for d in (1, 2) for i, s in ((1, 500), (2, len(words) - 30))])
    assert mixing.mix_plan(long_docs).count() == len(long_rows) and sharding.shard(long_docs, 3).count() == len(long_rows)
    model = quality_model.fit(long_docs, spark.createDataFrame([(1, 2), (3, 0)], "doc_id long, grade int"), bits=8)
    assert quality_model.score(long_docs, model, 1).count() == len(long_rows)


def test_long_messages_and_conversations(spark):
    big = "word " * 100_000
    log = [(1, 0, 0, "message", "user", big)] + [(1, 1, k, "message" if k == 0 else "delta", "assistant", f"{k},") for k in range(3000)] + [(2, k, k, "message", "user", str(k)) for k in range(5000)]
    strangers = [F.lit("x").alias(c) for c in (*CLASH, "at", "version", "last", "first_role")]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string").select("*", *strangers)
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(events)).collect()}
    said = "".join(f"{k}," for k in range(3000))
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said) and got[2].n_turns == 5000
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{big}\nassistant\n{said}\n".encode()).hexdigest()


def test_clashing_names_on_the_other_tables(spark, docs, rows):
    more = [F.lit("x").alias(c) for c in (*(c for c in CLASH if c not in ("item_id",)), "doc_id", "iw", "n", "ish", "ifp", "pos", "fp", "k", "v")]
    bench = spark.createDataFrame([(1, " ".join(prose(random.Random(1), 30))), (None, rows[3][1]), (3, None)], "item_id long, text string").select("*", *more)
    found = decontaminate.leaks(docs, bench).where("item_id is null").select("doc_id").collect()
    assert {3} <= {r.doc_id for r in found}
    names = [F.lit("x").alias(c) for c in (*(c for c in CLASH if c not in ("grade", "_label", "_id")), "text", "id", "label", "_doc", "_hash", "_bytes")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int").select("*", *names)
    assert isinstance(quality_rules.fit(docs, labels), list)
    assert quality_model.fit(docs, labels.withColumn("grade", F.col("quality")), bits=8).bits == 8


def test_leaks_of_null_and_repeated_ids(spark, rows):
    item = prose(random.Random(8), 40, 10**6)
    extra = [(None, " ".join(["a"] * 9 + item), "en", "s", 0), (None, " ".join(item), "en", "s", 0), (3, " ".join(item + ["b"] * 9), "en", "s", 0), (3, " ".join(item + ["b"] * 9), "en", "s", 0)]
    mine = rows[40:60] + extra
    d, bench = spark.createDataFrame(mine, SCHEMA), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    expected = {(i, t, x) for i, t, *_ in mine for _, x, _ in brute_leaks([(i, t)], [(5, " ".join(item))])}
    got = decontaminate.leaks(d, bench).collect()
    assert len(got) == len(expected) == 3
    assert decontaminate.clean(d, bench).count() == len(mine) - 4


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_odd_and_no_rows(spark, tmp_path, docs, none, name):
    """Null ids and texts, repeated rows and ids, strangers' names; then no rows at all."""
    for table, schema, data in (("labels", "doc_id long, quality int, toxic int", [(k, k % 2, 0) for k in range(30)]), ("benchmark", "item_id long, text string", [(1, None), (2, "one two three four five six")])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    out = STAGES[name](spark, docs, str(tmp_path))
    before, after = docs.count(), out.collect()
    if name != "sharding":
        assert out.columns == docs.columns
    assert len(after) == before if name == "sharding" else 0 < len(after) <= 2 * before
    assert STAGES[name](spark, none, str(tmp_path)).collect() == []


def test_one_repeated_row_is_spread(spark):
    """Rows equal in id and text, the most part of a table, do not meet in one block."""
    rows = [(7, "the same text again " * 20, "en", "s", 0)] * 4000 + [(k, f"other {k} " * 30, "en", "s", 0) for k in range(400)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(16)
    layout = packed.deal(d, "doc_id", "text", 20_000, 0.1)
    most = layout.docs.groupBy("block").count().agg(F.max("count")).first()[0]
    assert most < 1000
    assert bag(substring_dedup.digest(substring_dedup.substring_dedup(d, block_bytes=20_000)).collect()) == bag(brute_substring(rows))


def test_messages_grow_as_the_input_does():
    """Blocks times buckets at 1, 4 and 16 times an input: linear, not squared (the buckets' number is a power of two)."""
    count = []
    for times in (1, 4, 16):
        blocks, bits = packed.sizes(packed.GROW_FROM * times, 4 << 20, 0.1, 1 << 19)
        count.append(blocks << bits)
    assert count[1] <= 2 * 4 * count[0] and count[2] <= 2 * 16 * count[0] < 16**2 * count[0]


def test_messages_and_answers_keep_their_order():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    extra = [rng.integers(-5, 5, len(key)), rng.integers(0, 255, len(key)).astype(np.uint8)]
    rows = packed._messages(4, Elements(key, extra), 5, 8)
    got, (a, b), sizes = packed.unpack(rows, 8, ["i8", "u1"])
    assert (got == key).all() and (a == extra[0]).all() and (b == extra[1]).all() and len(sizes) == 32 == rows.num_rows
    assert packed.unpack(rows.slice(3, 2), 8, ["i8", "u1"])[0].tolist() == key[sizes[:3].sum() : sizes[:5].sum()].tolist()
    empty = packed._messages(4, Elements(key[:0], [x[:0] for x in extra]), 5, 8)
    assert empty.num_rows == 0 and len(packed.unpack(empty, 8, ["i8", "u1"])[0]) == 0
    same = np.repeat(key[:9], 3)
    assert (same[packed.order_of(same[::-1])[::-1]] <= same.max()).all() and (np.diff(key[::-1][packed.order_of(key[::-1].copy())].astype(float)) >= 0).all()


def test_a_boilerplate_of_thousands_makes_no_pairs(spark):
    """3,000 texts that share a passage, none alike, and a few chains of copies among them; groups cut into many tiles."""
    rng = random.Random(6)
    passage = " ".join(prose(rng, 60, 10**6))
    rows = [(k, f"{passage} {' '.join(f'u{k}x{j}' for j in range(30))}", "en", "s", 0) for k in range(3000)]
    for k in range(3000, 3040):
        rows.append((k, rows[k - 3000][1] + f" end{k}", "en", "s", 0))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: k if k < 3000 else k - 3000 for k in range(3040)}


def near_threshold(percent, n, words=220):
    """n texts of which any two share about percent of their shingles' union: a common part, and an own part."""
    shared = round(words * 2 * percent / (100 + percent))
    head = [f"c{k}" for k in range(shared + 4)]
    return [" ".join(head + [f"o{d}_{k}" for k in range(words - shared)]) for d in range(n)]


@pytest.mark.parametrize("percent, linked", [(73, False), (74, False), (74.5, False), (76, True)])
def test_groups_near_the_threshold_make_no_pairs(spark, monkeypatch, percent, linked):
    """300 documents in five tiles, any two just below or above the threshold: every stage gives out rows as many as there
    are members in tile pairs at most, and links are a forest."""
    monkeypatch.setattr(ngram_jaccard, "TILE", 64)
    seen = {}
    for name in ("_closest", "_partnered", "_spanning"):
        plain = getattr(ngram_jaccard, name)

        def counted(*options, name=name, plain=plain):
            total = seen.setdefault(name, spark.sparkContext.accumulator(0))
            inner = plain(*options)

            def run(batches):
                for b in inner(batches):
                    total.add(b.num_rows)
                    yield b

            return run

        monkeypatch.setattr(ngram_jaccard, name, counted)
    tiled, plain_tiled = [], ngram_jaccard._tiled
    monkeypatch.setattr(ngram_jaccard, "_tiled", lambda members: tiled.append(plain_tiled(members)) or tiled[-1])
    d = spark.createDataFrame([(k, t) for k, t in enumerate(near_threshold(percent, 300))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(d).collect()}
    assert got == {k: 0 if linked else k for k in range(300)}
    members = tiled[0].count()
    assert seen["_partnered"].value <= members and seen["_closest"].value <= members and seen["_spanning"].value <= (members if linked else 0)
    if not linked:
        assert tiled[0].select("p", "q").distinct().count() >= 10  # five tiles


def test_tiles_find_what_one_task_finds(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 3)
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", 0)
    assert bag(ngram_jaccard.jaccard_components(docs, block_bytes=3000).collect()) == bag(brute_components(rows))
