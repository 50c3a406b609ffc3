import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, same_rows
from hypothesis import given
from hypothesis import strategies as st
from llm_helpers import bag

import corpus_pipeline
from tidebar.llm import chat, decontaminate, mixing, quality_model, quality_rules, sharding, token_counts
from tidebar.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


# --- chat


@given(st.text(alphabet="\\<>/sINT[]01 é\n", max_size=40) | st.sampled_from(["</s>[INST] ok [/INST]", "<<SYS>>", "<</s>s>", "\\</s>"]), st.text(alphabet="user</s>[INST]\\ ", max_size=12))
def test_a_turn_can_be_read_back(text, role):
    turn, lo, hi = chat.render(role, text)
    assert chat.parse(turn) == (role, text)
    assert chat.unescape(turn[lo:hi]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "Hel"), (1, 1, 4, "delta", None, "lo"),
        (1, 2, 5, "message", "user", "edit me"), (1, 2, 6, "edit", None, "edited"), (1, 3, 7, "message", "assistant", "bad"), (1, 3, 8, "regenerate", None, "ignored"), (1, 3, 9, "delta", None, "good"),
        (1, 4, 10, "message", "user", "gone"), (1, 4, 11, "delete", None, None), (None, 0, 1, None, None, None), (2, None, 1, "message", "user", "x"), (2, None, 2, "message", "user", "y"),
    ]
    e = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = [tuple(r) for r in chat.final_messages(e).orderBy("conv_id", "message", "part").collect()]
    assert got == [(None, 0, 1, "", ""), (1, 0, 1, "user", "hi"), (1, 1, 1, "assistant", "Hello"), (1, 2, 1, "user", "edited"), (1, 3, 1, "assistant", "good"), (2, None, 1, "user", "x"), (2, None, 2, "user", "y")]
    d = {r.conv_id: r for r in chat.digest(chat.format_chat(e)).collect()}
    assert d[1].loss_chars == 9 and d[1].loss_sha256 == hashlib.sha256(b"Hellogood").hexdigest() and d[None].n_turns == 1
    assert chat.digest(chat.format_chat(e.limit(0))).collect() == []


# --- tokens


def test_token_counts(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    expected = [(d, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in rows]
    assert bag(token_counts.token_counts(docs, path).collect()) == bag(expected)


def test_cuts_never_change_a_count():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, counter = Tokenizer.from_file(path), token_counts.Counter(path, "tokenizers")
    rng = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t ", "'s", "'ll", ",", "!", "12", "<|endoftext|>", "日本", "\u0301", "😀", "\x85", "\x1c", "\u180e", "\u200b", "½", ". ", "|"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(3000)]
    assert counter.count(texts) == [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def test_sentencepiece_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs.where("doc_id < 20"), path, "sentencepiece").collect()
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 20 and doc_id <> 3").collect()}
    assert all(len(model.encode(texts[r.doc_id])) == r.n_tokens for r in got if r.doc_id != 3)


def test_a_tokenizer_without_boundaries_counts_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models

    path = f"{tmp_path}/plain.json"
    Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4}, merges=[("a", " "), ("a ", "b")])).save(path)
    assert not token_counts.cuttable(path) and token_counts.Counter(path, "tokenizers").count(["a b", "", "a"]) == [1, 0, 1]


@pytest.mark.parametrize("token", [{"content": "<|end of turn|>"}, {"content": "end."}, {"content": "<e>", "lstrip": True}, {"content": "<e>", "rstrip": True}, {"content": "ab", "single_word": True}, {"content": "<e>"}])
def test_added_tokens_are_never_cut(tmp_path, token):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    model = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    flags = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized", "special"), False)
    model["added_tokens"].append({"id": 50257, **flags, **token})
    path = tmp_path / "added.json"
    path.write_text(json.dumps(model))
    library = Tokenizer.from_file(str(path))
    t = token["content"]
    texts = [f"say {t} and go", f"say{t}and", f"{t}", f"a  {t}  b", f"x {t}, y ab ab. c"]
    assert token_counts.Counter(str(path), "tokenizers").count(texts) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
    assert token_counts.cuttable(str(path)) == (token == {"content": "<e>"})


def test_batches_are_balanced_by_bytes_and_long_pieces_forgotten():
    import public_tokenizers

    parts = list(token_counts.batches(["é" * 30] * 10 + ["x" * 500] + ["a"] * 5, 130))
    assert [sum(map(token_counts.n_bytes, p)) for p in parts] == [120] * 5 + [500, 5]
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), "tokenizers")
    long = "日本" * 400
    n = counter.count([long, "short text", long])
    assert n[0] == n[2] == len(__import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(long).ids) and long not in counter.known and counter.held < 1000


def test_token_counts_of_nothing(none):
    import public_tokenizers

    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


# --- quality rules


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)


def test_statistics(docs, rows):
    got = quality_rules.statistics(docs).select("doc_id", *quality_rules.BASE, "base_failed").collect()
    assert bag(got) == bag((d, *brute_statistics(t)) for d, t, *_ in rows)


def test_rules_are_learned_and_applied_alike(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = {f: rng.random(n) for f in quality_rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) | ((x["upper_share"] > 0.6) & (x["word_length"] <= 0.5))
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality_rules._covered(x, r.conditions)
    assert (hit == bad).mean() > 0.95 and rules == quality_rules.learn(x, bad)


def test_rules_keep_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    rules = quality_rules.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = quality_rules.judged(docs, rules).where("not base_failed").join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert rules and held[held.quality == 1].kept.mean() > 0.97 and (~held[held.quality == 0].kept).mean() > 0.8


def test_kept_is_what_the_rules_say(spark):
    """The verdict recomputed in Python from each document's statistics and the learned conditions."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    rules = quality_rules.fit(spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), labels)
    got = quality_rules.judged(docs, rules).collect()
    over = lambda a, b: a / b if b else 0.0
    assert rules
    for r in got:
        x = {
            "symbols_per_word": over(r.n_symbols, r.n_words), "dup_line_share": over(r.n_dup_lines, r.n_lines), "repeat_share": over(r.n_repeat_words, r.n_words), "word_length": over(r.word_chars, r.n_words),
            "upper_share": over(r.n_upper, r.word_chars), "marks_per_word": over(r.n_marks, r.n_words), "words": float(r.n_words),
        }
        hit = any(all(x[f] > c if op == ">" else x[f] <= c for f, op, c in rule.conditions) for rule in rules)
        assert r.kept == (not r.base_failed and not hit)
    assert {r.kept for r in got} == {True, False}


def test_labelled_documents_are_bounded(spark, docs):
    from tidebar.llm.common import labelled

    many = spark.createDataFrame([(k % 3, f"text {k}", "en", "s", 0) for k in range(3000)] + [(1, "text 1", "en", "s", 0)] * 50, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (None, 1), (0, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    pick = lambda **k: labelled(many, labels, F.col("quality"), "doc_id", "text", **k).collect()
    whole = pick(max_labels=10**6, max_bytes=1 << 30)
    assert len(whole) == 2000 and {(r.id, r.label) for r in whole} == {(1, 1), (2, 0)}
    assert len(pick(max_labels=20, max_bytes=1 << 30)) == 20 and sum(len(r.text) for r in pick(max_labels=10**6, max_bytes=500)) in range(480, 501)


def test_rules_without_labels(docs, none, spark):
    rules = quality_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules == [] and quality_rules.judged(docs, rules).where("kept = base_failed").count() == 0
    assert quality_rules.judged(none, rules).collect() == []


# --- quality model


def test_model_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.1/labels.parquet")
    rated = labels.selectExpr("doc_id", "quality", "toxic", "quality + 1 - toxic as grade")
    model = quality_model.fit(docs, rated.where("doc_id % 5 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = quality_model.score(docs, model, 2).join(rated.where("doc_id % 5 = 0"), "doc_id").toPandas()
    assert held[(held.quality == 1) & (held.toxic == 0)].kept.mean() > 0.95
    assert (~held[held.toxic == 1].kept).mean() > 0.75
    assert held.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_model_of_odd_rows(docs, none, rows, spark):
    model = quality_model.fit(docs, docs.selectExpr("doc_id", "cast(pmod(doc_id, 3) as int) as grade"))
    got = quality_model.score(docs, model, 1)
    assert got.count() == len(rows) and got.where("tail_probability is null").count() == 0
    assert quality_model.score(none, model, 1).collect() == []
    empty = quality_model.train([], [], 3, 4)
    assert len(empty.thresholds) == 2


def test_model_without_ratings_and_with_bad_grades(docs, rows, none, spark):
    nothing = spark.createDataFrame([], "doc_id long, grade int")
    assert quality_model.fit(none, nothing).thresholds == quality_model.fit(docs, nothing).thresholds
    got = quality_model.score(docs, quality_model.fit(docs, nothing), 2)
    assert got.count() == len(rows) and got.select("expected_grade").distinct().count() == 1
    bad = spark.createDataFrame([(k, g) for k, g in zip(range(40), [0, 1, 2, 3, -1, 99, None, 1] * 5)], "doc_id long, grade int, quality int".replace(", quality int", ""))
    good = bad.where("grade between 0 and 2")
    assert quality_model.fit(docs, bad, bits=8) == quality_model.fit(docs, good, bits=8)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    n, size = 40, 12
    doc = np.repeat(np.arange(n), 4)
    flat, y = rng.integers(0, size, 4 * n), rng.integers(0, 4, n)
    w, par = rng.normal(size=size), np.array([-0.5, 0.2, -0.3])
    _, g_w, g_par = quality_model.gradient(w, par, flat, doc, y, 0.01)
    e = 1e-6
    for k in range(size):
        d = np.eye(size)[k] * e
        slope = (quality_model.gradient(w + d, par, flat, doc, y, 0.01)[0] - quality_model.gradient(w - d, par, flat, doc, y, 0.01)[0]) / (2 * e)
        assert slope == pytest.approx(g_w[k], abs=1e-6)
    for k in range(3):
        d = np.eye(3)[k] * e
        slope = (quality_model.gradient(w, par + d, flat, doc, y, 0.01)[0] - quality_model.gradient(w, par - d, flat, doc, y, 0.01)[0]) / (2 * e)
        assert slope == pytest.approx(g_par[k], abs=1e-6)


def test_scores_from_weights_by_hand(docs, rows, spark):
    """Scores recomputed word by word, without the operator's features."""
    import math

    import xxhash

    bits = 10
    ratings = spark.createDataFrame([(k, k % 3) for k in range(40)], "doc_id long, grade int")
    model = quality_model.fit(docs, ratings, bits=bits)
    model = quality_model.Model(bits, np.random.default_rng(1).normal(size=(1 << bits) + 44).astype("<f4").tobytes(), model.thresholds)
    weights = np.frombuffer(model.weights, "<f4").astype(float)
    place = lambda text: xxhash.xxh3_64_intdigest(text) & ((1 << bits) - 1)

    def by_hand(t):
        words, hot, shapes = (t or "").encode().split(), set(), [0, 0, 0, 0]
        for w in words:
            core = w.strip(b".,;:!?'\"()[]{}-")
            low = core.decode().lower()
            hot |= {place(low)} | {place(f"{low[:n]}\0{n}" if len(low) > n else low) for n in (4, 6)}
            for k, yes in enumerate((any(c in b"#*$%&|<>" for c in w), len(core) > 1 and core.isupper(), any(c in b"0123456789" for c in w), w.endswith(b"!"))):
                shapes[k] += yes
        s = sum(weights[k] for k in hot) + sum(weights[(1 << bits) + 11 * k + (math.ceil(10 * c / len(words)) if words else 0)] for k, c in enumerate(shapes))
        tail = [1 / (1 + math.exp(-min(max(s - x, -30), 30))) for x in model.thresholds]
        return round(sum(tail), 6), round(tail[1], 6), tail[1] >= 0.5

    got = quality_model.score(docs, model, 2).collect()
    assert bag((r.doc_id, round(r.expected_grade, 6), round(r.tail_probability, 6), r.kept) for r in got) == bag((d, *by_hand(t)) for d, t, *_ in rows)


# --- mixing


def test_mix(spark, docs, rows):
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == len(rows)
    assert bag((None if i != i else int(i), n) for i, n in zip(plan.doc_id, plan["size"])) == bag((d, len(WORD.findall(t or ""))) for d, t, *_ in rows)
    by = plan.groupby("source", dropna=False).agg(size=("size", "sum"), known=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.known).all() and (by.target <= 2 * by.known + 1e-9).all()
    assert by.target.sum() == pytest.approx(1.5 * plan["size"].sum())
    assert (plan.taken <= 2 * plan["size"]).all()
    assert ((by.taken - by.target).abs() <= 2 * plan.groupby("source", dropna=False)["size"].max()).all()
    again = mixing.mix_plan(docs).toPandas()
    key = ["doc_id", "text_hash", "source", "copies"]
    assert sorted(map(str, plan[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == plan.copies.sum()
    assert out.selectExpr("sum(size(regexp_extract_all(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)))").first()[0] == plan.taken.sum()


def test_targets_by_repeated_dealing(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"s{k}": rng.randint(0, 1000) for k in range(rng.randint(1, 9))} | {None: 50}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        target, open_ = {}, set(names)
        while True:
            left = 1.5 * sum(sizes.values()) - sum(target.values())
            level = left / sum(weight[s] for s in open_) if open_ else 0
            over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
            if not over:
                target |= {s: level * weight[s] for s in open_}
                break
            target |= {s: 2.0 * sizes[s] for s in over}
            open_ -= over
        assert got == pytest.approx(target)


def test_mix_of_nothing(none):
    assert mixing.mix_plan(none).collect() == [] and mixing.mix(none).collect() == []


# --- sharding


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards(docs, rows, n):
    out = sharding.shard(docs, n).toPandas()
    assert bag(out[["doc_id", "size", "text_crc32"]].astype(object).where(out[["doc_id", "size", "text_crc32"]].notna(), None).values.tolist()) == bag((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    total, biggest = out["size"].sum(), out["size"].max()
    by = out.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "size"), lo=("slot", "min"), hi=("slot", "max"), slots=("slot", "nunique"))
    assert ((by.bytes - total / n).abs() <= biggest + n).all() and by.index.max() < n
    assert (by.lo == 0).all() and (by.hi == by.n - 1).all() and (by.slots == by.n).all()


@pytest.mark.parametrize("n", [3, 40])
def test_shards_by_hand(docs, rows, n):
    """Every row's place: by MD5 and id, cut at equal sums of bytes; a small group of equal texts goes by its own middle."""
    texts = sorted(((hashlib.md5((t or "").encode()).digest(), -1 if d is None else d, len((t or "").encode()) + 16, d) for d, t, *_ in rows))
    cut = (2 * sum(x[2] for x in texts) + n - 1) // n
    placed, upto, spans = [], 0, {}
    for k, _, size, _ in texts:
        lo, _ = spans.get(k, (upto, 0))
        upto += size
        spans[k] = lo, upto
    upto = 0
    for k, _, size, d in texts:
        upto += size
        lo, hi = spans[k]
        own = (2 * upto - size) // cut
        placed.append((d, size, (lo + hi) // cut if 2 * lo // cut < (2 * hi - 1) // cut and 2 * (hi - lo) <= sharding.WHOLE * cut else own))
    seen, expected = Counter(), []
    for d, size, s in placed:
        expected.append((d, size, s, seen[s]))
        seen[s] += 1
    assert bag(sharding.shard(docs, n).select("doc_id", "size", "shard", "slot").collect()) == bag(expected)


def test_a_small_group_of_equal_texts_is_never_parted(spark):
    rows = [(k, f"text {k // 3} " + "x" * 40, "en", "s", 0) for k in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), 8).toPandas()
    assert (out.groupby(out.doc_id // 3)["shard"].nunique() == 1).all()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.1 * sizes.min()


def test_shards_of_nothing(none):
    assert sharding.shard(none, 4).collect() == []


# --- decontamination


def brute_leaks(rows, items):
    low = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    for d, t, *_ in rows:
        w = low(t)
        for i, u in items:
            v = low(u)
            best = 0.0
            for s in range(1 - len(v), len(w)) if v and w else ():
                a, b = grams(w[max(s, 0) : s + len(v)]), grams(v)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.75:
                yield d, i, round(best, 9)


def test_leaks_against_every_window(spark, rows):
    rng = random.Random(9)
    item = [[f"q{rng.randrange(500)}" for _ in range(n)] for n in (30, 45, 14, 3, 60)]
    some = [
        " ".join(["lead"] * 5 + item[0] + ["tail"] * 9), " ".join(item[0]).upper(), " ".join(item[1][3:]), " ".join(["x"] * 40 + item[1][:41]), " ".join(item[1][:25]), " ".join(item[2]), " ".join(item[3]),
        " ".join(item[4][:30] + ["new"] + item[4][31:]), " ".join(item[4][:20] + ["new"] + item[4][21:40] + ["new"] + item[4][41:]), None, "",
    ]
    mine = rows[:20] + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(some)]
    items = [(k, " ".join(w)) for k, w in enumerate(item)] + [(9, None), (10, "")]
    docs, bench = spark.createDataFrame(mine, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.leaks(docs, bench).collect()]
    assert bag(got) == bag(brute_leaks(mine, items)) and len(got) >= 6
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(mine) - len({d for d, *_ in got})
    wide = decontaminate.leaks(docs, bench.limit(0))
    assert wide.collect() == [] and decontaminate.clean(docs, bench.limit(0)).count() == len(mine)


def test_leaks_without_broadcast_are_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    one = bag(decontaminate.leaks(d, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    assert bag(decontaminate.leaks(d, bench).collect()) == one
    assert decontaminate.clean(docs, bench).columns == docs.columns


# --- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    from test_dedup import brute_components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        ids = Counter(r[0] for r in rows)
        if k < 4:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(tuple(r) in set(before) for r in rows)
        if name == "quality_rules":
            assert not any(brute_statistics(r.text)[-1] for r in rows) and len(rows) > len(before) / 2
        elif name == "ngram_jaccard":
            assert ids.keys() == {c for *_, c in brute_components(before)}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            assert ids.keys() == {r[0] for r in before} - {d for d, *_ in brute_leaks(before, items)}
        elif name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
            assert ids == Counter({d: c for d, c in plan.items() if c})
        else:
            assert ids == Counter(r[0] for r in before)
        docs = after


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
