"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import durable, words

#: Fingerprints of 64 bits are compared within this radius: one of eight blocks of 8 bits then differs in 2 bits at most.
RADIUS, BLOCKS, BLOCK_BITS = 23, 8, 8
#: Benchmarks of up to so many words are broadcast to the documents' scan; a larger one is joined by shuffling.
BROADCAST_WORDS = 1_000_000


def lowered(text: Column) -> Column:
    """A-Z only, so that results do not hang on a locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(w: Column, size: int) -> Column:
    """Hashes of all shingles of an array of words' hashes in order; fewer words are one shingle, none have none."""
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    parts = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)), F.lit(0)))
    return F.when(F.size(w) >= size, parts).otherwise(whole)


def hashed(w: Column) -> Column:
    """Words' hashes: a word is hashed once, and its shingles from there."""
    return F.transform(w, lambda x: F.xxhash64(x))


def short_windows(w: Column, n: int) -> Column:
    """Place and hash of every window of n words, fewer than a shingle: hashed like an item of n words."""
    at = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(w, i + 1, n)).alias("h")))
    return F.when(F.size(w) >= n, at).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def fingerprints(df: DataFrame, keys: list[str], w: str, name: str) -> DataFrame:
    """keys (of one row each) and the 64-bit SimHash of the word array w: a bit is the majority of that bit in the words'
    hashes. Words are counted by an aggregate, two bits to a sum, which Spark begins where the rows are."""
    h = F.xxhash64("_w")
    sums = [F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"_{b}") for b in range(32)]
    counted = df.select(*keys, F.explode(w).alias("_w")).groupBy(*keys).agg(F.count("*").alias("_n"), *sums)
    most = lambda count, b: F.when(2 * count > F.col("_n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))
    bits = F.lit(0).cast("long")
    for b in range(32):
        bits = bits + most(F.col(f"_{b}").bitwiseAND(F.lit((1 << 32) - 1)), b) + most(F.shiftrightunsigned(F.col(f"_{b}"), 32), b + 32)
    # coalesced, as a value that may be null gets a test for null in every join below, each with the whole expression
    return counted.select(*keys, F.coalesce(bits, F.lit(0).cast("long")).alias(name))


def _block(fp: str, k: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")


def with_numbered(df: DataFrame, a: str, name: str) -> DataFrame:
    """df with a hash for each element of the array a, of the element and the number of equal ones before it: sets of these
    count every copy, and are compared by hashing."""
    x = F.col("_sorted")
    return df.withColumn("_sorted", F.sort_array(a)).withColumn(name, F.transform(x, lambda v, k: F.xxhash64(v, (k + 1).cast("long") - F.array_position(x, v)))).drop("_sorted")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, similarity: float = 0.75) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity and text_hash of each row of docs that holds a benchmark item.

    Of all windows as long as an item, those are looked at that hold enough shingles of items of that length, at any place:
    the union has as many as the item at least, so the others cannot be similar enough. Windows and items
    get SimHash fingerprints of their words; multi-index blocks find all pairs within the radius; what is returned has a
    weighted Jaccard similarity (shingles count as often as they occur) of ``similarity`` or more. Of several windows of
    a row, the most similar and then the first is given. Windows may reach beyond both ends of a text and are cut there, so
    that a text that begins or ends within an item is held against as much of it.

    Case is ignored in A-Z. Null and empty texts and items match nothing; a text shorter than a shingle is one shingle. Rows
    with null or repeated ids are judged each on its own text (repeated rows give one result); items may have null or
    repeated ids as well. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_id_col).alias("item_id"), words(lowered(F.col(item_text_col))).alias("iw")).where(F.size("iw") > 0)
    items = items.withColumn("n", F.size("iw")).withColumn("ih", F.xxhash64("iw")).withColumn("ihw", hashed(F.col("iw"))).withColumn("ish", shingle_hashes(F.col("ihw"), size))
    marks = items.select("n", F.explode("ish").alias("h")).distinct()
    total, short = items.agg(F.sum("n"), F.collect_set(F.when(F.col("n") < size, F.col("n")))).first()
    marks = F.broadcast(marks) if (total or 0) <= BROADCAST_WORDS else marks
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed(words(lowered(F.col("text")))).alias("w"))
    placed = F.transform(shingle_hashes(F.col("w"), size), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    # items of fewer words than a shingle are looked for as windows of their own length
    placed = F.concat(placed, *(short_windows(F.col("w"), n) for n in short)) if short else placed
    hits = keyed.select("doc_id", "text_hash", F.inline(placed)).join(marks, "h")
    # a row that is repeated counts once
    hits = hits.select("doc_id", "text_hash", "n", "pos").distinct()
    span = F.greatest(F.col("n") - size, F.lit(0))  # how far before a shingle a window that holds it starts, at most
    enough = F.col("c") >= similarity * (span + 1)
    # texts without enough shingles at all go before windows are made of the rest
    hits = hits.withColumn("c", F.count("*").over(W.partitionBy("doc_id", "text_hash", "n"))).where(enough)
    starts = hits.select("doc_id", "text_hash", "n", F.explode(F.sequence(F.col("pos") - span, F.col("pos"))).alias("start"))
    spots = starts.groupBy("doc_id", "text_hash", "n", "start").agg(F.count("*").alias("c")).where(enough)
    # a document's windows: no more than its words times the items' lengths
    rows = spots.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("spots")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "spots")
    found = texts.withColumn("text_hash", F.xxhash64("text")).join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).dropDuplicates(["doc_id", "text_hash"])
    windows = found.select("doc_id", "text_hash", words(lowered(F.col("text"))).alias("w"), "spots").select("doc_id", "text_hash", "w", F.inline("spots"))
    windows = windows.select("doc_id", "text_hash", "start", "n", F.slice("w", F.greatest("start", F.lit(0)) + 1, F.col("n") + F.least("start", F.lit(0))).alias("ww")).withColumn("wh", F.xxhash64("ww"))
    windows = durable(windows)
    # equal windows are compared once: a passage that many documents hold is one key below
    contents = windows.select("wh", "n", "ww").dropDuplicates(["wh", "n"])
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda m: F.bit_count(m) <= RADIUS // BLOCKS)
    blocks = lambda fp: F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _block(fp, k).alias("v")) for k in range(BLOCKS))))
    item_fps = fingerprints(items.select("ih", "n", "iw").dropDuplicates(["ih", "n"]), ["ih", "n"], "iw", "ifp")
    index = item_fps.select("ih", "n", "ifp", blocks("ifp").alias("b")).select("ih", "n", "ifp", "b.k", F.explode(F.transform(near, lambda m: F.col("b.v").bitwiseXOR(m))).alias("v"))
    probe = fingerprints(contents, ["wh", "n"], "ww", "wfp").select("*", blocks("wfp").alias("b")).select("wh", "n", "wfp", "b.k", "b.v")
    pairs = probe.join(index, ["n", "k", "v"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("wh", "n", "ih").distinct()
    mine = with_numbered(contents.select("wh", "n", hashed(F.col("ww")).alias("hw")).select("wh", "n", shingle_hashes(F.col("hw"), size).alias("s")), "s", "a").select("wh", "n", "a")
    theirs = with_numbered(items.select("ih", "n", F.col("ish").alias("s")).dropDuplicates(["ih", "n"]), "s", "b").select("ih", "n", "b")
    both = pairs.join(mine, ["wh", "n"]).join(theirs, ["ih", "n"]).withColumn("c", F.size(F.array_intersect("a", "b")))
    alike = both.withColumn("similarity", F.col("c") / (F.size("a") + F.size("b") - F.col("c"))).where(F.col("similarity") >= similarity)
    named = alike.join(items.select("ih", "n", "item_id"), ["ih", "n"]).select("wh", "n", "item_id", "similarity")
    scored = windows.join(named, ["wh", "n"])
    best = scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct("start", F.size("ww").alias("n"), "similarity"), F.struct("similarity", -F.col("start"))).alias("m"))
    return best.select("doc_id", "item_id", F.greatest("m.start", F.lit(0)).cast("long").alias("start_word"), F.col("m.n").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity"), "text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, all columns, without those that hold a benchmark item."""
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_d2"), F.xxhash64(text_col).alias("_t2"))
    return keyed.join(bad, F.col("_d2").eqNullSafe(F.col("_d")) & (F.col("_t2") == F.col("_t")), "left_anti").select("_row.*")
