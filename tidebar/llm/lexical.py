"""Ranked lexical search of all documents for a set of items: an index of postings in shards, and MaxScore over each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import durable

#: A shard holds at most so many documents, or about so many bytes of text.
SHARD_DOCS, SHARD_BYTES = 1 << 13, 64 << 20
#: Items are searched for in blocks of about so many bytes of text, which is what bounds the terms that travel.
ITEM_BYTES = 16 << 20

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII, which in UTF-8 is bytes from 80 on; A-Z only
#: are lower-cased, everything else parts terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: One shard: documents in order of id (null last), their numbers of terms, and for each term of the items that occurs the
#: places of its documents and how often each has it, all as packed numbers.
INDEX = "docs long, with_terms long, n_terms long, term array<int>, df array<int>, ids binary, nulls binary, lengths binary, places binary, counts binary"
_INDEX = pa.schema([
    ("docs", pa.int64()), ("with_terms", pa.int64()), ("n_terms", pa.int64()), ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())),
    ("ids", pa.binary()), ("nulls", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()),
])


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


@dataclass
class Items:
    """A block of items: the distinct terms of all, and the terms of each by number."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        each = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms(text or "")}), np.int64) for _, text in rows]
        return cls(vocabulary, each)


class Builder:
    """Collects documents to a shard."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.hits: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms(text)
        known = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.hits.append(known[known >= 0])
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def shard(self) -> pa.RecordBatch:
        nulls = np.array([d is None for d in self.ids])
        ids = np.array([d or 0 for d in self.ids], np.int64)
        order = np.lexsort((ids, nulls))
        lengths = np.array(self.lengths, np.int64)[order]
        n = np.array([len(self.hits[k]) for k in order])
        keys = (np.concatenate([self.hits[k] for k in order]) << 32) | np.repeat(np.arange(len(order)), n)
        keys, counts = np.unique(keys, return_counts=True)
        term, df = np.unique(keys >> 32, return_counts=True)
        packed = [ids[order], nulls[order].astype(np.uint8), lengths, (keys & 0xFFFFFFFF).astype(np.uint32), counts.astype(np.uint32)]
        row = [len(order), int((lengths > 0).sum()), int(lengths.sum()), term.tolist(), df.tolist(), *(x.tobytes() for x in packed)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX.types)], schema=_INDEX)


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """INDEX of docs, whole texts, for the terms of a vocabulary. Shards are made where texts are read: no text is shuffled.

    Null texts have no terms. Repeated rows are documents each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(shared.value)
        for batch in parts:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                builder.add(doc_id, text)
                if builder.full():
                    yield builder.shard()
                    builder = Builder(shared.value)
        if builder.ids:
            yield builder.shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(build, INDEX)


class Shard:
    """A shard's postings, with what each would add to a score but for its term's weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8)
        self.places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
        tf = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 10 + 90 * lengths * n_docs // max(n_terms, 1)
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.places])
        self.term = np.asarray(row["term"], np.int64)
        self.ends = np.cumsum(np.asarray(row["df"], np.int64))
        self.starts = self.ends - np.asarray(row["df"], np.int64)
        self.most = np.maximum.reduceat(self.part, self.starts) if len(self.term) else np.zeros(0, np.int64)
        self.scores = np.zeros(len(self.ids), np.int64)


def maxscore(shard: Shard, wanted: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents of a shard that are among its k best for the terms wanted and reach least.

    Terms stand in order of their upper bounds in this shard, the highest first. Those at the end whose bounds together stay
    under the threshold are non-essential: a document that holds no other cannot qualify, so that only the essential lists
    are read through. A candidate's partial scores raise the threshold (the k-th best partial score is one that k documents
    reach), and the remaining lists are probed one after another for those candidates only that can still reach it.
    """
    at = np.searchsorted(shard.term, wanted)
    at = at[(at < len(shard.term)) & (shard.term[np.minimum(at, len(shard.term) - 1)] == wanted)] if len(shard.term) else at[:0]
    at = at[weights[shard.term[at]] > 0]
    bounds = weights[shard.term[at]] * shard.most[at]
    order = np.argsort(-bounds, kind="stable")
    at, bounds = at[order], bounds[order]
    rest = np.r_[np.cumsum(bounds[::-1])[::-1], 0]  # the most that the lists from here on add
    essential = int((rest[:-1] >= max(least, 1)).sum())
    if not essential:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores, spans = shard.scores, list(zip(shard.starts[at].tolist(), shard.ends[at].tolist(), weights[shard.term[at]].tolist()))
    scores[:] = 0
    for a, b, w in spans[:essential]:
        scores[shard.places[a:b]] += w * shard.part[a:b]
    found = np.flatnonzero(scores)
    for k_list in range(essential, len(spans) + 1):
        if len(found) > k:
            least = max(least, int(np.partition(scores[found], len(found) - k)[len(found) - k]))
        found = found[scores[found] + rest[k_list] >= least]
        if k_list == len(spans) or not len(found):
            break
        a, b, w = spans[k_list]
        there = np.searchsorted(shard.places[a:b], found)
        hit = there < b - a
        hit[hit] = shard.places[a + there[hit]] == found[hit]
        scores[found[hit]] += w * shard.part[a + there[hit]]
    return found, scores[found]


class Best:
    """The k best documents of an item so far: higher scores first, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    def least(self) -> int:
        """A score that a document must reach to be among them."""
        return int(-self.rows[-1, 0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([-scores, nulls.astype(np.int64), ids], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))[: self.k]]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _searched(docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    """item (its number in the block), doc_id and score: of each task's shards the k best documents for each item."""
    spark = docs.sparkSession
    shards = durable(index(docs, items.vocabulary, id_col, text_col))
    total = shards.agg(F.sum("with_terms").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in shards.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df")).collect():  # no more rows than terms of the block
        df[r["term"]] = r["df"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    shared = spark.sparkContext.broadcast((items.terms, weights))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        best = [Best(k) for _ in wanted]
        for batch in parts:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                for b, terms_ in zip(best, wanted):
                    places, scores = maxscore(shard, terms_, weights, k, b.least())
                    if len(places):
                        b.add(scores, shard.ids[places], shard.nulls[places])
        n = [len(b.rows) for b in best]
        rows = np.concatenate([b.rows for b in best]) if best else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(rows[:, 2], mask=rows[:, 1] > 0), pa.array(-rows[:, 0])], ["item", "doc_id", "score"])

    return shards.mapInArrow(search, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score: for each row of items the k rows of docs with the highest scores above 0.

    Scores: a term's weight is floor(1000 ln((2N + 2) / (2df + 1))), and it adds weight * (10^9 tf div (1000 tf + 8m)), with
    m = 10 + 90 n N div L: N documents with terms, L terms in all, n in the document. An item's terms count once each.
    Statistics are of all documents. Equal scores rank by id, null last. Items with no terms, or none that a document holds,
    have no rows; repeated items rank each on their own, under their id. Null texts have no terms; repeated documents rank
    each. Other columns are ignored. No documents or no items give no rows.

    Items are searched for in blocks of about ITEM_BYTES; for each, every text is read once into an index that holds the
    block's terms only, and is searched where it was made: a task goes through its shards with one list of the best for
    each item, so that later shards meet a higher threshold. Only k rows for each task and item are shuffled.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    asked = durable(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in asked.where(F.col("block") == b).select("item_id", "text").collect()]
        found = _searched(docs, Items.of(rows), k, id_col, text_col)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as a block has items
        out = top if out is None else out.unionByName(top)
    return out
