"""Asking all documents about hashed pieces of text with packed messages instead of a row per piece.

Documents are dealt into *blocks* of a few megabytes by a hash. A block derives 64-bit keys from its texts, keeps one
element per distinct key (so a key that millions of documents hold costs a block one element), and sends one packed
message to each *bucket* of the key space. A bucket sees every element of its keys, decides a state per element, and
answers each message with one byte per element in the message's own order. Nothing holds more than one block or one
bucket; lost tasks are recomputed from the shuffle files, as every step is a pure function of its input.

Blocks and buckets both grow with the square root of the input up to a limit, so that the number of messages grows as the
input does and each stays large. Beyond the limit messages get shorter, down to one key; they are cut out of one buffer
without a loop, so that even then they cost no more than a row per key would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import U64

MESSAGE = "bucket int, block int, keys binary, extra binary"
REPLY = "block int, phase int, bucket int, states binary"
_REPLY_ARROW = pa.schema([("block", pa.int32()), ("phase", pa.int32()), ("bucket", pa.int32()), ("states", pa.binary())])


@dataclass
class Layout:
    """How documents are dealt: blocks of about block_bytes, 2**bits buckets of keys."""

    docs: DataFrame
    rows: int
    bits: int
    partitions: int


#: Bytes of input at which blocks and buckets begin to grow, and how many times their size they reach.
GROW_FROM, GROW_MOST = 1 << 29, 4


def sizes(total: int, block_bytes: int, keys_per_byte: float, bucket_keys: int) -> tuple[int, int]:
    """(blocks, bits): how many blocks and 2**bits buckets an input of so many bytes is dealt into."""
    grown = min(max(1.0, (total / GROW_FROM) ** 0.5), GROW_MOST)
    blocks = max(1, int(-(-total // (block_bytes * grown))))
    return blocks, max(0, int(np.ceil(np.log2(max(1.0, total * keys_per_byte / (bucket_keys * grown))))))


def deal(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, keys_per_byte: float, bucket_keys: int = 1 << 19) -> Layout:
    """(block, doc_id, text_hash, text) of every row, dealt by a hash of id, text and the input partition that holds it: a
    hot source or a group of copies spreads, and of one repeated row a block gets what one input partition holds at most."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    total = size["b"] or 0
    blocks, bits = sizes(total, block_bytes, keys_per_byte, bucket_keys)
    # Not fewer than Spark's own number, or Spark would deal the texts anew to join them with replies.
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 << 20)))
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block")
    small = docs.select(block, "doc_id", "text_hash", "text").mapInArrow(_compressed, "block int, doc_id long, text_hash long, text binary")
    return Layout(small.repartition(partitions, "block"), size["n"], bits, partitions)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are shuffled compressed; Spark's own codec leaves them half as large again."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        text = pa.array([zip_.compress(t.encode()) for t in batch["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["block"], batch["doc_id"], batch["text_hash"], text], ["block", "doc_id", "text_hash", "text"])


def texts(rows: pa.Table) -> list[str]:
    """The texts of a block's rows."""
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(x).decode() for x in rows["text"].to_pylist()]


@dataclass
class Elements:
    """Distinct keys of a block, sorted, and arrays in the same order that go with them."""

    key: np.ndarray
    extra: list[np.ndarray] = field(default_factory=list)
    #: For each item the block derived a key from, the place of that key.
    place: np.ndarray | None = None


def order_of(keys: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit keys. Sorting values is several times faster than sorting places, so the keys' highest
    bits are sorted with their places below them; keys that then stand wrong, equal in those bits, are rare."""
    if keys.dtype != U64 or len(keys) < 2:
        return np.argsort(keys, kind="stable")
    low = U64((1 << int(len(keys) - 1).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=U64)) & low).astype(np.int64)
    s = keys[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(keys, kind="stable")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys sorted, the order that sorts all items, and where each key starts in that order."""
    order = order_of(keys)
    s = keys[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[starts], order, starts


def places(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each item, the place of its key among the distinct ones."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    return out


def _cut(data: np.ndarray, starts: np.ndarray, width: int) -> pa.Array:
    """data, items of width bytes, as binary values that begin at starts: cut out of one buffer, without a loop."""
    raw = np.ascontiguousarray(data).view(np.uint8).ravel()
    ends = np.r_[starts, len(raw) // width if width else 0] * width
    if len(raw) > np.iinfo(np.int32).max:
        raise ValueError("more than 2 GB in one block; take a smaller block_bytes")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _flat(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of binary values one after another, and the size of each value."""
    data, sizes_ = [], []
    for c in values.chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        if len(c):
            raw = np.frombuffer(c.buffers()[2] or b"", np.uint8)
            data.append(raw[offsets[0] : offsets[-1]])
            sizes_.append(np.diff(offsets))
    return (np.concatenate(data), np.concatenate(sizes_).astype(np.int64)) if data else (np.zeros(0, np.uint8), np.zeros(0, np.int64))


def buckets(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each starts; a bucket is the key's highest bits."""
    if not len(key):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    bucket = (key >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return bucket[starts], starts


def _messages(block: int, elements: Elements, bits: int, width: int) -> pa.Table:
    """extra holds the extra arrays' items side by side, as many bytes an element."""
    key = elements.key
    bucket, starts = buckets(key, bits)
    wire = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    extra = np.concatenate([np.zeros((len(key), 0), np.uint8), *(np.ascontiguousarray(x).view(np.uint8).reshape(len(key), x.dtype.itemsize) for x in elements.extra)], axis=1)
    return pa.table([pa.array(bucket), pa.array(np.full(len(bucket), block, np.int32)), _cut(wire, starts, width), _cut(extra, starts, extra.shape[1])], ["bucket", "block", "keys", "extra"])


def states(replies: pa.Table, phase: int, size: int) -> np.ndarray:
    """The states of a block's elements in the order of their keys."""
    mine = replies.filter(pa.compute.equal(replies["phase"], phase)).sort_by("bucket")
    out, _ = _flat(mine["states"])
    if len(out) != size:
        raise ValueError(f"{len(out)} states for {size} elements")
    return out


def unpack(rows: pa.Table, width: int, types: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All elements of a bucket: keys, extra arrays, and the number of elements in each message."""
    raw, n = _flat(rows["keys"])
    keys = np.zeros((len(raw) // width, 8), np.uint8)
    keys[:, :width] = raw.reshape(-1, width)
    kinds = [np.dtype(t) for t in types]
    each = sum(k.itemsize for k in kinds)
    more = _flat(rows["extra"])[0].reshape(len(keys), each)
    at = np.cumsum([0, *(k.itemsize for k in kinds)])
    extra = [np.ascontiguousarray(more[:, a : a + k.itemsize]).view(k).ravel() for a, k in zip(at, kinds)]
    return keys.view("<u8").ravel(), extra, n // width


def ask(layout: Layout, phase: int, emit: Callable[[pa.Table, pa.Table | None], Elements], types: list[str], decide: Callable[..., np.ndarray], width: int = 8, earlier: DataFrame | None = None) -> DataFrame:
    """Replies (REPLY) to the elements that emit derives from each block (and, from the second phase on, from the
    replies it had before). decide gets all keys and extra arrays of a bucket and gives a state to each."""
    bits = layout.bits
    messages = gather(layout, emit, width, earlier)

    def resolve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        keys, extra, sizes = unpack(rows, width, types)
        state = decide(keys, *extra).astype(np.uint8)
        return pa.table([rows["block"].combine_chunks(), pa.array(np.full(len(sizes), phase, np.int32)), rows["bucket"].combine_chunks(), _cut(state, np.cumsum(sizes) - sizes, 1)], schema=_REPLY_ARROW)

    return messages.repartition(layout.partitions, "bucket").groupBy("bucket").applyInArrow(resolve, REPLY)


def gather(layout: Layout, emit: Callable, width: int = 8, earlier: DataFrame | None = None) -> DataFrame:
    """The packed messages of every block."""
    bits = layout.bits

    def alone(rows: pa.Table) -> pa.Table:
        return _messages(rows["block"][0].as_py(), emit(rows, None), bits, width)

    def informed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        return _messages(rows["block"][0].as_py(), emit(rows, replies), bits, width)

    if earlier is None:
        return layout.docs.groupBy("block").applyInArrow(alone, MESSAGE)
    return layout.docs.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(informed, MESSAGE)


def conclude(layout: Layout, replies: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows that finish makes from each block and its replies."""
    return layout.docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
