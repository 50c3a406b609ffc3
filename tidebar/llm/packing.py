"""Packing documents' tokens into as few sequences of a fixed length as possible: best fit in every partition, then a tree of
rounds over the bins that are not nearly full."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import durable
from tidebar.llm.token_counts import BATCH_BYTES, BOUNDARY, PIECE, batches, cuttable

LENGTH, END_ID = 1024, 2
#: A leaf of the tree packs about so many pieces; a node has so many children, and hands on so many bins at most, so that
#: no node holds more than a leaf.
LEAF, FAN = 1 << 14, 8
HANDED_ON = LEAF // FAN
#: Bins with at most this share of a sequence free are emitted at once.
NEARLY = 1 / 128

#: A piece as it travels inside a bin: its document (and whether that id is null), place, length and checksum.
RECORD = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: A bin: the node that has it next, or the sequence that it has become; fill: its tokens; members: its records.
BINS = "node long, sequence_id long, fill int, members binary"
_BINS = pa.schema([("node", pa.int64()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.binary())])

#: A space that follows white space; it and a space at the start follow no visible character.
_ODD_SPACE = re.compile(" (?<=[\\s\u180e] )")
#: Bytes of pieces in each of two generations of a memory, and pieces that go to the library as one text.
GENERATION, TOGETHER = 128 << 20, 500
#: Bytes of texts that are cut at once.
TEXT_BYTES = 8 << 20
#: BOUNDARY also lies between one of the letters and one of the marks.
_LETTERS = frozenset(c for c in map(chr, range(256)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
_MARKS = frozenset(",.;:!?")


class Memory:
    """The ids of pieces, in bounded memory: what was asked for since the last generation began, and in the one before."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def unknown(self, pieces: set[str]) -> set[str]:
        new = pieces - self.now.keys()
        again = new & self.before.keys()
        self.add({p: self.before[p] for p in again})
        return new - again

    def add(self, ids: dict[str, bytes]) -> None:
        self.now.update(ids)
        self.held += sum(map(len, ids)) + 200 * len(ids)

    def age(self) -> None:
        if self.held > GENERATION:
            self.now, self.before, self.held = {}, {k: v for k, v in self.now.items() if len(k) <= PIECE}, 0


class Encoder:
    """The ids of texts as little-endian 32-bit numbers, as the tokenizers library gives them without special tokens added.

    Texts are cut before spaces that follow a visible character (BOUNDARY says why that changes no token); each distinct
    piece goes to the library once and is remembered, in bounded memory. New pieces go there many in one text, as cuts at
    their spaces change nothing; the bytes that each id stands for tell whose it is. Other texts are cut by BOUNDARY itself,
    and where the tokenizer's file does not allow cuts, they go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.encode = lambda texts: [np.array(e.ids, "<u4") for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.cuttable = cuttable(path)
        if self.cuttable:
            added = {t.content: len(t.content.encode()) for t in model.get_added_tokens_decoder().values()}
            vocabulary = model.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, k in vocabulary.items():
                self.bytes_of[k] = added.get(token, len(token))  # a byte-level token has a character for each byte
            self.marks = {m: i.tobytes() for m, i in zip(sorted(_MARKS), self.encode(sorted(_MARKS)))}
        self.known, self.after_space = Memory(), Memory()

    def _whole(self, pieces: list[str]) -> dict[str, bytes]:
        return {p: i.tobytes() for batch in batches(pieces, BATCH_BYTES) for p, i in zip(batch, self.encode(batch))}

    def _together(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that end in a visible character, each behind a space."""
        out = {}
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            ids = self.encode([" " + " ".join(some)])[0]
            ends = np.cumsum([1 + (len(p) if p.isascii() else len(p.encode())) for p in some])
            upto = np.cumsum(self.bytes_of[ids])
            at = np.searchsorted(upto, ends)
            if len(ids) and at[-1] < len(ids) and (upto[at] == ends).all():
                data, at = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
                out.update(zip(some, (data[a:b] for a, b in zip(at, at[1:]))))
            else:
                out.update((p, x.tobytes()) for p, x in zip(some, self.encode([" " + p for p in some])))
        return out

    def _learn_after_space(self, pieces: set[str]) -> None:
        memory = self.after_space
        new = memory.unknown(pieces)
        marked, heads, odd = [], [], []
        for p in new:
            last = p[-1:]
            if last in _MARKS and p[-2:-1] in _LETTERS:
                marked.append(p)
            elif last.isspace() or not last or last == "\u180e":
                odd.append(p)
            else:
                heads.append(p)
        heads += memory.unknown({p[:-1] for p in marked}).difference(heads)
        memory.add(self._together(heads))
        memory.add({p: x.tobytes() for p, x in zip(odd, self.encode([" " + p for p in odd]))})
        memory.add({p: memory.now[p[:-1]] + self.marks[p[-1]] for p in marked})

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each of a few texts."""
        cut = []  # of each text the pieces that stand as they are, and those behind a space
        for t in texts:
            if self.cuttable and t[:1] != " " and not _ODD_SPACE.search(t):
                first, space, rest = t.partition(" ")
                cut.append(((first,), rest.split(" ") if space else ()))
            else:
                cut.append((BOUNDARY.split(t) if self.cuttable else (t,), ()))
        self.known.add(self._whole(list(self.known.unknown(set().union(*(whole for whole, _ in cut))))))
        self._learn_after_space(set().union(*(behind for _, behind in cut)))
        known, after = self.known.now.__getitem__, self.after_space.now.__getitem__
        out = [b"".join([*map(known, whole), *map(after, behind)]) for whole, behind in cut]
        self.known.age()
        self.after_space.age()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which outlives a task and keeps what it knows."""
    return Encoder(path)


def cut(n: int, length: int) -> list[int]:
    """Where the pieces of n tokens begin: all but the first have the full length."""
    first = (n - 1) % length + 1
    return [0, *range(first, n, length)]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of at most length tokens of each row of docs.

    A document is the ids of its whole text and end_id. Null and empty texts are end_id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            doc, at = batch["doc_id"].to_pylist(), 0
            for texts in batches(batch["text"].to_pylist(), TEXT_BYTES):
                rows = []
                for ids in encoder(path).ids(texts):
                    data = memoryview(ids + end)
                    n = len(data) // 4
                    starts = cut(n, length)
                    rows += [(doc[at], k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, PIECES)


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item, by best fit in the given order: the fullest bin that the item fits in, else a new one."""
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, bins, out = 0, 0, []
    for s in sizes.tolist():
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = length, bins, bins + 1
        room -= s
        with_room[room].append(b)
        rooms |= 1 << room
        out.append(b)
    return np.array(out, np.int64)


def joined(members: pa.Array, starts: np.ndarray) -> pa.Array:
    """Neighbouring binary values as one, from each of starts to the next."""
    offsets = np.frombuffer(members.buffers()[1], np.int32)[members.offset : members.offset + len(members) + 1]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[offsets[starts], offsets[-1:]].astype(np.int32)), members.buffers()[2]])


def round_of(rows: pa.Table, length: int, nearly: int, level: int, handed_on: int) -> pa.Table:
    """One node's round: its bins as items of a best fit from the largest down. Nearly full bins become sequences; of the
    rest the emptiest handed_on bins go to the node above, and the fuller ones, which nothing that is left would fill
    before those, become sequences too. Bins in any order give the same result."""
    node = rows["node"][0].as_py()
    rows = rows.sort_by([("fill", "descending"), ("members", "ascending")]).combine_chunks()
    fill = rows["fill"].to_numpy().astype(np.int64)
    own = best_fit(fill, length)
    order = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
    total = np.add.reduceat(fill[order], starts)
    open_ = np.zeros(len(starts), bool)
    emptiest = np.argsort(total, kind="stable")[:handed_on]
    open_[emptiest] = total[emptiest] < length - nearly
    serial = (level << 56) | (node << 24) | np.arange(len(starts))
    members = joined(rows["members"].combine_chunks().take(pa.array(order)), starts)
    return pa.table([pa.array(np.full(len(starts), node // FAN), mask=~open_), pa.array(2 * serial + 1, mask=open_), pa.array(total.astype(np.int32)), members], schema=_BINS)


def _round(*options: int):
    def run(rows: pa.Table) -> pa.Table:
        return round_of(rows, *options)

    return run


def packed(items: DataFrame, n_items: int, length: int = LENGTH) -> DataFrame:
    """Placements (pieces' columns, sequence_id, offset) of items, the rows of PIECES that are shorter than a sequence.

    items must not change when read again (a checkpoint or table). They are dealt over leaves by a hash of their place, so
    that every leaf has a fair mix of lengths. Leaves best-fit theirs from the largest down; a level's rest is written, and
    goes up to a node for FAN of its own. The last node emits all it has. A leaf holds about LEAF items, a node HANDED_ON
    bins from each child; a bin carries the records of its pieces, so nothing is joined back.
    """
    nodes, level = max(1, -(-n_items // LEAF)), 0
    nearly = int(length * NEARLY)

    def started(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            r = np.zeros(b.num_rows, RECORD)
            r["null"] = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            r["doc_id"] = b["doc_id"].fill_null(0).to_numpy()
            for name, col in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
                r[name] = b[col].to_numpy()
            at = np.arange(b.num_rows + 1, dtype=np.int32) * RECORD.itemsize
            members = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(r.tobytes())])
            yield pa.RecordBatch.from_arrays([b["node"], pa.nulls(b.num_rows, pa.int64()), pa.array(r["length"]), members], schema=_BINS)

    leaf = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(nodes)).alias("node")
    rows = items.select(leaf, "*").mapInArrow(started, BINS)
    closed = None
    while True:
        last = nodes == 1
        keep = 0 if last else HANDED_ON
        out = rows.groupBy("node").applyInArrow(_round(length, nearly, level, keep), BINS)
        out = out if last else durable(out)
        done = out.where("sequence_id is not null").select("sequence_id", "members")
        closed = done if closed is None else closed.unionByName(done)
        if last:
            return closed.mapInArrow(_placements, PIECES + ", sequence_id long, offset long")
        rows, nodes, level = out.where("sequence_id is null"), -(-nodes // FAN), level + 1


def _placements(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record of each bin, with its place there."""
    for b in parts:
        members = b["members"]
        offsets = np.frombuffer(members.buffers()[1], np.int32)[members.offset : members.offset + len(members) + 1]
        r = np.frombuffer(members.buffers()[2] or b"", RECORD, count=(int(offsets[-1]) - int(offsets[0])) // RECORD.itemsize, offset=int(offsets[0]))
        first = (offsets[:-1] - offsets[0]) // RECORD.itemsize
        n = np.diff(offsets) // RECORD.itemsize
        upto = np.cumsum(r["length"].astype(np.int64)) - r["length"]
        place = upto - np.repeat(upto[first], n)
        columns = [pa.array(r["doc_id"], mask=r["null"].astype(bool)), r["piece"], r["start"], r["length"].astype(np.int64), r["crc"].astype(np.int64), np.repeat(b["sequence_id"].to_numpy(), n), place]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PLACED)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each row of docs.

    A document is its ids by the tokenizers library and end_id; only longer ones than length are cut, into pieces of that
    length of which the first may be shorter. A full piece is a sequence of its own; the others are packed. path: of the
    tokenizer's file, on every executor. Sequences' numbers are unique, with gaps; a sequence's pieces stand gapless from 0.
    Null and empty texts are a piece of one token. Ids may be null; repeated rows are packed each. Other columns are
    ignored. An empty table gives no rows. Texts are encoded once; what is packed after that is a record for each piece.
    """
    fixed = durable(pieces(docs, path, length, end_id, id_col, text_col))
    full = fixed.where(F.col("length") == length).select("*", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = fixed.where(F.col("length") < length)
    return full.unionByName(packed(rest, rest.count(), length))
