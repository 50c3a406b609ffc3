"""Substring dedup over words with difference-cover anchors.

A match of at least ``length`` words is found through anchors: hashes of shorter windows that are taken only where the
position modulo a period lies in a difference cover. For any two positions of an equal passage there is a shift below
the period that brings both onto the cover, so every long match shares an aligned anchor. Anchors that one document
alone holds are dropped; the matches behind the others are extended to whole windows of ``length`` words and compared.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import packed
from tidebar.llm.common import U64, window_hashes
from tidebar.llm.packed import Elements

#: Perfect difference sets: every residue of the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LAST = np.iinfo(np.int64).max
OUT = "doc_id long, n_words long, n_removed long, kept_text string"


class _Block:
    """The words of a block's documents, one after another."""

    def __init__(self, rows: pa.Table):
        ids = rows["doc_id"].to_pylist()
        self.doc_id = ids
        self.rank = np.array([LAST if x is None else x for x in ids], np.int64)
        self.words = [t.encode().split() for t in packed.texts(rows)]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.hash = np.fromiter((x for w in self.words for x in map(xxhash.xxh3_64_intdigest, w)), U64, total)
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.pos = np.arange(total) - np.repeat(self.start, self.n)
        self.left = np.repeat(self.n, self.n) - self.pos  # words from here to the document's end

    def anchors(self, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors start, and their hashes."""
        span = length - period + 1
        on = np.zeros(period, bool)
        on[list(COVERS[period])] = True
        at = np.flatnonzero(on[self.pos % period] & (self.left >= span) & (np.repeat(self.n, self.n) >= length))
        return at, window_hashes(self.hash, span, 0x2545F4914F6CDD1D)[at]


def _first(block: _Block, length: int, period: int) -> tuple[Elements, np.ndarray]:
    at, h = block.anchors(length, period)
    key, order, starts = packed.distinct(h)
    doc = block.doc[at][order]
    many = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts) if len(key) else np.zeros(0, bool)
    return Elements(key, [many.astype(np.uint8)], packed.places(order, starts)), at


def _shared(key: np.ndarray, many: np.ndarray) -> np.ndarray:
    """1 where a second document holds the anchor."""
    _, order, starts = packed.distinct(key)
    size = np.diff(np.r_[starts, len(key)])
    shared = (size > 1) | (np.maximum.reduceat(many[order], starts) > 0) if len(key) else np.zeros(0, bool)
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(shared, size)
    return out


def _second(block: _Block, replies: pa.Table, length: int, period: int) -> tuple[Elements, np.ndarray]:
    """Whole windows around shared anchors: key and smallest id in the block."""
    first, at = _first(block, length, period)
    hit = packed.states(replies, 1, len(first.key))[first.place] > 0
    flag = np.zeros(len(block.hash) + period + 1, np.int32)
    flag[at[hit] + 1] = 1
    seen = np.cumsum(flag)
    i = np.arange(len(block.hash))
    window = np.flatnonzero((seen[i + period] > seen[i]) & (block.left >= length))
    h = window_hashes(block.hash, length, 0x5851F42D4C957F2D)[window]
    key, order, starts = packed.distinct(h)
    rank = block.rank[block.doc[window]][order]
    least = np.minimum.reduceat(rank, starts) if len(key) else np.zeros(0, np.int64)
    return Elements(key, [least], packed.places(order, starts)), window


def _beaten(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """1 where another block has the window in a document with a smaller id."""
    _, order, starts = packed.distinct(key)
    out = np.empty(len(key), np.uint8)
    if len(key):
        least = np.minimum.reduceat(rank[order], starts)
        out[order] = rank[order] > np.repeat(least, np.diff(np.r_[starts, len(key)]))
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, period: int = 7, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (words joined by one space) of each row of docs.

    A word goes if it lies in a window of ``length`` words of its document whose sequence also starts in a document with
    a smaller id. Null and empty texts have no words and keep an empty text. A null id counts as larger than all others.
    Rows that share an id never remove each other's words; a repeated row gives a repeated result. Other columns are
    ignored. An empty table gives no rows. Hashes have 64 bits, and a window must agree in two of them.
    """
    if period not in COVERS or period >= length:
        raise ValueError(f"the period must be one of {sorted(COVERS)} and below the length")
    layout = packed.deal(docs, id_col, text_col, block_bytes, len(COVERS[period]) / period / 6)

    def anchors(rows: pa.Table, _replies) -> Elements:
        return _first(_Block(rows), length, period)[0]

    def windows(rows: pa.Table, replies: pa.Table) -> Elements:
        return _second(_Block(rows), replies, length, period)[0]

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(rows)
        found, window = _second(block, replies, length, period)
        goes = packed.states(replies, 2, len(found.key))[found.place] > 0
        goes |= block.rank[block.doc[window]] > found.extra[0][found.place]
        edge = np.zeros(len(block.hash) + 1, np.int32)
        np.add.at(edge, window[goes], 1)
        np.add.at(edge, window[goes] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(block.doc[gone], minlength=len(block.n))
        text = [b" ".join(w if not r else compress(w, ~gone[s : s + n])).decode() for w, r, s, n in zip(block.words, removed, block.start, block.n)]
        return pa.table([pa.array(block.doc_id, pa.int64()), pa.array(block.n), pa.array(removed.astype(np.int64)), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    one = packed.ask(layout, 1, anchors, ["u1"], _shared, width=6)
    two = packed.ask(layout, 2, windows, ["i8"], _beaten, earlier=one)
    return packed.conclude(layout, one.unionByName(two), finish, OUT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
