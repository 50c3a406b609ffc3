"""Repeated byte strings by bucket-pointer refinement, spread over Spark.

Suffixes start in q-gram buckets (q = 8: the bucket identifier is the eight bytes themselves). A bucket is refined by the
bucket identifier that its suffixes have at a later offset, and the refined identifiers are reused for the next round:
8, 16, 32, 64, 128 bytes. Identifiers are hashes of content, so every task refines alone and all agree.

Only some suffixes have to be compared between tasks. In each window of ``length`` bytes the suffix with the smallest
64-byte identifier stands for the window: two equal windows have it at the same offset. The windows that one such suffix
stands for form a run. A run is asked about as a whole (the bytes that all its windows share, refined by all bytes of the
run): if the shared bytes are unique, no window repeats; if all its bytes repeat, every window does; else the run is cut
into shorter ones, down to single windows. Long repeats are thereby settled by few questions, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import packed
from tidebar.llm.common import U64, mix
from tidebar.llm.packed import Elements

Q = 64
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
#: Documents are worked on in slices of so many bytes, whose identifiers fit a core's cache.
SLICE = 1 << 16
#: Blocks of up to so many bytes keep the identifiers of their slices; larger ones (of very long texts) make them anew.
KEEP = 8 << 20
UNIQUE, REPEATED, OPEN, MODEL = 0, 1, 2, 3
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def refine(ids: np.ndarray, step: int) -> np.ndarray:
    """Bucket identifiers of twice the depth: an identifier and the one that lies step later."""
    x = ids[:-step] * _A
    x ^= x >> U64(29)
    x += ids[step:] * _B
    x *= _A
    x ^= x >> U64(32)
    return x


def widths(length: int) -> list[int]:
    """How many windows a question covers, from whole runs down to one."""
    return [length - Q + 1, 16, 1]


class _Slice:
    """Bytes of some documents, one after another, with the runs of their windows."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
        """starts, ends: of windows that may be taken, by document: start <= first byte of a window <= end - length."""
        self.length, self.data = length, data
        # 24 bytes more than there are: no identifier is missing for a suffix that counts
        raw = np.concatenate([data, np.zeros(2 * length, np.uint8)])
        ids = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
        for step in (8, 16, 32):
            ids = refine(ids, step)
        self.id64 = ids
        self.id128 = refine(ids, 64)
        place = U64((1 << int(len(raw)).bit_length()) - 1)
        low = (ids[: len(data)] & ~place) | np.arange(len(data), dtype=U64)
        span, wide = length - Q + 1, 1
        while 2 * wide <= span:
            low = np.minimum(low[:-wide], low[wide:]) if len(low) > wide else low[:0]
            wide *= 2
        if span > wide:
            low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :]) if len(low) > span - wide else low[:0]
        least = (low & place).astype(np.int64)
        ok = np.zeros(len(data) + 1, np.int32)
        np.add.at(ok, starts, 1)
        np.add.at(ok, ends - length + 1, -1)
        i = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
        i = i[i < len(least)]
        if len(i):
            new = np.r_[True, (np.diff(i) > 1) | (np.diff(least[i]) != 0)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(i)] - 1
            self.at = least[i[first]]
            self.far, self.near = self.at - i[first], self.at - i[last]  # how far before it windows start
        else:
            self.at = self.far = self.near = np.zeros(0, np.int64)

    def bins(self, run: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cuts runs into bins of distances: (run, bin, nearest, farthest)."""
        b0, b1 = self.near[run] // width, self.far[run] // width
        n = b1 - b0 + 1
        of = np.repeat(np.arange(len(run)), n)
        b = b0[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        r = run[of]
        return r, b, np.maximum(self.near[r], b * width), np.minimum(self.far[r], (b + 1) * width - 1)

    def _hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the size (128 to 384) bytes from start on."""
        x = mix(self.id128[start] + size.astype(U64) * _B)
        x = mix(x + self.id128[start + (size - 128) // 2])
        return mix(x + self.id128[start + size - 128])

    def ask(self, run: np.ndarray, b: np.ndarray, near: np.ndarray, far: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(key of the bytes that all windows of the bin share, key of all bytes of the bin)."""
        a = self.at[run]
        top = np.minimum((b + 1) * width - 1, self.length - Q)
        start, size = a - b * width, self.length - (top - b * width)
        if width >= self.length - Q + 1:
            core = mix(self.id64[a])
        else:
            core = self._hash(start, size)
        core = mix(core + b.astype(U64) * _A + U64(width))
        whole = self._hash(a - far, self.length + far - near)
        return core, mix(whole + (far * 1009 + near).astype(U64) * _B)


class _Block:
    def __init__(self, rows: pa.Table, length: int):
        self.length = length
        # in an order of their own: slices must be the same each time, and rows come as the shuffle brings them
        known = sorted(zip(rows["doc_id"].to_pylist(), packed.texts(rows)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.doc_id = [x for x, _ in known]
        self.texts = [x.encode() for _, x in known]
        self.n = np.array([len(x) for x in self.texts], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self._made = {}

    def slices(self):
        """(first byte in the block, slice): every window that lies in one document is in one slice."""
        total, at = len(self.data), 0
        doc_end = self.start + self.n
        while at < total:
            stop = min(total, at + SLICE)
            upto = min(total, stop + self.length - 1)  # windows that start before stop
            made = self._made.get(at)
            if made is None:
                d = slice(int(np.searchsorted(doc_end, at, "right")), int(np.searchsorted(self.start, stop, "left")))
                starts, ends = np.maximum(self.start[d], at) - at, np.minimum(doc_end[d], upto) - at
                long = ends - starts >= self.length
                made = _Slice(self.data[at:upto], starts[long], ends[long], self.length)
                if total <= KEEP:
                    self._made[at] = made
            yield at, made
            at = stop

    def elements(self, replies: pa.Table | None, level: int):
        """The questions of a level: elements, and for each slice what the answers of earlier levels left open."""
        ws = widths(self.length)
        asked = []  # by slice: (run, bin, nearest, farthest) of each level
        for _ in self.slices():
            asked.append([])
        for k in range(level + 1):
            cores, wholes = [], []
            for j, (_, s) in enumerate(self.slices()):
                if k == 0:
                    item = s.bins(np.arange(len(s.at)), ws[0])
                else:
                    r, b, near, far = (x[asked[j][-1][1]] for x in asked[j][-1][0])
                    item = self._cut(r, near, far, ws[k])
                core, whole = s.ask(*item, ws[k])
                cores.append(core)
                wholes.append(whole)
                asked[j].append([item, None])
            core, whole = np.concatenate(cores or [np.zeros(0, U64)]), np.concatenate(wholes or [np.zeros(0, U64)])
            order = np.lexsort((whole, core))
            c, w = core[order], whole[order]
            starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, np.int64)
            count = np.minimum(np.diff(np.r_[starts, len(c)]), 2).astype(np.uint8)
            found = Elements(c[starts], [w[starts], count], packed.places(order, starts))
            if k == level:
                return found, asked
            state = packed.states(replies, k, len(found.key))[found.place]
            at = 0
            for parts in asked:
                size = len(parts[-1][0][0])
                mine = state[at : at + size]
                parts[-1][1] = (mine == OPEN) | (mine == MODEL)
                parts[-1].append((mine == REPEATED) | (mine == MODEL))
                at += size

    @staticmethod
    def _cut(r, near, far, width):
        b0, b1 = near // width, far // width
        n = b1 - b0 + 1
        of = np.repeat(np.arange(len(r)), n)
        b = b0[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        return r[of], b, np.maximum(near[of], b * width), np.minimum(far[of], (b + 1) * width - 1)


def _decide(last: bool):
    def decide(core: np.ndarray, whole: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros(len(core), np.uint8)
        if not len(core):
            return out
        order = np.lexsort((whole, core))
        c, w, n = core[order], whole[order], count[order].astype(np.int64)
        group = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        size = np.diff(np.r_[group, len(c)])
        times = np.add.reduceat(n, group)
        bucket = np.flatnonzero(np.r_[True, c[group][1:] != c[group][:-1]])
        wide = np.diff(np.r_[bucket, len(group)])
        single = np.repeat(np.add.reduceat(times, bucket) == 1, wide)
        open_too = np.repeat(np.add.reduceat((times == 1).astype(np.int64), bucket) > 0, wide)
        state = np.where(single, UNIQUE, np.where(times == 1, UNIQUE if last else OPEN, REPEATED)).astype(np.uint8)
        each = np.repeat(state, size)
        if not last:  # one of those with equal bytes stands for them in the next level
            each[group[(state == REPEATED) & open_too]] = MODEL
        out[order] = each
        return out

    return decide


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of each row of docs.

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also starts at any other place of any
    row, the same row included; matches never cross rows. Null and empty texts have no bytes. Ids may be null or repeat:
    each row is judged on its own, and a repeated row of at least ``length`` bytes goes whole. Other columns are ignored.
    An empty table gives no rows. Bytes are compared by two 64-bit identifiers.
    """
    if not 128 + 16 <= length <= 256:
        raise ValueError("the length must lie between 144 and 256 bytes")
    layout = packed.deal(docs, id_col, text_col, block_bytes, 2 / (length - Q + 2))
    replies = None
    for level in range(len(widths(length))):

        def emit(rows: pa.Table, earlier: pa.Table | None, level=level) -> Elements:
            return _Block(rows, length).elements(earlier, level)[0]

        new = packed.ask(layout, level, emit, ["u8", "u1"], _decide(level == len(widths(length)) - 1), earlier=replies)
        replies = new if replies is None else replies.unionByName(new)

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(rows, length)
        final = len(widths(length)) - 1
        found, asked = block.elements(told, final)
        state = packed.states(told, final, len(found.key))[found.place]
        edge = np.zeros(len(block.data) + 1, np.int32)
        at = 0
        for (first, s), parts in zip(block.slices(), asked):
            size = len(parts[-1][0][0])
            parts[-1].append(state[at : at + size] == REPEATED)
            at += size
            for item, *_, repeats in parts:
                r, _, near, far = (x[repeats] for x in item)
                np.add.at(edge, first + s.at[r] - far, 1)
                np.add.at(edge, first + s.at[r] - near + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = {"n_removed": [], "n_spans": [], "kept": []}
        for text, start, n in zip(block.texts, block.start, block.n):
            mine = gone[start : start + n]
            removed = int(mine.sum())
            out["n_removed"].append(removed)
            out["n_spans"].append(int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if removed else 0)
            out["kept"].append(block.data[start : start + n][~mine].tobytes() if removed else text)
        return pa.table([pa.array(block.doc_id, pa.int64()), pa.array(block.n), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return packed.conclude(layout, replies, finish, OUT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
