"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct word shingles. In a size band, shingles are hashed into a fixed number of cells,
and each cell keeps the parity (XOR) of its shingles' hashes. Every shingle that only one of two documents has changes
one cell, so the number of cells that differ is a lower bound of their symmetric difference. Linked documents of sizes
a and b differ in at most (100 - t) (a + b) / (100 + t) shingles, so all but so many of a document's filled cells must
recur in any document linked with it (pigeonhole). Documents are found by filled cells, rarest first, and only if enough
of their cells recur at all.

Documents with a cell in common are a group. First each document is compared with one other of its groups, on the
shingles themselves. Groups that this leaves in several components are cut into tiles of bounded size; a task compares
the bit sketches of one pair of tiles (Hamming distance again bounds the symmetric difference from below) and gives out
only each document's closest outside its component. Documents whose sketches then still allow a partner meet once more
with their texts; the exact test takes place in the task, which gives out the links of a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import packed
from tidebar.llm.common import U64, durable, mix, runs, window_hashes
from tidebar.llm.components import components
from tidebar.llm.packed import Elements

#: Shingles to a cell in the largest document of a band; more make fewer keys, but leave less to the pigeonhole.
LOAD = 2.5
#: Rounds in which each document is compared with the closest outside its component, before all that is left.
ROUNDS = 1
#: Documents to a tile of a group; a task holds two tiles' sketches.
TILE = 4096
_CELL, _BIT = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
FACTS = "doc_id long, text_hash long, n_shingles long, node long, text binary, sketch binary, keys array<bigint>, nodes array<bigint>"


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: (number of the text, hash), sorted by both."""
    words = [t.encode().lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), U64, int(n.sum()))
    full = window_hashes(h, size, 0x2545F4914F6CDD1D)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))  # a shorter text is one shingle as a whole
    start, end = np.cumsum(count) - count, np.cumsum(count)
    key, doc = np.empty(int(count.sum()), U64), np.repeat(np.arange(len(n)), count)
    for k, (first, m, s, e) in enumerate(zip((np.cumsum(n) - n).tolist(), n.tolist(), start.tolist(), end.tolist())):
        if m >= size:
            key[s:e] = full[first : first + m - size + 1]
            key[s:e].sort()
        elif m:
            x = np.zeros(1, U64)
            for j in range(m):
                x = x * U64(0x2545F4914F6CDD1D) + h[first + j]
            key[s:e] = mix(x + U64(m * int(_CELL) % 2**64))
    if len(doc):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
        doc, key = doc[new], key[new]
    return doc, key


class _Block:
    def __init__(self, rows: pa.Table, size: int, percent: int):
        self.doc_id, self.texts = rows["doc_id"].to_pylist(), packed.texts(rows)
        self.doc, self.shingle = shingles(self.texts, size)
        self.n = np.bincount(self.doc, minlength=len(self.texts))
        # equal sets are one node, so copies never meet as a pair
        total = np.zeros(len(self.texts), U64)
        np.add.at(total, self.doc, mix(self.shingle ^ _CELL))
        self.node = mix(total + self.n.astype(U64) * _CELL).view(np.int64)
        self.keys(percent)

    def keys(self, percent: int) -> None:
        """key, key_doc, key_group: sketch cells of each document in the bands where a partner may be; need, by group: cells
        that a linked document shares at least. A group is a document in a band."""
        a = self.n
        band = np.floor(np.log2(np.maximum(a, 1))).astype(np.int64)
        key, doc, group, need = [], [], [], []
        n_groups = 0
        for up in (0, 1):
            # in the next band, a document meets only larger ones
            use = a > 0 if up == 0 else (a > 0) & (percent * (2 ** (band + 1)) <= 100 * a)
            number = np.full(len(a), -1)
            number[use] = n_groups + np.arange(int(use.sum()))
            n_groups += int(use.sum())
            mine = use[self.doc]
            d, h = self.doc[mine], self.shingle[mine]
            t = band[d] + up
            cells = np.ceil(2.0 ** (t + 1) / LOAD).astype(U64)
            # in the order of a document's hashes, so that its cells need no sorting
            cell = ((h >> U64(32)) * cells) >> U64(32)
            starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (cell[1:] != cell[:-1])]) if len(d) else np.zeros(0, np.int64)
            word = np.bitwise_xor.reduceat(mix(h + _CELL), starts) if len(d) else np.zeros(0, U64)
            where = cell[starts] * U64(64) + t[starts].astype(U64)
            key.append(mix(word ^ mix(where + _CELL)))
            doc.append(d[starts])
            group.append(number[d[starts]])
            filled = np.bincount(d[starts], minlength=len(a))[use]
            hi = 2 ** (band[use] + 1 + up) - 1
            most = np.minimum(100 * a[use] // percent, hi)
            spare = filled - (100 - percent) * (a[use] + most) // (100 + percent)
            need.append(np.maximum(spare, 1))
            # too few filled cells for the pigeonhole: such documents also meet by every single shingle
            poor = np.zeros(len(a), bool)
            poor[np.flatnonzero(use)[spare < 1]] = True
            extra = poor[d]
            key.append(mix(h[extra] ^ mix(U64(0xFFFFFFFF) * U64(64) + t[extra].astype(U64))))
            doc.append(d[extra])
            group.append(number[d[extra]])
        self.key, self.key_doc, self.key_group = np.concatenate(key), np.concatenate(doc), np.concatenate(group)
        self.need = np.concatenate(need) if need else np.zeros(0, np.int64)
        self.key = np.where(self.key == 0, U64(1), self.key)

    def sketch(self, k: int) -> bytes:
        """Bits of which each shingle of text k turns one: four to eight a shingle, a power of two in all."""
        lo, hi = np.searchsorted(self.doc, [k, k + 1])
        bits = 1 << max(3, int(hi - lo).bit_length() + 2)
        place = (mix(self.shingle[lo:hi] ^ _BIT) & U64(bits - 1)).astype(np.int64)
        return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()

    def first(self) -> Elements:
        """The distinct keys, and how many of the block's different sets hold each (255 for more)."""
        key, order, starts = packed.distinct(self.key)
        _, node = np.unique(self.node, return_inverse=True)  # copies count once
        code = np.repeat(np.arange(len(key)), np.diff(np.r_[starts, len(order)])) << 32 | node[self.key_doc[order]]
        times = np.bincount(np.unique(code) >> 32, minlength=len(key))
        return Elements(key, [np.minimum(times, 255).astype(np.uint8)], packed.places(order, starts))

    def likely(self, replies: pa.Table) -> np.ndarray:
        """Which keys recur, belong to a document of which enough keys recur, and are among its rarest.

        Two sets of keys that share at least need of them share one among the first (all - need + 1) in any one order."""
        found = self.first()
        rarity = packed.states(replies, 1, len(found.key))[found.place]
        again = rarity > 0
        times = np.bincount(self.key_group[again], minlength=len(self.need))
        size = np.bincount(self.key_group, minlength=len(self.need))
        once = size - times  # keys that do not recur come first in the order of rarity
        able = np.flatnonzero(again & (times >= self.need)[self.key_group])
        order = able[np.lexsort((self.key[able], rarity[able], self.key_group[able]))]
        group = self.key_group[order]
        starts = runs(group)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) + once[group]
        out = np.zeros(len(self.key), bool)
        out[order[place <= (size - self.need)[group]]] = True
        return out


def _rarity(key: np.ndarray, times: np.ndarray) -> np.ndarray:
    """0 for a key of one set alone, else larger for more: eight steps to a doubling."""
    _, order, starts = packed.distinct(key)
    out = np.empty(len(key), np.uint8)
    if len(key):
        total = np.add.reduceat(times[order].astype(np.int64), starts)
        step = np.where(total > 1, np.minimum(1 + 8 * np.log2(total), 255), 0).astype(np.uint8)
        out[order] = np.repeat(step, np.diff(np.r_[starts, len(key)]))
    return out


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of fewer bits: a place's lowest bits are its place there, and parities add up."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _compare(percent: int, root: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: list[bytes], side: np.ndarray | None, all_: bool) -> Iterator[np.ndarray]:
    """Pairs (node, node, how many bits differ), those of one document at a time, of different components that sizes and sketches do not rule out; of each
    document only the closest, unless all_. side: for two tiles, which of them a document is in; pairs lie across."""
    size = min(map(len, sketch))
    bits = np.array([_folded(x, size) for x in sketch])
    wide = bits.view(np.uint64) if size % 8 == 0 else bits
    roots, count = np.unique(root, return_counts=True)
    largest = root == roots[count.argmax()]
    for i in np.flatnonzero(~largest).tolist():  # each pair once: with one of the largest component, or a later one
        j = largest | (root != root[i])
        if all_:
            j[:i] &= largest[:i]
        j &= (percent * n <= 100 * n[i]) & (percent * n[i] <= 100 * n)
        if side is not None:
            j &= side != side[i]
        j = np.flatnonzero(j)
        if not len(j):
            continue
        differ = np.bitwise_count(wide[j] ^ wide[i]).sum(1, dtype=np.int64)
        near = (100 + percent) * differ <= (100 - percent) * (n[j] + n[i])
        if not all_:
            k = int(differ.argmin())
            if near[k]:
                yield np.array([[node[i], node[j[k]], differ[k]]])
        elif near.any():
            yield np.stack([np.full(int(near.sum()), node[i]), node[j[near]], differ[near]], 1)


def _by_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile pair, of rows sorted by g, p and q."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        g, p, q = (batch[c].to_numpy() for c in ("g", "p", "q"))
        starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(g) else []
        for s, e in zip(starts, [*starts[1:], len(g)]):
            key = int(g[s]), int(p[s]), int(q[s])
            if key != now and held:
                yield pa.Table.from_batches(held)
                held.clear()
            now = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of(percent: int, t: pa.Table, all_: bool) -> Iterator[np.ndarray]:
    """_compare of a tile pair's rows."""
    root, node, n, tile = (t[c].to_numpy() for c in ("root", "node", "n", "tile"))
    return iter(()) if (root == root[0]).all() else _compare(percent, root, node, n, t["sketch"].to_pylist(), tile if t["p"][0] != t["q"][0] else None, all_)


def _closest(percent: int):
    """Over rows (g, p, q, tile, root, node, n, sketch): of each document the closest of another component in each tile pair."""

    def run(batches):
        for t in _by_tiles(batches):
            pairs = np.concatenate([np.zeros((0, 3), np.int64), *_pairs_of(percent, t, False)])
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 0]))]
            pairs = pairs[runs(pairs[:, 0])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], ["a", "b", "differ"])

    return run


def _partnered(percent: int):
    """Of the same rows those that sizes and sketches leave a partner in their tile pair: as many as there were at most."""

    def run(batches):
        for t in _by_tiles(batches):
            nodes = set().union(*(np.unique(pairs[:, :2]).tolist() for pairs in _pairs_of(percent, t, True)))
            some = t.filter(pa.compute.is_in(t["node"], pa.array(sorted(nodes), pa.int64())))
            yield from some.select(["g", "p", "q", "tile", "root", "node", "n", "sketch"]).to_batches()

    return run


def _spanning(percent: int, size: int):
    """Over the same rows with text: links of a spanning forest of each tile pair, by the exact test. Pairs that are one
    component by then are not tested, and no pair is given out that does not link."""

    def run(batches):
        for t in _by_tiles(batches):
            place = {x: k for k, x in enumerate(t["node"].to_pylist())}
            part = {x: r for x, r in zip(t["node"].to_pylist(), t["root"].to_pylist())}
            sets: dict[int, np.ndarray] = {}
            above: dict[int, int] = {}

            def top(r: int) -> int:
                while r in above:
                    r = above[r]
                return r

            def members(x: int) -> np.ndarray:
                if x not in sets:
                    sets[x] = shingles([zstandard.decompress(t["text"][place[x]].as_py()).decode()], size)[1]
                return sets[x]

            out = []
            for a, b in (x[:2] for pairs in _pairs_of(percent, t, True) for x in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist()):
                ra, rb = top(part[a]), top(part[b])
                if ra == rb:
                    continue
                p, q = members(a), members(b)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    above[max(ra, rb)] = min(ra, rb)
                    out.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _tiled(members: DataFrame) -> DataFrame:
    """members (g, node and others) with p, q and tile: a row for each pair of tiles of its group that its own is in. A
    group of up to TILE documents is one tile; a larger one is cut by a hash of the node, and no task holds more of it
    than two tiles."""
    count = members.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    cut = members.join(count, "g").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return cut.withColumn("p", F.least("tile", "other")).withColumn("q", F.greatest("tile", "other")).drop("other", "tiles")


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs (a, b) with linked (boolean): the exact test on the shingle sets. texts: (node, text, compressed)."""

    def members(data: bytes) -> np.ndarray:
        return shingles([zstandard.decompress(data).decode()], size)[1]

    def test(batches):
        known = (None, None)  # a join by a brings a's pairs one after another
        for batch in batches:
            out = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["ta"], batch["tb"]):
                if a != known[0]:
                    known = a, members(x.as_py())
                p, q = known[1], members(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(out, pa.bool_())], ["a", "b", "linked"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(test, "a long, b long, linked boolean")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block_bytes: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and class (rows that links join have the same) of each row of docs."""
    layout = packed.deal(docs, id_col, text_col, block_bytes, 0.11)

    def cells(rows: pa.Table, _replies) -> Elements:
        return _Block(rows, size, percent).first()

    def facts(rows: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(rows, size, percent)
        go = block.likely(replies)
        key, node = block.key[go].view(np.int64), block.node[block.key_doc[go]]
        wanted = np.zeros(len(block.texts), bool)
        wanted[block.key_doc[go]] = True
        _, first = np.unique(block.node, return_index=True)
        shown = np.zeros(len(block.texts), bool)
        shown[first] = True  # one text for a node is enough
        shown &= wanted
        zip_ = zstandard.ZstdCompressor(level=3)
        return pa.table(
            [
                pa.array([*block.doc_id, None], pa.int64()),
                pa.array([*rows["text_hash"].to_pylist(), None], pa.int64()),
                pa.array([*block.n.tolist(), None], pa.int64()),
                pa.array([*block.node.tolist(), None], pa.int64()),
                pa.array([*(zip_.compress(t.encode()) if w else None for t, w in zip(block.texts, shown)), None], pa.binary()),
                pa.array([*(block.sketch(k) if w else None for k, w in enumerate(shown)), None], pa.binary()),
                pa.array([*[None] * len(block.texts), key], pa.list_(pa.int64())),
                pa.array([*[None] * len(block.texts), node], pa.list_(pa.int64())),
            ],
            ["doc_id", "text_hash", "n_shingles", "node", "text", "sketch", "keys", "nodes"],
        )

    again = packed.ask(layout, 1, cells, ["u1"], _rarity, width=5)
    known = durable(packed.conclude(layout, again, facts, FACTS))
    rows = known.where("keys is null").select("doc_id", "text_hash", "n_shingles", "node")
    texts = known.where("text is not null").groupBy("node").agg(F.first("text").alias("text"))
    info = known.where("sketch is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    found = known.where("keys is not null").select(F.inline(F.arrays_zip(F.col("keys").alias("g"), F.col("nodes").alias("node")))).toDF("g", "node").distinct()
    # keys that the same documents share are one group; the sum of hashes stands for who they are
    groups = found.groupBy("g").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.min("node").alias("first")).where("c > 1")
    groups = groups.groupBy("c", "who", "first").agg(F.min("g").alias("g"))
    members = durable(found.join(groups.select("g", "c", "first"), "g"))
    # two pairs a document at most: with the least document that it has a group with, and with one of its smallest group
    ends = F.array(F.min("first"), F.min_by("first", F.struct("c", "g")))
    pairs = members.where("node <> first").groupBy("node").agg(ends.alias("ends")).select(F.explode("ends").alias("a"), F.col("node").alias("b")).distinct()
    tried = durable(verify(pairs, texts, size, percent))
    root = components(tried.where("linked"))
    def apart(root: DataFrame) -> DataFrame:
        """Members of groups that are not one component yet."""
        parts = members.select("g", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = parts.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
        return _tiled(parts.join(split, "g", "left_semi")).join(info, "node").select("g", "p", "q", "tile", "root", "node", "n", "sketch")

    def joined(links: DataFrame, root: DataFrame) -> DataFrame:
        return components(links.select("a", "b").unionByName(root.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    by_tiles = lambda df: df.repartition(layout.partitions, "g", "p", "q").sortWithinPartitions("g", "p", "q")
    for _ in range(ROUNDS):
        found = by_tiles(apart(root)).mapInArrow(_closest(percent), "a long, b long, differ long").groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        new = durable(verify(pairs, texts, size, percent))
        tried = tried.unionByName(new)
        if not new.where("linked").isEmpty():
            root = joined(new.where("linked"), root)
    # what is left: documents whose sketches allow a partner meet once more, with their texts, in the tasks of their tiles
    left = by_tiles(apart(root)).mapInArrow(_partnered(percent), "g long, p int, q int, tile int, root long, node long, n long, sketch binary")
    links = durable(by_tiles(left.join(texts, "node")).mapInArrow(_spanning(percent, size), "a long, b long").distinct())
    if not links.isEmpty():
        root = joined(links, root)
    return rows.join(root, "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of each row of docs.

    Words are lower-cased in A-Z only; a text of fewer than ``size`` words is one shingle; null and empty texts have none
    and link with nothing. Rows link if percent or more of their shingles' union is shared. A row with a null id takes
    part, but never names a component unless all of its rows have null ids. Rows that repeat an id are judged each on its
    own and may name different components. Other columns are ignored; an empty table gives no rows.
    """
    named = _classes(docs, id_col, text_col, size, percent, block_bytes)
    # Documents of equal sets are linked; texts without shingles stand alone.
    least = named.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "class", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, block_bytes: int = 4 << 20) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest id (null last; then by the text's hash).

    Rows without shingles stay. Rows that repeat both id and text count as one, whichever it is.
    """
    named = _classes(docs, id_col, text_col, size, percent, block_bytes)
    first = named.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m"))
    stay = first.select(F.col("m.doc_id").alias("_d"), F.col("m.text_hash").alias("_t")).unionByName(named.where("n_shingles = 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct())
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_d2"), F.xxhash64(text_col).alias("_t2"))
    found = keyed.join(stay, F.col("_d2").eqNullSafe(F.col("_d")) & (F.col("_t2") == F.col("_t")), "left_semi")
    # of rows that repeat both, the one whose other columns come first in a fixed order, so that a retry gives the same
    return found.groupBy("_d2", "_t2").agg(F.min_by("_row", F.xxhash64(*(F.col(f"_row.`{c}`") for c in docs.columns if c != text_col))).alias("_row")).select("_row.*")
