"""Token counts with the tokenizer's own library, without moving tokens to Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level tokenizer's pattern never matches across a space that follows a visible character, as the space starts
#: the next piece, nor from a letter on to a full stop and the like. Texts may be cut there without changing a token.
#: (U+180E is white space to some libraries only.)
BOUNDARY = re.compile("(?<=[^\\s\u180e])(?= )|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[,.;:!?])")
#: Bytes of pieces that a task remembers the length of, and how long a piece may be to be remembered.
MEMORY, PIECE = 64 << 20, 256
#: Bytes to a batch that is given to the library at once.
BATCH_BYTES = 1 << 18


def cuttable(path: str) -> bool:
    """Whether a tokenizer's file is byte-level with the usual pattern, changes no text before it, and has no added token that
    reaches over a boundary (by what it contains, or by taking the space beside it): then BOUNDARY holds."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    for token in model.get("added_tokens") or []:
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word") or BOUNDARY.search(f"x{token['content']}x", 1, len(token["content"]) + 1):
            return False
    pre = model.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and model.get("normalizer") is None


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def batches(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Texts in order, in batches of about limit bytes; a longer text is a batch of its own."""
    batch, size = [], 0
    for t in texts:
        n = n_bytes(t)
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += n
    if batch:
        yield batch


class Counter:
    """Counts tokens of texts. Long texts are split at safe boundaries; the pieces go to the library in batches of about
    equal bytes, and only lengths come back. Short pieces are remembered, in bounded memory, so that each goes there once.

    Texts of a tokenizer that BOUNDARY does not hold for, and pieces without a boundary, go to the library whole.
    """

    def __init__(self, path: str, kind: str):
        if kind == "tokenizers":
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.cut = BOUNDARY.split if cuttable(path) else lambda text: [text]
        elif kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.cut = lambda text: [text]  # its pieces are normalised across spaces
        else:
            raise ValueError(f"unknown kind {kind!r}")
        self.known: dict[str, int] = {"": 0}
        self.held = 0

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        known, new = self.known, []
        for batch in batches(set().union(*cut) - known.keys(), BATCH_BYTES):
            known.update(zip(batch, self.encode(batch)))
            new += batch
        out = [sum(map(known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > PIECE:
                del known[p]
            else:
                self.held += len(p) + 100
        if self.held > MEMORY:
            self.known, self.held = {"": 0}, 0
        return out


def token_counts(docs: DataFrame, path: str, kind: str = "tokenizers", id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of docs, in whole texts.

    Begin, end and added tokens are not counted; special strings inside texts are read as the library reads them by
    default. path: of the tokenizer's file, on every executor; kind: tokenizers, for a .json, or sentencepiece.
    Null and empty texts have no bytes and no tokens. Ids pass through, null or not; repeated rows are counted each. Other
    columns are ignored. An empty table gives no rows.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in parts:
            counter = counter or Counter(path, kind)
            texts = batch["text"].to_pylist()
            n = [x for part in batches(texts, 1 << 20) for x in counter.count(part)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
