"""Chat formatting: conversations rebuilt from logged events, rendered with a template, and read back.

Events have a conversation, a message (its place in the conversation), a sequence number, a kind and a text:

- message: the message's whole text, with its role
- delta: text that is appended to the message
- edit: a new whole text
- regenerate: the message starts anew, from nothing
- delete: the message is gone

The last message, edit, regenerate or delete of a message counts, and the deltas after it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Control strings of the template; a turn is OPEN role BODY text CLOSE.
OPEN, BODY, END_BODY, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = {"\\": "\\\\"} | {c: f"\\{k}" for k, c in enumerate(CONTROL)}
_PLAIN = {v: k for k, v in _ESCAPE.items()}
_FIND = re.compile("|".join(map(re.escape, sorted(_ESCAPE, key=len, reverse=True))))
_BACK = re.compile(r"\\[\\0-9]")
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(END_BODY)}{re.escape(CLOSE)}", re.DOTALL)
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    """Control strings and backslashes become backslash codes; unescape gives the text back."""
    return _FIND.sub(lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _PLAIN[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and from where to where its text lies in it."""
    head = f"{OPEN}{escape(role)}{BODY}"
    body = escape(text)
    return f"{head}{body}{END_BODY}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a rendered turn")
    return unescape(m[1]), unescape(m[2])


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, message, part (number of the row in its message's group), role, text: what events leave of each message.

    events: conv_id, message, seq, kind, role, text. Events of a message with equal seq come in the order of kind, role and
    text; null texts are empty. Two messages with the same place in a conversation are separate if the log has a message
    event for each: they stand one after the other, as conversations logged without message numbers may hold.
    """
    e = events.select("conv_id", "message", "seq", F.lower(F.coalesce("kind", F.lit("message"))).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("seq", "kind", "role", "text")]
    w = W.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("part", F.sum((F.col("kind") == "message").cast("long")).over(w))
    each = W.partitionBy("conv_id", "message", "part").orderBy(*order)
    e = e.withColumn("at", F.row_number().over(each)).withColumn("version", F.sum(F.col("kind").isin(*RESETS).cast("long")).over(each.rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("last", F.max("version").over(W.partitionBy("conv_id", "message", "part"))).withColumn("first_role", F.first(F.nullif("role", F.lit("")), ignorenulls=True).over(each.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    alive = e.where("version = last")
    folded = alive.groupBy("conv_id", "message", "part").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("x"), F.first("first_role").alias("role"))
    # a regenerate or delete event brings no text of its own
    text = F.array_join(F.transform("x", lambda v: F.when(v["kind"].isin("regenerate", "delete"), F.lit("")).otherwise(v["text"])), "")
    return folded.where(F.col("x")[0]["kind"] != "delete").select("conv_id", "message", "part", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def format_chat(events: DataFrame) -> DataFrame:
    """conv_id, message, part, formatted, loss_from, loss_to: a rendered turn for each message that events leave.

    A conversation's output is its turns one after another, by message and part. The loss mask is the text of assistant
    turns, as code point offsets in the turn (0, 0 for others). A null conv_id is a conversation; null or repeated message
    numbers, null roles and texts and an empty log are handled as final_messages says. Other columns are ignored. A turn is
    a row, so that a conversation of any length needs no more memory than its longest message.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
            spoken = [r == "assistant" for r in batch["role"].to_pylist()]
            lo = pa.array([x[1] if s else 0 for x, s in zip(out, spoken)], pa.int64())
            hi = pa.array([x[2] if s else 0 for x, s in zip(out, spoken)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["message"], batch["part"], pa.array([x[0] for x in out], pa.string()), lo, hi], ["conv_id", "message", "part", "formatted", "loss_from", "loss_to"])

    return final_messages(events).mapInArrow(turns, "conv_id long, message long, part long, formatted string, loss_from long, loss_to long")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from rendered turns.

    Turns stream through in order; only running digests are kept, one conversation after another.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = object(), None

        def close() -> pa.RecordBatch:
            values = [now, row[0], row[1].hexdigest(), row[2], row[3].hexdigest(), row[4]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        done = []
        for batch in batches:
            for conv, text, lo, hi in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                if row is None or conv != now:
                    if row is not None:
                        done.append(close())
                    now, row = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse(text)
                loss = unescape(text[lo:hi])
                row[0] += 1
                row[1].update(f"{role}\n{said}\n".encode())
                row[2] += len(loss)
                row[3].update(loss.encode())
                row[4] += len(text)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if row is not None:
            yield close()

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "message", "part", "formatted").mapInArrow(read, schema)
