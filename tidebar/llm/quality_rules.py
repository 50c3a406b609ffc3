"""Quality rules: a decision list that is learned from labelled statistics and applied as Spark conditions.

Sequential covering: a rule is a conjunction of thresholds, grown condition by condition on two thirds of the labelled
documents and pruned on the rest; what it covers is taken away, and the next rule is grown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import U64, labelled, mix, window_hashes

SYMBOLS = "#*$%&|<>"
SPAN = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper", "n_marks"]
#: What rules may ask about: ratios, so that a rule holds for short and long texts alike.
FEATURES = {
    "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0), 0)",
    "dup_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
    "repeat_share": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
    "word_length": "coalesce(word_chars / nullif(n_words, 0), 0)",
    "upper_share": "coalesce(n_upper / nullif(word_chars, 0), 0)",
    "marks_per_word": "coalesce(n_marks / nullif(n_words, 0), 0)",
    "words": "cast(n_words as double)",
}


def _counts(texts: list[str]) -> list[np.ndarray]:
    words = [t.encode().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), U64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(doc))
    at = np.flatnonzero(left >= SPAN)
    key = mix(window_hashes(h, SPAN, 0x2545F4914F6CDD1D)[at] ^ mix(doc[at].astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + SPAN, -1)
    repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(n))
    out = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        gaps = sum(map(t.count, " \t\n\v\f\r"))
        out.append((len(t) - gaps, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), sum(map(str.isupper, t)), t.count("!") + t.count("?")))
    chars, symbols, dups, lines, upper, marks = np.array(out, np.int64).reshape(-1, 6).T
    return [n, chars, symbols, dups, repeat.astype(np.int64), lines, upper, marks]


def _in_parts(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, in parts of about limit characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _count(text: pa.Array) -> pa.Array:
    parts = [_counts(p) for p in _in_parts(text.to_pylist())]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, COUNTS and base_failed of each row of docs, from whole texts; null is empty.

    Only texts go to Python; the kept columns stay in Spark.
    """
    # not deterministic, so that Spark does not run it once for a filter and again for the columns
    count = F.arrow_udf(_count, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), count(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"))
    out = counted.select("doc_id", *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_n.*")
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


@dataclass(frozen=True)
class Rule:
    """A document that meets all conditions is rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return F.expr(" and ".join(f"{FEATURES[f]} {op} {x!r}D" for f, op, x in self.conditions))


def _covered(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for f, op, cut in conditions:
        out &= x[f] > cut if op == ">" else x[f] <= cut
    return out


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 8, max_conditions: int = 3, min_covered: int = 5, min_precision: float = 0.95, cuts: int = 64) -> list[Rule]:
    """The decision list: rows has the FEATURES of labelled documents, bad their labels. Deterministic."""
    x = {f: rows[f].astype(float) for f in FEATURES}
    n = len(bad)
    prune_set = np.arange(n) % 3 == 2
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow = left & ~prune_set
        conditions: list[tuple[str, str, float]] = []
        inside = grow.copy()
        while len(conditions) < max_conditions:
            p, q = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p or not q:
                break
            best, here = None, np.log2(p / (p + q))
            for f in FEATURES:
                values = np.unique(np.quantile(x[f][inside], np.linspace(0, 1, cuts)))
                for cut in (values[1:] + values[:-1]) / 2:
                    for op, side in ((">", x[f] > cut), ("<=", x[f] <= cut)):
                        p1, q1 = int((inside & side & bad).sum()), int((inside & side & ~bad).sum())
                        if p1:
                            gain = p1 * (np.log2(p1 / (p1 + q1)) - here)
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, (f, op, float(cut))
            if best is None or best[0] <= 1e-9:
                break
            conditions.append(best[1])
            inside &= _covered(x, [best[1]])
        check = left & prune_set

        def worth(c) -> float:
            hit = check & _covered(x, c)
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        if not conditions:
            break
        hit = left & _covered(x, conditions)
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + q < min_covered or p / (p + q) < min_precision or worth(conditions) <= 0:
            break
        rules.append(Rule(tuple(conditions), p / (p + q), p + q))
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, max_bytes: int = 1 << 27, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> list[Rule]:
    """Rules learned from labelled documents, at most max_labels of max_bytes in all (common.labelled says which).

    labels: id and label (0 is bad, null is ignored). Documents that the base rules reject teach nothing; without labelled
    documents there are no rules.
    """
    known = labelled(docs, labels, F.col(label_col), id_col, text_col, max_labels, max_bytes)
    stats = statistics(known, "id", "text", ("label",)).where("not base_failed")
    rows = stats.select("doc_id", "label", *(F.expr(e).alias(f) for f, e in FEATURES.items())).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(["doc_id", *FEATURES]).reset_index(drop=True)
    return learn({f: rows[f].to_numpy() for f in FEATURES}, rows["label"].to_numpy() == 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """True for documents to keep: the rules in order, as one Spark expression."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """statistics of each row of docs with kept: false where the base rules or a learned rule reject it.

    Null and empty texts fail the base rules (no words). Ids pass through, null or not; repeated rows are judged each.
    Columns outside keep are ignored; an empty table gives no rows. A text may be of any length.
    """
    return statistics(docs, id_col, text_col, keep).withColumn("kept", verdict(rules))
