"""Quality classifier: ordinal cumulative-link regression on hashed words.

A document's score is the sum of the weights of its distinct words and of a few shapes; P(grade >= k) is the logistic
function of score - threshold k, with ordered thresholds shared by all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import labelled

#: Words that a task remembers the features of, and how long a word may be to be remembered.
_MEMORY, _WORD = 200_000, 64
_STRIP = b".,;:!?'\"()[]{}-"
_SYMBOLS = frozenset(b"#*$%&|<>")
#: Shapes of words; a document has a feature for the share of its words (in tenths, rounded up) of each.
SHAPES = ("symbols", "capitals", "digits", "cries")


#: Beginnings of words that count as features besides the words: they carry over to inflections and compounds.
PREFIXES = (4, 6)


def _word(raw: bytes, bits: int) -> tuple[int, ...]:
    """Hashed places of the word and its beginnings, then its shapes as bits."""
    shape = 0
    if not _SYMBOLS.isdisjoint(raw):
        shape |= 1
    core = raw.strip(_STRIP)
    if len(core) > 1 and core.isupper():
        shape |= 2
    if any(48 <= c <= 57 for c in raw):
        shape |= 4
    if raw.endswith(b"!"):
        shape |= 8
    text = core.decode().lower()
    parts = [text, *(f"{text[:n]}\0{n}" if len(text) > n else text for n in PREFIXES)]
    return (*(xxhash.xxh3_64_intdigest(p) & ((1 << bits) - 1) for p in parts), shape)


class Features:
    """Distinct features of texts as numbers below 2**bits + 11 * len(SHAPES)."""

    def __init__(self, bits: int):
        self.bits, self.known = bits, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().split()
        if len(self.known) > _MEMORY:
            self.known.clear()
        known = self.known
        long = {w: _word(w, self.bits) for w in set(words).difference(known)}
        rows = np.array([known[w] if w in known else long[w] for w in words], np.int64).reshape(-1, 2 + len(PREFIXES))
        known.update((w, x) for w, x in long.items() if len(w) <= _WORD)
        out = [np.unique(rows[:, :-1])]
        for k in range(len(SHAPES)):
            n = int((rows[:, -1] >> k & 1).sum())
            tenths = -(-10 * n // len(words)) if words else 0
            out.append(np.array([(1 << self.bits) + 11 * k + tenths]))
        return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    bits: int
    weights: bytes  # float32
    thresholds: tuple[float, ...]


def thresholds(par: np.ndarray) -> np.ndarray:
    """Ordered thresholds of free parameters: the first as it is, the others by positive steps."""
    return np.r_[par[0], par[0] + np.cumsum(np.exp(par[1:]))]


def gradient(w: np.ndarray, par: np.ndarray, flat: np.ndarray, doc: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of the grades y (minus log likelihood, and half the decay times the squared weights), and its slopes along
    w and par. flat, doc: a feature and its document, for every feature of every document."""
    n, n_grades = len(y), len(par) + 1
    theta, at = thresholds(par), np.arange(n)
    s = np.bincount(doc, w[flat], minlength=n)
    tail = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30)))
    edge = np.c_[np.ones(n), tail, np.zeros(n)]
    p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-9)
    slope = edge * (1 - edge)
    up, down = slope[at, y] / p / max(n, 1), slope[at, y + 1] / p / max(n, 1)
    g_w = np.bincount(flat, (down - up)[doc], minlength=len(w)) + decay * w
    g_theta = np.zeros(n_grades - 1)
    np.add.at(g_theta, y[y > 0] - 1, up[y > 0])
    np.add.at(g_theta, y[y < n_grades - 1], -down[y < n_grades - 1])
    g_par = np.r_[g_theta.sum(), np.cumsum(g_theta[:0:-1])[::-1] * np.exp(par[1:])]
    return float(-np.log(p).sum() / max(n, 1) + decay * (w @ w) / 2), g_w, g_par


def train(texts: list[str], grades: list[int], n_grades: int, bits: int, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4, min_docs: int = 5, min_z: float = 5.5) -> Model:
    """Full-batch Adam on the likelihood of the grades; deterministic. Only features of min_docs texts or more get a weight,
    and only if their texts' mean grade lies min_z standard errors or more from the mean of all. Without texts all weights
    are 0 and every grade is as likely."""
    size = (1 << bits) + 11 * len(SHAPES)
    if not texts:
        return Model(bits, np.zeros(size, "<f4").tobytes(), tuple(float(np.log(k / (n_grades - k))) for k in range(1, n_grades)))
    features = Features(bits)
    rows = [features(t) for t in texts]
    y = np.array(grades, np.int64)
    flat = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = np.bincount(flat, minlength=size)
    shift = np.bincount(flat, (y - y.mean())[doc], minlength=size)
    often = (n >= min_docs) & (np.abs(shift) >= min_z * y.std() * np.sqrt(n))
    flat, doc = flat[often[flat]], doc[often[flat]]
    w = np.zeros(size)
    share = [min(max((y >= k).mean(), 0.01), 0.99) for k in range(1, n_grades)]
    start = np.maximum.accumulate([-np.log(s / (1 - s)) for s in share])
    par = np.r_[start[0], np.log(np.maximum(np.diff(start), 0.1))]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(par), np.zeros_like(par)]
    for t in range(1, rounds + 1):
        _, g_w, g_par = gradient(w, par, flat, doc, y, decay)
        for x, g, m, v in ((w, g_w, 0, 1), (par, g_par, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * g
            state[v] = 0.999 * state[v] + 0.001 * g * g
            x -= rate * (state[m] / (1 - 0.9**t)) / (np.sqrt(state[v] / (1 - 0.999**t)) + 1e-8)
    return Model(bits, w.astype("<f4").tobytes(), tuple(map(float, thresholds(par))))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_labels: int = 20_000, max_bytes: int = 1 << 27, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from rated documents, at most max_labels of max_bytes in all (common.labelled says which), trained in one
    task. What comes back to the driver are 2**bits weights.

    ratings: id and grade. Null grades, and grades outside 0 to n_grades - 1, are left out. Without rated documents the
    model says the same of every text.
    """
    grade = F.col("grade").cast("int")
    known = labelled(docs, ratings.where(grade.between(0, n_grades - 1)), grade, id_col, text_col, max_labels, max_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["label"].to_pylist()))
        if rows:
            model = train([r[1] for r in rows], [r[2] for r in rows], n_grades, bits)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights], pa.binary()), pa.array([list(model.thresholds)], pa.list_(pa.float64()))], ["weights", "thresholds"])

    row = known.repartition(1).mapInArrow(learn, "weights binary, thresholds array<double>").first()
    return Model(bits, bytes(row["weights"]), tuple(row["thresholds"])) if row else train([], [], n_grades, bits)


def score(docs: DataFrame, model: Model, at_least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of grade at_least or more) and kept (tail_probability >= 0.5) of each row.

    Whole texts count. Null and empty texts have no words and get what the shapes' features say. Ids pass through, null
    or not; repeated rows get equal scores. Other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights, theta, features = np.frombuffer(m.weights, "<f4").astype(float), np.array(m.thresholds), Features(m.bits)
        for batch in batches:
            s = np.array([weights[features(t)].sum() for t in batch["text"].to_pylist()]).reshape(-1, 1)
            tail = 1 / (1 + np.exp(-np.clip(s - theta, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(tail.sum(1)), pa.array(tail[:, at_least - 1])], ["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(rate, "doc_id long, expected_grade double, tail_probability double").withColumn("kept", F.col("tail_probability") >= 0.5)
