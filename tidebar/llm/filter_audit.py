"""What each of several document filters removes, in every order of them, from joint failures alone."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import durable, words

FILTERS = "ABCDE"
OUT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that a text alone decides. A: under 50 words; B: distinct words are under 65% of the words; C: over 5% of the
    code points are A-Z; D: a symbol. An empty text fails A only."""
    ws = words(text)
    return {
        "A": F.size(ws) < 50,
        "B": 100 * F.size(F.array_distinct(ws)) < 65 * F.size(ws),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and one boolean for each of FILTERS of each row of docs; E: the text is that of a smaller id.

    Texts are compared by SHA-256. Null texts are empty, null parts the empty string. The copies of a text meet in no task:
    the least id of each text is found with partial aggregates, and joined back by text and id, so that of a group of
    copies one row finds a partner. Rows that repeat a text's least id pass E, and so do null ids, which are no smaller and
    no larger than others. Texts are read once; what follows works on rows of a hash and a few flags.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = text_failures(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), *(c.alias(k) for k, c in own.items()))
    rows = durable(rows)
    first = rows.groupBy(F.col("same").alias("of")).agg(F.min("doc_id").alias("least")).where("least is not null")
    found = rows.join(first, (F.col("same") == F.col("of")) & (F.col("doc_id") == F.col("least")), "left")
    return found.select("doc_id", "part", *own, (F.col("doc_id").isNotNull() & F.col("least").isNull()).alias("E"))


def subsets(n: int) -> list[int]:
    return list(range(1 << n))


def joint_failures(rows: DataFrame, filters: str, weights: dict[str, Column], by: str = "part") -> DataFrame:
    """A row for each part: for each weight an array with the weighted rows that fail all filters of a set, for every set.

    A set is a bit mask, the place in the array; filter k is bit k. Each count is the sum of a product of flags, so that
    partial aggregates of fixed size are all that is shuffled, however the rows are spread over parts.
    """
    sets = subsets(len(filters))
    flags = rows.select(by, *(F.col(f).cast("long").alias(f"f{k}") for k, f in enumerate(filters)), *(w.cast("long").alias(name) for name, w in weights.items()))
    product = lambda s, name: " * ".join([name, *(f"f{k}" for k in range(len(filters)) if s >> k & 1)])
    sums = flags.groupBy(by).agg(*(F.expr(f"sum({product(s, name)})").alias(f"{name}{s}") for name in weights for s in sets))
    return sums.select(by, *(F.expr(f"array({', '.join(f'{name}{s}' for s in sets)})").alias(name) for name in weights))


def _signed(joint: str, sums: list[list[tuple[int, int]]]) -> Column:
    """An array with a number for each of sums: factor * joint[set] over its terms (set, factor)."""
    one = lambda terms: " + ".join(f"{factor}L * {joint}[{s}]" for s, factor in terms)
    return F.expr(f"array({', '.join(map(one, sums))})")


def survivors(joint: str, n: int) -> Column:
    """For every set of filters, how many pass all of it: the Moebius inversion over the set's own subsets."""
    return _signed(joint, [[(s, (-1) ** s.bit_count()) for s in subsets(n) if s & p == s] for p in subsets(n)])


def only(joint: str, n: int) -> Column:
    """For each filter, how many fail it and no other: the inversion over the sets that hold it."""
    return _signed(joint, [[(s, (-1) ** (s.bit_count() - 1)) for s in subsets(n) if s >> k & 1] for k in range(n)])


def shapley(joint: str, n: int) -> Column:
    """For each filter, how many it removes summed over all n! orders: each set's Harsanyi dividend of "removed by any of
    them", which is its joint failures with the sign of inclusion and exclusion, is shared equally within the set."""
    share = lambda s: (-1) ** (s.bit_count() + 1) * factorial(n) // s.bit_count()
    return _signed(joint, [[(s, share(s)) for s in subsets(n) if s >> k & 1] for k in range(n)])


def interactions(rows: DataFrame, filters: str, good: Column, toxic: Column, by: str = "part") -> DataFrame:
    """OUT for each part, order of filters and step: what filters do that are applied from left to right.

    rows: a boolean for each letter of filters, true where the row fails it; good and toxic: booleans. kept: rows left
    after the step; removed: by it; redundant: fail its filter, removed earlier; unique_fails: fail its filter only;
    good_lost, toxic_lost: such rows removed; shapley: removed by its filter, summed over all orders. No rows are read
    twice for that: all comes from the joint failures of each part. No rows give no rows.
    """
    n = len(filters)
    joint = joint_failures(rows, filters, {"n": F.lit(1), "good": good, "toxic": toxic}, by)
    parts = joint.select(
        F.col(by).alias("part"), *(survivors(w, n).alias(f"left_{w}") for w in ("n", "good", "toxic")),
        F.array(*(F.col("n")[1 << k] for k in range(n))).alias("fail"), only("n", n).alias("only"), shapley("n", n).alias("shapley"),
    )
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = [F.instr("filter_order", f) for f in filters]
    mask = lambda test: sum((F.when(test(p), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    steps = steps.select("*", mask(lambda p: p < F.col("step")).alias("before"), mask(lambda p: p <= F.col("step")).alias("after"), own.alias("own"))
    lost = lambda w: F.col(f"left_{w}")[F.col("before")] - F.col(f"left_{w}")[F.col("after")]
    of = lambda name: F.col(name)[F.col("own")]
    return steps.select(
        "part", "filter_order", "step", F.col("left_n")[F.col("after")].alias("kept"), lost("n").alias("removed"), (of("fail") - lost("n")).alias("redundant"),
        of("only").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), of("shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """OUT of the five FILTERS over docs, for each value of part_col, all orders and steps, zeros included.

    labels: id, quality and toxic; good is quality 1, toxic is toxic 1. Of several labels of an id any may say so; null ids
    and documents without a label are neither. Repeated rows count each. Other columns are ignored. A null or empty text
    fails A, and E if a smaller id has one too; texts of any length are read whole. An empty table of documents gives no
    rows; without labels nothing is lost.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("of")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, id_col, text_col, part_col)
    rows = rows.join(said, F.col("doc_id") == F.col("of"), "left").select("part", *FILTERS, *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    return interactions(rows, FILTERS, F.col("good"), F.col("toxic"))
