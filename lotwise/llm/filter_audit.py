"""Interaction of corpus filters: who removes what, in any order, from one pass over the documents.

Each document has a flag for each filter that it fails. Joint-failure counts J(S), how many documents fail all filters of a set S, are sums of products of flags, one for each of the
2**k sets, over all documents of a part at once. All else follows from them without looking at a document again. Inclusion and exclusion (Möbius inversion) gives the survivors of any set U,
the sum over T in U of (-1)**|T| J(T), so every order of the filters is read off; and the documents that fail one filter only, the sum over T with f of (-1)**(|T|-1) J(T). The same signed counts are
the Harsanyi dividends of the game "documents removed", so a filter's Shapley value is the sum of its dividends, each divided by the size of its set.

A text is the copy of another if a row of smaller id has it. Copies are never joined: a text's rows are first summed by part, with those of its least id apart.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common as C

#: What is counted of each set: all documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides."""
    words = C.words(text)

    def judged(w: Column) -> Column:
        return F.struct((F.size(w) < 100).alias("A"), (100 * F.size(F.array_distinct(w)) < 80 * F.size(w)).alias("B"))

    both = C.let(words, judged)
    capitals = F.length(text) - F.length(F.translate(text, C.UPPER, ""))
    return {"A": both["A"], "B": both["B"], "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _texts(docs: DataFrame) -> DataFrame:
    """(part, id, digest, A to D) of each row; equal texts have equal digests (128 bits)."""
    read = docs.select(F.coalesce(C.quoted("lang").cast("string"), F.lit("")).alias("part"), C.quoted("doc_id").alias("id"), F.coalesce(C.quoted("text"), F.lit("")).alias("text"))
    judged = C.computed(read, {"digest": F.unhex(F.md5("text")), "flags": F.struct(*[v.alias(k) for k, v in text_flags(F.col("text")).items()])})
    return judged.select("part", "id", "digest", *[F.col("flags")[k].cast("long").alias(k) for k in "ABCD"])


def _labels(labels: DataFrame) -> DataFrame:
    """(id, good, toxic) with one row for each id; of repeated labels any 1 counts."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    return labels.groupBy(F.col("doc_id").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, n, good, toxic): flags, and how many rows of ``docs`` have them. Rows of a text are two at most for each part: those that are copies and those that are not."""
    keys = ["digest", "part", "A", "B", "C", "D"]
    rows = _texts(docs).groupBy(*keys, "id").agg(F.count("*").alias("n"))
    rows = rows.join(_labels(labels), "id", "left").select(*keys, F.struct(F.col("id").isNull().alias("last"), "id").alias("who"), "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    low = F.min(F.struct("who", *COUNTS)).alias("low")
    by_text = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], low)
    least = F.min("low.who").over(Window.partitionBy("digest"))  # a text has one row here for each part
    met = by_text.withColumn("own", F.col("low.who") == least)
    first = {c: F.when(F.col("own"), F.col(f"low.{c}")).otherwise(F.lit(0)) for c in COUNTS}
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("E"), *[v.alias(c) for c, v in first.items()]), F.struct(F.lit(1).cast("long").alias("E"), *[(F.col(c) - v).alias(c) for c, v in first.items()]))
    return met.select("part", *"ABCD", F.explode(kinds).alias("kind")).select("part", *"ABCD", "kind.*").where("n > 0")


def joint_failures(flags: DataFrame, filters: str) -> DataFrame:
    """(part, n, good, toxic): for each count the array of J(S), S by its bits (the first filter is bit 0). ``flags`` has a 0 or 1 (long) for each filter and the counts."""

    def failing_all(s: int, what: str) -> Column:
        return F.coalesce(F.sum(reduce(lambda a, f: a * F.col(f), [f for i, f in enumerate(filters) if s >> i & 1], F.col(what))), F.lit(0))

    sums = flags.groupBy("part").agg(*[failing_all(s, c).alias(f"{c}_{s}") for c in COUNTS for s in range(2 ** len(filters))])
    return sums.select("part", *[F.array(*[F.col(f"{c}_{s}") for s in range(2 ** len(filters))]).alias(c) for c in COUNTS])


def _products(joint: Column, weights: list[list[int]]) -> Column:
    """The sums of J times each row of weights."""
    dot = lambda row: F.aggregate(F.zip_with(joint, row, lambda j, w: j * w), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.array(*[F.lit(row).cast("array<long>") for row in weights]), dot)


def audit(joint: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order of all filters and step of it.

    shapley is the filter's removals summed over all orders, k! times its Shapley value.
    """
    k, every = len(filters), range(2 ** len(filters))
    size = lambda s: bin(s).count("1")
    inside = [[(-1) ** size(t) if t & u == t else 0 for t in every] for u in every]
    alone = [[(-1) ** (size(t) - 1) if t >> f & 1 else 0 for t in every] for f in range(k)]
    dividends = [[w * math.factorial(k) // size(t) if w else 0 for t, w in enumerate(row)] for row in alone]
    sums = {f"{c}_left": _products(F.col(c), inside) for c in COUNTS} | {"alone": _products(F.col("n"), alone), "shapley": _products(F.col("n"), dividends)}
    whole = C.computed(joint, sums)
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(filters))), ",")
    rows = whole.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = lambda i: F.pow(F.lit(2.0), F.instr(F.lit(filters), F.substring(F.col("filter_order"), i, F.lit(1))) - 1).cast("int")
    until = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, i: a.bitwiseOR(bit(i)))
    rows = C.computed(rows, {"now": until, "own": bit(F.col("step"))})
    rows = C.computed(rows, {"before": F.col("now") - F.col("own"), "f": F.log2(F.col("own").cast("double")).cast("int")})
    lost = lambda c: F.get(f"{c}_left", "before") - F.get(f"{c}_left", "now")
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n_left", "now").alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", "own") - lost("n")).alias("redundant"),
        F.get("alone", "f").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", "f").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E (see ``audit``) over ``docs`` with doc_id, text and lang, a part for each lang.

    A null text is empty, a null lang is the part "". Rows count one by one, repeated rows each; a row is a copy (E) if a row with a smaller id has its text, in whatever part; a null id is larger
    than all others, so rows of equal ids (ties) are no copies of each other. Documents without a label are neither good nor toxic; of repeated or contradicting labels any 1 counts; labels
    of no document count nowhere. Very long texts are judged whole. An empty table has no parts and an empty result. Other columns are not looked at.
    """
    return audit(joint_failures(flagged(docs, labels), "ABCDE"), "ABCDE")
