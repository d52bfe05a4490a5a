"""Line dedup: lines that many documents hold, or all but a line's first occurrence, marked in one small bitmap per document.

Every line becomes a row (hash, slice, document, position). The rows are range-partitioned by hash and slice and sorted by document and position inside, so a key's
occurrences stream by in order: a row is the first of its document if the row before it is of another. A slice is a fixed share of the documents, so the rows of one key, however many
documents hold it, stand in many ranges; the slices' counts and first occurrences are then added up, one row for each. The positions that go come back to their documents as run lengths of
kept and dropped lines. Texts are never grouped or sorted; whoever wants them applies the bitmap (``kept_text``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common as C

#: What is stripped from both ends of a line, and the bytes of a run length.
BLANKS = " \t\n\x0b\x0c\r"
_GROUPS = 5


@dataclass(frozen=True)
class LineParams:
    """min_docs: a key in so many documents is common. min_chars: shorter keys are never common. keep: "none" drops all lines of common keys, "first" keeps the first
    occurrence (least document, then position). slices: parts of the documents over which the rows of one key are spread."""

    min_docs: int = 10
    min_chars: int = 1
    keep: str = "none"
    slices: int = 1024


def line_keys(text: Column) -> Column:
    """The lines of a text as they are compared: ends stripped, A-Z lower-cased. Null is one empty line."""
    return F.transform(F.split(C.ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _varint(n: Column) -> Column:
    """Hex of a number in bytes of seven bits, low ones first; the top bit says that more follow."""
    more = lambda i: F.when(F.shiftrightunsigned(n, 7 * (i + 1)) > 0, F.lit(128)).otherwise(F.lit(0))
    byte = lambda i: F.lpad(F.hex((F.shiftrightunsigned(n, 7 * i).bitwiseAND(127) + more(i)).cast("long")), 2, "0")
    return F.concat(byte(0), *[F.when(F.shiftrightunsigned(n, 7 * i) > 0, byte(i)).otherwise("") for i in range(1, _GROUPS)])


def bitmap(dropped: Column, n: Column) -> Column:
    """The keep bitmap of ``n`` lines: binary run lengths, of kept and of dropped lines by turns, the first of kept ones. ``dropped``: ascending positions."""
    edges = F.filter(
        F.flatten(F.transform(dropped, lambda p, i: F.array(F.when((i == 0) | (F.get(dropped, i - 1) != p - 1), p), F.when((i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1), p + 1)))),
        lambda x: x.isNotNull(),
    )
    bounds = F.when(F.element_at(edges, -1) == n, edges).otherwise(F.concat(edges, F.array(n)))
    runs = lambda b: F.transform(b, lambda x, i: _varint(x - F.coalesce(F.get(b, i - 1), F.lit(0))))
    return F.unhex(F.when(F.size(dropped) == 0, _varint(n)).otherwise(F.array_join(C.let(bounds, runs), "")))


def run_lengths(keep: Column) -> Column:
    """The run lengths of a keep bitmap."""
    digits = F.hex(keep)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int")
    none = F.struct(F.array().cast("array<int>").alias("runs"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(a: Column, b: Column) -> Column:
        n = a["n"] + (b.bitwiseAND(127) * F.pow(F.lit(2.0), a["at"] * 7).cast("int"))
        return F.when(b >= 128, F.struct(a["runs"].alias("runs"), n.alias("n"), (a["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(a["runs"], F.array(n)).alias("runs"), F.lit(0).alias("n"), F.lit(0).alias("at"))
        )

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(keep) - 1), byte), none, step, lambda a: a["runs"])


def kept_text(text: Column, keep: Column) -> Column:
    """A text without the lines that its bitmap drops, the others as they were, joined by line feeds."""
    whole = F.coalesce(text, F.lit(""))

    def joined(x: Column) -> Column:
        lines, runs = x["lines"], x["runs"]
        begins = F.aggregate(runs, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r)))
        parts = C.let(begins, lambda b: F.filter(F.transform(runs, lambda r, i: F.when(i % 2 == 0, F.slice(lines, F.get(b, i) + 1, r))), lambda p: p.isNotNull()))
        return F.array_join(F.flatten(parts), "\n")

    both = F.struct(F.split(whole, "\n").alias("lines"), run_lengths(keep).alias("runs"))
    return F.when(F.length(keep) <= 1, F.when(keep == F.unhex(F.lit("00")), F.lit("")).otherwise(whole)).otherwise(C.let(both, joined))


def line_rows(docs: DataFrame, params: LineParams) -> DataFrame:
    """(h, g, slice, doc, body, pos): 96 bits of hash of each line that can be common, and where it stands. ``body`` tells texts of one id apart."""
    own = docs.select(C.quoted("doc_id").alias("doc"), F.xxhash64(C.quoted("text")).alias("body"), F.posexplode(line_keys(C.quoted("text"))).alias("pos", "key"))
    long_enough = F.col("key") != "" if params.min_chars <= 1 else F.length("key") >= params.min_chars
    share = F.pmod(F.xxhash64("doc"), F.lit(params.slices)).cast("int")
    return own.where(long_enough).select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), share.alias("slice"), "doc", "body", "pos")


def common_lines(rows: DataFrame, params: LineParams) -> DataFrame:
    """(h, g, slice, first): the slices of the keys that ``min_docs`` documents or more hold, and where the key stands first, (last, doc, pos); a null id is last. ``rows``: cut rows of ``line_rows``."""
    laid = rows.select("h", "g", "slice", F.col("doc").isNull().alias("last"), "doc", "pos").repartitionByRange("h", "g", "slice")
    stream = Window.partitionBy("h", "g", "slice").orderBy("last", "doc", "pos")
    marked = laid.withColumns({"nth": F.row_number().over(stream), "before": F.lag("doc").over(stream)})
    firsts = marked.where((F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col("doc")))
    slices = firsts.groupBy("h", "g", "slice").agg(F.count("*").alias("docs"), F.min(F.struct("last", "doc", "pos")).alias("first"))
    key = Window.partitionBy("h", "g")  # no more rows than slices
    totals = slices.select("h", "g", "slice", F.sum("docs").over(key).alias("docs"), F.min("first").over(key).alias("first"))
    return totals.where(F.col("docs") >= params.min_docs).drop("docs")


def line_dedup(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """All columns of ``docs`` and: n_lines, n_dropped (long), keep (binary, the keep bitmap: see ``bitmap`` and ``kept_text``).

    Input columns of these names are replaced, all others pass whatever their names. A null or empty text is one empty line, which stays. Documents are counted by id: rows of one
    id count once, each text of it has its own bitmap, repeated rows have equal ones; null ids are one document, which comes last. A key in exactly ``min_docs`` documents (a tie) is
    common. Very long texts and lines are worked on whole. An empty table gives an empty result.
    """
    made = ["n_lines", "n_dropped", "keep"]
    own = docs.drop(*made)
    rows = C.cut(line_rows(docs, params))
    gone = rows.join(C.cut(common_lines(rows, params)).hint("merge"), ["h", "g", "slice"])  # a small file may be many rows: never a broadcast
    if params.keep == "first":
        gone = gone.where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))))
    elif params.keep != "none":
        raise ValueError(f"keep must be 'none' or 'first', not {params.keep!r}")
    doc, body, gone_at, lines = C.fresh(own.select("*", *[F.lit(0).alias(m) for m in made]), "doc", "body", "gone_at", "lines")
    marks = gone.groupBy(F.col("doc").alias(doc), F.col("body").alias(body)).agg(F.sort_array(F.collect_set("pos")).alias(gone_at))
    met = own.withColumn(lines, F.size(F.split(F.coalesce(C.quoted("text"), F.lit("")), "\n"))).join(
        marks, C.quoted("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(C.quoted("text")) == F.col(body)), "left"
    )
    at = F.coalesce(F.col(gone_at), F.array().cast("array<int>"))
    out = {"n_lines": F.col(lines).cast("bigint"), "n_dropped": F.size(at).cast("bigint"), "keep": bitmap(at, F.col(lines))}
    return met.withColumns(out).drop(doc, body, gone_at, lines)
