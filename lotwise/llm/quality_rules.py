"""Quality rules: per-document checks, and lines that too many documents of one host share.

Everything is a DataFrame expression. A line's hash is counted over the distinct documents (ids) of its host. Lines above the host's limits are
removed, and documents that lose too much of their words by it are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C

SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class QualityParams:
    """min_docs, host_share, most_docs: a line is boilerplate if more documents of its host hold it than min_docs, and more than the share of the host's documents or
    than most_docs, which binds on large hosts. min_kept_share: a document is depleted if less of its words than this share stays.
    most_broadcast: rows of the boilerplate table up to which it is broadcast by host; beyond it documents meet their own boilerplate lines by a shuffle."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    min_docs: int = 20
    host_share: float = 0.1
    most_docs: int = 50_000
    min_kept_share: float = 0.3
    most_broadcast: int = 200_000


def _repeat_words(tokens: Column, width: int) -> Column:
    """Words inside runs of ``width`` words that occur twice or more in the text."""

    def count(hashes: Column) -> Column:
        def runs(pairs: Column) -> Column:
            n = F.size(pairs)
            again = F.filter(
                pairs,
                lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == x["h"])),
            )
            return C.let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda starts: C.covered(starts, width))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(C.let(ranked, runs))

    return C.let(C.grams(tokens, width), count)


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(C.WORD))


def normal_line(line: Column) -> Column:
    """A line as it is compared: lower case, white space squeezed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), f"{SPACE}+", " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _host_lines(docs: DataFrame, host: str) -> DataFrame:
    """(host, doc, line): the distinct line hashes of each row; documents without an id are one."""
    rows = docs.select(C.quoted(host).alias("host"), C.quoted("doc_id").alias("doc"), F.array_distinct(F.transform(_lines(C.quoted("text")), _line_hash)).alias("lines"))
    return rows.select("host", "doc", F.explode("lines").alias("line"))


def _documents() -> Column:
    return F.count_distinct("doc") + F.max(F.col("doc").isNull()).cast("int")


def frequent_lines(docs: DataFrame, host: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """(host, line): hashes of the boilerplate lines of each host. A null host is a host of its own."""
    sizes = docs.select(C.quoted(host).alias("host"), C.quoted("doc_id").alias("doc")).groupBy("host").agg(_documents().alias("n_host"))
    counted = _host_lines(docs, host).groupBy("host", "line").agg(_documents().alias("n")).where(F.col("n") > params.min_docs)
    both = counted.alias("a").join(sizes.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
    return both.where((F.col("n") > F.col("n_host") * params.host_share) | (F.col("n") > params.most_docs)).select("a.host", "line")


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), host: str = "source") -> DataFrame:
    """All columns of ``docs`` and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_boiler_words,
    base_failed, kept (boolean), clean_text (the text without the host's boilerplate lines).

    Input columns of the same names are replaced, all others pass whatever their names. A null or empty text has no words: it fails the base rules and its clean text is
    empty; as a document it counts for its host. Rows are judged one by one: repeated rows and repeated ids stay, each with its own result. Very long texts are judged whole. A
    line exactly at a limit stays, and so does a document exactly at the kept share. An empty table gives an empty result.
    """
    found = C.cut(frequent_lines(docs, host, params))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boiler_words", "base_failed", "kept", "clean_text"]
    own = docs.drop(*made)
    words, lines, boiler, key = C.fresh(own.select("*", *[F.lit(0).alias(m) for m in made]), "words", "lines", "boiler", "key")
    if C.small(found, params.most_broadcast):
        # a host has few boilerplate lines: at most 1 / host_share times as many as a document of it has lines, and those above most_docs
        by_host = F.broadcast(found.groupBy("host").agg(F.collect_list("line").alias(boiler)).withColumnRenamed("host", key))
        joined = own.join(by_host, C.quoted(host).eqNullSafe(F.col(key)), "left").drop(key)
    else:
        document = F.xxhash64(C.quoted(host), C.quoted("doc_id"), C.quoted("text"))
        held = docs.select(document.alias(key), C.quoted(host).alias("host"), F.explode(F.array_distinct(F.transform(_lines(C.quoted("text")), _line_hash))).alias("line"))
        met = held.alias("a").join(found.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")), "left_semi")
        by_row = met.groupBy(key).agg(F.collect_set("line").alias(boiler))
        joined = own.withColumn(key, document).join(by_row, key, "left").drop(key)
    tokens, rows, text = F.col(words), F.col(lines), C.quoted("text")
    gone = lambda x: F.array_contains(F.col(boiler), _line_hash(x))
    has = F.size(F.coalesce(F.col(boiler), F.array().cast("array<bigint>"))) > 0
    judged = (
        C.computed(
            C.computed(joined, {words: C.words(text), lines: _lines(text)}),
            {
                "n_words": F.size(tokens).cast("bigint"),
                "word_chars": F.length(F.array_join(tokens, "")).cast("bigint"),
                "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("bigint"),
                "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint"),
                "n_repeat_words": _repeat_words(tokens, params.window),
                "n_boiler_words": F.when(has, F.aggregate(F.filter(rows, gone), F.lit(0).cast("bigint"), lambda a, x: a + F.size(C.words(x)))).otherwise(F.lit(0).cast("bigint")),
                "clean_text": F.when(has, F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~(x.rlike(C.WORD) & gone(x))), "\n")).otherwise(F.coalesce(text, F.lit(""))),
            },
        )
        .withColumn("base_failed", (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words")))
    )
    stays = F.col("n_words") - F.col("n_boiler_words")
    return judged.withColumn("kept", ~F.col("base_failed") & (stays >= params.min_kept_share * F.col("n_words"))).drop(words, lines, boiler)
