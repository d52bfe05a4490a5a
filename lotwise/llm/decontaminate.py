"""Benchmark decontamination by winnowing.

A window is ``width`` consecutive words of an item. Of the word ``k``-grams of each window the least hash is its fingerprint, in
items and in documents alike, so any shared window has a shared fingerprint (``k`` + number of grams in a window - 1 = ``width``).
Fingerprint hits are then extended: where a document's window has a fingerprint of the benchmark, the hash of its words looks up the one window that can be equal, and the words of both
are compared. So a place in a document meets one window, however many of the benchmark share its fingerprint. An item of fewer words is one window whose only fingerprint is the hash of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C

#: A-Z are lower-cased first; words are then runs of a-z, 0-9 and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same words in a text that is not lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return C.words(C.ascii_lower(text), WORD)


def _minima(hashes: Column, w: int) -> Column:
    """Least hash of every ``w`` consecutive ones."""
    return F.when(
        F.size(hashes) >= w, F.transform(F.sequence(F.lit(0), F.size(hashes) - w), lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)]))
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, width: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(window, words, n, fp, wh): the distinct windows with fingerprint and hash of all words; (window, item_id): who has them."""
    w = width - k + 1
    items = benchmark.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cutup = F.when(F.size("words") < width, F.array(F.col("words"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1))), lambda i: F.slice("words", i, width))
    )
    rows = items.select("item_id", F.explode(cutup).alias("words")).withColumn("window", F.unhex(F.sha2(F.array_join("words", " "), 256)))
    held = rows.select("window", "item_id").distinct()
    n = F.size("words")
    windows = (
        rows.select("window", "words")
        .dropDuplicates(["window"])
        .withColumn("n", n)
        .withColumn("_h", C.grams(F.col("words"), k))
        .withColumn("fp", F.when(F.col("n") < width, F.xxhash64(F.col("n"), "words")).otherwise(F.array_min("_h")))
        .withColumn("wh", F.xxhash64("n", "words"))
        .drop("_h")
    )
    return windows, held


def _short(tokens: Column, m: int) -> Column:
    """Hashes of all runs of ``m`` words, as the fingerprint of an item of ``m`` words has it."""
    return F.when(
        F.size(tokens) >= m, F.transform(F.sequence(F.lit(1), F.size(tokens) - (m - 1)), lambda i: F.xxhash64(F.lit(m), F.slice(tokens, i, m)))
    ).otherwise(F.array().cast("array<bigint>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5, most_broadcast: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, body (hash of the text), n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    A word is hit if it lies inside an occurrence of a window of an item. Null and empty texts have no words, neither as documents nor as items;
    items with a null id count under the name "". Repeated rows of one id and text each get that text's result; one id with several texts gets
    one row per text. Very long texts are searched whole. An item that stands in a document several times counts once. Without items or documents nothing is hit. Columns other
    than doc_id, item_id and text are not looked at. Windows and hits are broadcast only while they are few (``most_broadcast`` rows, checked); beyond it the joins shuffle.
    """
    windows, held = benchmark_windows(benchmark, width, k)
    windows, held = C.cut(windows), C.cut(held.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")))
    few = C.small(windows, most_broadcast)
    near = F.broadcast if few else (lambda df: df)
    shorts = sorted(r["n"] for r in windows.where(F.col("n") < width).select("n").distinct().collect())  # fewer than ``width`` values

    tokens = F.col("_words")
    marks = [C.let(C.grams(tokens, k), lambda h: _minima(h, width - k + 1)), *[_short(tokens, m) for m in shorts]]
    own = docs.select("doc_id", F.xxhash64("text").alias("body"), item_words(F.col("text")).alias("_words"))
    lengths = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("bigint").alias("n_words"))
    scanned = own.select("doc_id", "body", F.explode(F.array_distinct(F.concat(*marks))).alias("mark"))
    prints = windows.select(F.col("fp").alias("mark")).distinct()
    touched = C.cut(scanned.join(near(prints), "mark", "left_semi").groupBy("doc_id", "body").agg(F.collect_set("mark").alias("prints")))
    some = F.broadcast(touched) if touched.agg(F.coalesce(F.sum(F.size("prints") + 1), F.lit(0))).first()[0] <= most_broadcast else touched
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.body") == F.col(f"{b}.body"))
    hit_docs = texts.alias("a").join(some.alias("b"), same("a", "b")).select("a.doc_id", "a.body", "a.text", "prints").dropDuplicates(["doc_id", "text"])
    hit_docs = C.cut(hit_docs.select("doc_id", "body", item_words(F.col("text")).alias("_words"), "prints"))
    # a place with a fingerprint of the benchmark meets windows by the hash of its words, which come back once for all hits of the document
    known = lambda h: F.array_contains("prints", h)
    laid_over = lambda hashes, m: F.filter(
        F.transform(hashes, lambda h, i: F.when(known(h), F.struct(i.alias("s"), F.lit(m).alias("n"), F.xxhash64(F.lit(m), F.slice(tokens, i + 1, m)).alias("wh")))), lambda p: p.isNotNull()
    )
    places = F.concat(laid_over(C.let(C.grams(tokens, k), lambda h: _minima(h, width - k + 1)), width), *[laid_over(_short(tokens, m), m) for m in shorts])
    laid = hit_docs.select("doc_id", "body", F.explode(places).alias("p")).select("doc_id", "body", "p.*")
    met = laid.join(near(windows.select("wh", "n", "window")), ["wh", "n"])
    spot = F.struct("s", "n", "window", F.col("words").alias("item"))
    by_doc = met.join(windows.select("window", "words"), "window").groupBy("doc_id", "body").agg(F.collect_list(spot).alias("spots"))
    whole = hit_docs.alias("a").join(by_doc.alias("b"), same("a", "b")).select("a.doc_id", "a.body", "_words", "spots")
    equal = F.filter("spots", lambda x: F.slice(tokens, x["s"] + 1, x["n"]) == x["item"])
    exact = C.cut(whole.select("doc_id", "body", F.explode(equal).alias("x")).select("doc_id", "body", "x.s", "x.n", "x.window"))
    spots = exact.select("doc_id", "body", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("w")).distinct().groupBy("doc_id", "body").agg(F.count("*").alias("n_hit"))
    names = exact.select("doc_id", "body", "window").distinct().join(near(held), "window").select("doc_id", "body", "item").distinct().groupBy("doc_id", "body").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = C.cut(spots.alias("a").join(names.alias("b"), same("a", "b")).select("a.doc_id", "a.body", "n_hit", "items"))
    C.drop(touched, hit_docs, exact)
    few_hits = F.broadcast(found) if found.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] <= most_broadcast else found
    out = lengths.alias("a").join(few_hits.alias("b"), same("a", "b"), "left").select("a.doc_id", "a.body", "n_words", "n_hit", "items")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "body",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
