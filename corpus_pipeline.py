"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of ``documents``.
Null and empty texts do not survive the quality stage. Rows repeated with id and text pass the quality stage one by one; the near-duplicate stage keeps one of them. Very long
texts are worked on whole. Extra columns pass through every stage but the last, whatever their names. An empty table gives empty stages and token files without a shard.
"""

from __future__ import annotations

import uuid
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import token_files
from lotwise.llm.decontaminate import decontaminate
from lotwise.llm.mixing import mix
from lotwise.llm.near_dedup import NearParams, near_dedup
from lotwise.llm.quality_rules import quality_rules

#: Rows of a list of ids up to which it is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 2_000_000


#: Columns that the stages know; all others are carried in one struct, so no name of theirs meets one of an operator's.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def carried(stage):
    """A stage that returns the columns it was given, in their order."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest = [c for c in docs.columns if c not in KNOWN]
        packed = docs.select(*[c for c in docs.columns if c in KNOWN], *([F.struct(*map(C.quoted, rest)).alias("rest")] if rest else []))
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col("rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns])

    return run_stage


def _met(docs: DataFrame, some: DataFrame, body, how: str) -> DataFrame:
    """``docs`` joined by ``how`` with the cut rows (doc_id, body) of ``some``; the texts move only if the list is long."""
    key, held = C.fresh(docs, "key", "held")
    some = some.select(F.col("doc_id").alias(key), F.col("body").alias(held))
    some = F.broadcast(some) if C.small(some, MOST_BROADCAST) else some
    return docs.join(some, C.quoted("doc_id").eqNullSafe(F.col(key)) & body.eqNullSafe(F.col(held)), how)


def _without(docs: DataFrame, gone: DataFrame, body) -> DataFrame:
    """``docs`` without the rows (doc_id, body) of ``gone``."""
    return _met(docs, C.cut(gone.select("doc_id", "body").distinct()), body, "left_anti")


@carried
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents, and takes the boilerplate lines of their host out of the others."""
    kept = quality_rules(docs).where("kept")
    fresh = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.withColumns(fresh)


@carried
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays, the one with the least id; of repeated rows one stays."""
    found = C.cut(near_dedup(docs, NearParams()))
    body = F.shiftright(F.xxhash64("text"), 33).cast("int")
    left = _without(docs, found.where("not kept"), body)
    again = C.cut(found.where("kept").groupBy("doc_id", "body").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not again.limit(1).count():
        return left
    return _met(left, again, body, "left_anti").unionByName(_met(left, again, body, "left_semi").dropDuplicates(["doc_id", "text"]))


@carried
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = decontaminate(docs, C.read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), F.xxhash64("text"))


@carried
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics come near to their tempered shares of tokens."""
    return mix(docs).where("kept")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns each document's place in them."""
    import public_tokenizers

    path = f"{C.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, path)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("benchmark leaks", leaks), ("mixture", mixture), ("token files", tokens)]

#: A sketch, an iteration and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's rows are written as Parquet in the shared folder and read again by the next."""
    docs = C.read(spark, sf_dir, "documents")
    folder = f"{C.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, numbered: tuple) -> DataFrame:
        k, (_, stage) = numbered
        with C.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        return spark.read.parquet(f"{folder}/{k}")

    return reduce(step, enumerate(STAGES), docs)
