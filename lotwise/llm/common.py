"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once per row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` does the same on ASCII texts and is much cheaper."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, pattern: str = WORD) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def grams(tokens: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` consecutive tokens, in order; empty when there are fewer."""
    hashed = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]))
    return let(tokens, lambda t: F.when(F.size(t) >= k, hashed(t)).otherwise(F.array().cast("array<bigint>")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that are computed once per row: neither filters nor other columns over them repeat their expressions below."""
    (row,) = fresh(df, "row")
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(row)
    return df.select("*", made).select(*[quoted(c) for c in df.columns], *[quoted(row)[n].alias(n) for n in columns])


def covered(starts: Column, width: int) -> Column:
    """How many positions the runs ``[s, s + width)`` cover, for an ascending array of distinct starts."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 1, F.greatest(n - 1, F.lit(0))), F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(width)).cast("bigint"))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(gaps, F.lit(width).cast("bigint"), lambda a, x: a + x))


#: Folders of the tables that ``cut`` wrote and nobody has dropped.
_CUTS: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the cluster's shared folder and read from there, so that lost executors cost nothing.

    What was shuffled on the way is given free at once. The table stays until it is dropped by ``drop`` or at the end of ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _CUTS.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _CUTS.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*cuts: DataFrame) -> None:
    """Deletes tables that ``cut`` made and that nothing reads any more."""
    for df in cuts:
        _delete(df.sparkSession, df._cut)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever was cut inside; for callers that have written their result by then."""
    held = set(_CUTS)
    try:
        yield
    finally:
        for path in [x for x in _CUTS if x not in held]:
            _delete(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Only a local session, as in tests, gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lotwise-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def small(df: DataFrame, most: int) -> bool:
    """True if ``df`` has at most ``most`` rows, so that it may be broadcast; look only at data that is already cut."""
    return df.limit(most + 1).count() <= most


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
