"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: (session, path) of the tables that ``stored`` wrote and no ``scope`` has deleted.
_TABLES: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session, as in tests, gets a folder of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lotwise-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a table, so that several passes over it cost one computation and lost executors cost nothing.

    The table stays until the ``scope`` ends in which it was made; without one, until the cluster clears the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _TABLES.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables that were stored inside; for callers that have written their result by then."""
    held = len(_TABLES)
    try:
        yield
    finally:
        while len(_TABLES) > held:
            delete(*_TABLES.pop())
