"""Streaming intake of scenes: files that arrive in a folder are added to a scene table, late repeats of an id replacing nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema, late: str = "2 days") -> DataFrame:
    """Scenes from Parquet files as they arrive, each id once within the time that an event may be late."""
    stream = spark.readStream.schema(schema).parquet(folder).withColumn("datetime", F.col("datetime").cast("timestamp"))
    return stream.withWatermark("datetime", late).dropDuplicatesWithinWatermark(["id"])


def counts(stream: DataFrame, every: str = "1 day") -> DataFrame:
    """Scenes and mean cloud per provider and window of time; a window is final once the watermark has passed it."""
    return stream.groupBy(F.window("datetime", every).alias("w"), "provider").agg(F.count("*").alias("scenes"), F.avg("cloud").alias("cloud")).select(F.col("w.start").alias("start"), "provider", "scenes", "cloud")


def into(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Appends a stream to a Parquet table, exactly once, until the present files are read."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
