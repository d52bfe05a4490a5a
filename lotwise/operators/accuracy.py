"""Comparison of predictions with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.quantiles import quantiles


def binary(pairs: DataFrame) -> DataFrame:
    """Counts and rates of boolean truth against boolean pred; rates without a denominator are 0."""
    t, p = F.col("truth"), F.col("pred")
    counts = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    out = counts.withColumns({"precision": rate(c["tp"], c["tp"] + c["fp"]), "recall": rate(c["tp"], c["tp"] + c["fn"]), "accuracy": rate(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"])})
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pairs: DataFrame, values: list) -> DataFrame:
    """Counts of pred in columns by truth in rows."""
    return pairs.groupBy("truth").pivot("pred", values).count().na.fill(0)


def sweep(scores: DataFrame, low: float = 0.05, high: float = 0.85, step: float = 0.005) -> DataFrame:
    """(k, threshold, tp, fp, fn, f1) over all thresholds, from one pass: counts by the last threshold that a score reaches, summed from above."""
    n = int(round((high - low) / step))
    reached = F.greatest(F.lit(-1), F.least(F.lit(n), F.floor((F.col("score") - low) / step + 1e-9))).cast("int")
    per = scores.groupBy(reached.alias("k")).agg(F.count_if("truth").alias("t"), F.count_if(~F.col("truth")).alias("f"))
    grid = per.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("j"))  # a fixed number of rows
    total = per.agg(F.sum("t").alias("all"))
    met = grid.join(F.broadcast(per), F.col("k") >= F.col("j"), "left").groupBy("j").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tp"), F.coalesce(F.sum("f"), F.lit(0)).alias("fp"))
    out = met.crossJoin(F.broadcast(total)).select(F.col("j").alias("k"), (low + F.col("j") * step).alias("threshold"), "tp", "fp", (F.col("all") - F.col("tp")).alias("fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def best(swept: DataFrame) -> DataFrame:
    return swept.agg(F.max_by("k", F.struct(F.bround("f1", 9), -F.col("k"))).alias("k"), F.max("f1").alias("f1"))


def quantiles_by(scores: DataFrame, state: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of the score and counts by state; states are few."""
    found = quantiles(scores, {"score": F.col("score")}, qs, F.col(state))
    groups = list(dict.fromkeys(g for g, _, _ in found))
    kind = dict(scores.dtypes)[state]
    rows = [(g, *[float(found[g, "score", q]) for q in qs]) for g in groups]
    table = scores.sparkSession.createDataFrame(rows, f"g {kind}, " + ", ".join(f"p{round(100 * q)} double" for q in qs))
    counts = scores.groupBy(F.col(state)).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(table), F.col(state).eqNullSafe(F.col("g")), "left").select(state, *[f"p{round(100 * q)}" for q in qs], "n")


def calibration(scored: DataFrame, truth: DataFrame, damaged: tuple[str, ...] = ("major", "destroyed")) -> tuple[DataFrame, DataFrame]:
    """Of structures (parcel_id, score) against the true states (parcel_id, state): the counts and rates at all thresholds, and the best of them."""
    pairs = scored.join(truth, "parcel_id").select(F.coalesce("score", F.lit(0.0)).alias("score"), F.col("state").isin(*damaged).alias("truth"))
    swept = sweep(pairs)
    return swept, best(swept)
