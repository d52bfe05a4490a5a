"""Roll-up of pixel change to structures, parcels and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import measures as M
from lotwise.operators import zonal
from lotwise.operators.neighbourhood import focus_scores
from lotwise.params import CLASSES, DAMAGED, LOSS_FACTOR, Detector

LAYERS = {"score_mean": "score", "magnitude": "magnitude", "structure_loss": "structure_loss", "ndvi_delta": "ndvi_delta", "flooded": "flooded"}


def _factor(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LOSS_FACTOR.items() for x in kv])
    return F.element_at(table, name)


def parcel_stats(change: DataFrame, detector: Detector = Detector()) -> DataFrame:
    """Per zone (parcel): pixels, coverage, mean score, flooded, lost vegetation and changed shares of the usable pixels."""
    used = lambda x: F.when(F.col("valid"), x.cast("double"))
    return (
        change.where("zone > 0")
        .groupBy("zone")
        .agg(
            F.count_if("valid").alias("pixels"),
            F.avg(F.col("valid").cast("double")).alias("coverage"),
            F.avg(used(F.col("score"))).alias("score"),
            F.avg(used(F.col("flooded"))).alias("flooded"),
            F.avg(used(F.col("vegetation_loss"))).alias("veg_loss"),
            F.avg(used(F.col("score") >= detector.class_breaks[1])).alias("changed"),
        )
    )


def structure_scores(change: DataFrame, structures: DataFrame, gsd: float, detector: Detector = Detector(), keys: tuple[str, ...] = (), zone: str = "structure_zone") -> DataFrame:
    """Per structure: score, damage class, pixels, confidence. ``structures`` has the ``zone`` that each is scored on, and the pixels name it in the column ``zone`` of this call.

    A mapped structure's score is the 75th percentile of its own zone, or the mean where that is of under four pixels. Approximate structures of a parcel share a zone: the strongest patch of the
    size of the largest of them counts.
    """
    core = change.where(F.col(zone) > 0)
    stats = zonal.stats(core, LAYERS, zone).withColumnRenamed(zone, "zone")
    p75 = zonal.nearest_rank(core, "score", 0.75, "score_p75", zone).withColumnRenamed(zone, "zone")
    zones = stats.join(p75, "zone", "left")
    sizes = structures.where("approximate").groupBy("zone").agg(M.focus_size(F.max("area_m2"), F.lit(gsd)).alias("size"))
    focus = focus_scores(change.withColumn("_zone", F.col(zone)), sizes.withColumnRenamed("zone", "_zone"), zone="_zone", keys=keys)
    joined = structures.join(zones, "zone", "left").join(focus.withColumnRenamed("_zone", "zone"), "zone", "left")
    usual = F.when(F.col("pixels") >= 4, F.col("score_p75")).otherwise(F.col("score_mean"))
    score = F.when(F.col("approximate"), F.coalesce("focus", usual)).otherwise(usual)
    pixels = F.coalesce("pixels", F.lit(0))
    return joined.select(
        "parcel_id", "id", "kind", "ord", "area_m2", "description", "approximate", score.alias("score"), M.damage_class(score, detector).alias("damage_class"), pixels.alias("pixels"),
        M.confidence(pixels, F.col("approximate"), F.lit(gsd), F.col("area_m2")).alias("confidence"), F.col("flooded").alias("flooded_fraction"), "magnitude", "structure_loss", "ndvi_delta",
    )


def parcel_rollup(parcels: DataFrame, scored: DataFrame, stats: DataFrame, detector: Detector = Detector()) -> DataFrame:
    """Per parcel: structure counts by class, worst class (without structures the class of the parcel's own score), loss, changed area, coverage."""
    kind = F.col("damage_class")
    area = F.coalesce("area_m2", F.lit(0.0))
    counted = scored.groupBy("parcel_id").agg(
        F.count("*").alias("structures"),
        *[F.count_if(kind == c).alias(f"n_{c}") for c in CLASSES],
        F.max(M.class_rank(kind)).alias("_worst"),
        F.sum(area * _factor(kind)).alias("_lost"),
        F.sum(area).alias("_area"),
        F.min("approximate").alias("_all_approximate"),
        F.max("approximate").alias("_any_approximate"),
    )
    joined = parcels.join(counted.withColumnRenamed("parcel_id", "id"), "id", "left").join(stats.withColumnRenamed("zone", "id"), "id", "left")
    own = M.class_rank(M.damage_class(F.col("score"), detector))
    rank = F.coalesce("_worst", own)
    loss = F.when((F.coalesce("apr_bldg", F.lit(0.0)) != 0) & F.col("structures").isNotNull(), F.col("_lost") / F.when(F.col("_area") == 0, 1.0).otherwise(F.col("_area")) * F.col("apr_bldg"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "id", "address", "pin", "parid", "owner", "subdivision", "apr_bldg", zero("structures"), *[zero(f"n_{c}") for c in CLASSES], F.element_at(F.array(*[F.lit(c) for c in CLASSES]), rank + 1).alias("worst_class"), rank.alias("worst_rank"),
        F.col("score").alias("parcel_score"), F.col("flooded").alias("flooded_fraction"), F.col("veg_loss").alias("vegetation_loss_fraction"), (F.col("changed") * F.col("area_m2")).alias("changed_area_m2"),
        loss.alias("estimated_loss"), F.coalesce("pixels", F.lit(0)).alias("pixels"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("_all_approximate", F.lit(False)).alias("approximate_only"),
        F.coalesce("_any_approximate", F.lit(False)).alias("any_approximate"),
    )


def totals(rolled: DataFrame) -> DataFrame:
    """One row over all parcels: structures by class, damaged structures, affected and flooded parcels, loss."""
    return rolled.agg(
        F.count("*").alias("parcels"), F.sum("structures").alias("structures"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in CLASSES],
        F.sum(sum((F.col(f"n_{c}") for c in DAMAGED), F.lit(0))).alias("damaged"), F.count_if(F.col("worst_class") != "none").alias("affected"),
        F.count_if(F.coalesce("flooded_fraction", F.lit(0.0)) > 0.05).alias("flooded_parcels"), F.sum("estimated_loss").alias("estimated_loss"),
    )


def class_bar(scored: DataFrame) -> DataFrame:
    """(rank, damage_class, structures, share): of every class, also those without any, the structures and their share of all (0 if there are none)."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    counts = scored.agg(*[F.count_if(F.col("damage_class") == c).alias(c) for c in CLASSES])
    bars = counts.select(F.posexplode(F.array(*CLASSES)).alias("rank", "structures"), sum((F.col(c) for c in CLASSES), F.lit(0)).alias("n"))
    return bars.select("rank", F.get(names, F.col("rank")).alias("damage_class"), "structures", F.coalesce(F.try_divide("structures", "n"), F.lit(0.0)).alias("share"))


def by_parcel(scored: DataFrame) -> DataFrame:
    """(parcel_id, structures): the structures of each parcel that has any, in their order, as records."""
    rest = [c for c in scored.columns if c not in ("parcel_id", "ord")]
    return scored.groupBy("parcel_id").agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("structures"))


def warnings(rolled: DataFrame, synthetic: bool = False) -> DataFrame:
    """(ord, warning): low coverage, approximate outlines, synthetic images."""
    low = rolled.agg(F.count_if(F.col("coverage") < 0.5).alias("low"), F.count("*").alias("n"), F.max("approximate_only").alias("guessed"))
    text = F.concat(F.col("low").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" parcels had under half of their pixels usable on both dates"))
    rows = F.array(
        F.struct(F.lit(1).alias("ord"), F.when(F.col("low") > 0, text).alias("warning")),
        F.struct(F.lit(2).alias("ord"), F.when(F.col("guessed"), F.lit("structure outlines are approximate")).alias("warning")),
        F.struct(F.lit(3).alias("ord"), F.when(F.lit(synthetic), F.lit("a date is a synthetic image")).alias("warning")),
    )
    return low.select(F.inline(rows)).where("warning is not null")


def worst_first(rolled: DataFrame, limit: int | None = None) -> DataFrame:
    """Parcels by class, then score to six places, then id; with a limit only damaged ones, at most so many."""
    ordered = rolled if limit is None else rolled.where(F.col("worst_class") != "none")
    ordered = ordered.orderBy(F.col("worst_rank").desc(), F.bround(F.coalesce("parcel_score", F.lit(0.0)), 6).desc(), "id")
    return ordered if limit is None else ordered.limit(limit)
