import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import change
from lotwise.operators.neighbourhood import box_mean, ssim
from lotwise.params import BANDS, Detector, JobError


def frame(spark, pre, post, valid=None):
    h, w = pre[0].shape
    rows, cols = np.mgrid[0:h, 0:w]
    ok = np.ones((h, w), bool) if valid is None else valid
    data = zip(*[x.ravel().tolist() for x in (rows, cols, *pre, *post, ok, ok)])
    names = [*(f"pre_{b} double" for b in BANDS), *(f"post_{b} double" for b in BANDS)]
    return spark.createDataFrame(list(data), f"row int, col int, {', '.join(names)}, pre_valid boolean, post_valid boolean")


def scene(seed, shape=(60, 60), base=(0.06, 0.09, 0.07, 0.10)):
    rng = np.random.default_rng(seed)
    return [b + rng.normal(0, 0.01, shape) + 0.05 * (np.indices(shape).sum(0) % 7 == 0) for b in base]


def layers(spark, pre, post):
    return change.detect(frame(spark, pre, post)).select("row", "col", "score", "flooded", "magnitude").toPandas()


def test_box_mean_repeats_the_edge(spark):
    a = np.random.default_rng(1).random((6, 7))
    df = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(6) for c in range(7)], "row int, col int, v double")
    for size in (3, 7):
        r = size // 2
        padded = np.pad(a, r, mode="edge")
        want = np.array([[padded[i : i + size, j : j + size].mean() for j in range(7)] for i in range(6)])
        got = box_mean(df, ["v"], size).toPandas().pivot(index="row", columns="col", values="v").to_numpy()
        assert np.abs(got - want).max() < 1e-12


def test_identical_images_are_alike(spark):
    a = np.random.default_rng(2).random((12, 12))
    df = spark.createDataFrame([(r, c, float(a[r, c]), float(a[r, c]), float(a[c, r])) for r in range(12) for c in range(12)], "row int, col int, a double, b double, s double")
    assert abs(ssim(df, "a", "b").agg(F.min("ssim")).first()[0] - 1) < 1e-9
    assert ssim(df, "a", "s").agg(F.avg("ssim")).first()[0] < 0.6


def test_shift_is_found_and_undone(spark):
    a = np.random.default_rng(3).random((64, 64))
    df = spark.createDataFrame([(r, c, float(a[r, c]), float(np.roll(a, (4, -3), (0, 1))[r, c]), True) for r in range(64) for c in range(64)], "row int, col int, a double, b double, valid boolean")
    got = change.estimate_shift(df, "a", "b").first()
    assert (got["dr"], got["dc"]) == (-4, 3)
    flat = df.withColumns({"a": F.lit(0.5), "b": F.lit(0.5)})
    assert tuple(change.estimate_shift(flat, "a", "b").first()) == (0, 0)


def test_gain_is_recovered_and_a_wild_one_refused(spark):
    pre = scene(4)
    for gain, want in ((1.2, (1.2, 0.03)), (9.0, (1.0, 0.0))):
        post = [(b - 0.03) / gain for b in pre]
        marked = change.with_valid(frame(spark, pre, post)).withColumns({"stable": F.lit(True)})
        got = change.band_fits(marked)["red"]
        assert np.allclose(got, want, atol=1e-6)


def test_no_change_and_a_rubble_patch(spark):
    pre = scene(5)
    assert layers(spark, pre, pre)["score"].max() < 1e-6
    post = [b.copy() for b in pre]
    for b in post:
        b[20:35, 20:35] = 0.35 + np.random.default_rng(6).normal(0, 0.08, (15, 15))
    got = layers(spark, pre, post)
    inside = got["row"].between(22, 32) & got["col"].between(22, 32)
    assert got[inside]["score"].mean() > 0.7 and got[~got["row"].between(15, 40)]["score"].mean() < 0.2


def test_water_raises_the_flood_flag(spark):
    pre = scene(7, base=(0.06, 0.09, 0.12, 0.20))
    post = [b.copy() for b in pre]
    post[3][10:25, 10:25] = 0.02
    got = layers(spark, pre, post)
    inside = got["row"].between(10, 24) & got["col"].between(10, 24)
    assert got[inside]["flooded"].mean() > 0.9 and not got[~inside]["flooded"].any() and got[inside]["score"].min() >= 0.45


def test_settings_are_checked():
    assert Detector().with_overrides({"structure_window": "9", "unknown": 1, "veg_ndvi_threshold": None}).structure_window == 9
    with pytest.raises(JobError):
        Detector().with_overrides({"structure_window": "wide"})


@pytest.mark.parametrize("name", ["shift_apply", "estimate_shift"])
def test_a_shift_broadcasts_no_pixels(spark, name, tmp_path):
    """100 pixels come of each row of a table; from 50,000 rows on a broadcast no longer fits beside the driver's other work, though the table is a few hundred KB."""
    spark.range(200).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
