import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.functions import geo
from lotwise.operators import neighbourhood, zonal
from lotwise.operators import quantiles as exact
from lotwise.operators.quantiles import quantile, quantiles


def labels(spark):
    cells = [(r, c, float(6 * r + c), 1 if r < 3 and c < 3 else 2 if r < 2 and c > 3 else 3 if r > 3 and 1 <= c <= 3 else 0) for r in range(6) for c in range(6)]
    return spark.createDataFrame([(*x, True) for x in cells], "row int, col int, v double, zone int, valid boolean")


def test_counts_and_means(spark):
    got = {r["zone"]: (r["pixels"], r["m"]) for r in zonal.stats(labels(spark), {"m": "v"}).collect()}
    assert got == {1: (9, 7.0), 2: (4, 7.5), 3: (6, 29.0)}


def test_invalid_pixels_are_left_out_and_empty_zones_stay(spark):
    px = labels(spark).withColumn("valid", F.col("zone") != 2)
    zones = spark.createDataFrame([(1,), (2,), (9,)], "zone int")
    got = {r["zone"]: (r["pixels"], r["m"]) for r in zonal.for_all(zones, zonal.stats(px, {"m": "v"})).collect()}
    assert got == {1: (9, 7.0), 2: (0, None), 9: (0, None)}


def test_nearest_rank_rounds_half_to_even(spark):
    px = spark.createDataFrame([(1, float(v), True) for v in (1, 2, 4, 7, 10, 11)], "zone int, v double, valid boolean")
    for q in (0.0, 0.1, 0.5, 0.75, 0.9, 1.0):
        want = sorted((1, 2, 4, 7, 10, 11))[int(np.rint(q * 5))]
        assert zonal.nearest_rank(px, "v", q, "x").first()["x"] == want


def test_fraction_of_a_boolean_layer(spark):
    got = zonal.stats(labels(spark).withColumn("b", F.col("v") > 7), {"share": "b"}).where("zone = 1").first()
    assert abs(got["share"] - 4 / 9) < 1e-12


def test_later_zone_wins_and_touching_reaches_further(spark):
    ring = lambda x0, y0, x1, y1: geo.box_ring(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))
    two = spark.range(1).select(F.lit(1).alias("zone"), F.lit(1).alias("ord"), ring(0.0, 0.0, 3.0, 3.0).alias("ring")).union(spark.range(1).select(F.lit(2), F.lit(2), ring(2.0, 2.0, 4.6, 4.0)))
    got = {(r["row"], r["col"]): r["zone"] for r in zonal.label_rings(two).collect()}
    assert got[2, 2] == 2 and got[0, 0] == 1 and (2, 4) in got and len(got) == 9 + 6 - 1
    narrow = spark.range(1).select(F.lit(1).alias("zone"), F.lit(1).alias("ord"), ring(1.1, 1.1, 1.3, 2.2).alias("ring"))
    assert zonal.label_rings(narrow).count() == 0
    assert {(r["row"], r["col"]) for r in zonal.label_rings(narrow, all_touched=True).collect()} == {(1, 1), (2, 1)}


def test_quantile_of_a_long_column(spark, monkeypatch):
    import lotwise.operators.quantiles as Q

    rng = np.random.default_rng(3)
    columns = {"smooth": rng.normal(size=3000), "round": rng.normal(size=3000).round(1), "two": np.where(rng.random(3000) < 0.5, 1e-9, 1e9), "apart": np.concatenate([rng.random(1500) * 1e-6, 1e6 + rng.random(1500)])}
    group = rng.integers(0, 2, 3000)
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()], group.tolist())), ", ".join(f"{c} double" for c in columns) + ", g long")
    qs = (0.0, 0.4, 0.5, 0.95, 1.0)
    for parts in (4, 4096):
        monkeypatch.setattr(Q, "PARTS", parts)
        got = quantiles(df, {c: F.col(c) for c in columns}, qs)
        assert all(np.isclose(got[None, c, q], np.quantile(v, q), rtol=1e-12, atol=1e-12) for c, v in columns.items() for q in qs)
    got = quantiles(df, {"v": F.col("smooth")}, qs, F.col("g"))
    assert all(abs(got[g, "v", q] - np.quantile(columns["smooth"][group == g], q)) < 1e-12 for g in (0, 1) for q in qs)
    assert quantile(df.where("smooth > 100"), F.col("smooth"), 0.5) is None


def test_blocks_meet_at_their_edges(spark, monkeypatch):
    """Windows that reach over several blocks, of an image and of several."""
    monkeypatch.setattr(neighbourhood, "BLOCK", 8)
    a = np.random.default_rng(1).random((2, 21, 30))
    df = spark.createDataFrame([(k, r + 5, c + 3, float(a[k, r, c])) for k in range(2) for r in range(21) for c in range(30)], "image int, row int, col int, v double")
    padded = np.pad(a, ((0, 0), (4, 4), (4, 4)), mode="edge")
    want = np.array([[[padded[k, r : r + 9, c : c + 9].mean() for c in range(30)] for r in range(21)] for k in range(2)])
    got = neighbourhood.box_mean(df, ["v"], 9, ("image",)).collect()
    assert len(got) == a.size and max(abs(x["v"] - want[x["image"], x["row"] - 5, x["col"] - 3]) for x in got) < 1e-12
    grown = neighbourhood.spread(df.where("image = 0"), F.col("v") > 0.99, 2, "near").collect()
    flag = np.pad(a[0] > 0.99, 2)
    assert all(x["near"] == flag[x["row"] - 5 : x["row"], x["col"] - 3 : x["col"] + 2].any() for x in grown)


def test_discs_cut_a_zone(spark):
    ring = geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    disc = spark.range(1).select(F.lit(1).alias("zone"), F.lit(1).alias("ord"), ring.alias("ring"), F.lit(5.0).alias("cx"), F.lit(5.0).alias("cy"), F.lit(2.0).alias("radius"))
    got = {(r["row"], r["col"]) for r in zonal.label_rings(disc).collect()}
    assert got == {(r, c) for r in range(10) for c in range(10) if (r + 0.5 - 5) ** 2 + (c + 0.5 - 5) ** 2 < 4}
    touched = {(r["row"], r["col"]) for r in zonal.label_rings(disc, all_touched=True).collect()}
    assert got < touched and (5, 6) in touched and (0, 0) not in touched


@pytest.mark.parametrize("most", [1 << 16, 50])
def test_ranks_of_large_zones(spark, most):
    """One zone holds most pixels, one far value stretches its range, another has equal values only."""
    rng = np.random.default_rng(5)
    values = {1: np.append(rng.random(3000), 1e9), 2: np.full(400, 2.5), 3: rng.normal(size=40), 4: np.repeat(rng.random(7), 60), 5: np.array([4.0])}
    df = spark.createDataFrame([(z, float(v), True) for z, some in values.items() for v in some] + [(1, -5.0, False), (0, 1.0, True)], "zone int, v double, valid boolean")
    for q in (0.0, 0.25, 0.75, 1.0):
        got = {r["zone"]: r["p"] for r in zonal.nearest_rank(df, "v", q, "p", most=most).collect()}
        assert got == {z: np.sort(some)[int(np.rint(q * (len(some) - 1)))] for z, some in values.items()}


def test_quantiles_by_brackets_and_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 20_000
    data = pd.DataFrame({"a": rng.normal(size=n), "b": np.round(rng.random(n), 1), "c": np.where(rng.random(n) < 0.5, 0.0, rng.random(n)), "d": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)), "none": np.nan})
    df, qs = spark.createDataFrame(data), (0.0, 0.4, 0.5, 0.999, 1.0)
    for most in (exact.MOST_VALUES, 1):
        monkeypatch.setattr(exact, "MOST_VALUES", most)
        got = quantiles(df, {c: F.col(c) for c in data}, qs)
        assert {k[1] for k in got} == set("abcd")
        assert all(abs(got[None, c, q] - np.nanquantile(data[c], q)) < 1e-12 for c in "abcd" for q in qs)
    grouped = quantiles(df, {"a": F.col("a")}, (0.3,), by=F.col("b").cast("string"))
    assert all(abs(v - np.quantile(data["a"][data["b"].astype(str) == g], 0.3)) < 1e-12 for (g, _, _), v in grouped.items())
    assert quantile(df.limit(0), F.col("a"), 0.5) is None
