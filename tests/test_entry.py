import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lotwise.plans import queries as Q
from lotwise.plans.assessment import Jobs, assess
from lotwise.sources import testviews as V
from lotwise.streaming import intake

DATA = "/root/testdata/sf0.001"
QUICK = ["get_many_ordered", "bbox_precise_box", "utm_forward", "taxroll_structures", "footprint_overlap_join", "zonal_quantile_nearest_rank", "box_filter", "ols_fit_trimmed", "damage_score", "parcel_rollup", "scene_search", "threshold_sweep"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(Q.ORACLE_SQL[name]).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_jobs(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path))
    job = jobs.submit(lambda: assess(V.parcels(spark, DATA), V.pixels(spark, DATA), 2.0))
    bad = jobs.submit(lambda: 1 / 0)
    import time

    for _ in range(600):
        if {job.status, bad.status} <= {"done", "error"}:
            break
        time.sleep(0.2)
    assert job.status == "done" and jobs.result(job.id, "summary").first()["parcels"] == 150
    assert bad.status == "error" and bad.error.startswith("ZeroDivisionError") and jobs.get("nothing") is None


def test_stream_of_scenes(spark, tmp_path):
    scenes = V.scenes(spark, DATA)
    for k in range(2):
        scenes.where(f"id % 2 = {k} or id = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = intake.arrivals(spark, str(tmp_path / "in"), scenes.schema, "40 days")
    intake.into(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == scenes.count()
