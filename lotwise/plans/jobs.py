"""Assessments as background jobs: a durable log of their states, and their result files."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import geo
from lotwise.operators import raster as R
from lotwise.params import JobError
from lotwise.plans import reports
from lotwise.sources import files

ENDED = ("done", "error")
#: Layers of a job's pyramid, as far as its change table has them.
LAYERS = ("score", "magnitude", "structure_loss", "ndvi_delta", "flooded", "vegetation_loss")


@dataclass
class Job:
    id: str
    status: str = "queued"
    error: str = ""
    created: float = field(default_factory=time.time)
    path: str = ""


class JobLog:
    """States of jobs, each a row that is added and never changed, in a folder of its own as writers to one folder would clear each other's work: a job is what its latest row says. Any number of processes may
    write and read one log.

    A process that works on a job appends a sign of life from time to time; a job that has not ended and gave none for ``lost_after`` seconds is lost.
    """

    SHAPE = "id string, status string, error string, created double, path string, at double"

    def __init__(self, spark: SparkSession, path: str, lost_after: float = 120.0):
        self.spark, self.path, self.lost_after = spark, path, lost_after

    def append(self, job: Job) -> None:
        self.spark.createDataFrame([(*asdict(job).values(), time.time())], self.SHAPE).coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def latest(self) -> DataFrame:
        """One row for each job."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at):
            return self.spark.createDataFrame([], self.SHAPE)
        last = self.spark.read.schema(self.SHAPE).parquet(f"{self.path}/*").groupBy("id").agg(F.max_by(F.struct("status", "error", "created", "path", "at"), "at").alias("r")).select("id", "r.*")
        silent = ~F.col("status").isin(*ENDED) & (F.col("at") < time.time() - self.lost_after)
        return last.withColumn("status", F.when(silent, "lost").otherwise(F.col("status")))

    def get(self, key: str) -> Job | None:
        row = self.latest().where(F.col("id") == key).first()
        return Job(row["id"], row["status"], row["error"], row["created"], row["path"]) if row else None

    def recent(self, limit: int) -> list[Job]:
        return [Job(r["id"], r["status"], r["error"], r["created"], r["path"]) for r in self.latest().orderBy(F.desc("created"), "id").limit(limit).collect()]


class Jobs:
    """Assessments run in background threads, each in a scheduler pool of its own; results are tables and files below a folder, which several processes may share."""

    def __init__(self, spark: SparkSession, folder: str, lost_after: float = 120.0):
        self.spark, self.folder, self.jobs, self.log = spark, folder, {}, JobLog(spark, f"{folder}/log", lost_after)

    def submit(self, make, raster: R.Raster | None = None) -> Job:
        """Starts a job; ``make()`` returns an Assessment. With the grid of its pixels its layers are stored as a pyramid."""
        job = Job(uuid.uuid4().hex[:12])
        job.path = f"{self.folder}/{job.id}"
        self.jobs[job.id] = job
        self.log.append(job)
        threading.Thread(target=inheritable_thread_target(self.spark)(self._run), args=(job, make, raster), daemon=True).start()
        return job

    def _run(self, job: Job, make, raster: R.Raster | None) -> None:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.id)
        ended = threading.Event()

        def live() -> None:
            while not ended.wait(self.log.lost_after / 3):
                self.log.append(job)

        threading.Thread(target=live, daemon=True).start()
        status, error = "done", ""
        try:
            job.status = "running"
            self.log.append(job)
            self._save(job, make(), raster)
        except JobError as e:
            status, error = "error", str(e)
        except Exception as e:  # whatever a job may raise is its result
            status, error = "error", f"{type(e).__name__}: {e}"[:500]
        finally:
            ended.set()
            self.log.append(Job(job.id, status, error, job.created, job.path))
            job.error, job.status = error, status

    def _save(self, job: Job, made, raster: R.Raster | None) -> None:
        for name in ("structures", "parcels", "summary"):
            getattr(made, name).write.mode("overwrite").parquet(f"{job.path}/{name}")
        parcels, structures = reports.parcel_report(made.roll, made.parcels), reports.structure_report(made.roll, made.structures)
        for name, rows in {"parcels_csv": reports.parcels_file(parcels), "buildings_csv": reports.structures_file(structures)}.items():
            rows.write.mode("overwrite").option("header", True).csv(f"{job.path}/{name}")
        for name, rows in {"parcels_geojson": parcel_features(parcels, made.summary), "buildings_geojson": structure_features(structures, made.roll)}.items():
            rows.write.mode("overwrite").text(f"{job.path}/{name}")
        if raster is not None:
            layers = [c for c in LAYERS if c in made.change.columns]
            R.write_pyramid(made.change, layers, raster, f"{job.path}/layers")
            self.spark.createDataFrame([(raster.left, raster.top, raster.gsd, raster.width, raster.height)], "left double, top double, gsd double, width int, height int").coalesce(1).write.mode("overwrite").parquet(f"{job.path}/grid")

    def get(self, key: str) -> Job | None:
        """A job of this process, or of another that wrote to the same folder."""
        return self.jobs.get(key) or self.log.get(key)

    def recent(self, limit: int = 20) -> list[Job]:
        """The latest jobs of all processes."""
        return self.log.recent(limit)

    def result(self, key: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{key}/{name}")

    def chip(self, key: str, bounds: tuple[float, float, float, float], size: int = 320, pad: float = 25.0, layers: tuple[str, ...] = ("score",)) -> dict[str, np.ndarray]:
        """Layers around a lot, given by its bounds (x0, y0, x1, y1) in metres of the job's grid, as arrays of ``size`` pixels along the longer side."""
        job = self.get(key)
        if job is None or job.status != "done":
            raise JobError(f"job {key!r} has no results")
        grid = R.Raster(**self.result(key, "grid").first().asDict())
        x0, y0, x1, y1 = bounds
        box = (int((grid.top - y1 - pad) // grid.gsd), int((x0 - pad - grid.left) // grid.gsd), -int((y0 - pad - grid.top) // grid.gsd), -int((grid.left - x1 - pad) // grid.gsd))
        return R.chip(self.spark, f"{job.path}/layers", list(layers), grid, box, size)


def parcel_features(report: DataFrame, summary: DataFrame) -> DataFrame:
    """The lines of the parcels' feature collection; its properties are the summary."""
    ring = geo.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    held = [c for c in report.columns if not c.startswith("_") and c not in ("minx", "miny", "maxx", "maxy", "worst_rank", "shape")]
    return reports.collection(report.select(F.col("id").alias("ord"), files.feature_json(held, ring).alias("feature")), summary)


def structure_features(report: DataFrame, parcels: DataFrame) -> DataFrame:
    """The lines of the structures' feature collection. A structure without a shape of its own has the middle of its parcel as its place."""
    middle = F.struct(((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    placed = report.join(parcels.select(F.col("id").alias("parcel_id"), middle.alias("_at")), "parcel_id", "left")
    geometry = F.when(F.col("_at").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("_at.x", "_at.y").alias("coordinates")))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*report.columns).alias("properties")), {"ignoreNullFields": "false"})
    order = F.row_number().over(reports.file_order("parcel_id", "ord"))
    return reports.collection(placed.select(order.alias("ord"), feature.alias("feature")))
