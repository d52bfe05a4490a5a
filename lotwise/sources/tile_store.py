"""Parcels stored by tile, with rows added and replaced in place.

Below the store's path lie ``parcels`` (a folder for each tile), ``index`` (the tile of every id, in a fixed number of buckets) and ``meta``. An insert rewrites the tiles that its
rows leave and enter, and the buckets of their ids; all other files stay as they are. Tiles are written before the index, so an insert that broke off is mended by running it again. One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import parcels as P
from lotwise.sources.tables import scope, stored

BUCKETS = 64
#: Tiles up to which a filter names them; more are met by a join.
NAMED = 2_000


class TileStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- folders ----------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, part: str) -> bool:
        fs, at = self._fs(f"{self.path}/{part}")
        return bool(fs.exists(at)) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at))

    def _delete(self, part: str) -> None:
        fs, at = self._fs(f"{self.path}/{part}")
        fs.delete(at, True)

    def exists(self) -> bool:
        return self._there("parcels")

    # -- writing ----------------------------------------------------------------------------------------------------------

    @staticmethod
    def tile() -> Column:
        """The tile of a parcel's corner; one that is larger than a tile stands in a folder of its own that every search reads."""
        wide = (F.col("maxx") - F.col("minx") > P.TILE) | (F.col("maxy") - F.col("miny") > P.TILE)
        return F.when(wide, F.lit("wide")).otherwise(P.tile_of(F.col("minx"), F.col("miny")))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")

    def _replace(self, rows: DataFrame, part: str, by: str) -> None:
        """Overwrites those folders of a part that ``rows`` have rows for. Large tiles are dealt to several files, small ones share tasks."""
        rows.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{part}")

    def insert(self, rows: DataFrame, order: str | None = None) -> None:
        """Adds rows, or puts them in the place of those with their ids, wherever these lie. Of several rows of an id the last by ``order`` counts (without one, any)."""
        cols = [c for c in rows.columns if c != order]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*cols), F.col(order) if order else F.lit(0)).alias("r")).select("r.*")
        with scope():
            last = stored(last.withColumns({"tile": self.tile(), "bucket": self._bucket()}))
            new_index = last.select(self.key, "tile", "bucket")
            if not self.exists():
                self._replace(last.drop("bucket"), "parcels", "tile")
                self._replace(new_index, "index", "bucket")
                return
            buckets = [r[0] for r in last.select("bucket").distinct().collect()]  # at most BUCKETS
            index = stored(self.spark.read.parquet(f"{self.path}/index").where(F.col("bucket").isin(buckets)).select(self.key, "tile", "bucket"))
            left = index.join(last.select(self.key), self.key, "left_semi").select("tile")
            touched = stored(left.union(last.select("tile")).distinct())
            fresh = stored(self._in_tiles(touched).join(last.select(self.key), self.key, "left_anti").unionByName(last.drop("bucket"), allowMissingColumns=True))
            self._replace(fresh, "parcels", "tile")
            for r in touched.join(fresh.select("tile").distinct(), "tile", "left_anti").toLocalIterator():
                self._delete(f"parcels/tile={r['tile']}")
            self._replace(stored(index.join(last.select(self.key), self.key, "left_anti").unionByName(new_index)), "index", "bucket")

    def reset(self) -> None:
        """Takes all parcels out; the meta values stay."""
        self._delete("parcels")
        self._delete("index")

    # -- reading ----------------------------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """All parcels, with their tile."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/parcels")

    def _in_tiles(self, tiles: DataFrame) -> DataFrame:
        some = [r["tile"] for r in tiles.limit(NAMED + 1).collect()]
        return self.read().where(F.col("tile").isin(some)) if len(some) <= NAMED else self.read().join(tiles, "tile", "left_semi")

    def get(self, key: int) -> DataFrame:
        """The parcel of an id: one bucket and one tile are read."""
        at = self.spark.read.parquet(f"{self.path}/index").where((F.col(self.key) == key) & (F.col("bucket") == F.lit(self.bucket_of(key)))).select("tile").first()
        return self.read().where((F.col("tile") == (at["tile"] if at else "")) & (F.col(self.key) == key))

    def bucket_of(self, key: int) -> int:
        return self.spark.range(1).select(F.lit(key).cast("bigint").alias(self.key)).select(self._bucket()).first()[0]

    def in_box(self, box: tuple[float, float, float, float]) -> DataFrame:
        """Parcels whose bounds meet a box; only the tiles around it are read."""
        return P.candidates(self.read().where(F.col("tile").isin(["wide", *self._names(box)])), box)

    @staticmethod
    def _names(box: tuple[float, float, float, float]) -> Iterator[str]:
        w, s, e, n = box
        span = lambda a, b: range(int((a - P.TILE) // P.TILE), int(b // P.TILE) + 1)
        return (f"{i}_{j}" for i in span(w, e) for j in span(s, n))

    # -- meta -------------------------------------------------------------------------------------------------------------

    def meta(self) -> DataFrame:
        """(key, value as JSON)."""
        if not self._there("meta"):
            return self.spark.createDataFrame([], "key string, value string")
        return P.all_meta(self.spark.read.parquet(f"{self.path}/meta"))

    def set_meta(self, key: str, value: Column) -> None:
        with scope():
            stored(P.set_meta(self.meta(), key, value)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")  # a handful of values

    def get_meta(self, key: str) -> str | None:
        return P.get_meta(self.meta(), key)
