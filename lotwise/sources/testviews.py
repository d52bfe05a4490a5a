"""Parcels, pixels, scenes, structures and footprints derived from the shared test tables.

The formulas are SQL expressions that Spark and DuckDB read alike, so each query's counterpart can start from the same data.
Lots lie on a lattice 50 wide; each is 10 x 10 pixels of 2 m, of which 9 x 9 are the lot and the rest is road.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LON0, LAT0, PITCH = -79.18, 35.478, 0.0006
_ROW, _COL = "CAST(floor(c_custkey / 50e0) AS BIGINT)", "c_custkey % 50"

PARCEL = {
    "id": "c_custkey + 1",
    "pin": "concat('LOT-', CAST(c_custkey + 1 AS STRING))",
    "parid": "concat('P', CAST(c_custkey + 1 AS STRING))",
    "owner": "c_name",
    "address": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat(CAST(100 + c_custkey AS STRING), ' ', c_mktsegment, ' ST') END",
    "subdivision": "n_name",
    "lot_row": _ROW,
    "lot_col": _COL,
    "minx": f"-79.18e0 + 0.0006e0 * ({_COL})",
    "miny": f"35.478e0 + 0.0006e0 * {_ROW}",
    "maxx": f"-79.18e0 + 0.0006e0 * (({_COL}) + 0.9e0)",
    "maxy": f"35.478e0 + 0.0006e0 * ({_ROW} + 0.9e0)",
    "apr_bldg": "CASE WHEN c_custkey % 5 = 4 THEN 0e0 ELSE greatest(c_acctbal, 0e0) * 20e0 END",
    "apr_land": "30000e0",
    "dwel_desc": "CASE c_custkey % 6 WHEN 0 THEN 'RANCH' WHEN 1 THEN 'COLONIAL' WHEN 2 THEN ' split level ' WHEN 3 THEN 'GEODESIC' WHEN 4 THEN 'CAPE COD' ELSE NULL END",
    "dwel_sfla": "CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 900e0 + 100e0 * (c_custkey % 17) END",
    "ob_desc": "CASE c_custkey % 7 WHEN 0 THEN 'WOODEN SHED' WHEN 1 THEN 'ASPHALT YARD' WHEN 2 THEN 'BARN' WHEN 3 THEN 'OLD DWELLING' WHEN 4 THEN '' ELSE NULL END",
    "ob_area": "CASE WHEN c_custkey % 7 < 5 THEN 100e0 + 50e0 * (c_custkey % 13) ELSE NULL END",
    "area_m2": "324e0",
    "acres": "0.08e0",
    "dwel_yrblt": "CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 1950 + c_custkey % 70 END",
    "ob_yrblt": "CASE WHEN c_custkey % 7 < 5 THEN 1960 + c_custkey % 60 ELSE NULL END",
    "tax_card": "concat('https://cards.invalid/', CAST(c_custkey AS STRING))",
}

_R, _C = f"({_ROW} * 10 + CAST(floor(k / 10e0) AS BIGINT))", f"(({_COL}) * 10 + k % 10)"
_LOT = "(k % 10 < 9 AND k < 90)"
_ROOF = "(k % 10 BETWEEN 2 AND 6 AND k BETWEEN 20 AND 69)"


_PLACE = "`row` * 7919 + `col` * 104729"
#: ``place`` times 2654435761, modulo 2 ** 32, by its halves of 16 bits (31153 is the factor's lower half).
_MIXED = "pmod((place % 65536) * 2654435761 + (place div 65536 % 65536 * 31153) % 65536 * 65536, 4294967296)"


def _noise(band: int, split: bool) -> str:
    """Beyond row 438,000 or so a place times the factor passes 64 bits, which is an error; ``split`` starts from the columns place and mixed, with the same remainder."""
    add = band * 1299709
    mixed = f"(({_R} * 7919 + {_C} * 104729 + {add}) * 2654435761) % 4294967296"
    if split:
        mixed = f"CASE WHEN place < {-add} THEN ((place + {add}) * 2654435761) % 4294967296 ELSE (mixed + {add * 2654435761 % 4294967296}) % 4294967296 END"
    return f"0.02e0 * (({mixed}) / 4294967296e0 - 0.5e0)"


def _band(split: bool, k: int, roof: float, yard: float, road: float, debris: float, water: float) -> tuple[str, str]:
    ground = f"CASE WHEN {_ROOF} THEN {roof}e0 WHEN {_LOT} THEN {yard}e0 ELSE {road}e0 END"
    later = f"CASE WHEN c_custkey % 7 = 0 AND {_ROOF} THEN {debris}e0 WHEN c_custkey % 50 < 3 AND {_LOT} THEN {water}e0 ELSE {ground} END"
    return f"{ground} + {_noise(k, split)}", f"({later} + {_noise(k + 4, split)}) * 1.05e0 + 0.01e0"


def _pixel(split: bool) -> dict[str, str]:
    columns = {"row": _R, "col": _C, "zone": f"CASE WHEN {_LOT} THEN c_custkey + 1 ELSE 0 END", "roof": _ROOF}
    for name, args in {"blue": (0, 0.20, 0.05, 0.12, 0.34, 0.06), "green": (1, 0.22, 0.09, 0.13, 0.33, 0.08), "red": (2, 0.24, 0.07, 0.14, 0.33, 0.05), "nir": (3, 0.28, 0.40, 0.16, 0.35, 0.02)}.items():
        columns[f"pre_{name}"], columns[f"post_{name}"] = _band(split, *args)
    columns["pre_valid"] = f"({_R} * 31 + {_C} * 17) % 97 <> 0"
    columns["post_valid"] = f"({_R} * 13 + {_C} * 29) % 89 <> 0 AND c_custkey % 41 <> 40"
    return columns


_OFTEN = {"lot": _LOT, "roof": _ROOF, "row": _R, "col": _C}


def _shorter(x: str) -> str:
    for name, often in _OFTEN.items():
        x = x.replace(often, f"`{name}`")
    return x


#: The pixels' columns as DuckDB gets them; and with products that fit 64 bits for any table, from columns that are there once (the JVM compiles no method of over 8000 bytes of code).
PIXEL, PIXEL_WIDE = _pixel(False), {n: _shorter(x) for n, x in _pixel(True).items()}

SCENE = {
    "id": "event_id",
    "datetime": "ts",
    "provider": "CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'demo' ELSE 'catalogue' END",
    "platform": "event_type",
    "cloud": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE least(abs(value), 100e0) END",
    "west": "-79.3e0 + 0.001e0 * (user_id % 200)",
    "east": "-79.3e0 + 0.001e0 * (user_id % 200) + 0.1e0",
    "synthetic": "user_id % 3 = 1",
}

FOOTPRINT = {
    "fid": "p_partkey",
    "x0": "-79.18e0 + 0.0006e0 * ((p_partkey * 7) % 50) + 0.00001e0 * (p_partkey % 50)",
    "y0": "35.478e0 + 0.0006e0 * ((p_partkey * 3) % 30) + 0.00001e0 * (p_partkey % 37)",
    "w": "0.00005e0 * (2 + p_size % 7)",
    "kind": "p_type",
}


#: Lots of a form that is no box: two boxes on top of each other, the upper one narrower. The part of the width and of the height where it starts.
NOTCH_X, NOTCH_Y = "minx + (maxx - minx) * (0.3e0 + 0.1e0 * (id % 3))", "miny + (maxy - miny) * 0.4e0"


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in columns.items())


#: The same views for DuckDB, as WITH entries.
SQL_VIEWS = {
    "parcels": f"parcels AS (SELECT {select_list(PARCEL)} FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "pixels": f"pixels AS (SELECT {select_list(PIXEL)} FROM customer, range(100) AS t(k))",
    "scenes": f"scenes AS (SELECT {select_list(SCENE)} FROM events)",
    "footprints": f"footprints AS (SELECT {select_list(FOOTPRINT)} FROM part)",
    "lots": f"lots AS (SELECT id, minx AS x0, miny AS y0, maxx AS x1, {NOTCH_Y} AS y1 FROM parcels UNION ALL SELECT id, minx, {NOTCH_Y}, {NOTCH_X}, maxy FROM parcels)",
}

def notched(x0: str, y0: str, x1: str, y1: str, xm: str, ym: str):
    """The six-cornered ring of two such boxes as a shape."""
    return F.expr(f"array(array({', '.join(f'named_struct({chr(39)}x{chr(39)}, CAST({x} AS DOUBLE), {chr(39)}y{chr(39)}, CAST({y} AS DOUBLE))' for x, y in ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1)))}))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")  # a fixed table of 25 rows
    both = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.selectExpr(*[f"{x} AS {n}" for n, x in PARCEL.items()])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dates of every pixel: row, col, zone (0: road), roof, pre_*, post_*."""
    cells = table(spark, sf_dir, "customer").selectExpr("c_custkey", "explode(sequence(0L, 99L)) AS k")
    for made in (_OFTEN, {"place": _PLACE}, {"mixed": _MIXED}):  # once a pixel, for all bands
        cells = cells.selectExpr("*", *[f"{x} AS `{n}`" for n, x in made.items()])
    return cells.selectExpr(*[f"{x} AS {n}" for n, x in PIXEL_WIDE.items()])


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {n}" for n, x in SCENE.items()])


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{x} AS {n}" for n, x in FOOTPRINT.items()])


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parcels with six-cornered shapes."""
    return parcels(spark, sf_dir).withColumn("shape", notched("minx", "miny", "maxx", "maxy", NOTCH_X, NOTCH_Y))
