"""Every operator as a named query over the points of ``lineitem``, and the same query as DuckDB SQL."""

from __future__ import annotations

import functools
import json
import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import geometry, octree
from .operators import apply, areas, catalog, pyramid, stats, thinning, tiling
from .plans.filters import Filter
from .sources import store, tiled, vpc
from .sources.lineitem import DUCKDB_EPOCH, ORDER, POINTS_SQL, points

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
#: The last column of the order as a whole number, for hashes.
WHOLE = {"l_extendedprice": "CAST(round(l_extendedprice * 100) AS BIGINT)"}
BASE = KEYS + ("X", "Y", "Z")
_WITH = f"WITH points AS ({POINTS_SQL.format(epoch=DUCKDB_EPOCH, table='lineitem')})"
_BASE = ", ".join(BASE)
_ORDER = ", ".join(ORDER.columns)
_MD5 = "md5(concat_ws('-', '{seed}', " + ", ".join(f"CAST({WHOLE.get(c, f'CAST({c} AS BIGINT)')} AS VARCHAR)" for c in ORDER.columns) + "))"
EXTENT = (0.0, 0.0, 1100.0, 1000.0)


def _query(name: str, sql: str | None = None, own: bool = False):
    """Registers a query of the points; its SQL may use ``points``."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _QUERIES[name] = f if own else lambda spark, sf_dir: f(points(spark, sf_dir))
        if sql is not None:
            _SQL[name] = f"{_WITH} {sql}".replace("WITH points", "WITH RECURSIVE points", 1)
        return f

    return add


def _filtered(name: str, text: str, where: str, extra: tuple[str, ...] = ()) -> None:
    """A filter string over the points."""
    columns = BASE + extra
    _query(name, f"SELECT {', '.join(columns)} FROM points WHERE {where}")(lambda p: Filter.parse(text).where(p).select(*columns))


_filtered("keep_class", "-keep_class 2 6 9", "Classification IN (2, 6, 9)", ("Classification",))
_filtered("drop_class", "-drop_class 0 1 2 3 4 5 6 7 8 9 10", "Classification NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)", ("Classification",))
_filtered("keep_ground", "-keep_ground", "Classification = 2", ("Classification",))
_filtered("drop_noise", "-drop_noise", "Classification NOT IN (7, 18)", ("Classification",))
_filtered("keep_first", "-keep_first", "ReturnNumber = 1", ("ReturnNumber",))
_filtered("keep_last", "-keep_last", "ReturnNumber = NumberOfReturns", ("ReturnNumber", "NumberOfReturns"))
_filtered("keep_single", "-keep_single", "NumberOfReturns = 1", ("NumberOfReturns",))
_filtered("keep_return", "-keep_return 2 3", "ReturnNumber IN (2, 3)", ("ReturnNumber",))
_filtered("drop_return", "-drop_return 1 2 3", "ReturnNumber NOT IN (1, 2, 3)", ("ReturnNumber",))
_filtered("drop_withheld", "-drop_withheld", "Withheld_flag = 0", ("Withheld_flag",))
_filtered("drop_overlap", "-drop_overlap", "Overlap_flag = 0", ("Overlap_flag",))
_filtered("intensity_range", "-keep_intensity_above 10000 -keep_intensity_below 30000", "Intensity BETWEEN 10000 AND 30000", ("Intensity",))
_filtered("z_above_below", "-keep_z_above 10 -keep_z_below 20", "Z BETWEEN 10 AND 20")
_filtered("drop_z", "-drop_z_above 40 -drop_z_below 30", "Z BETWEEN 30 AND 40")
_filtered("scan_angle_range", "-keep_scan_angle_above -10 -keep_scan_angle_below 12.5", "ScanAngleRank BETWEEN -10 AND 12.5", ("ScanAngleRank",))


@_query("bbox_filter", f"SELECT {_BASE}, Classification FROM points WHERE X BETWEEN 200 AND 600 AND Y BETWEEN 100 AND 700 AND Classification NOT IN (7, 18) AND ReturnNumber = 1")
def bbox_filter(p: DataFrame) -> DataFrame:
    p = Filter.parse("-drop_noise -keep_first").where(p.where(geometry.box(200, 100, 600, 700)))
    return schema.select(p, "xyzc").select(*BASE, "Classification")


@_query("zrange_filter", f"SELECT {_BASE} FROM points WHERE Z BETWEEN 5 AND 12.5")
def zrange_filter(p: DataFrame) -> DataFrame:
    return p.where(F.col("Z").between(5, 12.5)).select(*BASE)


@_query("half_open_box", f"SELECT {_BASE} FROM points WHERE X >= 100 AND X < 300 AND Y >= 50 AND Y < 250")
def half_open_box(p: DataFrame) -> DataFrame:
    return p.where(geometry.box(100, 50, 300, 250, half_open=True)).select(*BASE)


@_query("select_letters", "SELECT X, Y, Z, Intensity, ReturnNumber, NumberOfReturns, Classification, R, G, B, NIR FROM points WHERE X BETWEEN 100 AND 400")
def select_letters(p: DataFrame) -> DataFrame:
    return schema.select(p.drop(*ORDER.columns, "extra_discount").where(F.col("X").between(100, 400)), "irncRN")


@_query("lidar_types", "SELECT l_orderkey, CAST(trunc(ScanAngleRank) AS INTEGER) AS ScanAngleRank, Withheld_flag <> 0 AS Withheld_flag, Overlap_flag <> 0 AS Overlap_flag, Intensity FROM points")
def lidar_types(p: DataFrame) -> DataFrame:
    return schema.as_lidar_types(p.select("l_orderkey", "ScanAngleRank", "Withheld_flag", "Overlap_flag", "Intensity"))


@_query("standard_names", "SELECT X, Y, Z, Intensity, ReturnNumber, ScanAngleRank, R, NIR FROM points WHERE Z > 25")
def standard_names(p: DataFrame) -> DataFrame:
    names = {"X": "x", "Y": "Y", "Z": "z", "Intensity": "INTENSITY", "ReturnNumber": "return_number", "ScanAngleRank": "Scan_Angle", "R": "red", "NIR": "nir"}
    other = p.where("Z > 25").select(*(F.col(c).alias(n) for c, n in names.items()))
    return schema.with_standard_names(other)


@_query("every_nth", f"SELECT {_BASE} FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS k FROM points WHERE Classification NOT IN (7, 18)) WHERE k % 7 = 1")
def every_nth(p: DataFrame) -> DataFrame:
    p = Filter.parse("-drop_noise").where(p).select(*ORDER.columns, "X", "Y", "Z")
    return thinning.every_nth(p, 7, ORDER).select(*BASE)


@_query("random_fraction", f"SELECT {_BASE} FROM points WHERE substring({_MD5.format(seed=5)}, 1, 8) < '{int(0.2 * 2**32):08x}'")
def random_fraction(p: DataFrame) -> DataFrame:
    return thinning.random_fraction(p, 0.2, ORDER, 5, WHOLE).select(*BASE)


@_query("combined_filter", f"SELECT {_BASE}, Intensity, Classification FROM points WHERE X BETWEEN 100 AND 800 AND Y BETWEEN 50 AND 900 AND Z BETWEEN 2 AND 45 AND Classification NOT IN (7, 18) AND ReturnNumber = 1 AND Withheld_flag = 0 AND Intensity >= 1000")
def combined_filter(p: DataFrame) -> DataFrame:
    p = p.where(geometry.box(100, 50, 800, 900) & F.col("Z").between(2, 45))
    return Filter.parse("-keep_first -drop_noise -drop_withheld -keep_intensity_above 1000").where(p).select(*BASE, "Intensity", "Classification")


def _voxel_sql(size: float, rank: str) -> str:
    return f"SELECT {_BASE} FROM (SELECT *, row_number() OVER (PARTITION BY floor(X / {size}), floor(Y / {size}), floor(Z / {size}) ORDER BY {rank}{_ORDER}) AS k FROM points) WHERE k = 1"


_D = [f"({c} - (floor({c} / 20.0e0) + 0.5e0) * 20.0e0)" for c in "XYZ"]
_D2 = " + ".join(f"{d} * {d}" for d in _D)


@_query("voxel_center", _voxel_sql(20.0, f"{_D2}, "))
def voxel_center(p: DataFrame) -> DataFrame:
    return thinning.voxel_thin(p.select(*ORDER.columns, "X", "Y", "Z"), 20.0, ORDER).select(*BASE)


@_query("voxel_first", _voxel_sql(25.0, ""))
def voxel_first(p: DataFrame) -> DataFrame:
    return thinning.voxel_thin(p.select(*ORDER.columns, "X", "Y", "Z"), 25.0, ORDER, "first").select(*BASE)


@_query("voxel_random", _voxel_sql(25.0, _MD5.format(seed=3) + ", "))
def voxel_random(p: DataFrame) -> DataFrame:
    return thinning.voxel_thin(p.select(*ORDER.columns, "X", "Y", "Z"), 25.0, ORDER, "random", 3, WHOLE).select(*BASE)


@_query("sample_n", f"SELECT {_BASE} FROM points ORDER BY {_MD5.format(seed=9)}, {_ORDER} LIMIT 1000")
def sample_n(p: DataFrame) -> DataFrame:
    return thinning.sample(p.select(*ORDER.columns, "X", "Y", "Z"), 1000, ORDER, 9, WHOLE).select(*BASE)


@_query("max_points_head", f"SELECT {_BASE} FROM points WHERE Classification = 2 ORDER BY {_ORDER} LIMIT 500")
def max_points_head(p: DataFrame) -> DataFrame:
    return thinning.head(Filter.parse("-keep_ground").where(p).select(*ORDER.columns, "X", "Y", "Z"), 500, ORDER).select(*BASE)


@_query("quantize_roundtrip", "SELECT l_orderkey, l_linenumber, CAST(round((X - 9.0e0) / 0.01e0) AS INTEGER) AS x_raw, round(CAST(round((X - 9.0e0) / 0.01e0) AS INTEGER) * 0.01e0 + 9.0e0, 4) AS x_back, CAST(round(ScanAngleRank / 0.006e0) AS INTEGER) AS angle_raw FROM points")
def quantize_roundtrip(p: DataFrame) -> DataFrame:
    raw = F.round((F.col("X") - 9.0) / 0.01).cast("int")
    return p.select("l_orderkey", "l_linenumber", raw.alias("x_raw"), stats.rounded(raw * F.lit(0.01) + 9.0, 4).alias("x_back"), F.round(F.col("ScanAngleRank") / schema.ANGLE_STEP).cast("int").alias("angle_raw"))


@_query("flags_pack_unpack", "SELECT l_orderkey, l_linenumber, Synthetic_flag + 2 * Keypoint_flag + 4 * Withheld_flag + 8 * Overlap_flag AS packed, Withheld_flag AS withheld, Overlap_flag AS overlap FROM points")
def flags_pack_unpack(p: DataFrame) -> DataFrame:
    packed = F.lit(0)
    for k, name in enumerate(schema.FLAGS):
        packed = packed.bitwiseOR(F.shiftleft(F.col(name), k))
    back = lambda k: F.shiftright("packed", k).bitwiseAND(1)
    return p.select("l_orderkey", "l_linenumber", packed.alias("packed")).select("*", back(2).alias("withheld"), back(3).alias("overlap"))


RINGS = (((100, 100), (700, 150), (900, 800), (400, 950), (100, 100)), ((350, 300), (600, 300), (600, 600), (350, 600), (350, 300)))


def _polygon_sql() -> str:
    edges = [(*a, *b) for ring in RINGS for a, b in zip(ring, ring[1:], strict=False)]
    crossings = " + ".join(f"CASE WHEN (({y1} > Y AND {y2} <= Y) OR ({y2} > Y AND {y1} <= Y)) THEN CASE WHEN X < ({x2} - {x1}) * (Y - {y1}) / CAST({y2 - y1} AS DOUBLE) + {x1} THEN 1 ELSE 0 END ELSE 0 END" for x1, y1, x2, y2 in edges if y1 != y2)
    border = " OR ".join(f"(({x2} - {x1}) * (Y - {y1}) = ({y2} - {y1}) * (X - {x1}) AND X BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND Y BETWEEN {min(y1, y2)} AND {max(y1, y2)})" for x1, y1, x2, y2 in edges)
    return f"(({crossings}) % 2 = 1 OR {border})"


@_query("polygon_clip", f"SELECT {_BASE} FROM points WHERE {_polygon_sql()}")
def polygon_clip(p: DataFrame) -> DataFrame:
    return p.where(geometry.in_polygon(RINGS)).select(*BASE)


@_query("many_areas_semi_join", f"SELECT {_BASE} FROM points WHERE (X BETWEEN 50 AND 250 AND Y BETWEEN 50 AND 250) OR (X BETWEEN 200 AND 400 AND Y BETWEEN 200 AND 400)")
def many_areas(p: DataFrame) -> DataFrame:
    return p.where(geometry.in_any_polygon([geometry.Area.of(b).polygons[0] for b in ((50, 50, 250, 250), (200, 200, 400, 400))])).select(*BASE)


#: Diamonds of a grid; every point but those between them is in one.
_DIAMONDS = [(60.0 * i + 30, 60.0 * j + 30, 25.0) for i in range(18) for j in range(16)]


@_query("areas_join", f"SELECT {_BASE} FROM points, (SELECT 60.0e0 * i + 30 AS cx, 60.0e0 * j + 30 AS cy FROM (SELECT unnest(range(18)) AS i), (SELECT unnest(range(16)) AS j)) WHERE abs(X - cx) + abs(Y - cy) <= 25")
def areas_join(p: DataFrame) -> DataFrame:
    shapes = [geometry.Area.of({"type": "Polygon", "coordinates": [[(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]]}) for x, y, r in _DIAMONDS]
    return areas.within_any(p, shapes).select(*BASE)


def _near_sql(x1: float, y1: float, x2: float, y2: float, width: float) -> str:
    dx, dy = x2 - x1, y2 - y1
    t = f"greatest(0.0e0, least(1.0e0, ((X - {x1}) * {dx} + (Y - {y1}) * {dy}) / {dx * dx + dy * dy}e0))"
    return f"(X - ({x1} + {t} * {dx})) * (X - ({x1} + {t} * {dx})) + (Y - ({y1} + {t} * {dy})) * (Y - ({y1} + {t} * {dy})) <= {width * width}"


@_query("corridor", f"SELECT {_BASE} FROM points WHERE {_near_sql(100, 100, 500, 400, 20)} OR {_near_sql(500, 400, 900, 300, 20)}")
def corridor(p: DataFrame) -> DataFrame:
    return p.where(geometry.near_line([(100, 100), (500, 400), (900, 300)], 20)).select(*BASE)


@_query("point_buffer", f"SELECT {_BASE} FROM points WHERE (X - 500) * (X - 500) + (Y - 500) * (Y - 500) <= 10000")
def point_buffer(p: DataFrame) -> DataFrame:
    return p.where(geometry.near_line([(500, 500)], 100)).select(*BASE)


#: The root cube and the nodes of a level in SQL.
_CUBE = """, e AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1, min(Z) AS z0, max(Z) AS z1 FROM points),
h AS (SELECT *, CASE WHEN greatest(x1 - x0, y1 - y0, z1 - z0) / 2 < 1e-6 THEN 1.0e0 ELSE greatest(x1 - x0, y1 - y0, z1 - z0) / 2 END * 1.001e0 AS half FROM e),
cube AS (SELECT half, (x0 + x1) / 2 - half AS ox, (y0 + y1) / 2 - half AS oy, (z0 + z1) / 2 - half AS oz FROM h)"""


def _nodes_sql(name: str, level: int) -> str:
    side = f"(2 * half / {2**level})"
    index = lambda c: f"least(greatest(CAST(floor(({c} - o{c.lower()}) / {side}) AS BIGINT), 0), {2**level - 1})"
    return f""", {name}_k AS (SELECT {index('X')} AS x, {index('Y')} AS y, {index('Z')} AS z, ox, oy, oz, half FROM points, cube),
{name} AS (SELECT {level} AS level, x, y, z, count(*) AS point_count, any_value(ox) + x * any_value({side}) AS xmin, any_value(oy) + y * any_value({side}) AS ymin, any_value(oz) + z * any_value({side}) AS zmin,
any_value(ox) + x * any_value({side}) + any_value({side}) AS xmax, any_value(oy) + y * any_value({side}) + any_value({side}) AS ymax, any_value(oz) + z * any_value({side}) + any_value({side}) AS zmax FROM {name}_k GROUP BY x, y, z)"""


def _nodes(p: DataFrame, level: int) -> DataFrame:
    return octree.nodes(p, octree.Cube.of(p), level)


@_query("octree_keys", f"{_CUBE}{_nodes_sql('n', 4)} SELECT x AS kx, y AS ky, z AS kz, count(*) AS n FROM n_k GROUP BY x, y, z")
def octree_keys(p: DataFrame) -> DataFrame:
    return octree.with_keys(p, octree.Cube.of(p), 4).groupBy("kx", "ky", "kz").agg(F.count(F.lit(1)).alias("n"))


@_query("octree_nodes", f"{_CUBE}{_nodes_sql('n', 3)} SELECT level, x, y, z, point_count FROM n")
def octree_nodes(p: DataFrame) -> DataFrame:
    return _nodes(p, 3).select("level", "x", "y", "z", "point_count")


@_query("node_bounds", f"{_CUBE}{_nodes_sql('n', 3)} SELECT x, y, z, round(xmin, 4) AS xmin, round(ymin, 4) AS ymin, round(zmin, 4) AS zmin, round(xmax, 4) AS xmax, round(ymax, 4) AS ymax, round(zmax, 4) AS zmax FROM n")
def node_bounds(p: DataFrame) -> DataFrame:
    return _nodes(p, 3).select("x", "y", "z", *(stats.rounded(c, 4).alias(c) for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")))


#: A level by a hash of the order key: 3 in 64 points at level 0, and so on.
_LEVEL = "CASE WHEN l_orderkey % 64 = 0 THEN 0 WHEN l_orderkey % 16 = 1 THEN 1 WHEN l_orderkey % 4 = 2 THEN 2 ELSE 3 END"


@_query("lod_max_depth", f"SELECT {_BASE}, {_LEVEL} AS level FROM points WHERE {_LEVEL} <= 1")
def lod_max_depth(p: DataFrame) -> DataFrame:
    return p.withColumn("level", F.expr(_LEVEL)).where(octree.within("level", 1)).select(*BASE, "level")


@_query("lod_resolution", f"SELECT {_BASE}, {_LEVEL} AS level FROM points WHERE {_LEVEL} <= greatest(0, CAST(floor(log2(10.0 / 2.0)) AS INTEGER))")
def lod_resolution(p: DataFrame) -> DataFrame:
    return p.withColumn("level", F.expr(_LEVEL)).where(octree.within("level", octree.depth_of_resolution(10.0, 2.0))).select(*BASE, "level")


_WINDOWS = "w AS (SELECT i + 4 * j AS window_id, i * 250.0e0 AS xmin, j * 250.0e0 AS ymin, i * 250.0e0 + 240.0e0 AS xmax, j * 250.0e0 + 240.0e0 AS ymax FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j))"
_ESTIMATE = "CAST(coalesce(sum(n.point_count), 0) AS BIGINT) AS estimated_points, count(n.point_count) AS num_nodes"
_MEETS = "n.xmin <= w.xmax AND n.xmax >= w.xmin AND n.ymin <= w.ymax AND n.ymax >= w.ymin"


@_query(
    "estimate_points",
    f"{_CUBE}{_nodes_sql('n', 5)}, {_WINDOWS}, k AS (SELECT window_id, w.xmin, w.ymin, w.xmax, w.ymax, {_ESTIMATE} FROM w LEFT JOIN n ON {_MEETS} GROUP BY ALL) SELECT *, (xmax - xmin) * (ymax - ymin) AS area, round(estimated_points / ((xmax - xmin) * (ymax - ymin)), 8) AS density FROM k",
)
def estimate_points(p: DataFrame) -> DataFrame:
    i, j = F.col("id") % 4, F.floor(F.col("id") / 4)
    w = p.sparkSession.range(16).select(F.col("id").alias("window_id"), (i * 250.0).alias("xmin"), (j * 250.0).alias("ymin"), (i * 250.0 + 240.0).alias("xmax"), (j * 250.0 + 240.0).alias("ymax"))
    return tiling.estimate(_nodes(p, 5), w).withColumn("density", stats.rounded("density", 8))


@_query(
    "density",
    f"{_CUBE}{_nodes_sql('n', 5)} SELECT CAST(sum(point_count) AS BIGINT) AS estimated_points, count(*) AS num_nodes, 120000.0e0 AS area, round(sum(point_count) / 120000.0e0, 8) AS density FROM n WHERE xmin <= 500 AND xmax >= 200 AND ymin <= 500 AND ymax >= 100",
)
def density(p: DataFrame) -> DataFrame:
    one = p.sparkSession.range(1).select(F.lit(0).alias("window_id"), F.lit(200.0).alias("xmin"), F.lit(100.0).alias("ymin"), F.lit(500.0).alias("xmax"), F.lit(500.0).alias("ymax"))
    return tiling.estimate(_nodes(p, 5), one).select("estimated_points", "num_nodes", "area", stats.rounded("density", 8).alias("density"))


_MOST, _DEEPEST = 8000, 4


@_query(
    "adaptive_split",
    f"""{_CUBE}{_nodes_sql('n', 6)},
q AS (SELECT d, i, j, i * ({EXTENT[2]}e0 / (1 << d)) AS xmin, j * ({EXTENT[3]}e0 / (1 << d)) AS ymin, (i + 1) * ({EXTENT[2]}e0 / (1 << d)) AS xmax, (j + 1) * ({EXTENT[3]}e0 / (1 << d)) AS ymax
  FROM (SELECT d, i, unnest(range(1 << d)) AS j FROM (SELECT d, unnest(range(1 << d)) AS i FROM (SELECT unnest(range({_DEEPEST + 1})) AS d)))),
w AS (SELECT d, i, j, q.xmin, q.ymin, q.xmax, q.ymax, CAST(coalesce(sum(n.point_count), 0) AS BIGINT) AS est FROM q LEFT JOIN n ON n.xmin <= q.xmax AND n.xmax >= q.xmin AND n.ymin <= q.ymax AND n.ymax >= q.ymin GROUP BY ALL),
s AS (SELECT *, est > {_MOST} AND d < {_DEEPEST} AND {EXTENT[2]} / (1 << d) > 50 AND {EXTENT[3]} / (1 << d) > 50 AS split FROM w)
SELECT array_to_string([((j >> (d - k)) & 1) * 2 + ((i >> (d - k)) & 1) for k in range(1, d + 1)], '') AS path, CAST(d AS INTEGER) AS depth, i, j, est AS estimated_points FROM s WHERE NOT split AND NOT EXISTS (SELECT 1 FROM s a WHERE a.d < s.d AND NOT a.split AND a.i = s.i >> (s.d - a.d) AND a.j = s.j >> (s.d - a.d))""".replace("1100.0e0", "1100.0").replace("1000.0e0", "1000.0"),
)
def adaptive_split(p: DataFrame) -> DataFrame:
    return tiling.adaptive_split(_nodes(p, 6), EXTENT, _MOST, 50, 0.0, _DEEPEST).select("path", "depth", "i", "j", "estimated_points")


#: Two files of the points, by supplier: each has its own nodes, and a window's estimate is that of both.
_BOTH = """, two AS (SELECT f, count(*) AS point_count, any_value(ox) + x * any_value(2 * half / 64) AS xmin, any_value(oy) + y * any_value(2 * half / 64) AS ymin, any_value(ox) + x * any_value(2 * half / 64) + any_value(2 * half / 64) AS xmax, any_value(oy) + y * any_value(2 * half / 64) + any_value(2 * half / 64) AS ymax
FROM (SELECT l_suppkey % 2 AS f, ox, oy, half, least(greatest(CAST(floor((X - ox) / (2 * half / 64)) AS BIGINT), 0), 63) AS x, least(greatest(CAST(floor((Y - oy) / (2 * half / 64)) AS BIGINT), 0), 63) AS y, least(greatest(CAST(floor((Z - oz) / (2 * half / 64)) AS BIGINT), 0), 63) AS z FROM points, cube) GROUP BY f, x, y, z)"""


def _two_files(p: DataFrame) -> DataFrame:
    cube = octree.Cube.of(p)
    return octree.nodes(p.where("l_suppkey % 2 = 0"), cube, 6).union(octree.nodes(p.where("l_suppkey % 2 = 1"), cube, 6))


@_query(
    "adaptive_split_files",
    f"""{_CUBE}{_BOTH},
q AS (SELECT d, i, j, i * ({EXTENT[2]} / (1 << d)) AS xmin, j * ({EXTENT[3]} / (1 << d)) AS ymin, (i + 1) * ({EXTENT[2]} / (1 << d)) AS xmax, (j + 1) * ({EXTENT[3]} / (1 << d)) AS ymax
  FROM (SELECT d, i, unnest(range(1 << d)) AS j FROM (SELECT d, unnest(range(1 << d)) AS i FROM (SELECT unnest(range(5)) AS d)))),
w AS (SELECT d, i, j, q.xmin, q.ymin, q.xmax, q.ymax, CAST(coalesce(sum(n.point_count), 0) AS BIGINT) AS est FROM q LEFT JOIN two n ON n.xmin <= q.xmax AND n.xmax >= q.xmin AND n.ymin <= q.ymax AND n.ymax >= q.ymin GROUP BY ALL),
s AS (SELECT *, est > 6000 AND d < 4 AND {EXTENT[2]} / (1 << d) > 100 AND {EXTENT[3]} / (1 << d) > 100 AS split FROM w)
SELECT array_to_string([((j >> (d - k)) & 1) * 2 + ((i >> (d - k)) & 1) for k in range(1, d + 1)], '') AS path, xmin, ymin, xmax, ymax, est AS estimated_points FROM s WHERE NOT split AND NOT EXISTS (SELECT 1 FROM s a WHERE a.d < s.d AND NOT a.split AND a.i = s.i >> (s.d - a.d) AND a.j = s.j >> (s.d - a.d))""",
)
def adaptive_split_files(p: DataFrame) -> DataFrame:
    return tiling.adaptive_split(_two_files(p), EXTENT, 6000, 100, 0.0, 4).select("path", *tiling.BOX, "estimated_points")


def _tiles_sql(x1: float, y1: float, size: float, overlap: float) -> str:
    nx, ny = int(x1 // size) + 1, int(y1 // size) + 1
    return f"t AS (SELECT c + {nx} * r + 1 AS tile_id, c AS col, r AS row, c * {size}e0 AS xmin, r * {size}e0 AS ymin, least(c * {size}e0 + {size}, {x1}) AS xmax, least(r * {size}e0 + {size}, {y1}) AS ymax, c * {size}e0 - {overlap} AS rxmin, r * {size}e0 - {overlap} AS rymin, least(c * {size}e0 + {size} + {overlap}, {x1 + overlap}) AS rxmax, least(r * {size}e0 + {size} + {overlap}, {y1 + overlap}) AS rymax FROM (SELECT unnest(range({nx})) AS c), (SELECT unnest(range({ny})) AS r))"


_GRID = tiling.Grid(EXTENT, 250, 10)
_TILES = _tiles_sql(1100, 1000, 250, 10)


@_query("tile_grid", f", {_TILES} SELECT tile_id, col, row, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM t")
def tile_grid(p: DataFrame) -> DataFrame:
    return _GRID.tiles(p.sparkSession).select("tile_id", "col", "row", "xmin", "ymin", "xmax", "ymax")


@_query("tiles_points", f", {_TILES} SELECT {_BASE}, tile_id FROM points JOIN t ON X BETWEEN rxmin AND rxmax AND Y BETWEEN rymin AND rymax")
def tiles_points(p: DataFrame) -> DataFrame:
    return _GRID.assign(p.select(*BASE)).select(*BASE, "tile_id")


@_query("tiles_points_capped", f", {_TILES}, k AS (SELECT {_BASE}, tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY {_ORDER}) AS k FROM points JOIN t ON X BETWEEN rxmin AND rxmax AND Y BETWEEN rymin AND rymax) SELECT {_BASE}, tile_id FROM k WHERE k <= 20")
def tiles_points_capped(p: DataFrame) -> DataFrame:
    return tiling.cap_per_tile(_GRID.assign(p.select(*ORDER.columns, "X", "Y", "Z")), 20, ORDER).select(*BASE, "tile_id")


@_query("tile_metrics", f", {_TILES} SELECT tile_id, count(*) AS n, round(avg(Z), 6) AS z_mean, max(Z) AS z_max, round(quantile_cont(Z, 0.95), 6) AS z_p95, round(avg(CASE WHEN Z > 2 THEN 1.0e0 ELSE 0.0e0 END), 6) AS cover FROM points JOIN t ON X BETWEEN rxmin AND rxmax AND Y BETWEEN rymin AND rymax GROUP BY tile_id")
def tile_metrics(p: DataFrame) -> DataFrame:
    m = tiling.metrics(_GRID.assign(p.select("X", "Y", "Z")))
    return m.select("tile_id", "n", stats.rounded("z_mean", 6).alias("z_mean"), "z_max", stats.rounded("z_p95", 6).alias("z_p95"), stats.rounded("cover", 6).alias("cover"))


_CHUNKS = tiling.Grid.aligned((9.0, 0.0, 1049.9, 999.5), 200)
_CHUNK_SQL = "t AS (SELECT c + 6 * r + 1 AS tile_id, c AS col, r AS row, c * 200.0e0 AS xmin, r * 200.0e0 AS ymin, c * 200.0e0 + 200 AS xmax, r * 200.0e0 + 200 AS ymax FROM (SELECT unnest(range(6)) AS c), (SELECT unnest(range(5)) AS r))"


@_query("aligned_chunk_grid", f", {_CHUNK_SQL} SELECT * FROM t")
def aligned_chunk_grid(p: DataFrame) -> DataFrame:
    return _CHUNKS.tiles(p.sparkSession).select("tile_id", "col", "row", "xmin", "ymin", "xmax", "ymax")


@_query("chunk_apply_mean_z", f", {_CHUNK_SQL} SELECT tile_id, count(*) AS n, round(avg(Z), 4) AS z_mean FROM points JOIN t ON X BETWEEN xmin - 15 AND least(xmax, 1200) + 15 AND Y BETWEEN ymin - 15 AND least(ymax, 1000) + 15 GROUP BY tile_id")
def chunk_apply_mean_z(p: DataFrame) -> DataFrame:
    import pandas as pd

    out = apply.chunk_apply(p.select("X", "Y", "Z"), lambda t, chunk: pd.DataFrame({"n": [len(t)], "z_mean": [t["Z"].mean()]}), "n long, z_mean double", _CHUNKS, 15)
    return out.withColumn("z_mean", stats.rounded("z_mean", 4))


@_query(
    "chunk_apply_split",
    f"""{_CUBE}{_BOTH}, {_CHUNK_SQL},
q AS (SELECT tile_id, d, i, j, xmin + i * (200.0e0 / (1 << d)) AS xmin, ymin + j * (200.0e0 / (1 << d)) AS ymin, xmin + (i + 1) * (200.0e0 / (1 << d)) AS xmax, ymin + (j + 1) * (200.0e0 / (1 << d)) AS ymax
  FROM (SELECT *, unnest(range(1 << d)) AS j FROM (SELECT *, unnest(range(1 << d)) AS i FROM (SELECT *, unnest(range(4)) AS d FROM t)))),
w AS (SELECT tile_id, d, i, j, q.xmin, q.ymin, q.xmax, q.ymax, CAST(coalesce(sum(n.point_count), 0) AS BIGINT) AS est FROM q LEFT JOIN two n ON n.xmin <= q.xmax AND n.xmax >= q.xmin AND n.ymin <= q.ymax AND n.ymax >= q.ymin GROUP BY ALL),
s AS (SELECT *, est > 1500 AND 200.0e0 / (1 << d) > 25 AS split FROM w),
l AS (SELECT *, array_to_string([((j >> (d - k)) & 1) * 2 + ((i >> (d - k)) & 1) for k in range(1, d + 1)], '') AS path FROM s WHERE NOT split AND NOT EXISTS (SELECT 1 FROM s a WHERE a.tile_id = s.tile_id AND a.d < s.d AND NOT a.split AND a.i = s.i >> (s.d - a.d) AND a.j = s.j >> (s.d - a.d)))
SELECT tile_id, path, count(*) AS n, count(*) FILTER (X BETWEEN xmin AND xmax AND Y BETWEEN ymin AND ymax) AS own FROM points JOIN l ON X BETWEEN xmin - 15 AND xmax + 15 AND Y BETWEEN ymin - 15 AND ymax + 15 WHERE X BETWEEN -15 AND 1215 GROUP BY ALL""",
)
def chunk_apply_split(p: DataFrame) -> DataFrame:
    """Chunks above 1500 estimated points in quarters; all points of each, and those without the buffer."""

    def counted(t: pd.DataFrame, chunk: dict) -> pd.DataFrame:
        own = t["X"].between(chunk["xmin"], chunk["xmax"]) & t["Y"].between(chunk["ymin"], chunk["ymax"])
        return pd.DataFrame({"n": [len(t)], "own": [int(own.sum())]})

    return apply.chunk_apply(p.select("X", "Y", "Z"), counted, "n long, own long", _CHUNKS, 15, nodes=_two_files(p), max_points_per_chunk=1500, min_split_size=25)


#: A file for each supplier number modulo 6, as if each were a flight strip.
_FILES = "f AS (SELECT l_suppkey % 6 AS file, min(X) AS xmin, min(Y) AS ymin, min(Z) AS zmin, max(X) AS xmax, max(Y) AS ymax, max(Z) AS zmax, count(*) AS points FROM points WHERE X BETWEEN 100 * (l_suppkey % 6) AND 100 * (l_suppkey % 6) + 300 GROUP BY 1)"


def _files(p: DataFrame) -> DataFrame:
    p = p.withColumn("file", F.col("l_suppkey") % 6).where("X BETWEEN 100 * file AND 100 * file + 300")
    return p.groupBy("file").agg(*(F.min(c).alias(f"{c.lower()}min") for c in "XYZ"), *(F.max(c).alias(f"{c.lower()}max") for c in "XYZ"), F.count(F.lit(1)).alias("points"))


_IN_FILES = "points.X BETWEEN 100 * (l_suppkey % 6) AND 100 * (l_suppkey % 6) + 300"


@_query(
    "catalog_apply",
    f""", {_FILES}, g AS (SELECT file, xmin, ymin, xmax, ymax, gc, gr, CAST(floor((xmax - xmin) / 120) AS BIGINT) + 1 AS nx FROM (SELECT *, unnest(range(CAST(floor((ymax - ymin) / 120) AS BIGINT) + 1)) AS gr FROM (SELECT *, unnest(range(CAST(floor((xmax - xmin) / 120) AS BIGINT) + 1)) AS gc FROM f)))
SELECT CAST(file AS VARCHAR) AS file, gr * nx + gc + 1 AS chunk_id, count(*) AS n, round(avg(Z), 4) AS z_mean FROM points JOIN g ON l_suppkey % 6 = file AND {_IN_FILES} AND X BETWEEN xmin + gc * 120 - 10 AND least(xmin + gc * 120 + 120, xmax) + 10 AND Y BETWEEN ymin + gr * 120 - 10 AND least(ymin + gr * 120 + 120, ymax) + 10 GROUP BY ALL""",
)
def catalog_apply(p: DataFrame) -> DataFrame:
    of_file = p.withColumn("file", F.col("l_suppkey") % 6).where("X BETWEEN 100 * file AND 100 * file + 300").select("file", "X", "Y", "Z")
    out = apply.file_apply(of_file, _files(p), lambda t, chunk: pd.DataFrame({"n": [len(t)], "z_mean": [t["Z"].mean()]}), "n long, z_mean double", 120, 10)
    return out.withColumn("z_mean", stats.rounded("z_mean", 4))


@_query("chunk_file_overlap", f", {_FILES}, {_CHUNK_SQL} SELECT tile_id, file FROM t JOIN f ON f.xmin < t.xmax AND f.xmax > t.xmin AND f.ymin < t.ymax AND f.ymax > t.ymin")
def chunk_file_overlap(p: DataFrame) -> DataFrame:
    return tiling.chunks_with_files(_CHUNKS.tiles(p.sparkSession).select("tile_id", *tiling.BOX), _files(p)).select("tile_id", "file")


@_query("catalog_summary", f", {_FILES} SELECT count(*) AS files, CAST(sum(points) AS BIGINT) AS points, min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax, max(ymax) AS ymax, max(zmax) AS zmax FROM f")
def catalog_summary(p: DataFrame) -> DataFrame:
    return catalog.totals(_files(p))


@_query("bounds", "SELECT min(X) AS xmin, max(X) AS xmax, min(Y) AS ymin, max(Y) AS ymax, min(Z) AS zmin, max(Z) AS zmax, min(gpstime) AS gpstimemin, max(gpstime) AS gpstimemax, count(*) AS point_count FROM points")
def bounds(p: DataFrame) -> DataFrame:
    return stats.bounds(p)


@_query("returns_histogram", "SELECT ReturnNumber, count(*) AS n FROM points WHERE ReturnNumber BETWEEN 1 AND 15 GROUP BY ReturnNumber")
def returns_histogram(p: DataFrame) -> DataFrame:
    return stats.by_return(p)


@_query("class_histogram", "SELECT Classification, count(*) AS n FROM points GROUP BY Classification")
def class_histogram(p: DataFrame) -> DataFrame:
    return stats.by_class(p)


_STATS = ("Z", "Intensity", "Classification", "UserData", "NumberOfReturns")


@_query(
    "attribute_stats",
    " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS name, count({c}) AS count, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum, round(avg({c}), 4) AS average, round(stddev_samp({c}), 4) AS stddev, round(var_samp({c}), 2) AS variance FROM points" for k, c in enumerate(_STATS)),
)
def attribute_stats(p: DataFrame) -> DataFrame:
    return stats.attributes(p.select(*_STATS), 4).withColumn("variance", stats.rounded("variance", 2))


@_query("raster_cells", "SELECT CAST(floor(X / 50) AS BIGINT) AS cx, CAST(floor(Y / 50) AS BIGINT) AS cy, max(Z) AS zmax, round(avg(Z), 6) AS zmean, count(*) AS n, round(avg(CASE WHEN Z > 2 THEN 1.0e0 ELSE 0.0e0 END), 6) AS above2 FROM points GROUP BY 1, 2")
def raster_cells(p: DataFrame) -> DataFrame:
    return tiling.cells(p, 50).withColumns({"zmean": stats.rounded("zmean", 6), "above2": stats.rounded("above2", 6)})


@_query("raster_mosaic", "SELECT CAST(floor(X / 100) AS BIGINT) AS cx, round(sum(CASE WHEN Y <= 500 THEN 1 ELSE 0 END) / count(DISTINCT (Y <= 500)) + sum(CASE WHEN Y > 500 THEN 1 ELSE 0 END) / count(DISTINCT (Y <= 500)), 6) AS n FROM points GROUP BY 1")
def raster_mosaic(p: DataFrame) -> DataFrame:
    parts = p.groupBy(F.floor(F.col("X") / 100).alias("cx"), (F.col("Y") <= 500).alias("half")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return apply.mosaic(parts, ("cx",), "n").withColumn("n", stats.rounded("n", 6))


@_query("merge_fill", "SELECT l_orderkey, X, Z, Intensity, CAST(NULL AS INTEGER) AS NIR FROM points WHERE X < 200 UNION ALL SELECT l_orderkey, X, Z, NULL, NIR FROM points WHERE X >= 1000")
def merge_fill(p: DataFrame) -> DataFrame:
    return schema.merged([p.where("X < 200").select("l_orderkey", "X", "Z", "Intensity"), p.where("X >= 1000").select("l_orderkey", "X", "Z", "NIR")])


@_query(
    "overview_pyramid",
    " UNION ALL ".join(
        f"SELECT l_orderkey, X, Y, {d} AS overview_level, tile FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {_ORDER}) AS k FROM (SELECT *, least(CAST(floor((Y - 0.0) / {1000 / 2**d}e0) AS BIGINT), {2**d - 1}) * {2**d} + least(CAST(floor((X - 0.0) / {1100 / 2**d}e0) AS BIGINT), {2**d - 1}) AS tile FROM points)) WHERE (k - 1) % {max(1, int(1000 / 4**d))} = 0"
        for d in range(3)
    ),
)
def overview_pyramid(p: DataFrame) -> DataFrame:
    levels = [pyramid.overview(p, EXTENT, d, ORDER).select("l_orderkey", "X", "Y", "overview_level", "tile") for d in range(3)]
    return schema.merged(levels)


#: From the lowest of the leftmost points to the right by the least slope, and from the highest of the rightmost points back by the
#: least slope as well; of points in one direction the farthest.
_HULL = """, low AS (SELECT X, min(Y) AS Y FROM points GROUP BY X), high AS (SELECT X, max(Y) AS Y FROM points GROUP BY X),
lower_ AS (SELECT X, Y FROM (SELECT X, Y FROM low ORDER BY X LIMIT 1) UNION ALL
  SELECT X, Y FROM (SELECT l.X, l.Y, row_number() OVER (ORDER BY (l.Y - c.Y) / (l.X - c.X), l.X DESC) AS k FROM lower_ c JOIN low l ON l.X > c.X) WHERE k = 1),
upper_ AS (SELECT X, Y FROM (SELECT X, Y FROM high ORDER BY X DESC LIMIT 1) UNION ALL
  SELECT X, Y FROM (SELECT l.X, l.Y, row_number() OVER (ORDER BY (l.Y - c.Y) / (l.X - c.X), l.X) AS k FROM upper_ c JOIN high l ON l.X < c.X) WHERE k = 1)
SELECT row_number() OVER (ORDER BY part, X * (1 - 2 * part)) - 1 AS corner, X, Y FROM (SELECT 0 AS part, X, Y FROM lower_ UNION ALL SELECT 1, X, Y FROM (SELECT X, Y FROM upper_ EXCEPT SELECT X, Y FROM lower_))"""


@_query("convex_hull", _HULL)
def convex_hull(p: DataFrame) -> DataFrame:
    return stats.convex_hull(p)


@_query("extra_dimension", "SELECT l_orderkey, X, Y, Z, extra_discount FROM points WHERE extra_discount > 0.05 AND Z > 40")
def extra_dimension(p: DataFrame) -> DataFrame:
    return schema.select(p.drop(*KEYS[1:], "l_extendedprice"), "z").where("extra_discount > 0.05 AND Z > 40")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share: under ``spark.checkpoint.dir``. Where none is set, as in tests, a local master gets a
    temporary one; a cluster, whose executors couldn't read it, is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"cairn-{name}-")
    return f"{root.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


def _octree_files(p: DataFrame, folder: str, size: float) -> list[str]:
    """All points as octree files, one for each square tile that has any."""
    return tiled.write(p, folder, size, ORDER, list(schema.CORE), (0.0001,) * 3, 'PROJCS["local"]')


def _tiles_with(columns: str, size: int) -> str:
    return f", b AS (SELECT CAST(floor(X / {size}) AS BIGINT) AS tx, CAST(floor(Y / {size}) AS BIGINT) AS ty, min(X) AS xmin, min(Y) AS ymin, min(Z) AS zmin, max(X) AS xmax, max(Y) AS ymax, max(Z) AS zmax, count(*) AS points, min(gpstime) AS tmin, max(gpstime) AS tmax FROM points GROUP BY 1, 2) SELECT {columns} FROM b"


_HALF = "CASE WHEN greatest(xmax - xmin, ymax - ymin, zmax - zmin) / 2 < 1e-6 THEN 1.0e0 ELSE greatest(xmax - xmin, ymax - ymin, zmax - zmin) / 2 END * 1.001e0"


@_query("header_roundtrip", _tiles_with(f"xmin, ymin, zmin, xmax, ymax, zmax, points, CAST(8 AS INTEGER) AS point_format, 'PROJCS[\"local\"]' AS wkt, round(2 * ({_HALF}), 6) AS spacing, round({_HALF}, 6) AS halfsize, tmin, tmax", 250), own=True)
def header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points in octree files, a file for each tile; what their headers say."""
    paths = _octree_files(points(spark, sf_dir), _folder(spark, "header"), 250)
    return catalog.Catalog.of(spark, paths).files.drop("file").withColumns({c: stats.rounded(c, 6) for c in ("spacing", "halfsize")})


@_query("octree_file_scan", "SELECT round(X, 4) AS X, round(Y, 4) AS Y, round(Z, 4) AS Z, Intensity, Classification FROM points WHERE X BETWEEN 200 AND 600 AND Y BETWEEN 10 AND 700", own=True)
def octree_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points in octree files, a file for each tile; a box of them read by one scan."""
    from .sources import datasource

    paths = _octree_files(points(spark, sf_dir), _folder(spark, "scan"), 250)
    datasource.register(spark)
    df = spark.read.format("cairn_octree").option("path", json.dumps(paths)).option("bbox", "200,10,600,700").option("select", "ic").load()
    return df.select(*(stats.rounded(c, 4).alias(c) for c in "XYZ"), "Intensity", "Classification")


@_query("vpc_roundtrip", _tiles_with("CAST(tx AS VARCHAR) || '_' || CAST(ty AS VARCHAR) || '.copc.las' AS file, xmin, ymin, xmax, ymax, points, CAST(8 AS INTEGER) AS point_format", 500), own=True)
def vpc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points in octree files, a file for each tile, listed with statistics; the list read again."""
    folder = _folder(spark, "vpc")
    paths = _octree_files(points(spark, sf_dir), folder, 500)
    listed = vpc.write(spark, paths, f"{folder}/all.vpc", statistics=True)
    return vpc.read(spark, listed).files.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "xmin", "ymin", "xmax", "ymax", "points", "point_format")


@_query("store_box_scan", f"SELECT {_BASE} FROM points WHERE X BETWEEN 300 AND 420 AND Y BETWEEN 100 AND 300", own=True)
def store_box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'store')}/points"
    store.write(points(spark, sf_dir).select(*ORDER.columns, "X", "Y", "Z"), path, ORDER)
    return store.read(spark, path).where(geometry.box(300, 100, 420, 300)).select(*BASE)


@functools.cache
def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def describe() -> str:
    """Names of all queries, and which of them SQL checks."""
    return json.dumps({name: name in _SQL for name in _QUERIES}, indent=1)
