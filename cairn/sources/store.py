"""The point store: Parquet by octree level, sorted by node, with a small table of nodes beside it.

A query for a box reads few row groups, since neighbours in space lie together and Parquet keeps their ranges; a query for
coarse levels reads their folders only. Counts and densities come from the node table alone.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import octree
from ..functions.octree import Cube
from ..operators.thinning import shuffle_key
from ..plans.numbering import unused
from ..schema import Order


def _interleaved(columns: tuple[str, ...], bits: int):
    """A Z-order key of node numbers."""
    key = F.lit(0).cast("bigint")
    for b in range(bits):
        for k, c in enumerate(columns):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(1).cast("bigint"), 3 * b + k))
    return key


def write(points: DataFrame, path: str, order: Order, max_depth: int | None = None, layout: str = "leaf", partitions: int | None = None, whole: dict[str, str] | None = None, overwrite: bool = True) -> None:
    """Writes points/, nodes/ and info/ under ``path``.

    layout "leaf": every point at the deepest level. "lod": at each level from the root on, the point of each cell that comes
    first by a hash is placed there, and what is left goes on; a point is at one level only."""
    spark = points.sparkSession
    hashed, least, key = unused(points, "h", "least", "z_order")
    *box, n = points.agg(*(f(c) for f in (F.min, F.max) for c in "XYZ"), F.count(F.lit(1))).first()
    if box[0] is None:
        raise ValueError("0 points have no extent")
    cube = Cube.around(tuple(box[:3]), tuple(box[3:]))
    depth = octree.depth_for(n) if max_depth is None else max_depth
    if layout == "lod":

        def first(d: int):
            side = cube.half / 2**d / 64
            cell = [F.floor((F.col(c) - F.lit(o - cube.half)) / F.lit(side)) for c, o in zip("XYZ", (cube.x, cube.y, cube.z), strict=True)]
            return F.col(hashed) == F.min(hashed).over(W.partitionBy(*cell))

        leveled = points.withColumn(hashed, shuffle_key(order, 0, whole))
        if depth > 0:
            # Who is the least of a coarse cell is so of a finer one within it: after the finest, only those go on.
            finest = leveled.withColumn(least, first(depth - 1))
            top = finest.where(least).withColumn("level", F.lit(depth - 1))
            for d in range(depth - 2, -1, -1):
                top = top.withColumn("level", F.when(first(d), F.lit(d)).otherwise(F.col("level")))
            leveled = finest.where(~F.col(least)).withColumn("level", F.lit(depth)).union(top).drop(least)
        else:
            leveled = leveled.withColumn("level", F.lit(0))
        leveled = leveled.withColumn("level", F.col("level").cast("int")).drop(hashed)
    elif layout == "leaf":
        leveled = points.withColumn("level", F.lit(depth))
    else:
        raise ValueError("layout must be leaf or lod")
    side = F.lit(2 * cube.half) / F.pow(F.lit(2.0), F.col("level"))
    top = F.pow(F.lit(2.0), F.col("level")).cast("bigint") - 1
    keys = {f"k{c.lower()}": F.least(F.greatest(F.floor((F.col(c) - F.lit(o - cube.half)) / side), F.lit(0).cast("bigint")), top) for c, o in zip("XYZ", (cube.x, cube.y, cube.z), strict=True)}
    keyed = leveled.withColumns(keys).withColumn(key, _interleaved(("kx", "ky", "kz"), max(depth, 1)))
    count = partitions or max(1, -(-n // 2_000_000))
    laid = keyed.repartitionByRange(count, "level", key).sortWithinPartitions("level", key).drop(key)
    mode = "overwrite" if overwrite else "errorifexists"
    laid.write.mode(mode).partitionBy("level").parquet(f"{path}/points")
    stored = spark.read.parquet(f"{path}/points")
    per = stored.groupBy("level", "kx", "ky", "kz").agg(F.count(F.lit(1)).alias("point_count"))
    width = F.lit(2 * cube.half) / F.pow(F.lit(2.0), F.col("level"))
    low = {c: F.lit(o - cube.half) + F.col(f"k{c}") * width for c, o in zip("xyz", (cube.x, cube.y, cube.z), strict=True)}
    nodes = per.select("level", *(F.col(f"k{c}").alias(c) for c in "xyz"), "point_count", *(low[c].alias(f"{c}min") for c in "xyz"), *((low[c] + width).alias(f"{c}max") for c in "xyz"))
    # About a million nodes a file, of some thousand points each.
    nodes.repartition(max(1, n // 5_000_000_000)).write.mode(mode).parquet(f"{path}/nodes")
    spark.range(1).select(F.lit(json.dumps({"cube": asdict(cube), "spacing": 2 * cube.half, "depth": depth, "points": n, "columns": points.columns})).alias("info")).coalesce(1).write.mode(mode).parquet(f"{path}/info")


def info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/info").first()[0])


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes")


def read(spark: SparkSession, path: str, max_depth: int = -1, resolution: float | None = None) -> DataFrame:
    """The points down to a level (a folder each) or to the level of a resolution."""
    about = info(spark, path)
    if resolution is not None:
        max_depth = octree.depth_of_resolution(about["spacing"], resolution)
    df = spark.read.parquet(f"{path}/points").where(octree.within("level", max_depth))
    return df.select(*about["columns"], "level")
