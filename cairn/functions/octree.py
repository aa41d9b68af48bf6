"""Octree arithmetic: the root cube, depths, node keys and bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_POINTS, DEEPEST = 10_000, 8


@dataclass(frozen=True)
class Cube:
    """The root of an octree: centre and half the side."""

    x: float
    y: float
    z: float
    half: float

    @staticmethod
    def around(low: tuple[float, float, float], high: tuple[float, float, float]) -> Cube:
        """A little larger than the widest extent; a single point gets a side of two."""
        half = max(b - a for a, b in zip(low, high, strict=True)) / 2
        half = (1.0 if half < 1e-6 else half) * 1.001
        return Cube(*((a + b) / 2 for a, b in zip(low, high, strict=True)), half)

    @staticmethod
    def of(points: DataFrame) -> Cube:
        r = points.agg(*(f(c) for f in (F.min, F.max) for c in "XYZ")).first()
        if r[0] is None:
            raise ValueError("0 points have no extent")
        return Cube.around(tuple(r[:3]), tuple(r[3:]))

    def bounds(self, level: int, x: int, y: int, z: int) -> tuple[float, ...]:
        """xmin, ymin, zmin, xmax, ymax, zmax of a node."""
        if not (math.isfinite(self.half) and self.half > 0 and 0 <= level <= 30):
            raise ValueError("a cube needs a finite side and a level from 0 to 30")
        side = 2 * self.half / 2**level
        low = [c - self.half + k * side for c, k in zip((self.x, self.y, self.z), (x, y, z), strict=True)]
        return (*low, *(v + side for v in low))


def depth_for(points: int) -> int:
    """Levels until a leaf has about LEAF_POINTS points."""
    depth = 0
    while points > LEAF_POINTS * 8**depth and depth < DEEPEST:
        depth += 1
    return depth


def depth_of_resolution(spacing: float, resolution: float) -> int:
    """The level whose spacing is no finer than asked for."""
    if resolution <= 0 or spacing <= 0:
        raise ValueError("spacing and resolution must be positive numbers")
    return max(0, math.floor(math.log2(spacing / resolution)))


def node_index(coordinate: str, low: float, side: float, level: int) -> Column:
    """The place of a coordinate along its axis, held to the cube."""
    at = F.floor((F.col(coordinate) - F.lit(low)) / F.lit(side))
    return F.least(F.greatest(at, F.lit(0).cast("bigint")), F.lit(2**level - 1).cast("bigint"))


def with_keys(points: DataFrame, cube: Cube, level: int) -> DataFrame:
    """points with kx, ky, kz, the node of each at a level."""
    side = 2 * cube.half / 2**level
    return points.withColumns({f"k{c.lower()}": node_index(c, o - cube.half, side, level) for c, o in zip("XYZ", (cube.x, cube.y, cube.z), strict=True)})


def nodes(points: DataFrame, cube: Cube, level: int) -> DataFrame:
    """level, x, y, z, point_count and the bounds of every node that has points."""
    side = F.lit(2 * cube.half / 2**level)
    n = with_keys(points, cube, level).groupBy("kx", "ky", "kz").agg(F.count(F.lit(1)).alias("point_count"))
    low = {c: F.lit(o - cube.half) + F.col(f"k{c}") * side for c, o in zip("xyz", (cube.x, cube.y, cube.z), strict=True)}
    return n.select(
        F.lit(level).alias("level"),
        *(F.col(f"k{c}").alias(c) for c in "xyz"),
        "point_count",
        *(low[c].alias(f"{c}min") for c in "xyz"),
        *((low[c] + side).alias(f"{c}max") for c in "xyz"),
    )


def within(level: str | Column, deepest: int) -> Column:
    """Levels down to a depth; all of them below 0."""
    c = F.col(level) if isinstance(level, str) else level
    return F.lit(True) if deepest < 0 else c <= deepest
