"""Counts and statistics: bounds, returns, classes, attributes, hulls."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bounds(points: DataFrame) -> DataFrame:
    """One row: lowest and highest X, Y, Z and time."""
    return points.agg(*(f(c).alias(f"{c.lower()}{n}") for c in ("X", "Y", "Z", "gpstime") for f, n in ((F.min, "min"), (F.max, "max"))), F.count(F.lit(1)).alias("point_count"))


def by_return(points: DataFrame) -> DataFrame:
    """Points of each return from 1 to 15."""
    return points.where(F.col("ReturnNumber").between(1, 15)).groupBy("ReturnNumber").agg(F.count(F.lit(1)).alias("n"))


def by_class(points: DataFrame) -> DataFrame:
    return points.groupBy("Classification").agg(F.count(F.lit(1)).alias("n"))


def rounded(value: str | Column, places: int) -> Column:
    """A double to so many places as SQL engines round: scaled by a power of ten as a double, halves away from zero. ``F.round`` goes
    by the shortest decimals of the value, and so parts from them where those end in a 5."""
    scale = F.lit(10.0**places)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale


def attributes(points: DataFrame, places: int = 6, by: str | None = None) -> DataFrame:
    """Of each numeric column: position from 0, name, count, minimum, maximum, average, sample deviation and variance.

    One pass for all columns, turned into rows after it; with ``by``, for each value of that column, which comes first."""
    numeric = [f.name for f in points.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != by]
    parts = []
    for k, c in enumerate(numeric):
        v = F.col(c).cast("double")
        parts.append(F.struct(F.lit(k).alias("position"), F.lit(c).alias("name"), F.count(v).alias("count"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), rounded(F.avg(v), places).alias("average"), rounded(F.stddev_samp(v), places).alias("stddev"), rounded(F.var_samp(v), places).alias("variance")))
    keys = [by] if by else []
    return points.groupBy(*keys).agg(F.array(*parts).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the lowest X."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) >= 2 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    corners: list[tuple[float, float]] = []
    for b in batches:
        corners = hull_of(corners + list(zip(b["X"].tolist(), b["Y"].tolist(), strict=True)))
    yield pd.DataFrame(corners, columns=["X", "Y"])


#: Directions in which the outermost points are looked for, a quarter of the circle apart after so many.
DIRECTIONS = 8


def convex_hull(points: DataFrame) -> DataFrame:
    """corner (from 0), X, Y. Few points are left when they meet in the last step.

    First the outermost point of each of 4 * DIRECTIONS directions: what lies inside the polygon of those is no corner, and
    goes by comparisons alone. Then the hull of what is left in each partition, in parallel, and of those one hull."""
    xy = points.select("X", "Y").where("X is not null and Y is not null")
    turns = [2 * math.pi * k / (4 * DIRECTIONS) for k in range(4 * DIRECTIONS)]
    far = xy.agg(*(F.max(F.struct((F.col("X") * math.cos(a) + F.col("Y") * math.sin(a)).alias("d"), "X", "Y")) for a in turns)).first()
    ring = hull_of([(p["X"], p["Y"]) for p in far if p is not None])
    if len(ring) > 2:
        side = lambda a, b: (b[0] - a[0]) * (F.col("Y") - F.lit(a[1])) - (b[1] - a[1]) * (F.col("X") - F.lit(a[0]))
        inside = functools.reduce(Column.__and__, (side(a, b) > 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True)))
        xy = xy.where(~inside)
    few = xy.mapInPandas(_hulls, "X double, Y double")
    last = few.repartition(1).mapInPandas(_hulls, "X double, Y double")
    return last.select(F.monotonically_increasing_id().alias("corner"), "X", "Y")


def _hulls_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    corners: dict[str, list[tuple[float, float]]] = {}
    for b in batches:
        for key, own in b.groupby("key"):
            corners[key] = hull_of(corners.get(key, []) + list(zip(own["X"].tolist(), own["Y"].tolist(), strict=True)))
    rows = [(key, *p) for key, ps in corners.items() for p in ps]
    yield pd.DataFrame(rows, columns=["key", "X", "Y"])


def _hull_by(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    corners = hull_of(list(zip(table["X"].tolist(), table["Y"].tolist(), strict=True)))
    return pd.DataFrame([(key[0], k, *p) for k, p in enumerate(corners)], columns=["key", "corner", "X", "Y"])


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """by, corner (from 0), X, Y: a hull for each value of a text column. Each partition's hulls first, then those of a value meet."""
    xy = points.select(F.col(by).alias("key"), "X", "Y").where("key is not null and X is not null and Y is not null")
    few = xy.mapInPandas(_hulls_by, "key string, X double, Y double")
    return few.groupBy("key").applyInPandas(_hull_by, "key string, corner long, X double, Y double").withColumnRenamed("key", by)
