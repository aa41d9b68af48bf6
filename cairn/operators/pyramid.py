"""Overview pyramids: fewer points for coarser levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import numbered, unused
from ..schema import Order

#: One in so many points at level 0; a fourth of that at each level after it.
TOP = 1000


def overview(points: DataFrame, extent: tuple[float, float, float, float], level: int, order: Order) -> DataFrame:
    """The points of a level, with tile (2^level by 2^level of them): every so-manieth of each tile in order.

    All points are numbered tile by tile, in ranges that a tile may span, and a tile's first number is taken off."""
    n, every = 2**level, max(1, int(TOP / 4**level))
    x0, y0, x1, y1 = extent
    at = lambda c, a, b: F.least(F.floor((F.col(c) - F.lit(a)) / F.lit((b - a) / n)), F.lit(n - 1).cast("bigint"))
    tiled = points.withColumn("tile", at("Y", y0, y1) * n + at("X", x0, x1))
    if every > 1:
        number, first, of, size = unused(tiled, "number", "first", "of", "size")
        sizes = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias(size))
        starts = sizes.select(F.col("tile").alias(of), (F.sum(size).over(W.orderBy("tile")) - F.col(size)).alias(first))
        # A row for each tile, 4^level at most.
        ranked = numbered(tiled, Order(("tile", *order.columns)), number).join(F.broadcast(starts), F.col("tile") == F.col(of))
        tiled = ranked.where((F.col(number) - 1 - F.col(first)) % every == 0).select(*tiled.columns)
    return tiled.withColumn("overview_level", F.lit(level))
