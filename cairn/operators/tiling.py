"""Tile grids, points by tile, counts from node tables, and adaptive splits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import unused
from ..schema import Order
from .overlap import BOX, meeting

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Grid:
    """Square tiles over an extent, numbered from 1, columns first."""

    extent: Box
    size: float
    overlap: float = 0.0

    def __post_init__(self):
        if not self.size > 0 or self.overlap < 0:
            raise ValueError("the tile size must be positive and the overlap not negative")

    @staticmethod
    def aligned(extent: Box, size: float, alignment: tuple[float, float] = (0.0, 0.0), buffer: float = 0.0) -> Grid:
        """Whole tiles that begin at a multiple of the size from ``alignment``."""
        x0, y0 = (a + math.floor((e - a) / size) * size for e, a in zip(extent[:2], alignment, strict=True))
        x1, y1 = (a + math.ceil((e - a) / size) * size for e, a in zip(extent[2:], alignment, strict=True))
        return _Aligned((x0, y0, max(x1, x0 + size), max(y1, y0 + size)), size, buffer)

    @property
    def across(self) -> int:
        return math.floor((self.extent[2] - self.extent[0]) / self.size) + 1

    @property
    def down(self) -> int:
        return math.floor((self.extent[3] - self.extent[1]) / self.size) + 1

    def tiles(self, spark: SparkSession) -> DataFrame:
        """tile_id, col, row, the tile's box, and with overlap (r...) what is read for it, held to the extent and its overlap."""
        n = F.lit(self.across)
        t = spark.range(self.across * self.down).select((F.col("id") + 1).alias("tile_id"), (F.col("id") % n).alias("col"), F.floor(F.col("id") / n).alias("row"))
        x0, y0, x1, y1 = self.extent
        low = {"x": F.lit(x0) + F.col("col") * F.lit(self.size), "y": F.lit(y0) + F.col("row") * F.lit(self.size)}
        high = {"x": F.least(low["x"] + self.size, F.lit(x1)), "y": F.least(low["y"] + self.size, F.lit(y1))}
        read = {"x": F.least(low["x"] + self.size + self.overlap, F.lit(x1 + self.overlap)), "y": F.least(low["y"] + self.size + self.overlap, F.lit(y1 + self.overlap))}
        return t.select("*", low["x"].alias("xmin"), low["y"].alias("ymin"), high["x"].alias("xmax"), high["y"].alias("ymax"), (low["x"] - self.overlap).alias("rxmin"), (low["y"] - self.overlap).alias("rymin"), read["x"].alias("rxmax"), read["y"].alias("rymax"))

    def _candidates(self, coordinate: str, low: float, n: int) -> Column:
        """Numbers of the tiles along an axis whose read range may hold a coordinate."""
        at = F.col(coordinate) - F.lit(low)
        first = F.greatest(F.floor((at - self.overlap) / self.size) - 1, F.lit(0).cast("bigint"))
        last = F.least(F.floor((at + self.overlap) / self.size), F.lit(n - 1).cast("bigint"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def assign(self, points: DataFrame, core: bool = False) -> DataFrame:
        """points once for each tile whose read box (or, with core, whose half-open box) holds them, with tile_id.

        Tiles follow from arithmetic, so nothing is joined or shuffled."""
        x0, y0, x1, y1 = self.extent
        if core:
            col, row = (F.floor((F.col(c) - F.lit(o)) / F.lit(self.size)) for c, o in (("X", x0), ("Y", y0)))
            inside = F.col("X").between(x0, x1) & F.col("Y").between(y0, y1)
            return points.where(inside).withColumn("tile_id", (row * self.across + col + 1).cast("bigint"))
        col, row = unused(points, "c", "r")
        p = points.withColumn(col, F.explode(self._candidates("X", x0, self.across))).withColumn(row, F.explode(self._candidates("Y", y0, self.down)))
        held = lambda c, k, o, top: F.col(c).between(F.lit(o) + F.col(k) * F.lit(self.size) - self.overlap, F.least(F.lit(o) + F.col(k) * F.lit(self.size) + self.size + self.overlap, F.lit(top + self.overlap)))
        p = p.where(held("X", col, x0, x1) & held("Y", row, y0, y1))
        return p.withColumn("tile_id", F.col(row) * self.across + F.col(col) + 1).drop(col, row)


class _Aligned(Grid):
    """A grid that ends where its extent does."""

    @property
    def across(self) -> int:
        return round((self.extent[2] - self.extent[0]) / self.size)

    @property
    def down(self) -> int:
        return round((self.extent[3] - self.extent[1]) / self.size)


def cap_per_tile(tiled: DataFrame, n: int, order: Order) -> DataFrame:
    """The first n points of each tile."""
    (rank,) = unused(tiled, "rank")
    number = F.row_number().over(W.partitionBy("tile_id").orderBy(*order.by()))
    return tiled.withColumn(rank, number).where(F.col(rank) <= n).drop(rank)


def metrics(tiled: DataFrame, by: tuple[str, ...] = ("tile_id",), cover: float = 2.0) -> DataFrame:
    """Of each tile: points, mean and highest Z, 95th percentile (between the two points next to it), share above ``cover``.

    Equal heights are counted before they are shuffled and then run through in order, so no tile's heights are held together."""
    heights = tiled.where(F.col("Z").isNotNull()).groupBy(*by, F.col("Z").alias("z")).agg(F.count(F.lit(1)).alias("k"))
    order = W.partitionBy(*by).orderBy("z").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(*by)
    run = heights.select("*", F.sum("k").over(order).alias("upto"), F.sum("k").over(every).alias("n"))
    at = (F.col("n") - 1) * F.lit(0.95)
    low, high = (F.min(F.when(F.col("upto") > f(at), F.col("z"))) for f in (F.floor, F.ceil))
    z, k = F.col("z"), F.col("k")
    out = run.groupBy(*by).agg(F.sum(k).alias("n"), (F.sum(z * k) / F.sum(k)).alias("z_mean"), F.max(z).alias("z_max"), low.alias("low"), high.alias("high"), (F.sum(F.when(z > cover, k).otherwise(0)) / F.sum(k)).alias("cover"))
    part = (F.col("n") - 1) * F.lit(0.95) - F.floor((F.col("n") - 1) * F.lit(0.95))
    return out.select(*by, "n", "z_mean", "z_max", (F.col("low") + part * (F.col("high") - F.col("low"))).alias("z_p95"), "cover")


def cells(points: DataFrame, size: float) -> DataFrame:
    """Raster cells: cx, cy, zmax, zmean, n, and the share above 2."""
    at = [F.floor(F.col(c) / F.lit(float(size))).alias(n) for c, n in (("X", "cx"), ("Y", "cy"))]
    return points.groupBy(*at).agg(F.max("Z").alias("zmax"), F.avg("Z").alias("zmean"), F.count(F.lit(1)).alias("n"), F.avg((F.col("Z") > 2).cast("int")).alias("above2"))


def estimate(nodes: DataFrame, windows: DataFrame, keys: tuple[str, ...] = ("window_id",), max_depth: int = -1) -> DataFrame:
    """Of each window (xmin, ymin, xmax, ymax): estimated_points and num_nodes of the nodes that touch it, area, density.

    Whole nodes count, so windows that share nodes count them twice."""
    if max_depth >= 0:
        nodes = nodes.where(F.col("level") <= max_depth)
    n = nodes.select("point_count", *(F.col(c).alias(f"n_{c}") for c in BOX))
    found = meeting(windows.select(*keys, *BOX), n, BOX, [f"n_{c}" for c in BOX]).groupBy(*keys).agg(F.sum("point_count").alias("p"), F.count(F.lit(1)).alias("k"))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    points = F.coalesce(F.col("p"), F.lit(0)).cast("bigint")
    return windows.join(found, list(keys), "left").select(*keys, *BOX, points.alias("estimated_points"), F.coalesce("k", F.lit(0)).cast("bigint").alias("num_nodes"), area.alias("area"), F.when(area > 0, points / area).otherwise(F.lit(float("inf"))).alias("density"))


def split(nodes: DataFrame, roots: DataFrame, max_points: int = 1_000_000, min_size: float = 50.0, deepest: int = 12, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Quadtree leaves of each root window (keys and its box): keys, path, depth, i, j, box, estimated_points.

    A window is split while its estimate is above max_points and both its sides are above min_size. The windows are a list
    that the caller gets, so the driver holds it; nodes stay distributed and go along with the windows that they touch: a window that is split
    hands each of its nodes to those of its quarters that the node touches, so no level looks at nodes of windows that are done. A leaf's
    path is the quarter taken at each level (0 lower left, 1 lower right, 2 upper left, 3 upper right), a root's is empty.
    ``nodes`` may be those of several files; their estimates add up."""
    spark = nodes.sparkSession
    names = [f"n_{c}" for c in BOX]
    by = [*keys, "path"]
    touches = F.expr("n_xmin <= xmax and n_xmax >= xmin and n_ymin <= ymax and n_ymax >= ymin")
    start = roots.select(*keys, F.lit("").alias("path"), *(F.col(c).cast("double").alias(c) for c in BOX))
    kind = start.schema
    held = meeting(start, nodes.select("point_count", *(F.col(c).cast("double").alias(n) for c, n in zip(BOX, names, strict=True))), BOX, names)
    n = len(keys)
    windows = [(tuple(r), 0, 0) for r in start.collect()]
    leaves: list[tuple] = []
    above = None
    for d in range(deepest + 1):
        held = held.persist()
        sums = {tuple(r)[:-1]: r["p"] for r in held.groupBy(*by).agg(F.sum("point_count").alias("p")).collect()}
        if above is not None:  # held is worked out now
            above.unpersist()
        parts: list[tuple[tuple, int, int]] = []
        for w, i, j in windows:
            x0, y0, x1, y1 = w[n + 1 :]
            known = int(sums.get(w[: n + 1], 0))
            if d == deepest or known <= max_points or x1 - x0 <= min_size or y1 - y0 <= min_size:
                leaves.append((*w[: n + 1], d, i, j, *w[n + 1 :], known))
                continue
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            for q, (a, b, box) in enumerate(((0, 0, (x0, y0, mx, my)), (1, 0, (mx, y0, x1, my)), (0, 1, (x0, my, mx, y1)), (1, 1, (mx, my, x1, y1)))):
                parts.append(((*w[:n], f"{w[n]}{q}", *box), 2 * i + a, 2 * j + b))
        if not parts:
            held.unpersist()
            break
        quarters = spark.createDataFrame([w for w, _, _ in parts], kind).withColumn("parent", F.expr("substring(path, 1, length(path) - 1)"))
        below = held.drop(*BOX).withColumnRenamed("path", "parent").join(quarters, [*keys, "parent"])
        above, windows = held, parts
        held = below.where(touches).select(*by, *BOX, "point_count", *names)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kind.fields[:n]] + ["path string", "depth int", "i long", "j long", *(f"{c} double" for c in BOX), "estimated_points long"]
    return spark.createDataFrame(sorted(leaves), ", ".join(fields))


def adaptive_split(nodes: DataFrame, extent: Box, max_points: int = 1_000_000, min_size: float = 50.0, collar: float = 0.0, deepest: int = 12) -> DataFrame:
    """Quadtree leaves of one extent, in the order of their paths (lower left first, depth first): path, depth, i, j, box, read box
    with collar, estimated_points."""
    root = nodes.sparkSession.range(1).select(F.col("id").alias("tile_id"), *(F.lit(float(v)).alias(c) for c, v in zip(BOX, extent, strict=True)))
    leaves = split(nodes, root, max_points, min_size, deepest)
    return leaves.select("path", "depth", "i", "j", *BOX, *((F.col(c) + s * collar).alias(f"r{c}") for c, s in zip(BOX, (-1, -1, 1, 1), strict=True)), "estimated_points")


def chunks_with_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Each chunk's files: their extents overlap (touching isn't enough); chunks without files go."""
    f = files.select(*(F.col(c).alias(f"f_{c}") for c in BOX), *(c for c in files.columns if c not in BOX))
    return meeting(chunks, f, BOX, [f"f_{c}" for c in BOX], touching=False)
