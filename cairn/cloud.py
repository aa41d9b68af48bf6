"""``PointCloud``: the operators as one chain over a table of points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import geometry
from .functions.geometry import Area
from .operators import apply, stats, thinning, tiling
from .operators.paging import PointPages
from .plans.filters import Filter
from .schema import Order


@dataclass(frozen=True)
class PointCloud:
    """A lazy table of points and the order in which "first" is meant."""

    df: DataFrame
    order: Order = Order(("X", "Y", "Z", "gpstime"))
    seed: int = 0
    whole: dict | None = None

    @staticmethod
    def of(spark: SparkSession, data, **options) -> PointCloud:
        """From a DataFrame, a pandas table, columns by name, or a result with ``data``; names are made standard."""
        if isinstance(data, PointCloud):
            return data
        if isinstance(data, dict) and "data" in data:
            data = data["data"]
        if isinstance(data, dict):
            import pandas as pd

            data = pd.DataFrame(data)
        df = data if isinstance(data, DataFrame) else spark.createDataFrame(data)
        return PointCloud(schema.with_standard_names(df), **options)

    @staticmethod
    def read(spark: SparkSession, path: str, **options) -> PointCloud:
        """From an octree file or several (options as those of the format)."""
        from .sources import datasource

        datasource.register(spark)
        reader = spark.read.format("cairn_octree").option("path", path)
        for k, v in options.items():
            reader = reader.option(k, str(v))
        return PointCloud(reader.load())

    def _with(self, df: DataFrame) -> PointCloud:
        return replace(self, df=df)

    def bbox(self, xmin: float, ymin: float, xmax: float, ymax: float, half_open: bool = False) -> PointCloud:
        return self._with(self.df.where(geometry.box(xmin, ymin, xmax, ymax, half_open=half_open)))

    def zrange(self, low: float, high: float) -> PointCloud:
        return self._with(self.df.where(F.col("Z").between(low, high)))

    def within(self, shape, width: float = 0.0) -> PointCloud:
        return self._with(self.df.where(Area.of(shape, width).holds()))

    def corridor(self, line, width: float) -> PointCloud:
        return self._with(self.df.where(geometry.near_line(line, width)))

    def select(self, letters: str | None) -> PointCloud:
        kept = schema.selected(letters, self.df.columns)
        return self._with(self.df.select(*kept, *(c for c in self.order.columns if c not in kept)))

    def thin(self, size: float, mode: str = "center") -> PointCloud:
        return self._with(thinning.voxel_thin(self.df, size, self.order, mode, self.seed, self.whole))

    def sample(self, n: int) -> PointCloud:
        return self._with(thinning.sample(self.df, n, self.order, self.seed, self.whole))

    def head(self, n: int) -> PointCloud:
        return self._with(thinning.head(self.df, n, self.order))

    def query(self, bbox=None, aoi=None, buffer: float = 0.0, zrange=None, select: str | None = None, filter: str | None = None, max_points: int = -1) -> PointCloud:
        """All arguments at once, in the fixed order: box, heights, predicates, decimation, random share, cap, polygon, voxels."""
        out, rule = self, Filter.parse(filter)
        area = None
        if aoi is not None:
            numeric = isinstance(aoi, (list, tuple))
            if not (numeric and bbox is not None):
                area = Area.of(aoi, buffer)
                bbox = area.bounds() if bbox is None else bbox
                area = None if numeric else area
        if bbox is not None:
            out = out.bbox(*bbox)
        if zrange is not None:
            out = out.zrange(*zrange)
        out = out._with(rule.where(out.df))
        if rule.every_nth:
            out = out._with(thinning.every_nth(out.df, rule.every_nth, self.order))
        if rule.random_fraction is not None:
            out = out._with(thinning.random_fraction(out.df, rule.random_fraction, self.order, self.seed, self.whole))
        if max_points and max_points > 0:
            out = out.head(max_points)
        if area is not None:
            out = out._with(out.df.where(area.holds()))
        if rule.voxel:
            out = out.thin(rule.voxel)
        return out.select(select) if select else out

    def tiles(self, extent, size: float, overlap: float = 0.0, max_points: int = -1) -> DataFrame:
        """Points with tile_id; the cap is of each tile."""
        tiled = tiling.Grid(tuple(extent), size, overlap).assign(self.df)
        return tiling.cap_per_tile(tiled, max_points, self.order) if max_points > 0 else tiled

    def apply(self, fun: Callable, result: str, extent, size: float = 200.0, buffer: float = 15.0, **options) -> DataFrame:
        return apply.chunk_apply(self.df, fun, result, tiling.Grid.aligned(tuple(extent), size), buffer, **options)

    def bounds(self) -> DataFrame:
        return stats.bounds(self.df)

    def pages(self, rows: int = 10_000) -> PointPages:
        """Points in order, page by page; partitions come to the driver one after the other."""
        return PointPages(self.df, self.order, rows)

    def write(self, path: str, filter: str | None = None, **options) -> None:
        """Octree files, one for each task with points; names are made standard and the filter applied first."""
        from .sources import datasource

        datasource.register(self.df.sparkSession)
        df = Filter.parse(filter).where(schema.with_standard_names(self.df))
        if not {"X", "Y", "Z"} <= set(df.columns):
            raise ValueError("the columns X, Y, Z are needed")
        if df.isEmpty():
            raise ValueError("0 points are left to write")
        writer = df.write.format("cairn_octree").mode("append").option("path", path)
        for k, v in options.items():
            writer = writer.option(k, str(v))
        writer.save()
