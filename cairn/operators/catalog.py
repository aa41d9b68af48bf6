"""Catalogs of files: extents, counts and formats as a table, with totals and selection."""

from __future__ import annotations

import json
import logging
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.geometry import Area
from ..functions.octree import depth_of_resolution
from ..sources import las
from ..sources.ranges import checked, opened, stamp
from .tiling import Grid

SCHEMA = "file string, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, points long, point_format int, wkt string, spacing double, halfsize double, tmin double, tmax double"


class _Cache:
    """What was read last, up to a number of headers, with counts of what was found and what wasn't."""

    def __init__(self):
        self.most, self.enabled, self.hits, self.misses = 256, True, 0, 0
        self.kept: OrderedDict[tuple, las.Header] = OrderedDict()

    def get(self, key: tuple, read: Callable[[], las.Header]) -> las.Header:
        if not self.enabled:
            return read()
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.misses += 1
        self.kept[key] = found = read()
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return found


_cache = _Cache()


def header(path: str) -> las.Header:
    """A file's header; kept until the file changes."""
    path = checked(path)

    def read() -> las.Header:
        with opened(path) as f:
            return las.read_header(f)

    return _cache.get((path, *stamp(path)), read)


def row(path: str, h: las.Header) -> tuple:
    return (path, *h.low, *h.high, h.points, h.point_format, h.wkt, h.spacing, h.cube.half if h.cube else None, *h.times)


def info(spark: SparkSession, path: str) -> DataFrame:
    """What the header says, in one row."""
    return spark.createDataFrame([row(path, header(path))], SCHEMA)


def resolution_depth(path: str, resolution: float) -> int:
    return depth_of_resolution(header(path).spacing, resolution)


#: Headers that the driver reads itself.
HERE = 32


def _tried(path: str) -> tuple:
    try:
        return (*row(path, header(path)), None)
    except (OSError, ValueError) as e:
        return (path, *[None] * (SCHEMA.count(",")), str(e))


def _tried_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")] + ["error"]
    for b in batches:
        yield pd.DataFrame([_tried(p) for p in b["path"]], columns=names)


@dataclass(frozen=True)
class Catalog:
    """Files and how they are to be worked on."""

    files: DataFrame
    chunk_size: float = 0.0
    chunk_buffer: float = 0.0
    select: str | None = None
    filter: str | None = None

    @staticmethod
    def of(spark: SparkSession, paths: Sequence[str], **options) -> Catalog:
        """Reads the headers, many of them on the executors; files that have none are left out with a warning, and none at
        all is an error."""
        paths = list(dict.fromkeys(paths))
        if len(paths) <= HERE:
            found = [_tried(p) for p in paths]
        else:
            kind = f"{SCHEMA}, error string"
            dealt = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths) // 16 + 1, 10_000))
            found = [tuple(r) for r in dealt.mapInPandas(_tried_all, kind).collect()]  # a row for each file
            found.sort(key=lambda r: paths.index(r[0]) if len(paths) < 1000 else r[0])
        for *r, error in found:
            if error is not None:
                logging.getLogger(__name__).warning("%s is left out: %s", r[0], error)
        rows = [r[:-1] for r in found if r[-1] is None]
        if not rows:
            raise ValueError("no file could be read")
        return Catalog(spark.createDataFrame(rows, SCHEMA), **options)

    def with_options(self, **options) -> Catalog:
        return replace(self, **options)

    def totals(self) -> DataFrame:
        """Files, points, and the extent of all."""
        return totals(self.files)

    def meeting(self, box: tuple[float, float, float, float]) -> Catalog:
        x0, y0, x1, y1 = box
        return replace(self, files=self.files.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)))

    def paths(self) -> list[str]:
        return [r["file"] for r in self.files.select("file").collect()]

    def points(self, file: str | None = None) -> DataFrame:
        """The points of all files, read by one scan; with ``file``, each file's name in a column of that name."""
        spark = self.files.sparkSession
        from ..plans.filters import Filter
        from ..sources import datasource

        datasource.register(spark)
        reader = spark.read.format("cairn_octree").option("path", json.dumps(self.paths()))
        reader = reader.option("fileColumn", file) if file else reader
        df = (reader.option("select", self.select) if self.select else reader).load()
        return Filter.parse(self.filter).where(df)

    def nodes(self) -> DataFrame:
        """file, level, box and point_count of the octree nodes of all files, read where there are many files on the executors."""
        spark = self.files.sparkSession
        dealt = self.files.select("file")
        n = dealt.count()
        return dealt.repartition(min(max(1, n // 16), 10_000)).mapInPandas(_nodes_of, "file string, level int, xmin double, ymin double, xmax double, ymax double, point_count long")

    def apply_files(self, fun: Callable, schema: str, **extras) -> DataFrame:
        """fun(table, chunk, **extras) for each chunk of chunk_size (0: the whole file) of each file: file, chunk_id, its result.

        A chunk is read with chunk_buffer around it, from its own file alone; results aren't clipped."""
        from .apply import file_apply

        return file_apply(self.points("file"), self.files, fun, schema, self.chunk_size, self.chunk_buffer, extras=extras)

    def apply(
        self,
        fun: Callable,
        schema: str,
        area: Area | None = None,
        chunk_size: float = 200.0,
        chunk_buffer: float = 15.0,
        chunk_alignment: tuple[float, float] = (0.0, 0.0),
        max_points_per_chunk: int | None = None,
        min_split_size: float = 25.0,
        merge: bool = True,
        keep_going: bool = True,
        **extras,
    ) -> DataFrame | None:
        """fun(table, chunk, **extras) for each chunk of an aligned grid over all files, or over the area's box.

        Chunks are read across files with their buffer, split by the estimates of all files if max_points_per_chunk is given, and
        what fun returns is clipped to them; a chunk that fails gives nothing. With ``merge`` the results are one table
        (``apply.automerge``), else rows keep tile_id (and path)."""
        from .apply import automerge, chunk_apply

        if not chunk_size > 0 or chunk_buffer < 0:
            raise ValueError("the chunk size must be positive and the buffer not negative")
        t = self.totals().first()
        extent = (t["xmin"], t["ymin"], t["xmax"], t["ymax"]) if area is None else area.bounds()
        if not (extent[0] < extent[2] and extent[1] < extent[3]):
            return None
        x0, y0, x1, y1 = extent
        near = self.meeting((x0 - chunk_buffer - chunk_size, y0 - chunk_buffer - chunk_size, x1 + chunk_buffer + chunk_size, y1 + chunk_buffer + chunk_size))
        if near.files.isEmpty():
            return None
        nodes = near.nodes() if max_points_per_chunk else None
        out = chunk_apply(near.points(), fun, schema, Grid.aligned(extent, chunk_size, chunk_alignment), chunk_buffer, None, True, keep_going, nodes, max_points_per_chunk, min_split_size, extras)
        return automerge(out) if merge else out

    def adaptive_split(self, max_points: int = 1_000_000, min_size: float = 50.0, extent: tuple | None = None, collar: float = 0.0) -> DataFrame:
        """Quadtree leaves over all files: the estimates of a window are those of every file, added up."""
        from .tiling import adaptive_split

        t = self.totals().first()
        return adaptive_split(self.nodes(), extent or (t["xmin"], t["ymin"], t["xmax"], t["ymax"]), max_points, min_size, collar)

    def __repr__(self) -> str:
        t = self.totals().first()
        return f"Catalog({t['files']} files, {t['points']} points, x {t['xmin']:g} to {t['xmax']:g}, y {t['ymin']:g} to {t['ymax']:g})"


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("points").alias("points"), *(F.min(c).alias(c) for c in ("xmin", "ymin", "zmin")), *(F.max(c).alias(c) for c in ("xmax", "ymax", "zmax")))


def _nodes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path in b["file"]:
            try:
                h = header(path)
                with opened(path) as f:
                    found = las.select_nodes(f, h)
            except (OSError, ValueError):  # a file that can't be read counts as empty
                continue
            boxes = [h.cube.bounds(e["level"], e["x"], e["y"], e["z"]) for e in found]
            yield pd.DataFrame({"file": path, "level": [e["level"] for e in found], "xmin": [x[0] for x in boxes], "ymin": [x[1] for x in boxes], "xmax": [x[3] for x in boxes], "ymax": [x[4] for x in boxes], "point_count": [e["point_count"] for e in found]})


def bounds(path: str) -> dict:
    """A file's box, and the code of its coordinates if it names one."""
    h = header(path)
    return dict(zip(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), (*h.low, *h.high), strict=True)) | {"epsg": crs.epsg_of(h.wkt) if h.wkt else None}


def cache_config(headers: int | None = None, enabled: bool | None = None) -> dict[str, int | bool]:
    """Sets how many headers are kept, and whether any are; points are kept by Spark itself (``persist``), on disk as well."""
    if headers is not None:
        if headers < 1:
            raise ValueError("one header at least can be kept")
        _cache.most = int(headers)
        while len(_cache.kept) > _cache.most:
            _cache.kept.popitem(last=False)
    if enabled is not None:
        _cache.enabled = bool(enabled)
    return {"headers": _cache.most, "enabled": _cache.enabled}


def cache_stats(spark: SparkSession | None = None) -> dict[str, int]:
    """Headers kept, how often one was found or wasn't; with a session, also tables that Spark keeps, and their bytes in memory
    and on disk."""
    out = {"headers": len(_cache.kept), "hits": _cache.hits, "misses": _cache.misses}
    if spark is not None:
        found = list(spark.sparkContext._jsc.sc().getRDDStorageInfo())
        out |= {"tables": len(found), "memory": sum(r.memSize() for r in found), "disk": sum(r.diskSize() for r in found)}
    return out


def cache_clear(spark: SparkSession | None = None) -> None:
    """Forgets headers; with a session, also the tables that Spark keeps."""
    _cache.kept.clear()
    _cache.hits = _cache.misses = 0
    if spark is not None:
        spark.catalog.clearCache()
