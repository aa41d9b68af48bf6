"""User functions over chunks: points are dealt into buffered tiles, each goes to the function as a pandas table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Area
from ..schema import merged
from .tiling import BOX, Grid, split


def _called(fun: Callable, schema: str, keys: Sequence[str], kinds: Sequence[str], box: Callable[[tuple], dict], drop: Sequence[str], clip: bool, keep_going: bool, extras: dict):
    """A group function that hands a chunk to fun, clips what it gives, and puts the keys before it."""
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(keys, key, strict=False))
        chunk = own | box(key)
        try:
            out = fun(table.drop(columns=list(drop)), chunk, **extras)
        except Exception:
            if not keep_going:
                raise
            out = None
        if out is None or not len(out):
            return pd.DataFrame(columns=[*keys, *columns])
        if clip and {"X", "Y"} <= set(out.columns):
            out = out[out["X"].between(chunk["xmin"], chunk["xmax"]) & out["Y"].between(chunk["ymin"], chunk["ymax"])]
        out = out[columns].copy()
        for k, (name, value) in enumerate(own.items()):
            out.insert(k, name, value)
        return out

    return run, ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + f", {schema}"


def chunk_apply(
    points: DataFrame,
    fun: Callable,
    schema: str,
    grid: Grid,
    buffer: float = 0.0,
    area: Area | None = None,
    clip: bool = False,
    keep_going: bool = False,
    nodes: DataFrame | None = None,
    max_points_per_chunk: int | None = None,
    min_split_size: float = 25.0,
    extras: dict | None = None,
) -> DataFrame:
    """fun(table, chunk, **extras) for each tile of the grid with points; what it returns, with tile_id before it.

    A chunk is read with ``buffer`` around it; ``chunk`` says its tile_id and box. With ``clip``, rows of the result whose X
    and Y lie outside the tile's own closed box go. ``area`` limits the points to its box, as the grid's extent would.
    None or an empty table from fun is no rows; with ``keep_going``, so is an error, else it ends the query.

    With ``max_points_per_chunk``, tiles whose estimate from ``nodes`` (of one file or several) is above it are split into quarters
    until it isn't or a side is at most min_split_size; a chunk then is a leaf, and its path stands after tile_id."""
    if area is not None:
        x0, y0, x1, y1 = area.bounds()
        points = points.where(F.col("X").between(x0, x1) & F.col("Y").between(y0, y1))
    reader = type(grid)(grid.extent, grid.size, buffer)
    tiled = reader.assign(points)
    x0, y0, size, across = *grid.extent[:2], grid.size, grid.across

    def tile(key: tuple) -> dict:
        k = int(key[0]) - 1
        low = x0 + (k % across) * size, y0 + (k // across) * size
        return dict(zip(BOX, (*low, low[0] + size, low[1] + size), strict=True))

    if max_points_per_chunk is None:
        run, whole = _called(fun, schema, ("tile_id",), ("long",), tile, ("tile_id",), clip, keep_going, extras or {})
        return tiled.groupBy("tile_id").applyInPandas(run, whole)
    if nodes is None or not max_points_per_chunk > 0 or not min_split_size > 0:
        raise ValueError("splitting chunks needs nodes, and positive numbers of points and size")
    spark = points.sparkSession
    low = lambda name, at: (F.lit(at) + F.col(name) * F.lit(size))
    n = F.lit(across)
    roots = spark.range(grid.across * grid.down).select((F.col("id") + 1).alias("tile_id"), (F.col("id") % n).alias("c"), F.floor(F.col("id") / n).alias("r"))
    roots = roots.select("tile_id", low("c", x0).alias("xmin"), low("r", y0).alias("ymin"), (low("c", x0) + size).alias("xmax"), (low("r", y0) + size).alias("ymax"))
    leaves = split(nodes, roots, max_points_per_chunk, min_split_size)
    # A tile's points meet its own leaves; a chunk's box comes along as columns of its rows.
    names = [f"chunk_{c}" for c in BOX]
    leaves = leaves.select("tile_id", "path", *(F.col(c).alias(n) for c, n in zip(BOX, names, strict=True)))
    inside = F.col("X").between(F.col("chunk_xmin") - buffer, F.col("chunk_xmax") + buffer) & F.col("Y").between(F.col("chunk_ymin") - buffer, F.col("chunk_ymax") + buffer)
    dealt = tiled.join(leaves, "tile_id").where(inside)
    run, whole = _called(fun, schema, ("tile_id", "path"), ("long", "string"), lambda key: dict(zip(BOX, key[2:], strict=True)), ("tile_id", "path", *names), clip, keep_going, extras or {})
    return dealt.groupBy("tile_id", "path", *names).applyInPandas(run, whole)


def file_apply(points: DataFrame, files: DataFrame, fun: Callable, schema: str, chunk_size: float = 0.0, buffer: float = 0.0, file: str = "file", extras: dict | None = None) -> DataFrame:
    """fun(table, chunk, **extras) for each chunk of each file, of that file's points alone: file, chunk_id, and what it returns.

    Chunks begin at the file's own corner and are numbered from 1, columns first; with chunk_size 0 a file is one chunk. They are
    read with ``buffer`` around them, up to the file's extent, and results are not clipped. Chunks without points have no result.
    ``files`` has file, xmin, ymin, xmax, ymax; points have the file's name in a column of the same name."""
    if chunk_size <= 0:
        run, whole = _called(fun, schema, (file,), ("string",), lambda key: {"chunk_id": 1}, (), False, False, extras or {})
        return points.withColumn(file, F.col(file).cast("string")).groupBy(file).applyInPandas(run, whole).withColumn("chunk_id", F.lit(1).cast("bigint"))
    names = [f"file_{c}" for c in BOX]
    own = files.select(F.col(file).cast("string").alias(file), *(F.col(c).cast("double").alias(n) for c, n in zip(BOX, names, strict=True)))
    p = points.withColumn(file, F.col(file).cast("string")).join(own, file)
    # A chunk more on both sides than the quotient says, as it may be off by a rounding; held() decides.
    cell = lambda c, low, high: (
        F.greatest(F.floor((F.col(c) - F.col(low) - buffer) / chunk_size) - 1, F.lit(0).cast("bigint")),
        F.least(F.floor((F.col(c) - F.col(low) + buffer) / chunk_size) + 1, F.floor((F.col(high) - F.col(low)) / chunk_size)),
    )
    over = lambda pair: F.explode(F.when(pair[0] <= pair[1], F.sequence(*pair)))
    p = p.withColumn("chunk_c", over(cell("X", "file_xmin", "file_xmax"))).withColumn("chunk_r", over(cell("Y", "file_ymin", "file_ymax")))
    held = lambda c, k, low, high: F.col(c).between(F.col(low) + F.col(k) * chunk_size - buffer, F.least(F.col(low) + F.col(k) * chunk_size + chunk_size, F.col(high)) + buffer)
    p = p.where(held("X", "chunk_c", "file_xmin", "file_xmax") & held("Y", "chunk_r", "file_ymin", "file_ymax"))
    across = F.floor((F.col("file_xmax") - F.col("file_xmin")) / chunk_size) + 1
    p = p.withColumn("chunk_id", (F.col("chunk_r") * across + F.col("chunk_c") + 1).cast("bigint"))

    def box(key: tuple) -> dict:
        _, _, c, r, x0, y0, x1, y1 = key
        low = x0 + c * chunk_size, y0 + r * chunk_size
        return dict(zip(BOX, (*low, min(low[0] + chunk_size, x1), min(low[1] + chunk_size, y1)), strict=True))

    run, whole = _called(fun, schema, (file, "chunk_id"), ("string", "long"), box, (file, "chunk_id", "chunk_c", "chunk_r", *names), False, False, extras or {})
    return p.groupBy(file, "chunk_id", "chunk_c", "chunk_r", *names).applyInPandas(run, whole)


def mosaic(parts: DataFrame, by: tuple[str, ...], value: str | Sequence[str]) -> DataFrame:
    """Raster cells of several chunks as one: the mean where they overlap."""
    values = [value] if isinstance(value, str) else list(value)
    return parts.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


#: Columns that make a table one of raster cells, and columns that say which chunk a row is from.
CELL, CHUNK = ("cx", "cy"), ("tile_id", "path", "file", "chunk_id")


def automerge(results: DataFrame | Sequence[DataFrame | None]) -> DataFrame | list[DataFrame] | None:
    """Results of chunks as one, by what they are: None ones go, none left is None, one is as it is; tables of raster cells (cx, cy)
    are laid over each other with the mean where they overlap; others follow each other, by name if their columns differ. What can't
    be merged (a column of two types) comes back as a list."""
    if isinstance(results, DataFrame):
        parts = [results.drop(*CHUNK)]
    else:
        parts = [r for r in results if r is not None]
        if len(parts) < 2:
            return parts[0] if parts else None
    kinds: dict[str, str] = {}
    for p in parts:
        for name, kind in p.dtypes:
            if kinds.setdefault(name, kind) != kind:
                return list(parts)
    whole = merged(parts)
    if set(CELL) <= set(parts[0].columns):
        return mosaic(whole, CELL, [c for c in whole.columns if c not in CELL])
    return whole
