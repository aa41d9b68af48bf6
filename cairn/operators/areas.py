"""Points within any of many areas, as a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.geometry import Area
from ..plans.numbering import unused

#: Areas up to which their conditions are written into the plan.
WRITTEN_AREAS = 16
#: Cells of the grid along an axis at most.
MOST_CELLS = 512


def within_any(points: DataFrame, areas: Sequence[Area], x: str = "X", y: str = "Y") -> DataFrame:
    """Points within at least one of the areas' polygons; a point in two of them is still one row.

    Many areas become a table: each polygon goes to the cells that its box covers, a point lies in one cell, and a semi-join on
    cells holds it against the polygons there. The plan doesn't grow with their number."""
    polygons = [rings for a in areas for rings in a.polygons]
    if not polygons:
        return points.where("false")
    if len(polygons) <= WRITTEN_AREAS:
        return points.where(geometry.in_any_polygon(polygons, x, y))
    rows = []
    for rings in polygons:
        edges = [tuple(map(float, e)) for e in geometry.edges(rings)]
        rows.append((min(min(e[0], e[2]) for e in edges), min(min(e[1], e[3]) for e in edges), max(max(e[0], e[2]) for e in edges), max(max(e[1], e[3]) for e in edges), edges))
    x0, y0, x1, y1 = min(r[0] for r in rows), min(r[1] for r in rows), max(r[2] for r in rows), max(r[3] for r in rows)
    cells = max(1, min(MOST_CELLS, round(len(rows) ** 0.5) * 2))
    wide, high = max((x1 - x0) / cells, 1e-9), max((y1 - y0) / cells, 1e-9)
    cell = lambda c, low, size: F.floor(F.greatest(F.least((c - F.lit(low)) / F.lit(size), F.lit(float(cells - 1))), F.lit(0.0))).cast("int")
    cx, cy, ax0, ay0, ax1, ay1, lines = unused(points, "cx", "cy", "ax0", "ay0", "ax1", "ay1", "lines")
    kind = f"{ax0} double, {ay0} double, {ax1} double, {ay1} double, {lines} array<struct<a: double, b: double, c: double, d: double>>"
    table = points.sparkSession.createDataFrame(rows, kind)
    over = lambda a, b, low, size: F.explode(F.sequence(cell(F.col(a), low, size), cell(F.col(b), low, size)))
    table = table.withColumn(cx, over(ax0, ax1, x0, wide)).withColumn(cy, over(ay0, ay1, y0, high))
    near = points.where(geometry.box(x0, y0, x1, y1, x, y)).withColumn(cx, cell(F.col(x), x0, wide)).withColumn(cy, cell(F.col(y), y0, high))
    left, right = near.alias("l"), table.alias("r")
    px, py = F.col(f"l.{x}"), F.col(f"l.{y}")
    same = (F.col(f"l.{cx}") == F.col(f"r.{cx}")) & (F.col(f"l.{cy}") == F.col(f"r.{cy}"))
    boxed = px.between(F.col(f"r.{ax0}"), F.col(f"r.{ax1}")) & py.between(F.col(f"r.{ay0}"), F.col(f"r.{ay1}"))
    return left.join(right, same & boxed & geometry.inside_edges(F.col(f"r.{lines}"), px, py), "left_semi").select(*points.columns)
