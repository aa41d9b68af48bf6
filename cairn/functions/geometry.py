"""Plane geometry as column expressions: boxes, polygons with holes, distances, and areas of interest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
Ring = Sequence[Point]
#: Above so many edges a polygon is folded over an array instead of written out.
WRITTEN_EDGES = 200


def box(xmin: float, ymin: float, xmax: float, ymax: float, x: str = "X", y: str = "Y", half_open: bool = False) -> Column:
    """Within a box; its border belongs to it, or with half_open just the lower one, so that tiles share no points."""
    if half_open:
        return (F.col(x) >= xmin) & (F.col(x) < xmax) & (F.col(y) >= ymin) & (F.col(y) < ymax)
    return F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax)


def overlap(a: Sequence[str], b: Sequence[float | Column], strict: bool = False) -> Column:
    """Whether boxes xmin, ymin, xmax, ymax meet; touching counts unless strict."""
    ax0, ay0, ax1, ay1 = (F.col(c) for c in a)
    if strict:
        return (ax0 < b[2]) & (ax1 > b[0]) & (ay0 < b[3]) & (ay1 > b[1])
    return (ax0 <= b[2]) & (ax1 >= b[0]) & (ay0 <= b[3]) & (ay1 >= b[1])


def _edges(rings: Sequence[Ring]) -> list[tuple[float, float, float, float]]:
    out = []
    for ring in rings:
        points = [(float(x), float(y)) for x, y in ring]
        if points[0] != points[-1]:
            points.append(points[0])
        out += [(*p, *q) for p, q in zip(points, points[1:], strict=False) if p != q]
    return out


def _crosses(x, y, x1, y1, x2, y2) -> Column:
    """Whether a ray to the right of (x, y) crosses an edge."""
    level = ((y1 > y) & (y2 <= y)) | ((y2 > y) & (y1 <= y))
    return F.when(level, F.when(x < (x2 - x1) * (y - y1) / (y2 - y1) + x1, 1).otherwise(0)).otherwise(0)


def _on_edge(x, y, x1, y1, x2, y2) -> Column:
    line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
    return line & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))


def in_polygon(rings: Sequence[Ring], x: str = "X", y: str = "Y") -> Column:
    """Within a polygon given by its rings, or on its border: even-odd, so inner rings are holes.

    The rings' box comes first: it reaches the scan, the rest can't."""
    edges = _edges(rings)
    xs, ys = [e[k] for e in edges for k in (0, 2)], [e[k] for e in edges for k in (1, 3)]
    px, py = F.col(x), F.col(y)
    if len(edges) <= WRITTEN_EDGES:
        lit = [tuple(F.lit(v) for v in e) for e in edges]
        crossings = reduce(lambda a, b: a + b, (_crosses(px, py, *e) for e in lit))
        border = reduce(lambda a, b: a | b, (_on_edge(px, py, *e) for e in lit))
        return box(min(xs), min(ys), max(xs), max(ys), x, y) & ((crossings % 2 == 1) | border)
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(e, ("a", "b", "c", "d"), strict=True))) for e in edges))
    return box(min(xs), min(ys), max(xs), max(ys), x, y) & inside_edges(table, px, py)


def inside_edges(table: Column, px: Column, py: Column) -> Column:
    """Within or on a polygon given as an array of edges (a, b) to (c, d)."""
    crossings = F.aggregate(table, F.lit(0), lambda s, e: s + _crosses(px, py, e["a"], e["b"], e["c"], e["d"]))
    return (crossings % 2 == 1) | F.exists(table, lambda e: _on_edge(px, py, e["a"], e["b"], e["c"], e["d"]))


def edges(rings: Sequence[Ring]) -> list[tuple[float, float, float, float]]:
    """The edges of a polygon's rings."""
    return _edges(rings)


def in_any_polygon(polygons: Sequence[Sequence[Ring]], x: str = "X", y: str = "Y") -> Column:
    """Within at least one of several polygons; a point in two of them is still one row."""
    return reduce(lambda a, b: a | b, (in_polygon(rings, x, y) for rings in polygons))


def squared_distance(a: Point, b: Point, x: str = "X", y: str = "Y") -> Column:
    """To the segment from a to b."""
    px, py = F.col(x), F.col(y)
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    if length == 0:
        return (px - a[0]) * (px - a[0]) + (py - a[1]) * (py - a[1])
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a[0]) * dx + (py - a[1]) * dy) / length))
    ex, ey = px - (a[0] + t * dx), py - (a[1] + t * dy)
    return ex * ex + ey * ey


def near_line(line: Sequence[Point], width: float, x: str = "X", y: str = "Y") -> Column:
    """Within ``width`` of a line (or of a point): exact, with round ends and joints."""
    line = [(float(a), float(b)) for a, b in line]
    segments = list(zip(line, line[1:], strict=False)) or [(line[0], line[0])]
    xs, ys = zip(*line, strict=True)
    close = reduce(lambda a, b: a | b, (squared_distance(a, b, x, y) <= width * width for a, b in segments))
    return box(min(xs) - width, min(ys) - width, max(xs) + width, max(ys) + width, x, y) & close


@dataclass(frozen=True)
class Area:
    """An area of interest: polygons, or lines and points with a width around them."""

    polygons: tuple[tuple[Ring, ...], ...] = ()
    lines: tuple[tuple[Point, ...], ...] = ()
    width: float = 0.0

    @staticmethod
    def of(shape, width: float = 0.0) -> Area:
        """From four numbers (xmin, ymin, xmax, ymax), or from a GeoJSON geometry, feature or collection."""
        if isinstance(shape, Area):
            return shape
        if isinstance(shape, (list, tuple)):
            if len(shape) != 4 or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in shape):
                raise ValueError("a box is four finite numbers: xmin, ymin, xmax, ymax")
            x0, y0, x1, y1 = map(float, shape)
            if x0 >= x1 or y0 >= y1:
                raise ValueError("a box needs xmin < xmax and ymin < ymax")
            return Area((((((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))),),))
        polygons, lines = [], []
        pending = [shape]
        while pending:
            g = pending.pop(0)
            if not g:
                continue
            kind, c = g.get("type"), g.get("coordinates")
            if kind == "FeatureCollection":
                pending += g["features"]
            elif kind == "Feature":
                pending.append(g["geometry"])
            elif kind == "GeometryCollection":
                pending += g["geometries"]
            elif not c:
                continue
            elif kind == "Polygon":
                polygons.append(tuple(tuple((p[0], p[1]) for p in ring) for ring in c))
            elif kind == "MultiPolygon":
                polygons += [tuple(tuple((p[0], p[1]) for p in ring) for ring in part) for part in c]
            elif kind in ("LineString", "MultiPoint"):
                parts = [c] if kind == "LineString" else [[p] for p in c]
                lines += [tuple((p[0], p[1]) for p in part) for part in parts]
            elif kind == "MultiLineString":
                lines += [tuple((p[0], p[1]) for p in part) for part in c]
            elif kind == "Point":
                lines.append(((c[0], c[1]),))
            else:
                raise ValueError(f"not a geometry: {kind}")
        if not polygons and not lines:
            raise ValueError("the area is empty")
        if lines and width <= 0:
            raise ValueError("lines and points need a width around them")
        return Area(tuple(polygons), tuple(lines), width)

    def bounds(self) -> tuple[float, float, float, float]:
        xs = [x for rings in self.polygons for ring in rings for x, _ in ring]
        ys = [y for rings in self.polygons for ring in rings for _, y in ring]
        xs += [x + s * self.width for line in self.lines for x, _ in line for s in (-1, 1)]
        ys += [y + s * self.width for line in self.lines for _, y in line for s in (-1, 1)]
        return min(xs), min(ys), max(xs), max(ys)

    def holds(self, x: str = "X", y: str = "Y") -> Column:
        parts = [in_polygon(rings, x, y) for rings in self.polygons] + [near_line(line, self.width, x, y) for line in self.lines]
        return reduce(lambda a, b: a | b, parts)

    def geojson(self) -> dict:
        """As a MultiPolygon; lines as a GeometryCollection beside it."""
        polygons = {"type": "MultiPolygon", "coordinates": [[[list(p) for p in ring] for ring in rings] for rings in self.polygons]}
        if not self.lines:
            return polygons
        return {"type": "GeometryCollection", "geometries": [polygons, {"type": "MultiLineString", "coordinates": [[list(p) for p in line] for line in self.lines]}]}
