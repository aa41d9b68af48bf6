"""Boxes that meet boxes, as an equi-join: both sides are dealt over the cells of one grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import unused

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Cells of the grid along an axis at most.
MOST_CELLS = 256


def meeting(left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str], touching: bool = True) -> DataFrame:
    """All pairs of rows whose boxes meet; with touching=False a shared edge isn't enough.

    The grid spans all boxes of the left side, with about one cell for each of its boxes. A box goes to every cell that it covers, and
    a pair is taken in one cell alone: that of the lower left corner of what they share. So equal cells are all that is joined on,
    no pair comes twice, and a cell holds what is near it. Column names of the two sides must differ; a box with a null meets
    nothing."""
    lx0, ly0, lx1, ly1 = left_box
    rx0, ry0, rx1, ry1 = right_box
    finite = lambda c: F.when(F.abs(F.col(c)) < 1e300, F.col(c))
    n, *span = left.agg(F.count(F.lit(1)), F.min(finite(lx0)), F.min(finite(ly0)), F.max(finite(lx1)), F.max(finite(ly1))).first()
    x0, y0, x1, y1 = (0.0 if v is None else float(v) for v in span)
    cells = max(1, min(MOST_CELLS, round(n**0.5)))
    wide, high = max((x1 - x0) / cells, 1e-9), max((y1 - y0) / cells, 1e-9)
    cx, cy = unused([*left.columns, *right.columns], "cx", "cy")

    def cell(c, low: float, size: float):
        at = F.floor(F.greatest(F.least((c - F.lit(low)) / F.lit(size), F.lit(float(cells - 1))), F.lit(0.0)))
        return at.cast("int")

    def dealt(df: DataFrame, box: Sequence[str]) -> DataFrame:
        a, b, c, d = map(F.col, box)
        over = lambda p, q, low, size: F.explode(F.when(p <= q, F.sequence(cell(p, low, size), cell(q, low, size))))
        return df.withColumn(cx, over(a, c, x0, wide)).withColumn(cy, over(b, d, y0, high))

    pairs = dealt(left, left_box).join(dealt(right, right_box), [cx, cy])
    below = (lambda p, q: F.col(p) <= F.col(q)) if touching else (lambda p, q: F.col(p) < F.col(q))
    pairs = pairs.where(below(lx0, rx1) & below(rx0, lx1) & below(ly0, ry1) & below(ry0, ly1))
    corner = (F.col(cx) == cell(F.greatest(lx0, rx0), x0, wide)) & (F.col(cy) == cell(F.greatest(ly0, ry0), y0, high))
    return pairs.where(corner).drop(cx, cy)
