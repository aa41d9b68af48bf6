"""Numbers of rows in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Order

#: Rows of the sample from which a range's bounds are taken, and ranges at most.
SAMPLED, MOST_RANGES = 40, 1024


def unused(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column of df (or a listed one)."""
    taken, out = {c.lower() for c in (df if isinstance(df, list) else df.columns)}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def range_of(df: DataFrame, order: Order, parts: int) -> Column:
    """The number, from 0, of the range of the order that a row lies in.

    Bounds are whole order tuples, taken from a sample of bounded size, so rows alike in the first column are parted by the others.
    They are compared by halves: a row meets log2(parts) of them."""
    keys = df.select(*order.columns)
    rows = keys.orderBy(F.xxhash64(*order.columns), *order.by()).limit(SAMPLED * parts).orderBy(*order.by()).collect() if parts > 1 else []
    cuts = list(dict.fromkeys(rows[k * len(rows) // parts] for k in range(1, parts))) if rows else []
    types = [df.schema[c].dataType for c in order.columns]
    row = F.struct(*(F.col(c).alias(f"k{k}") for k, c in enumerate(order.columns)))
    above = lambda cut: row > F.struct(*(F.lit(v).cast(t).alias(f"k{k}") for k, (v, t) in enumerate(zip(cut, types, strict=True))))

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(above(cuts[mid]), within(mid + 1, high)).otherwise(within(low, mid))

    return within(0, len(cuts))


def numbered(df: DataFrame, order: Order, name: str = "point_number", parts: int | None = None) -> DataFrame:
    """df with the row's number from 1 on.

    Rows are dealt into ranges of the order, numbered within their range, and the ranges' sizes are added up: ``parts`` rows,
    so they may be sent to all."""
    parts = min(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    part, size, of, before, inner = unused(df, "part", "size", "of", "before", "inner")
    dealt = df.withColumn(part, range_of(df, order, parts))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    sums = F.coalesce(F.sum(size).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(part).alias(of), sums.alias(before))
    out = dealt.withColumn(inner, F.row_number().over(W.partitionBy(part).orderBy(*order.by()))).join(F.broadcast(offsets), F.col(part) == F.col(of))
    return out.select(*df.columns, (F.col(before) + F.col(inner)).alias(name))
