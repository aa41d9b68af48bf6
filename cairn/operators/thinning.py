"""Thinning and sampling: voxels, every nth point, random shares and exact random samples, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import numbered, unused
from ..schema import Order

MODES = ("center", "first", "random")
#: Rows of a sample or a cap that may meet in one task.
FEW = 100_000


def voxel_index(size: float) -> dict[str, Column]:
    """The voxel of a point, counted from the origin; floor, so that cells don't meet at 0."""
    if not size > 0:
        raise ValueError("the voxel size must be a positive number")
    return {f"v{c.lower()}": F.floor(F.col(c) / F.lit(float(size))).cast("bigint") for c in "XYZ"}


def shuffle_key(order: Order, seed: int, whole: dict[str, str] | None = None) -> Column:
    """A hash of a point and a seed as text: the same points in every run, and in SQL. ``whole`` says how a column that is no whole
    number becomes one."""
    parts = [F.expr((whole or {}).get(c, f"CAST({c} AS BIGINT)")).cast("string") for c in order.columns]
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *parts).cast("binary"))


def voxel_thin(df: DataFrame, size: float, order: Order, mode: str = "center", seed: int = 0, whole: dict[str, str] | None = None) -> DataFrame:
    """One point of each voxel: nearest to its centre, first in order, or at random; ties go to the first in order.

    The pick is an aggregate (the least of a struct), so equal voxels are combined before they are shuffled."""
    index = voxel_index(size)
    if mode == "center":
        off = [(F.col(c) - (index[f"v{c.lower()}"] + F.lit(0.5)) * F.lit(float(size))) for c in "XYZ"]
        rank = [(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("d2")]
    elif mode == "first":
        rank = []
    elif mode == "random":
        rank = [shuffle_key(order, seed, whole).alias("key")]
    else:
        raise ValueError(f"mode must be one of {MODES}")
    names = [f"r{k}" for k in range(len(rank))] + [f"o{k}" for k in range(len(order.columns))]
    keys = [c.alias(n) for c, n in zip([*rank, *order.by()], names, strict=True)]
    row = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(df.columns)))
    picked = df.groupBy(*(c.alias(n) for n, c in index.items())).agg(F.min_by(row, F.struct(*keys)).alias("row"))
    return picked.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)))


def every_nth(df: DataFrame, n: int, order: Order) -> DataFrame:
    """The 1st, n+1st, 2n+1st ... point; n = 1 keeps all."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    if n == 1:
        return df
    (number,) = unused(df, "number")
    return numbered(df, order, number).where(F.col(number) % n == 1).drop(number)


def random_fraction(df: DataFrame, fraction: float, order: Order, seed: int = 0, whole: dict[str, str] | None = None) -> DataFrame:
    """A share of the points, each by its own hash."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be from 0 to 1")
    if fraction == 1:
        return df
    return df.where(F.substring(shuffle_key(order, seed, whole), 1, 8) < f"{int(fraction * 2**32):08x}")


def sample(df: DataFrame, n: int, order: Order, seed: int = 0, whole: dict[str, str] | None = None) -> DataFrame:
    """Exactly n points at random, or all if there are no more."""
    (key,) = unused(df, "key")
    return _first(df.withColumn(key, shuffle_key(order, seed, whole)), n, Order((key, *order.columns))).drop(key)


def _first(df: DataFrame, n: int, order: Order) -> DataFrame:
    """The first n rows: few meet in one task, many are numbered where they lie."""
    if n <= FEW:
        return df.orderBy(*order.by()).limit(n)
    (number,) = unused(df, "number")
    return numbered(df, order, number).where(F.col(number) <= n).drop(number)


def head(df: DataFrame, n: int | float | None, order: Order) -> DataFrame:
    """The first n points in order; None, infinity and numbers up to 0 mean all."""
    if n is None or n <= 0 or n == float("inf"):
        return df
    return _first(df, int(n), order)
