"""Filter strings such as ``-drop_noise -keep_first -keep_z_above 2`` as column expressions.

Predicates are joined by AND whatever their order in the string. Decimation, random thinning and voxels come after them,
in that order. One parser serves reading and writing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter string that says something unclear."""


def _is_in(column: str, keep: bool) -> Callable[[list[int]], Column]:
    return lambda v: F.col(column).isin(v) if keep else ~F.col(column).isin(v)


#: Token -> columns, kind of argument (list of integers, integer, number, none), and the predicate.
_PREDICATES: dict[str, tuple[tuple[str, ...], type | None, Callable]] = {
    "keep_class": (("Classification",), list, _is_in("Classification", True)),
    "drop_class": (("Classification",), list, _is_in("Classification", False)),
    "keep_ground": (("Classification",), None, lambda: F.col("Classification") == 2),
    "drop_noise": (("Classification",), None, lambda: ~F.col("Classification").isin(7, 18)),
    "keep_first": (("ReturnNumber",), None, lambda: F.col("ReturnNumber") == 1),
    "keep_last": (("ReturnNumber", "NumberOfReturns"), None, lambda: F.col("ReturnNumber") == F.col("NumberOfReturns")),
    "keep_single": (("NumberOfReturns",), None, lambda: F.col("NumberOfReturns") == 1),
    "keep_return": (("ReturnNumber",), list, _is_in("ReturnNumber", True)),
    "drop_return": (("ReturnNumber",), list, _is_in("ReturnNumber", False)),
    "drop_withheld": (("Withheld_flag",), None, lambda: F.col("Withheld_flag") == 0),
    "drop_overlap": (("Overlap_flag",), None, lambda: F.col("Overlap_flag") == 0),
    "keep_intensity_above": (("Intensity",), int, lambda v: F.col("Intensity") >= v),
    "keep_intensity_below": (("Intensity",), int, lambda v: F.col("Intensity") <= v),
    "keep_z_above": (("Z",), float, lambda v: F.col("Z") >= v),
    "keep_z_below": (("Z",), float, lambda v: F.col("Z") <= v),
    "drop_z_above": (("Z",), float, lambda v: F.col("Z") <= v),
    "drop_z_below": (("Z",), float, lambda v: F.col("Z") >= v),
    "keep_scan_angle_above": (("ScanAngleRank",), float, lambda v: F.col("ScanAngleRank") >= v),
    "keep_scan_angle_below": (("ScanAngleRank",), float, lambda v: F.col("ScanAngleRank") <= v),
}
_AFTER: dict[str, type] = {"keep_every_nth": int, "keep_random_fraction": float, "keep_voxel": float}


def _number(token: str, text: str | None, kind: type) -> float | int:
    try:
        value = kind(text)
    except (TypeError, ValueError):
        raise FilterError(f"-{token} needs a {'whole ' if kind is int else ''}number, not {text!r}") from None
    if not math.isfinite(value):
        raise FilterError(f"-{token} needs a finite number")
    return value


@dataclass(frozen=True)
class Filter:
    """A parsed filter string."""

    predicates: tuple[tuple[str, tuple], ...] = ()
    every_nth: int | None = None
    random_fraction: float | None = None
    voxel: float | None = None

    @staticmethod
    def parse(text: str | None, strict: bool = True) -> Filter:
        """strict=False passes over tokens and numbers that mean nothing, but never over a bad voxel size."""
        tokens, k = (text or "").split(), 0
        found: list[tuple[str, tuple]] = []
        after: dict[str, float | int] = {}
        while k < len(tokens):
            name, k = tokens[k].removeprefix("-"), k + 1
            if not tokens[k - 1].startswith("-") or name not in _PREDICATES and name not in _AFTER:
                if strict:
                    raise FilterError(f"unknown filter {tokens[k - 1]!r}")
                continue
            kind = _AFTER.get(name) or _PREDICATES[name][1]
            if kind is None:
                found.append((name, ()))
                continue
            values: list[str] = []
            while k < len(tokens) and not _is_token(tokens[k]) and (kind is list or not values):
                values.append(tokens[k])
                k += 1
            try:
                if kind is list:
                    if not values:
                        raise FilterError(f"-{name} needs at least one number")
                    found.append((name, ([_number(name, v, int) for v in values],)))
                    continue
                value = _number(name, values[0] if values else None, kind)
                if name == "keep_random_fraction" and not 0 <= value <= 1:
                    raise FilterError("-keep_random_fraction needs a number from 0 to 1")
                if name == "keep_every_nth" and value < 1:
                    raise FilterError("-keep_every_nth needs a number of 1 or more")
            except FilterError:
                if name == "keep_voxel":
                    raise FilterError("-keep_voxel needs a positive numeric size") from None
                if strict:
                    raise
                continue
            if name == "keep_voxel" and value <= 0:
                raise FilterError("-keep_voxel needs a positive numeric size")
            if name in _AFTER:
                after.setdefault(name, value)
            else:
                found.append((name, (value,)))
        return Filter(tuple(found), after.get("keep_every_nth"), after.get("keep_random_fraction"), after.get("keep_voxel"))

    def where(self, df: DataFrame) -> DataFrame:
        """The predicates; one whose column the table lacks is passed over."""
        parts: list[Column] = [_PREDICATES[name][2](*args) for name, args in self.predicates if set(_PREDICATES[name][0]) <= set(df.columns)]
        return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def _is_token(text: str) -> bool:
    return text.startswith("-") and not text[1:2].isdigit() and text[1:2] != "."
