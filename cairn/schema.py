"""Columns of a point table: names, types, which letters select them, and what else they are called."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name, Spark type, select letter, lowest point format that has it.
_CORE: tuple[tuple[str, T.DataType, str, int], ...] = (
    ("X", T.DoubleType(), "x", 6),
    ("Y", T.DoubleType(), "y", 6),
    ("Z", T.DoubleType(), "z", 6),
    ("gpstime", T.DoubleType(), "t", 6),
    ("Intensity", T.IntegerType(), "i", 6),
    ("ReturnNumber", T.IntegerType(), "r", 6),
    ("NumberOfReturns", T.IntegerType(), "n", 6),
    ("Classification", T.IntegerType(), "c", 6),
    ("ScanAngleRank", T.DoubleType(), "a", 6),
    ("UserData", T.IntegerType(), "u", 6),
    ("PointSourceID", T.IntegerType(), "s", 6),
    ("ScanDirectionFlag", T.IntegerType(), "p", 6),
    ("EdgeOfFlightline", T.IntegerType(), "p", 6),
    ("Synthetic_flag", T.IntegerType(), "p", 6),
    ("Keypoint_flag", T.IntegerType(), "p", 6),
    ("Withheld_flag", T.IntegerType(), "p", 6),
    ("Overlap_flag", T.IntegerType(), "p", 6),
    ("ScannerChannel", T.IntegerType(), "p", 6),
    ("R", T.IntegerType(), "R", 7),
    ("G", T.IntegerType(), "R", 7),
    ("B", T.IntegerType(), "R", 7),
    ("NIR", T.IntegerType(), "N", 8),
)
CORE = tuple(name for name, *_ in _CORE)
FLAGS = ("Synthetic_flag", "Keypoint_flag", "Withheld_flag", "Overlap_flag")
#: Bytes of a point record by point format.
RECORD_BYTES = {6: 30, 7: 36, 8: 38}
#: Degrees of one step of a stored scan angle.
ANGLE_STEP = 0.006

#: Other names of columns, in lower case.
ALIASES = {
    "x": "X",
    "y": "Y",
    "z": "Z",
    "easting": "X",
    "northing": "Y",
    "elevation": "Z",
    "gpstime": "gpstime",
    "gps_time": "gpstime",
    "time": "gpstime",
    "intensity": "Intensity",
    "returnnumber": "ReturnNumber",
    "return_number": "ReturnNumber",
    "numberofreturns": "NumberOfReturns",
    "number_of_returns": "NumberOfReturns",
    "classification": "Classification",
    "class": "Classification",
    "scananglerank": "ScanAngleRank",
    "scan_angle_rank": "ScanAngleRank",
    "scanangle": "ScanAngleRank",
    "scan_angle": "ScanAngleRank",
    "userdata": "UserData",
    "user_data": "UserData",
    "pointsourceid": "PointSourceID",
    "point_source_id": "PointSourceID",
    "psid": "PointSourceID",
    "scandirectionflag": "ScanDirectionFlag",
    "scan_direction_flag": "ScanDirectionFlag",
    "edgeofflightline": "EdgeOfFlightline",
    "edge_of_flightline": "EdgeOfFlightline",
    "edge_of_flight_line": "EdgeOfFlightline",
    "synthetic_flag": "Synthetic_flag",
    "keypoint_flag": "Keypoint_flag",
    "withheld_flag": "Withheld_flag",
    "overlap_flag": "Overlap_flag",
    "scannerchannel": "ScannerChannel",
    "scanner_channel": "ScannerChannel",
    "r": "R",
    "red": "R",
    "g": "G",
    "green": "G",
    "b": "B",
    "blue": "B",
    "nir": "NIR",
    "infrared": "NIR",
}


@dataclass(frozen=True)
class Order:
    """Columns that put points in a total order; where points are asked for "first", it is by these."""

    columns: tuple[str, ...]

    def by(self) -> list:
        return [F.col(c) for c in self.columns]


def struct_type(point_format: int = 8) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind, _, least in _CORE if point_format >= least])


def point_format(columns: list[str]) -> int:
    """The format that a table's columns ask for."""
    return 8 if "NIR" in columns else 7 if {"R", "G", "B"} <= set(columns) else 6


def selected(letters: str | None, columns: list[str]) -> list[str]:
    """Core columns that a select string names, in the fixed order, and all columns that aren't core.

    None, "" and any "*" select everything; coordinates always stay; other letters mean nothing."""
    wanted = None if not letters or "*" in letters else set(letters) | set("xyz")
    own = [name for name, _, letter, _ in _CORE if name in columns and (wanted is None or letter in wanted)]
    return own + [c for c in columns if c not in CORE]


def select(df: DataFrame, letters: str | None) -> DataFrame:
    return df.select(*selected(letters, df.columns))


def with_standard_names(df: DataFrame) -> DataFrame:
    """Columns renamed from their aliases; a name that is there already is not given twice."""
    taken = {c for c in df.columns if c in CORE}
    new = {}
    for c in df.columns:
        to = ALIASES.get(c.lower())
        if c not in CORE and to and to not in taken:
            new[c] = to
            taken.add(to)
    return df.withColumnsRenamed(new)


def as_lidar_types(df: DataFrame) -> DataFrame:
    """Types of lidar tables elsewhere: whole numbers as integers (angles cut off), flags as booleans."""
    whole = {"Intensity", "ReturnNumber", "NumberOfReturns", "Classification", "ScanAngleRank", "UserData", "PointSourceID", "ScanDirectionFlag", "EdgeOfFlightline", "ScannerChannel", "R", "G", "B", "NIR"}
    return df.select(*(F.col(c).cast("int").alias(c) if c in whole else (F.col(c) != 0).alias(c) if c in FLAGS else F.col(c) for c in df.columns))


def merged(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ; what one lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
