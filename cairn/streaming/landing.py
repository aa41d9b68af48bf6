"""Points that arrive as Parquet files in a folder, filtered and tiled as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.thinning import voxel_index
from ..plans.filters import Filter


def arriving(spark: SparkSession, folder: str, schema: T.StructType, filter: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """A stream of the points that the filter's predicates keep; what needs an order or a whole voxel isn't for streams."""
    rule = Filter.parse(filter)
    if rule.every_nth or rule.voxel:
        raise ValueError("decimation and voxels need all points: use them on a table")
    df = rule.where(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return df if rule.random_fraction is None else df.where(F.rand(0) <= rule.random_fraction)


def cell_counts(points: DataFrame, size: float) -> DataFrame:
    """Running counts and height ranges of voxels; the state is a row for each voxel seen."""
    return points.groupBy(*(c.alias(n) for n, c in voxel_index(size).items())).agg(F.count(F.lit(1)).alias("n"), F.min("Z").alias("zmin"), F.max("Z").alias("zmax"))


def timed_counts(points: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Points of each window of their time (seconds since 1970) and class; those later than ``late`` are passed over."""
    timed = points.withColumn("at", F.timestamp_seconds("gpstime")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "Classification").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "Classification", "n")
