"""A point table from order lines: an order is a pulse, a line a return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Order

ORDER = Order(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))

#: Portable SQL but for {epoch}, the seconds of l_shipdate.
POINTS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_extendedprice / 100.0e0 AS X,
  CAST(l_partkey % 2000 AS DOUBLE) / 2.0e0 AS Y,
  CAST(l_quantity AS DOUBLE) AS Z,
  {epoch} AS gpstime,
  CAST((l_orderkey * 7919) % 65536 AS INTEGER) AS Intensity,
  CAST(l_linenumber AS INTEGER) AS ReturnNumber,
  CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) AS INTEGER) AS NumberOfReturns,
  CAST(l_suppkey % 19 AS INTEGER) AS Classification,
  CAST((l_partkey * 37) % 10001 - 5000 AS DOUBLE) * 0.006e0 AS ScanAngleRank,
  CAST(round(l_tax * 100.0e0) AS INTEGER) AS UserData,
  CAST(l_suppkey AS INTEGER) AS PointSourceID,
  CAST(l_orderkey % 2 AS INTEGER) AS ScanDirectionFlag,
  CASE WHEN l_partkey % 100 = 0 THEN 1 ELSE 0 END AS EdgeOfFlightline,
  CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS Synthetic_flag,
  CASE WHEN l_suppkey % 25 = 0 THEN 1 ELSE 0 END AS Keypoint_flag,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS Withheld_flag,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS Overlap_flag,
  CAST(l_orderkey % 4 AS INTEGER) AS ScannerChannel,
  CAST((l_partkey * 31) % 65536 AS INTEGER) AS R,
  CAST((l_suppkey * 257) % 65536 AS INTEGER) AS G,
  CAST((l_orderkey * 13) % 65536 AS INTEGER) AS B,
  CAST((l_orderkey * 17 + l_linenumber) % 65536 AS INTEGER) AS NIR,
  l_discount AS extra_discount
FROM {table}
"""
#: Whatever the session's time zone: the column has none.
SPARK_EPOCH = "CAST(unix_date(CAST(l_shipdate AS DATE)) * 86400L + hour(l_shipdate) * 3600 + minute(l_shipdate) * 60 + second(l_shipdate) AS DOUBLE)"
DUCKDB_EPOCH = "CAST(epoch(l_shipdate) AS DOUBLE)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over ``lineitem.parquet``; what a query doesn't use, the number of returns among it, isn't worked out."""
    return spark.sql(POINTS_SQL.format(epoch=SPARK_EPOCH, table="{lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
