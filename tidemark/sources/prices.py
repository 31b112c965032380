"""Price series read from the sales tables: a ticker is a return flag, its price the smoothed daily average."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows over which daily averages are smoothed; a series starts once so many are there.
SMOOTH = 21


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ticker, dt, px, lo, hi, vol)``: one bar a ticker and day."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("dt"), "l_extendedprice", "l_quantity")
    return rows.groupBy("ticker", "dt").agg(F.avg("l_extendedprice").alias("px"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.sum("l_quantity").alias("vol"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ticker, dt, price)``"""
    by = Window.partitionBy("ticker").orderBy("dt")
    bars = daily_bars(spark, sf_dir).select("ticker", "dt", F.avg("px").over(by.rowsBetween(1 - SMOOTH, 0)).alias("price"), F.row_number().over(by).alias("rn"))
    return bars.where(F.col("rn") >= SMOOTH).select("ticker", "dt", "price")


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ticker, dt)``: the days of each order priority, a series with gaps."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt")).distinct()
