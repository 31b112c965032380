"""Price bars as they come: each micro-batch replaces the span of its rows in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.intervals import by_month, month_of


def latest(versions: DataFrame) -> DataFrame:
    """Of a store with rows (ticker, dt, price, version) those that no later version's span covers: a version replaces all days from its
    first to its last of a ticker, also those that it leaves out. Days meet spans by month."""
    spans = versions.groupBy("ticker", F.col("version").alias("_v")).agg(F.min("dt").alias("_a"), F.max("dt").alias("_b")).withColumnRenamed("ticker", "_t")
    spans = by_month(spans, "_a", "_b", "_m")
    later = (F.col("ticker") == F.col("_t")) & (month_of("dt") == F.col("_m")) & (F.col("version") < F.col("_v")) & F.col("dt").between(F.col("_a"), F.col("_b"))
    return versions.join(spans, later, "left_anti")


def ingest(bars: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch under its number; a batch that is sent again writes over its own folder, so it counts once."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return bars.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close and volume of each event type and hour, from the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return e.groupBy("ticker", "hour").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("volume"))

