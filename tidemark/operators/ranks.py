"""Exact percentiles of any number of values, and positions over a whole table, without a key's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import staged

#: Values numbered by one task, about.
RANGE = 500_000


def numbered(rows: DataFrame, key: str, value: str, size: int = RANGE) -> DataFrame:
    """``rows`` (key, value) with ``place``, from 0 in each key by ascending value, and ``n``, the key's number of values. Rows are dealt out by ranges
    of key and value, so that a key with all the rows has many tasks; each range goes on where those before it end."""
    parts = max(1, -(-rows.count() // size))
    dealt = staged(rows.repartitionByRange(parts, key, value).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_c"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_c").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(key, "_part", before.alias("_before"), F.sum("_c").over(of_key).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(value)) - 1 + F.col("_before")
    return dealt.join(counts, [key, "_part"]).withColumn("place", place).drop("_part", "_before")


def exact_percentiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float], size: int = RANGE) -> DataFrame:
    """``(key, <name>...)``: percentiles (from 0 to 1) of each key's values, between two values in proportion. Null values count for nothing."""
    placed = numbered(rows.select(key, value).where(F.col(value).isNotNull()), key, value, size)
    picked = []
    for q in wanted.values():
        at = (F.col("n").cast("double") - 1) * q
        low = F.floor(at)
        below, above = (F.max(F.when(F.col("place") == low + k, F.col(value))) for k in (0, 1))
        picked.append(below + F.coalesce((above - below) * F.max(at - low), F.lit(0.0)))
    return placed.groupBy(key).agg(*(p.alias(name) for p, name in zip(picked, wanted, strict=True)))
