"""Date intervals: islands of days, unions, differences, coverage, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days between two dates of one island.
TOLERANCE = 7


def month_of(day: str) -> Column:
    """The month of a day as a number, the bin of interval joins."""
    return F.year(day) * 12 + F.month(day)


def by_month(spans: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each month that a span touches, with its number; spans that end before they start have none. Spans that meet are in one month
    together, so a join on it and an exact check after find all that meet, however many spans and days a key has."""
    return spans.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(month_of(start), month_of(end))))


def islands(days: DataFrame, tolerance: int = TOLERANCE, key: str = "ticker") -> DataFrame:
    """``(key, start, end, days)``: runs of dates no more than ``tolerance`` days apart."""
    w = Window.partitionBy(key).orderBy("dt")
    new = (F.datediff("dt", F.lag("dt").over(w)) > tolerance).cast("int")
    marked = days.select(key, "dt", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    return marked.groupBy(key, "island").agg(F.min("dt").alias("start"), F.max("dt").alias("end"), F.count("*").alias("days")).drop("island")


def union(intervals: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, start, end)``: overlapping intervals as one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def missing(known: DataFrame, requested: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, start, end)``: the parts of each of ``requested`` (key, lo, hi) that no known interval covers; of a key without any, all."""
    asked = requested.select(key, "lo", "hi").distinct()
    # both in the months they touch; of the months in which two meet, the first counts
    meet = by_month(asked, "lo", "hi", "_m").join(by_month(known.select(key, "start", "end"), "start", "end", "_m"), [key, "_m"]).where("start <= hi and end >= lo").withColumns({"s": F.greatest("start", "lo"), "e": F.least("end", "hi")})
    cut = meet.where(month_of("s") == F.col("_m")).select(key, "lo", "hi", "s", "e")
    w = Window.partitionBy(key, "lo", "hi").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.select(key, F.coalesce(F.date_add(F.max("e").over(w), 1), "lo").alias("start"), F.date_sub("s", 1).alias("end"))
    last = cut.groupBy(key, "lo", "hi").agg(F.max("e").alias("e"))
    after = asked.join(last, [key, "lo", "hi"], "left").select(key, F.coalesce(F.date_add("e", 1), "lo").alias("start"), F.col("hi").alias("end"))
    return before.unionByName(after).where("start <= end")


def coverage(known: DataFrame, requested: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, covered_days, requested_days, ratio, whole)``"""
    clipped = requested.join(known, key, "left").withColumn("n", F.greatest(F.datediff(F.least("end", "hi"), F.greatest("start", "lo")) + 1, F.lit(0)))
    whole = F.coalesce((F.col("start") <= F.col("lo")) & (F.col("end") >= F.col("hi")), F.lit(False))
    agg = clipped.groupBy(key, "lo", "hi").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("covered_days"), F.bool_or(whole).alias("whole"))
    days = (F.datediff("hi", "lo") + 1).cast("long")
    return agg.select(key, "covered_days", days.alias("requested_days"), (F.col("covered_days") / days).alias("ratio"), "whole")


def gaps(days: DataFrame, longest: int = TOLERANCE, key: str = "ticker") -> DataFrame:
    """``(key, start, end, days)``: inner gaps of more than ``longest`` days between dates that follow each other."""
    w = Window.partitionBy(key).orderBy("dt")
    d = days.withColumn("prev", F.lag("dt").over(w)).withColumn("n", F.datediff("dt", "prev").cast("long"))
    return d.where(F.col("n") > longest).select(key, F.date_add("prev", 1).alias("start"), F.date_sub("dt", 1).alias("end"), F.col("n").alias("days"))


def to_text(intervals: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, intervals)``: each key's intervals as JSON."""
    return intervals.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))))).alias("intervals"))


def from_text(rows: DataFrame, key: str = "ticker") -> DataFrame:
    """The intervals again; text that is not JSON has none."""
    parsed = F.from_json("intervals", "array<struct<start:date,end:date>>")
    return rows.select(key, F.explode(parsed).alias("i")).select(key, "i.start", "i.end")


def replace_range(old: DataFrame, new: DataFrame, key: str = "ticker") -> DataFrame:
    """``old`` with the span of each key's new rows replaced by them; of new rows that repeat a day one stays (the largest)."""
    new = new.groupBy(key, "dt").agg(*(F.max(c).alias(c) for c in new.columns if c not in (key, "dt"))).select(*new.columns)
    span = new.groupBy(key).agg(F.min("dt").alias("_lo"), F.max("dt").alias("_hi"))
    kept = old.join(span, key, "left").where("_lo is null or dt < _lo or dt > _hi").drop("_lo", "_hi")
    return kept.unionByName(new)


def replace_days(old: DataFrame, new: DataFrame, key: str = "ticker") -> DataFrame:
    """``old`` with the days of ``new`` in place of its own."""
    return old.join(new.select(key, "dt").distinct(), [key, "dt"], "left_anti").unionByName(new)
