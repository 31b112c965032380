"""Keeping a price store: what to fetch, reading through it, and the table of what it holds. All are plans from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv

#: A failed request is not sent again for so many seconds.
COOLDOWN = 3600


def within(rows: DataFrame, spans: DataFrame, key: str = "ticker") -> DataFrame:
    """``rows`` (key, dt, ...) on the days of ``spans`` (key, start, end), each once. Joined by month, so the days of one key are shared out."""
    s = iv.by_month(spans.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_b")), "_a", "_b", "_m")
    same = (F.col(key) == F.col("_k")) & (iv.month_of("dt") == F.col("_m"))
    return rows.join(s, same & F.col("dt").between(F.col("_a"), F.col("_b")), "left_semi")


def read_through(store: DataFrame, known: DataFrame, source: DataFrame, requested: DataFrame, inception: DataFrame | None = None, key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """``(answer, store afterwards)``: what ``requested`` (key, lo, hi) asks for, with the days outside of ``known`` fetched from ``source``.
    Requests are cut to a key's ``inception`` (key, first) where it is known."""
    if inception is not None:
        requested = requested.join(inception.select(key, "first"), key, "left").select(key, F.greatest("lo", F.coalesce("first", "lo")).alias("lo"), "hi").where("lo <= hi")
    fetched = within(source, iv.missing(known, requested, key), key).select(*store.columns)
    after = iv.replace_days(store, fetched, key)
    return within(after, requested.select(key, F.col("lo").alias("start"), F.col("hi").alias("end")), key), after


def fetch_plan(known: DataFrame, requested: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, start, end, plan)``: what to fetch; "bulk" if every key lacks its whole range, which one request then covers, else "interval"."""
    need = iv.missing(known, requested, key)
    whole = need.join(requested.select(key, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), key, "left")
    bulk = whole.groupBy().agg(F.bool_and((F.col("start") == F.col("_lo")) & (F.col("end") == F.col("_hi"))).alias("all")).select(F.when(F.col("all"), "bulk").otherwise("interval").alias("plan"))
    return need.crossJoin(F.broadcast(bulk))


def split_known(requested: DataFrame, known: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, cached)``: whether the intervals cover the whole request."""
    return iv.coverage(known, requested, key).groupBy(key).agg(F.bool_and("whole").alias("cached"))


def not_cooling(spans: DataFrame, failures: DataFrame, now, seconds: int = COOLDOWN, key: str = "ticker") -> DataFrame:
    """``spans`` (key, start, end) but those that failed (key, start, end, failed_at) less than so long before ``now``."""
    recent = failures.where(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("failed_at") < seconds).select(key, "start", "end")
    return spans.join(recent, [key, "start", "end"], "left_anti")


def offline(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """All series up to the last day that all of them have reached."""
    common = prices.groupBy(key).agg(F.max("dt").alias("b")).agg(F.min("b").alias("_last"))
    return prices.join(F.broadcast(common), F.col("dt") <= F.col("_last")).drop("_last")


# -- the table of what the store holds: ticker, first, last, intervals, inception ------------------------------------------------


def described(known: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, first, last, intervals)`` from a key's intervals (key, start, end)."""
    bounds = known.groupBy(key).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    return bounds.join(iv.to_text(known.select(key, "start", "end"), key), key)


def upserted(old: DataFrame, new: DataFrame, key: str = "ticker") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of their keys; columns that only one has are null in the other."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def earlier_inception(old: DataFrame, seen: DataFrame, key: str = "ticker") -> DataFrame:
    """``old`` (key, inception, ...) with the earlier of its date and that of ``seen`` (key, found); only keys of ``old``."""
    return old.join(seen.groupBy(key).agg(F.min("found").alias("_found")), key, "left").withColumn("inception", F.least("inception", "_found")).drop("_found")


def without(table: DataFrame, keys: DataFrame, key: str = "ticker") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def migrated(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``table`` with those of ``columns`` (name: type) that it lacks, as nulls; a second time changes nothing."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def result_rows(results: DataFrame, weights: list[str], figures: list[str]) -> DataFrame:
    """``(label, allocations, stats)``: results as rows to append, their weights and figures as JSON."""
    return results.select("label", F.to_json(F.struct(*weights)).alias("allocations"), F.to_json(F.struct(*figures)).alias("stats"))


def gap_report(gaps: DataFrame, most: int = 5, key: str = "ticker") -> DataFrame:
    """``(key, report, more)``: the first gaps (start, end) of each key as text, and how many are left."""
    rows = gaps.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string")))).alias("all"))
    return rows.select(key, F.array_join(F.slice("all", 1, most), ", ").alias("report"), F.greatest(F.size("all") - most, F.lit(0)).cast("long").alias("more"))
