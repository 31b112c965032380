"""Columns over ordered series. Every window is partitioned by the series, so no series waits for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Trading days of a year.
YEAR = 252
RISK_FREE = 0.045


def by(key: str = "ticker") -> WindowSpec:
    return Window.partitionBy(key).orderBy("dt")


def last_rows(n: int, key: str = "ticker") -> WindowSpec:
    return by(key).rowsBetween(1 - n, 0)


def so_far(key: str = "ticker") -> WindowSpec:
    return by(key).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, n: int, key: str = "ticker") -> Column:
    """``value`` once a frame of ``n`` rows is full, else null."""
    return F.when(F.count(F.lit(1)).over(last_rows(n, key)) == n, value)


def simple_return(price: str = "price", key: str = "ticker") -> Column:
    return F.col(price) / F.lag(price).over(by(key)) - 1


def returns(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, dt, ret)`` without each series' first row."""
    return prices.select(key, "dt", simple_return(key=key).alias("ret")).where("ret is not null")


def growth(ret: str = "ret", key: str = "ticker") -> Column:
    """Growth of 1 since before the first row; returns are above -1."""
    return F.exp(F.sum(F.log1p(ret)).over(so_far(key)))


def compound(ret: Column | str) -> Column:
    """Aggregate: the growth over all rows."""
    return F.exp(F.sum(F.log1p(ret)))


def cagr(ret: Column | str = "ret", n: Column | None = None) -> Column:
    """Aggregate: yearly growth rate."""
    rows = F.count(F.lit(1)) if n is None else n
    return F.exp(F.sum(F.log1p(ret)) * YEAR / rows) - 1


def volatility(ret: Column | str = "ret") -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(YEAR)))


def downside(ret: str = "ret", threshold: float = 0.0) -> Column:
    r = F.col(ret)
    return F.coalesce(F.sqrt(F.avg(F.when(r < threshold, r * r))) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def drawdowns(series: DataFrame, key: str = "ticker", start: float | None = None) -> DataFrame:
    """``series`` with value, peak and dd; ``start``: a value before the first row that the peak knows of."""
    valued = series.withColumn("value", growth(key=key))
    peak = F.max("value").over(so_far(key))
    valued = valued.withColumn("peak", peak if start is None else F.greatest(peak, F.lit(start)))
    return valued.withColumn("dd", F.col("value") / F.col("peak") - 1)



def sliding_fall(rows: DataFrame, n: int, key: str = "ticker", at: str = "i", high: str = "high", low: str = "low", fall: str = "fall") -> DataFrame:
    """``rows`` with win_high and win_fall over the last ``n`` rows of a series: the highest value, and the deepest fall from an earlier value to a
    later one; null until there are so many rows. ``at`` numbers the rows of a series from 0; a row has the highest and the lowest of
    the values it stands for, and the deepest fall within them.

    Such summaries can be merged. A series is cut into blocks of ``n`` rows, so that any ``n`` rows are the end of one block and the start of the
    next, whose summaries are running ones: no frame is held as a list, and a row costs the same whatever ``n``.
    """
    block = F.floor(F.col(at) / n)
    up, down = (Window.partitionBy(key, block).orderBy(F.col(at) if ascending else F.col(at).desc()) for ascending in (True, False))
    through, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    into = F.least(F.col(fall), F.coalesce(F.col(low) / F.max(high).over(up.rowsBetween(*before)) - 1, F.col(fall)))
    out_of = F.least(F.col(fall), F.coalesce(F.min(low).over(down.rowsBetween(*before)) / F.col(high) - 1, F.col(fall)))
    run = rows.withColumns({"_into": into, "_out": out_of})
    run = run.withColumns({"_ph": F.max(high).over(up.rowsBetween(*through)), "_pl": F.min(low).over(up.rowsBetween(*through)), "_pf": F.min("_into").over(up.rowsBetween(*through))})
    run = run.withColumns({"_sh": F.max(high).over(down.rowsBetween(*through)), "_sf": F.min("_out").over(down.rowsBetween(*through))})
    back = Window.partitionBy(key).orderBy(at)
    run = run.withColumns({c: F.lag(c, n - 1).over(back) for c in ("_sh", "_sf")})
    whole = F.col(at) % n == n - 1
    merged = F.least("_sf", "_pf", F.col("_pl") / F.col("_sh") - 1)
    known = F.col(at) >= n - 1
    run = run.withColumns({"win_high": F.when(known, F.greatest("_sh", "_ph")), "win_fall": F.when(known, F.when(whole, F.col("_pf")).otherwise(merged))})
    return run.drop("_into", "_out", "_ph", "_pl", "_pf", "_sh", "_sf")
