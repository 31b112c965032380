"""Aggregates and rolling statistics of return series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import RISK_FREE, YEAR, by, cagr, compound, downside, drawdowns, full, growth, last_rows, ratio, sliding_fall, so_far, volatility

#: Rows that two series must share for a comparison.
LEAST_COMMON = 30


def max_drawdown(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, max_dd, avg_dd)``; the peak starts at the first return."""
    dd = drawdowns(rets, key)
    return dd.groupBy(key).agg(F.min("dd").alias("max_dd"), F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0)).alias("avg_dd"))


def summary(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """Return, risk and their ratios of each series."""
    dd = drawdowns(rets, key)
    agg = dd.groupBy(key).agg(cagr().alias("cagr"), volatility().alias("vol"), downside().alias("down"), F.min("dd").alias("max_dd"), F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0)).alias("avg_dd"), F.count("*").alias("n"))
    excess = F.col("cagr") - RISK_FREE
    return agg.withColumns({"sharpe": ratio(excess, F.col("vol")), "sortino": ratio(excess, F.col("down")), "calmar": ratio(F.col("cagr"), F.abs("max_dd"))})


def value_at_risk(rets: DataFrame, confidence: float = 0.95, key: str = "ticker") -> DataFrame:
    """``(key, var, cvar)``: the percentile, and the mean of what is at or below it."""
    var = rets.groupBy(key).agg(F.percentile("ret", 1 - confidence).alias("var"))
    return rets.join(var, key).groupBy(key).agg(F.first("var").alias("var"), F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"))


def shape(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, and the share of gains in percent."""
    agg = rets.groupBy(key).agg(F.count("*").cast("double").alias("n"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("positive_pct"))
    n = F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return agg.select(key, skew.alias("skew"), kurt.alias("kurt"), "positive_pct")


def against_benchmark(rets: DataFrame, benchmark: str, key: str = "ticker") -> DataFrame:
    """Of each other series on the days it shares with the benchmark: beta, alpha, r2, correlation, tracking error, information ratio, Treynor
    ratio, upside and downside capture. Fewer than 30 such days: no row."""
    bench = rets.where(F.col(key) == benchmark).select("dt", F.col("ret").alias("b"))
    both = rets.where(F.col(key) != benchmark).join(bench, "dt").withColumn("active", F.col("ret") - F.col("b"))
    year = float(YEAR)

    def capture(side):
        k = F.count_if(side)
        grow = lambda c: F.exp(F.sum(F.when(side, F.log1p(c))) * year / k) - 1
        return F.when(k > 0, ratio(grow("ret"), grow("b")) * 100).otherwise(0.0)

    agg = both.groupBy(key).agg(
        F.count("*").alias("n"), F.regr_slope("ret", "b").alias("beta"), (F.regr_intercept("ret", "b") * year).alias("alpha"), F.regr_r2("ret", "b").alias("r2"), F.corr("ret", "b").alias("corr"),
        (F.stddev_samp("active") * F.sqrt(F.lit(year))).alias("te"), (F.avg("active") * year).alias("active"), cagr().alias("cagr"), capture(F.col("b") > 0).alias("up_capture"), capture(F.col("b") < 0).alias("down_capture"),
    )
    out = agg.where(F.col("n") >= LEAST_COMMON)
    return out.withColumns({"info_ratio": ratio(F.col("active"), F.col("te")), "treynor": ratio(F.col("cagr") - RISK_FREE, F.col("beta"))})


def rolling(rets: DataFrame, n: int = YEAR, key: str = "ticker") -> DataFrame:
    """Return, volatility, Sharpe and Sortino ratio of the last ``n`` rows; null until there are so many."""
    w = last_rows(n, key)
    year = F.sqrt(F.lit(float(YEAR)))
    r = F.col("ret")
    down = F.coalesce(F.sqrt(F.avg(F.when(r < 0, r * r)).over(w)) * year, F.lit(0.01))
    out = rets.select(key, "dt", full(F.exp(F.sum(F.log1p("ret")).over(w) * YEAR / n) - 1, n, key).alias("roll_ret"), full(F.stddev_samp("ret").over(w) * year, n, key).alias("roll_vol"), full(down, n, key).alias("down"))
    return out.select(key, "dt", "roll_ret", "roll_vol", F.try_divide(F.col("roll_ret") - RISK_FREE, "roll_vol").alias("roll_sharpe"), F.try_divide(F.col("roll_ret") - RISK_FREE, "down").alias("roll_sortino"))


def rolling_max_drawdown(rets: DataFrame, n: int = YEAR, key: str = "ticker") -> DataFrame:
    """The deepest drawdown within the last ``n`` rows, growth starting afresh in each frame; null until there are so many."""
    rows = rets.select(key, "dt", growth(key=key).alias("high"), (F.row_number().over(by(key)) - 1).alias("i")).withColumns({"low": F.col("high"), "fall": F.lit(0.0)})
    return sliding_fall(rows, n, key).select(key, "dt", F.col("win_fall").alias("roll_mdd"))


def multi_year(values: DataFrame, key: str = "ticker") -> DataFrame:
    """Annualised 3 and 5 year returns of a value series, from its values 755 and 1259 rows ago."""
    def over(rows: int, years: float):
        base = F.lag("value", rows).over(by(key))
        return F.when(base > 0, F.pow(F.col("value") / base, F.lit(1 / years)) - 1).when(base.isNotNull(), 0.0)

    return values.select(key, "dt", over(755, 3.0).alias("roll_3y"), over(1259, 5.0).alias("roll_5y"))


def best_worst_year(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """Largest and least sum of 252 daily returns."""
    sums = rets.select(key, full(F.sum("ret").over(last_rows(YEAR, key)), YEAR, key).alias("s"))
    return sums.groupBy(key).agg(F.max("s").alias("best_year"), F.min("s").alias("worst_year"))


def indicators(rets: DataFrame, n: int = 63, key: str = "ticker") -> DataFrame:
    """What strategies look at: mean return, volatility (population), momentum and their ratio over ``n`` rows."""
    w = last_rows(n, key)
    out = rets.select(key, "dt", full(F.avg("ret").over(w) * YEAR, n, key).alias("ret_y"), full(F.stddev_pop("ret").over(w) * F.sqrt(F.lit(float(YEAR))), n, key).alias("vol_y"), full(F.sum("ret").over(w), n, key).alias("momentum"))
    return out.withColumn("sharpe", F.col("ret_y") / (F.col("vol_y") + 1e-6))


def episodes(rets: DataFrame, least: float = 0.05, key: str = "ticker") -> DataFrame:
    """Drawdowns of at least ``least``: from the row at the peak to the trough, and to the row back at it (null: still open)."""
    dd = drawdowns(rets, key).withColumn("at_peak", F.col("value") == F.col("peak")).withColumn("i", F.row_number().over(by(key)))
    isle = dd.withColumn("island", F.sum(F.col("at_peak").cast("int")).over(so_far(key)))
    low = F.struct("dd", "i")
    agg = isle.groupBy(key, "island").agg(F.min("dt").alias("start"), F.min("i").alias("start_i"), F.min_by("dt", low).alias("trough"), F.min_by("i", low).alias("trough_i"), F.min("dd").alias("drawdown"))
    w = Window.partitionBy(key).orderBy("island")
    agg = agg.withColumns({"recovery": F.lead("start").over(w), "recovery_i": F.lead("start_i").over(w)})
    return agg.where(F.col("drawdown") <= -least).select(key, "start", "trough", "recovery", "drawdown", (F.col("trough_i") - F.col("start_i")).cast("long").alias("length"), (F.col("recovery_i") - F.col("trough_i")).cast("long").alias("recovery_days"))


def monthly(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """Compounded returns by year and month, a column for each month, and the year's; a month without rows inside a series' span is 0."""
    m = rets.groupBy(key, F.trunc("dt", "month").alias("month")).agg((compound("ret") - 1).alias("r"))
    span = m.groupBy(key).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    every = span.join(m, [key, "month"], "left").select(key, F.year("month").cast("long").alias("year"), F.month("month").alias("m"), F.coalesce("r", F.lit(0.0)).alias("r"))
    wide = every.groupBy(key, "year").agg(*(F.max(F.when(F.col("m") == k, F.col("r"))).alias(f"m{k:02d}") for k in range(1, 13)), (compound("r") - 1).alias("total"))
    return wide


def annual(rets: DataFrame, key: str = "ticker") -> DataFrame:
    return rets.groupBy(key, F.year("dt").cast("long").alias("year")).agg((compound("ret") - 1).alias("total"))


def covariances(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """``(a, b, cov, corr)`` of every two series on the days that they share."""
    a, b = (rets.select("dt", F.col(key).alias(x), F.col("ret").alias("r" + x)) for x in ("a", "b"))
    return a.join(b, "dt").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.corr("ra", "rb").alias("corr"))


