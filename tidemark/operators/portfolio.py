"""Aligned assets, weighted portfolios, backtests with and without contributions, timing studies, optimisation, simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import YEAR, by, full, last_rows, ratio, so_far, volatility
from tidemark.operators.strategies import strategy_log, strategy_values
from tidemark.session import staged


def aligned(prices: DataFrame, tickers: tuple[str, ...]) -> DataFrame:
    """``(dt, <ticker>...)``: prices on the days that all tickers have."""
    wide = prices.where(F.col("ticker").isin(*tickers)).groupBy("dt").agg(*(F.max(F.when(F.col("ticker") == t, F.col("price"))).alias(t) for t in tickers))
    return wide.na.drop()


def portfolio_returns(prices: DataFrame, weights: dict[str, float], first: bool = True) -> DataFrame:
    """``(portfolio, dt, ret)`` of a portfolio that is set back to its weights every day; ``first``: with a zero on the first day."""
    wide = aligned(prices, tuple(weights)).withColumn("portfolio", F.lit("p"))
    w = Window.partitionBy("portfolio").orderBy("dt")
    ret = sum((F.lit(v) * (F.col(t) / F.lag(t).over(w) - 1) for t, v in weights.items()), F.lit(0.0))
    out = wide.select("portfolio", "dt", ret.alias("ret"))
    return out.withColumn("ret", F.coalesce("ret", F.lit(0.0))) if first else out.where("ret is not null")


def backtest(prices: DataFrame, weights: dict[str, float], capital: float = 10_000.0) -> DataFrame:
    """``(portfolio, dt, ret, value, dd)`` of a lump sum."""
    r = portfolio_returns(prices, weights)
    w = so_far("portfolio")
    valued = r.withColumn("value", F.exp(F.sum(F.log1p("ret")).over(w)) * capital)
    return valued.withColumn("dd", F.col("value") / F.max("value").over(w) - 1)


def backtest_metrics(test: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """The figures of a backtest; the ratios take no risk-free rate."""
    sums = test.withColumn("s", full(F.sum("ret").over(last_rows(YEAR, "portfolio")), YEAR, "portfolio"))
    agg = sums.groupBy("portfolio").agg(
        F.max_by("value", "dt").alias("final"), F.count("*").alias("n"), volatility().alias("vol"), F.min("dd").alias("max_dd"), F.max("s").alias("best_year"), F.min("s").alias("worst_year"),
        (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(F.lit(float(YEAR)))).alias("down"),
    )
    agg = agg.withColumn("cagr", F.pow(F.col("final") / capital, YEAR / F.col("n")) - 1)
    return agg.withColumns({"sharpe": ratio(F.col("cagr"), F.col("vol")), "sortino": ratio(F.col("cagr"), F.col("down"))})


def contributions(prices: DataFrame, weights: dict[str, float], capital: float = 10_000.0, amount: float = 500.0, every: int = 21, shares: dict[str, Column] | None = None) -> DataFrame:
    """``(portfolio, dt, day, value, invested)`` of holdings that drift, with cash added every so many days at the weights, or at ``shares``
    (columns over the aligned prices and their returns, r_<ticker>). Units are bought at the day's price, so the value is a sum over a window."""
    wide = aligned(prices, tuple(weights)).withColumn("portfolio", F.lit("p"))
    w = Window.partitionBy("portfolio").orderBy("dt")
    wide = wide.withColumn("day", (F.row_number().over(w) - 1).cast("long"))
    pays = (F.col("day") > 0) & (F.col("day") % every == 0)
    if shares:
        wide = wide.withColumns({f"r_{t}": F.col(t) / F.lag(t).over(w) - 1 for t in weights})
        wide = wide.withColumns({f"share_{t}": c for t, c in shares.items()})
    value = F.lit(0.0)
    for t, v in weights.items():
        share = F.col(f"share_{t}") if shares else F.lit(v)
        units = F.when(F.col("day") == 0, F.lit(capital * v) / F.col(t)).when(pays, share * amount / F.col(t)).otherwise(0.0)
        value = value + F.col(t) * F.sum(units).over(w.rowsBetween(Window.unboundedPreceding, 0))
    invested = F.lit(capital) + F.floor(F.col("day") / every) * amount
    return wide.select("portfolio", "dt", "day", value.alias("value"), invested.cast("double").alias("invested"))


def momentum_shares(weights: dict[str, float], lookback: int = 63, tilt: float = 0.5, least: float = 0.05) -> dict[str, Column]:
    """Shares tilted to the assets whose last ``lookback`` returns sum to most; the weights until there are so many. The returns are in columns
    r_<ticker>, as ``contributions`` makes them."""
    last = Window.partitionBy("portfolio").orderBy("dt").rowsBetween(1 - lookback, 0)
    moved = {t: F.when(F.count(f"r_{t}").over(last) == lookback, F.sum(f"r_{t}").over(last)) for t in weights}
    low = F.least(*moved.values())
    up = {t: m - low + 1e-6 for t, m in moved.items()}
    total = sum(up.values(), F.lit(0.0))
    blend = {t: F.greatest(F.lit((1 - tilt) * v) + tilt * up[t] / total, F.lit(least)) for t, v in weights.items()}
    norm = sum(blend.values(), F.lit(0.0))
    return {t: F.when(low.isNotNull(), blend[t] / norm).otherwise(F.lit(v)) for t, v in weights.items()}


# -- dispatch --------------------------------------------------------------------------------------------------------------------


def run_backtest(prices: DataFrame, weights: dict[str, float], strategy: dict | None = None, capital: float = 10_000.0, amount: float = 0.0, every: int = 21) -> DataFrame:
    """``(dt, value)``: a lump sum set back to its weights daily where there is neither a strategy nor cash to add; else the fold of the strategy
    (a configuration, static by default), whose holdings drift."""
    if strategy is None and amount <= 0:
        return backtest(prices, weights, capital).select("dt", "value")
    book = prices.sparkSession.createDataFrame([("p", t, float(v), i) for i, (t, v) in enumerate(weights.items())], "portfolio string, ticker string, weight double, position long")
    log = strategy_log(prices, book, {"s": strategy or {}}, capital, amount, every)
    return strategy_values(prices, book, log, capital, amount, every).select("dt", "value")


# -- timing ------------------------------------------------------------------------------------------------------------------


def entry_points(prices: DataFrame, years: tuple[int, ...] = (1, 3, 5, 10), stride: int = 21) -> DataFrame:
    """``(ticker, years, dt, total_pct, cagr_pct)`` of holdings begun on every so manieth row; a holding ends within the series."""
    w = by()
    rows = prices.select("ticker", "dt", "price", (F.row_number().over(w) - 1).alias("i"), *(F.lead("price", YEAR * y).over(w).alias(f"p{y}") for y in years)).where(F.col("i") % stride == 0)
    held = rows.select("ticker", "dt", "price", F.explode(F.array(*(F.struct(F.lit(y).cast("long").alias("years"), F.col(f"p{y}").alias("later")) for y in years))).alias("h")).select("ticker", "dt", "price", "h.*")
    gain = F.col("later") / F.col("price")
    return held.where("later is not null").select("ticker", "years", "dt", ((gain - 1) * 100).alias("total_pct"), ((F.pow(gain, 1 / F.col("years")) - 1) * 100).alias("cagr_pct"))


def lump_sum_or_monthly(prices: DataFrame, amount: float = 12_000.0, months: int = 12, years: int = 5, every: int = 21) -> DataFrame:
    """``(ticker, dt, lump_sum, monthly, diff)``: final values of an investment at once, and in equal parts each month."""
    w = by()
    parts = sum((F.lit(amount / months) / F.lead("price", m * every).over(w) for m in range(months)), F.lit(0.0))
    later = F.lead("price", YEAR * years).over(w)
    rows = prices.select("ticker", "dt", (F.row_number().over(w) - 1).alias("i"), (later / F.col("price") * amount).alias("lump_sum"), (later * parts).alias("monthly"))
    return rows.where((F.col("i") % every == 0) & F.col("lump_sum").isNotNull() & F.col("monthly").isNotNull()).select("ticker", "dt", "lump_sum", "monthly", (F.col("lump_sum") - F.col("monthly")).alias("diff"))


# -- optimisation ----------------------------------------------------------------------------------------------------------------


def simplex(spark: SparkSession, n: int, steps: int) -> DataFrame:
    """``(w0, ..., wn-1)``: all weights in parts of 1 / steps."""
    grid = spark.range(1).select(F.lit(0).alias("used"))
    for k in range(n - 1):
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps) - F.col("used"))).alias(f"k{k}")).withColumn("used", F.col("used") + F.col(f"k{k}"))
    grid = grid.withColumn(f"k{n - 1}", F.lit(steps) - F.col("used"))
    return grid.select(*((F.col(f"k{k}") / steps).alias(f"w{k}") for k in range(n)))


def score_weights(prices: DataFrame, tickers: tuple[str, ...], steps: int = 10, risk_free: float = 0.04) -> DataFrame:
    """Every point of the simplex with its return, volatility, Sharpe ratio and spread of risk contributions; the moments are a few
    numbers, summed on Spark."""
    wide = aligned(prices, tickers).withColumn("portfolio", F.lit("p"))
    w = Window.partitionBy("portfolio").orderBy("dt")
    r = wide.select(*((F.col(t) / F.lag(t).over(w) - 1).alias(t) for t in tickers)).na.drop()
    n = len(tickers)
    row = r.agg(*(F.avg(t) for t in tickers), *(F.covar_samp(a, b) for a in tickers for b in tickers)).first()
    mean, cov = row[:n], np.array(row[n:], float).reshape(n, n)
    if None in mean:
        mean, cov = [0.0] * n, np.zeros((n, n))
    grid = simplex(prices.sparkSession, n, steps)
    ws = [F.col(f"w{k}") for k in range(n)]
    out = grid.withColumn("ret", sum((x * float(m) for x, m in zip(ws, mean, strict=True)), F.lit(0.0)) * YEAR)
    marginal = [sum((ws[j] * float(cov[i, j]) for j in range(n)), F.lit(0.0)) for i in range(n)]
    out = out.withColumn("vol", F.sqrt(sum((x * m for x, m in zip(ws, marginal, strict=True)), F.lit(0.0)) * YEAR))
    sd = F.col("vol") / F.sqrt(F.lit(float(YEAR)))
    spread = sum((F.pow(x * m / sd - sd / n, F.lit(2.0)) for x, m in zip(ws, marginal, strict=True)), F.lit(0.0))
    return out.withColumns({"sharpe": ratio(F.col("ret") - risk_free, F.col("vol")), "risk_spread": F.when(sd > 0, spread).otherwise(1e10)})


# -- simulation ------------------------------------------------------------------------------------------------------------------

#: The generator of the parity tests; fixed values.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


def drawn(seed: int, day: Column | None = None) -> Column:
    """A number from 0 up to 1 for each (sim, day)."""
    u = ((F.col("sim") * 7919 + (F.col("day") if day is None else day) * 104729 + seed) * MULTIPLIER + INCREMENT) % MODULUS
    return ((u * MULTIPLIER + INCREMENT) % MODULUS) / F.lit(float(MODULUS))


def simulated_returns(prices: DataFrame, weights: dict[str, float], sims: int, days: int, method: str = "bootstrap", seed: int = 42) -> DataFrame:
    """``(sim, day, ret)``: days drawn from the portfolio's history with replacement, or correlated normal draws
    of the assets ("gbm": compounded, "parametric": taken as they are)."""
    spark = prices.sparkSession
    hist = portfolio_returns(prices, weights, first=False)
    grid = spark.range(sims).select(F.col("id").alias("sim")).select("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(days).cast("long"))).alias("day"))
    if method == "bootstrap":
        return gathered(grid, hist, seed, least=LEAST_HISTORY)
    return _normal_returns(prices, weights, grid, method, seed)


#: A history of at most so many days goes into the plan as an array; a longer one is joined by its day, with both sides shuffled.
ARRAY_DAYS = 20_000
#: A shorter common history is not simulated.
LEAST_HISTORY = 20


def gathered(grid: DataFrame, history: DataFrame, seed: int, most: int = ARRAY_DAYS, least: int = 0) -> DataFrame:
    """``(sim, day, ret)``: for each row of ``grid`` (sim, day) the return of a day of ``history`` (dt, ret), drawn with replacement. The grid is
    never shipped: a history that fits is looked up by place within each row. One of fewer than ``least`` days is an error."""
    kept = history.orderBy("dt").limit(most + 1).collect()
    if len(kept) < least:
        raise ValueError(f"insufficient common history ({len(kept)} days)")
    if len(kept) <= most:
        rets = F.lit(np.array([r["ret"] for r in kept], float))
        return grid.select("sim", "day", F.get(rets, F.floor(drawn(seed) * len(kept)).cast("int")).alias("ret")).where("ret is not null")
    # numbered range by range, as one window over all days would be one task
    dealt = history.select("dt", "ret").repartitionByRange("dt").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "history")
    before, n = [], 0
    for part, size in dealt.groupBy("part").count().orderBy("part").collect():
        before.append((part, n))
        n += size
    starts = grid.sparkSession.createDataFrame(before, "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy("dt")) + F.col("before")
    rows = dealt.join(starts, "part").select(number.alias("k"), "ret")
    return grid.withColumn("k", F.floor(drawn(seed) * n) + 1).join(rows.hint("merge"), "k").select("sim", "day", "ret")


#: Histories of so many days together are broadcast; beyond it they are shuffled to the simulations.
BROADCAST_DAYS = 1_000_000


def history_sizes(returns: DataFrame, least: int = LEAST_HISTORY) -> DataFrame:
    """``(portfolio, days, enough)``: the days of each portfolio's common history, and whether they can be simulated."""
    return returns.groupBy("portfolio").agg(F.count("ret").alias("days")).withColumn("enough", F.col("days") >= least)


def simulated_books(returns: DataFrame, sims: int, days: int, seed: int = 42) -> DataFrame:
    """``(portfolio, sim, day, ret)``: days drawn with replacement from the history of each portfolio in ``returns`` (portfolio, dt, ret).

    A simulation is one row until its days are drawn, and all of them stay where it is, so paths over (portfolio, sim) shuffle nothing more.
    Portfolios whose history is too short have none; ``history_sizes`` tells them.
    """
    history = returns.groupBy("portfolio").agg(F.transform(F.array_sort(F.collect_list(F.struct("dt", "ret"))), lambda x: x["ret"]).alias("rets")).where(F.size("rets") >= LEAST_HISTORY)
    history = staged(history, "histories")
    total = history.agg(F.coalesce(F.sum(F.size("rets")), F.lit(0))).first()[0]
    begun = history.select("portfolio", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))).alias("sim"))
    rows = begun.repartition("portfolio", "sim").join(F.broadcast(history) if total <= BROADCAST_DAYS else history, "portfolio")
    picks = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(days).cast("long")), lambda d: F.get("rets", F.floor(drawn(seed, d) * F.size("rets")).cast("int")))
    return rows.select("portfolio", "sim", F.posexplode(picks).alias("day", "ret")).withColumn("day", (F.col("day") + 1).cast("long"))


def lower_root(cov: np.ndarray) -> np.ndarray:
    """The lower triangle whose square is the matrix; where it is not positive definite, a root by singular values."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        u, s, _ = np.linalg.svd(cov)
        return u * np.sqrt(s)


def _normal_returns(prices: DataFrame, weights: dict[str, float], grid: DataFrame, method: str, seed: int) -> DataFrame:
    """Correlated normal draws of each asset, with its mean less half its variance as drift, weighted; the moments are a few numbers."""
    tickers, n = tuple(weights), len(weights)
    wide = aligned(prices, tickers).withColumn("portfolio", F.lit("p"))
    w = Window.partitionBy("portfolio").orderBy("dt")
    r = wide.select(*((F.col(t) / F.lag(t).over(w) - 1).alias(t) for t in tickers)).na.drop()
    row = r.agg(*(F.avg(t) for t in tickers), *(F.covar_samp(a, b) for a in tickers for b in tickers)).first()
    mean, cov = (np.zeros(n), np.zeros((n, n))) if None in row else (np.array(row[:n], float), np.array(row[n:], float).reshape(n, n))
    root = lower_root(cov)
    # two numbers a draw, so each asset has a pair of seeds of its own
    grid = grid.withColumns({f"z{k}": F.sqrt(-2 * F.log(F.greatest(drawn(seed + 2 * k), F.lit(1e-9)))) * F.cos(drawn(seed + 2 * k + 1) * 2 * np.pi) for k in range(n)})
    ret = F.lit(0.0)
    for i, v in enumerate(weights.values()):
        step = F.lit(float(mean[i] - 0.5 * cov[i, i])) + sum((float(root[i, k]) * F.col(f"z{k}") for k in range(n)), F.lit(0.0))
        ret = ret + v * (F.exp(step) - 1 if method == "gbm" else step)
    return grid.select("sim", "day", ret.alias("ret"))


def simulated_paths(rets: DataFrame, capital: float = 10_000.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(sim, day, value, dd)``, after the columns ``keys`` that tell sets of simulations apart."""
    w = Window.partitionBy(*keys, "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    valued = rets.select(*keys, "sim", "day", (F.exp(F.sum(F.log1p("ret")).over(w)) * capital).alias("value"))
    return valued.withColumn("dd", F.col("value") / F.greatest(F.max("value").over(w), F.lit(capital)) - 1)


def simulated_ends(paths: DataFrame, years: float, capital: float = 10_000.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(sim, final, mdd, cagr)`` of each path, after ``keys``."""
    return paths.groupBy(*keys, "sim").agg(F.max_by("value", "day").alias("final"), F.min("dd").alias("mdd")).withColumn("cagr", F.pow(F.col("final") / capital, F.lit(1 / years)) - 1)


def simulation_statistics(paths: DataFrame, years: float, capital: float = 10_000.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Figures over all paths, or over those of each of ``keys``."""
    final = simulated_ends(paths, years, capital, keys)
    return final.groupBy(*keys).agg(
        F.avg("final").alias("mean_final"), F.percentile("final", 0.5).alias("median_final"), F.avg("cagr").alias("mean_cagr"), F.percentile("cagr", 0.5).alias("median_cagr"), F.stddev_pop("cagr").alias("std_cagr"),
        F.percentile("mdd", 0.5).alias("median_mdd"), F.min("mdd").alias("worst_mdd"), F.percentile("mdd", 0.05).alias("p5_mdd"), F.avg((F.col("final") < capital).cast("double")).alias("p_loss"), F.avg((F.col("final") >= 2 * capital).cast("double")).alias("p_double"),
    )


def bands(paths: DataFrame, every: int = 21, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(day, p5, p50, p95)``, after ``keys``, of the values on every so manieth day."""
    p = lambda q: F.percentile("value", q)
    return paths.where(F.col("day") % every == 0).groupBy(*keys, "day").agg(p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"))

