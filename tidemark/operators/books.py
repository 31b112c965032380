"""Many portfolios at once: weights as a table ``(portfolio, ticker, weight, position)``, their backtests, texts and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import YEAR, ratio, volatility
from tidemark.session import small_enough

#: Broadcast weights of at most so many rows; beyond it the joins shuffle.
BROADCAST_WEIGHTS = 100_000
#: Weights below this count as none.
LEAST_WEIGHT = 0.001


def _small(weights: DataFrame) -> DataFrame:
    return F.broadcast(weights) if small_enough(weights, BROADCAST_WEIGHTS) else weights


def tidy_weights(weights: DataFrame) -> DataFrame:
    """Tickers trimmed and in upper case; rows without a ticker or weight go."""
    return weights.withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker <> '' and weight is not null")


def checked(weights: DataFrame, known: DataFrame, tolerance: float = 0.01, least_assets: int = 1) -> DataFrame:
    """``(portfolio, assets, total, missing, valid)``: weights must sum to 1 and every ticker be among ``known`` (ticker)."""
    tickers = known.select(F.col("ticker").alias("_known")).distinct()
    rows = tidy_weights(weights).join(_small(tickers), F.col("ticker") == F.col("_known"), "left")
    missing = F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("_known").isNull(), F.col("ticker")))))
    agg = rows.groupBy("portfolio").agg(F.count("*").alias("assets"), F.sum("weight").alias("total"), missing.alias("missing"))
    return agg.withColumn("valid", (F.abs(F.col("total") - 1) <= tolerance) & (F.col("assets") >= least_assets) & (F.col("missing") == ""))


def tickers_of(*tables: DataFrame) -> DataFrame:
    """The union of the tickers of several tables, in upper case."""
    out = tables[0].select(F.upper(F.trim("ticker")).alias("ticker"))
    for t in tables[1:]:
        out = out.unionByName(t.select(F.upper(F.trim("ticker")).alias("ticker")))
    return out.distinct()


def held_days(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """``(portfolio, ticker, weight, benchmark, dt, price, day)`` on the days that all assets of a portfolio have; the benchmark is its
    first asset; day from 0."""
    w = tidy_weights(weights)
    size = w.groupBy("portfolio").agg(F.count("*").alias("assets"), F.min_by("ticker", "position").alias("benchmark"))
    rows = prices.select("ticker", "dt", "price").join(_small(w.join(size, "portfolio")), "ticker")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("portfolio", "dt"))).where("n = assets")
    return rows.withColumn("day", (F.dense_rank().over(Window.partitionBy("portfolio").orderBy("dt")) - 1).cast("long")).drop("n", "assets", "position")


def book_returns(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """``(portfolio, benchmark, dt, day, ret, bench)``: returns of portfolios that are set back to their weights daily, 0 on the first day."""
    w = Window.partitionBy("portfolio", "ticker").orderBy("dt")
    rows = held_days(prices, weights).withColumn("r", F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0)))
    return rows.groupBy("portfolio", "benchmark", "dt", "day").agg(F.sum(F.col("weight") * F.col("r")).alias("ret"), F.max(F.when(F.col("ticker") == F.col("benchmark"), F.col("r"))).alias("bench"))


def lump_sums(returns: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """``returns`` with value and invested."""
    w = Window.partitionBy("portfolio").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("value", F.exp(F.sum(F.log1p("ret")).over(w)) * capital).withColumn("invested", F.lit(capital))


def monthly_sums(prices: DataFrame, weights: DataFrame, capital: float = 10_000.0, amount: float = 500.0, every: int = 21) -> DataFrame:
    """``(portfolio, benchmark, dt, day, value, invested, ret, bench)`` of holdings that drift, with cash added at the weights; ret is the change
    of the value, cash included."""
    w = Window.partitionBy("portfolio", "ticker").orderBy("dt")
    rows = held_days(prices, weights)
    units = F.when(F.col("day") == 0, F.col("weight") * capital / F.col("price")).when(F.col("day") % every == 0, F.col("weight") * amount / F.col("price")).otherwise(0.0)
    rows = rows.withColumn("units", F.sum(units).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0)))
    day = rows.groupBy("portfolio", "benchmark", "dt", "day").agg(F.sum(F.col("price") * F.col("units")).alias("value"), F.max(F.when(F.col("ticker") == F.col("benchmark"), F.col("r"))).alias("bench"))
    before = F.lag("value").over(Window.partitionBy("portfolio").orderBy("dt"))
    return day.withColumns({"ret": F.coalesce(F.col("value") / before - 1, F.lit(0.0)), "invested": F.lit(capital) + F.floor(F.col("day") / every) * amount})


def book_metrics(series: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """The figures of each portfolio's backtest (portfolio, benchmark, dt, value, invested, ret, bench). Where cash was added, growth is over what
    was invested on average. The ratios take no risk-free rate."""
    w = Window.partitionBy("portfolio").orderBy("dt")
    year = w.rowsBetween(1 - YEAR, 0)
    rows = series.withColumns({
        "dd": F.col("value") / F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1,
        "s": F.when(F.count("*").over(year) == YEAR, F.sum("ret").over(year)), "active": F.col("ret") - F.col("bench"),
    })
    root = F.sqrt(F.lit(float(YEAR)))
    agg = rows.groupBy("portfolio", "benchmark").agg(
        F.count("*").alias("n"), F.max_by("value", "dt").alias("final"), F.max("invested").alias("invested"), volatility().alias("vol"), F.max("s").alias("best_year"), F.min("s").alias("worst_year"),
        F.min("dd").alias("max_dd"), (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * root).alias("down"), (F.avg("active") * YEAR).alias("active"), (F.stddev_samp("active") * root).alias("te"), F.corr("ret", "bench").alias("corr"),
    )
    mean = (F.lit(capital) + F.col("invested")) / 2
    grown = F.when(F.col("invested") > capital, 1 + (F.col("final") - F.col("invested")) / mean).otherwise(F.col("final") / capital)
    agg = agg.withColumn("cagr", F.pow(grown, YEAR / F.col("n")) - 1).withColumn("start", F.lit(capital))
    agg = agg.withColumns({"sharpe": ratio(F.col("cagr"), F.col("vol")), "sortino": F.coalesce(ratio(F.col("cagr"), F.col("down")), F.lit(0.0)), "info_ratio": F.when(F.col("te") > 0, F.col("active") / F.col("te")).otherwise(0.0)})
    return agg.select("portfolio", "benchmark", "start", "invested", "final", "cagr", "vol", "best_year", "worst_year", "max_dd", "sharpe", "sortino", "active", "te", "info_ratio", "corr")


def type_label(metrics: DataFrame) -> Column:
    """"DCA: $x" where more was invested than the start and a hundredth, else "Lump Sum"."""
    more = F.col("invested") > F.col("start") * 1.01
    return F.when(more, F.concat(F.lit("DCA: $"), F.format_number(F.col("invested") - F.col("start"), 0))).otherwise(F.lit("Lump Sum"))


def summary_rows(metrics: DataFrame, simulated: DataFrame) -> DataFrame:
    """Backtests beside simulated growth rates (portfolio, median_cagr): label, difference, and its class (warn beyond 5 points, pos above 0)."""
    rows = metrics.join(simulated, "portfolio", "left").withColumn("delta", F.coalesce("median_cagr", F.lit(0.0)) - F.col("cagr"))
    kind = F.when(F.abs("delta") > 0.05, "warn").when(F.col("delta") > 0, "pos").otherwise("")
    return rows.select("portfolio", type_label(metrics).alias("type"), "median_cagr", "cagr", "delta", kind.alias("class"), "vol", "max_dd")


def allocation_matrix(weights: DataFrame, tickers: list[str]) -> DataFrame:
    """``(portfolio, <ticker>...)``: weights above a thousandth, a column for each ticker."""
    rows = tidy_weights(weights).where(F.col("weight") > LEAST_WEIGHT)
    return rows.groupBy("portfolio").agg(*(F.max(F.when(F.col("ticker") == t, F.col("weight"))).alias(t) for t in tickers))


def _percent(weight: Column) -> Column:
    return F.rint(weight * 100).cast("long").cast("string")


def allocation_text(weights: DataFrame) -> DataFrame:
    """``(portfolio, file_name, text)``: a name, an empty line, a heading, and a line with a percentage for each ticker in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ticker", "weight"))), lambda x: F.concat(x["ticker"], F.lit(","), _percent(x["weight"]), F.lit("%")))
    rows = tidy_weights(weights).groupBy("portfolio").agg(F.concat_ws("\n", F.concat(F.array(F.col("portfolio"), F.lit(""), F.lit("Symbol,Weight")), lines, F.array(F.lit("")))).alias("text"))
    safe = F.concat(F.regexp_replace("portfolio", "[^A-Za-z0-9_-]+", "_"), F.lit(".csv"))
    return rows.select("portfolio", safe.alias("file_name"), "text")


def parse_allocations(texts: DataFrame) -> DataFrame:
    """``(portfolio, ticker, weight, position)`` of texts (text): the first line names the portfolio, rows follow a heading that begins with
    "symbol". Rows without a comma, and those whose weight is no number, go; a text without a heading has none."""
    lines = F.transform(F.split(F.trim(F.regexp_replace("text", "^\\s+|\\s+$", "")), "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    rows = texts.select(lines.alias("lines")).select(F.element_at("lines", 1).alias("portfolio"), F.posexplode("lines").alias("position", "line"), "lines")
    heading = F.array_position(F.transform("lines", lambda x: F.lower(x).startswith("symbol")), True)
    rows = rows.where((heading > 0) & (F.col("position") + 1 > heading) & F.col("line").contains(","))
    parts = F.split("line", ",")
    weight = F.expr("try_cast(regexp_replace(trim(element_at(split(line, ','), 2)), '%+$', '') as double)") / 100
    out = rows.select("portfolio", F.upper(F.trim(F.element_at(parts, 1))).alias("ticker"), weight.alias("weight"), F.col("position").cast("long").alias("position"))
    return out.where("weight is not null and ticker <> ''")


def links(weights: DataFrame, base: str, fixed: dict[str, str], suffix: str = "_1") -> DataFrame:
    """``(portfolio, url)``: an address whose parameters are fixed ones, then symbolN and allocationN of the tickers in order."""
    order = F.row_number().over(Window.partitionBy("portfolio").orderBy("ticker"))
    rows = tidy_weights(weights).withColumn("i", order)
    part = F.concat(F.lit("symbol"), F.col("i"), F.lit("="), F.col("ticker"), F.lit("&allocation"), F.col("i"), F.lit(f"{suffix}="), _percent(F.col("weight")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), "&")
    head = base + "?" + "&".join(f"{k}={v}" for k, v in fixed.items()) + "&"
    return rows.groupBy("portfolio").agg(F.concat(F.lit(head), joined).alias("url"))
