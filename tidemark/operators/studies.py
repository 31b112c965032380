"""Studies over series, grids and simulations: holdings and their drawdowns, objectives, densities, yearly chances, cleaning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import YEAR, by, sliding_fall
from tidemark.operators.portfolio import aligned, simplex
from tidemark.operators.ranks import exact_percentiles
from tidemark.session import staged

#: Rows between two entries; a holding is a whole number of such blocks.
STRIDE = 21
#: Fewer common rows than this say nothing about a mix of assets.
LEAST_ROWS = 50
#: Broadcast a grid of at most so many points.
BROADCAST_POINTS = 100_000
#: What an objective costs where it cannot be told; fewer falls than this, or less spread, tell nothing.
UNKNOWN, LEAST_FALLS, LEAST_SPREAD = 100.0, 20, 0.001


# -- cleaning --------------------------------------------------------------------------------------------------------------------


def price_column(columns: list[str]) -> str:
    """The first of the usual names; without one an error."""
    for name in ("Adj Close", "Close", "price"):
        if name in columns:
            return name
    raise ValueError("no price column")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """The rows whose values are all numbers, neither NaN nor infinite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def clipped_log_return(ret: Column | str) -> Column:
    return F.log1p(F.greatest(F.col(ret) if isinstance(ret, str) else ret, F.lit(-0.99)))


def thinned(series: DataFrame, most: int = 500, key: str = "ticker") -> DataFrame:
    """Every so manieth row of a series so that about ``most`` stay, and its last."""
    rows = series.withColumns({"i": F.row_number().over(by(key)) - 1, "n": F.count("*").over(Window.partitionBy(key))})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return rows.where((F.col("i") % step == 0) | (F.col("i") == F.col("n") - 1)).drop("i", "n")


# -- holdings --------------------------------------------------------------------------------------------------------------------


def holdings(prices: DataFrame, years: tuple[int, ...] = (1, 3, 5, 10), key: str = "ticker") -> DataFrame:
    """``(key, years, dt, total_pct, cagr_pct, max_dd_pct)`` of holdings begun on every 21st row, with the deepest drawdown in each.

    A series is cut into blocks of 21 rows, each with its highest and lowest price and the deepest fall within; the blocks of a holding are merged
    by ``sliding_fall``.
    """
    rows = prices.select(key, "dt", "price", (F.row_number().over(by(key)) - 1).alias("i")).withColumn("b", F.floor(F.col("i") / STRIDE))
    peak = F.max("price").over(Window.partitionBy(key, "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("fall", F.col("price") / peak - 1)
    blocks = rows.groupBy(key, "b").agg(F.min_by("dt", "i").alias("dt"), F.min_by("price", "i").alias("price"), F.max("price").alias("high"), F.min("price").alias("low"), F.min("fall").alias("fall"))
    w = Window.partitionBy(key).orderBy("b")
    out = None
    for y in years:
        n = YEAR * y // STRIDE
        held = sliding_fall(blocks, n, key, "b").withColumns({"later": F.lead("price", n).over(w), "top": F.lead("win_high", n - 1).over(w), "deepest": F.lead("win_fall", n - 1).over(w)}).where("later is not null")
        gain = F.col("later") / F.col("price")
        deepest = F.least(F.col("deepest"), F.col("later") / F.greatest("top", "later") - 1)
        part = held.select(key, F.lit(y).cast("long").alias("years"), "dt", ((gain - 1) * 100).alias("total_pct"), ((F.pow(gain, F.lit(1 / y)) - 1) * 100).alias("cagr_pct"), (deepest * 100).alias("max_dd_pct"))
        out = part if out is None else out.unionByName(part)
    return out


# -- objectives over the simplex -------------------------------------------------------------------------------------------------


def mixes(prices: DataFrame, tickers: tuple[str, ...], steps: int = 10) -> tuple[DataFrame, list[str]]:
    """``(w0, ..., dt, ret)``: the daily returns of every point of the simplex; and the names of the weights."""
    wide = aligned(prices, tickers).withColumn("portfolio", F.lit("p"))
    w = Window.partitionBy("portfolio").orderBy("dt")
    r = wide.select("dt", *((F.col(t) / F.lag(t).over(w) - 1).alias(f"r{k}") for k, t in enumerate(tickers))).na.drop()
    names = [f"w{k}" for k in range(len(tickers))]
    grid = simplex(prices.sparkSession, len(tickers), steps)
    # the grid has so many points, whatever the data
    small = math.comb(steps + len(tickers) - 1, len(tickers) - 1) <= BROADCAST_POINTS
    return r.crossJoin(F.broadcast(grid) if small else grid).select(*names, "dt", sum((F.col(f"w{k}") * F.col(f"r{k}") for k in range(len(tickers))), F.lit(0.0)).alias("ret")), names


def sortino_losses(prices: DataFrame, tickers: tuple[str, ...], steps: int = 10, risk_free: float = 0.04) -> DataFrame:
    """``(w0, ..., loss)``: the negative Sortino ratio of each mix, or 100 where falls are too few or too alike."""
    rows, names = mixes(prices, tickers, steps)
    falls = F.when(F.col("ret") < 0, F.col("ret"))
    agg = rows.groupBy(*names).agg(F.avg("ret").alias("mean"), F.count(falls).alias("n"), (F.stddev_pop(falls) * F.sqrt(F.lit(float(YEAR)))).alias("down"))
    unknown = (F.col("n") < LEAST_FALLS) | (F.col("down") < LEAST_SPREAD)
    return agg.select(*names, F.when(unknown, UNKNOWN).otherwise(-(F.col("mean") * YEAR - risk_free) / F.col("down")).alias("loss"))


def weighted_losses(prices: DataFrame, tickers: tuple[str, ...], wanted: dict[str, float], steps: int = 10, risk_free: float = 0.04) -> DataFrame:
    """``(w0, ..., loss)``: a sum of return and volatility (over those of equal weights), Sharpe ratio, drawdown and Sortino ratio,
    weighted as ``wanted`` has them of their sum."""
    rows, names = mixes(prices, tickers, steps)
    w = Window.partitionBy(*names).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum(clipped_log_return("ret")).over(w))
    rows = rows.withColumn("fall", F.col("level") - F.max("level").over(w))
    falls, root = F.when(F.col("ret") < 0, F.col("ret")), F.sqrt(F.lit(float(YEAR)))
    agg = rows.groupBy(*names).agg((F.avg("ret") * YEAR).alias("ret"), F.greatest(F.stddev_samp("ret") * root, F.lit(1e-6)).alias("vol"), (1 - F.exp(F.min("fall"))).alias("max_dd"), F.count(falls).alias("n"), (F.stddev_pop(falls) * root).alias("down"))
    wide = aligned(prices, tickers).withColumn("portfolio", F.lit("p"))
    by_day = Window.partitionBy("portfolio").orderBy("dt")
    even = wide.select((sum((F.col(t) / F.lag(t).over(by_day) - 1 for t in tickers), F.lit(0.0)) / len(tickers)).alias("r"))
    base = even.agg(F.greatest(F.abs(F.avg("r") * YEAR), F.lit(0.01)).alias("base_ret"), F.greatest(F.stddev_samp("r") * root, F.lit(0.01)).alias("base_vol"))
    excess = F.col("ret") - risk_free
    sortino = F.when(F.col("n") == 0, 5.0).when(F.col("down") > 0, excess / F.col("down")).otherwise(0.0)
    terms = {"return": -F.col("ret") / F.col("base_ret"), "sharpe": -excess / F.col("vol"), "volatility": F.col("vol") / F.col("base_vol"), "drawdown": F.col("max_dd") * 5, "sortino": -sortino / 2}
    total = sum(wanted.values()) or 1
    loss = sum((F.lit(k / total) * terms[name] for name, k in wanted.items() if k > 0), F.lit(0.0))
    return agg.crossJoin(F.broadcast(base)).select(*names, loss.alias("loss"))


def cleaned_weights(weights: DataFrame, names: list[str], least: float = 0.001) -> DataFrame:
    """Weights that sum to 1, after those below ``least`` of the sum have become 0."""
    total = sum((F.col(c) for c in names), F.lit(0.0))
    kept = weights.select(*(c for c in weights.columns if c not in names), *(F.when(F.col(c) / total < least, 0.0).otherwise(F.col(c) / total).alias(c) for c in names))
    left = sum((F.col(c) for c in names), F.lit(0.0))
    return kept.select(*(c for c in weights.columns if c not in names), *((F.col(c) / left).alias(c) for c in names))


def guarded(losses: DataFrame, prices: DataFrame, tickers: tuple[str, ...], label: str, least: int = LEAST_ROWS) -> DataFrame:
    """``(label, w0, ..., score)``: the mix of least loss; equal weights, labelled as failed, if the assets share too few rows."""
    names = [f"w{k}" for k in range(len(tickers))]
    rows = aligned(prices, tickers).agg(F.count("*").alias("rows"))
    best = losses.groupBy().agg(F.min_by(F.struct(*names), F.struct("loss", *names)).alias("best"), F.min("loss").alias("loss"))
    enough = (F.col("rows") > least) & F.col("best").isNotNull()
    picked = [F.when(enough, F.col("best")[c]).otherwise(1 / len(tickers)).alias(c) for c in names]
    return rows.crossJoin(best).select(F.when(enough, label).otherwise(f"{label} (FAILED)").alias("label"), *picked, F.when(enough, -F.col("loss")).otherwise(0.0).alias("score"))


# -- distributions ---------------------------------------------------------------------------------------------------------------


def density(values: DataFrame, column: str, points: int = 200, clip: float = 0.01, bins: int = 1 << 15, key: str | None = None) -> DataFrame:
    """``(k, x, y)``, after ``key`` if there is one: a Gaussian density with Scott's bandwidth between two percentiles.

    The kernel is summed over places: the values themselves where there are no more than ``bins``; of more, each is shared between the two nearest
    of so many even places, which are far closer than the bandwidth. So the work at the points does not grow with the values. Without two
    different values there is none.
    """
    rows = values.select((F.col(key) if key else F.lit(0)).alias("_key"), F.col(column).cast("double").alias("v")).where("v is not null")
    shape = rows.groupBy("_key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).where("sd > 0")
    shape = shape.join(exact_percentiles(rows, "_key", "v", {"first": clip, "last": 1 - clip}), "_key")
    shape = staged(shape.select("*", ((F.col("high") - F.col("low")) / bins).alias("width"), (F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).alias("h")), "shapes")
    at = (F.col("v") - F.col("low")) / F.col("width")
    cell = F.least(F.floor(at), F.lit(bins - 1))
    place = lambda k: F.col("low") + (cell + k) * F.col("width")
    shared = F.array(F.struct(place(0).alias("place"), (1 - (at - cell)).alias("w")), F.struct(place(1).alias("place"), (at - cell).alias("w")))
    shared = F.when(F.col("n") <= bins, F.array(F.struct(F.col("v").alias("place"), F.lit(1.0).alias("w")))).otherwise(shared)
    cells = rows.join(shape, "_key").select("_key", F.explode(shared).alias("s")).groupBy("_key", "s.place").agg(F.sum("s.w").alias("w")).where("w > 0")
    # of a key no more rows than places times points
    near = cells.join(shape, "_key").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    near = near.withColumn("x", F.col("first") + (F.col("last") - F.col("first")) * F.col("k") / (points - 1))
    u = (F.col("x") - F.col("place")) / F.col("h")
    out = near.groupBy("_key", "k", "x").agg((F.sum(F.col("w") * F.exp(-0.5 * u * u)) / F.first("n") / F.first("h") / 2.5066282746310002).alias("y"))
    return out.select(*([F.col("_key").alias(key)] if key else []), "k", "x", "y")


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, low, n)``: counts in equal bins from the least to the largest value, which falls in the last."""
    rows = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    return rows.crossJoin(F.broadcast(span)).groupBy(cell.alias("bin")).agg(F.first(F.col("lo")).alias("lo"), F.first(width).alias("w"), F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), "n")


# -- simulations -----------------------------------------------------------------------------------------------------------------


def funded_paths(rets: DataFrame, capital: float = 10_000.0, amount: float = 0.0, every: int = 21) -> DataFrame:
    """``(sim, day, value, invested)``: paths with cash added after the return of every so manieth day."""
    w = Window.partitionBy("sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    grown = rets.withColumn("g", F.exp(F.sum(F.log1p("ret")).over(w)))
    cash = F.sum(F.when(F.col("day") % every == 0, amount / F.col("g")).otherwise(0.0)).over(w)
    return grown.select("sim", "day", (F.col("g") * (capital + cash)).alias("value"), (F.lit(capital) + F.floor(F.col("day") / every) * amount).alias("invested"))


def yearly_chances(paths: DataFrame, years: int, rise: float = 1.10, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(year, p_loss, p_high)``, after ``keys``: the share of paths below what was invested, and of those above it grown by a tenth a year, at the
    end of each year or at the last day."""
    last = paths.agg(F.max("day").alias("_last"))
    ends = last.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years)))).select(F.col("year").cast("long").alias("year"), F.least(F.col("year") * YEAR, "_last").alias("day"))
    rows = paths.join(F.broadcast(ends), "day")
    high = F.col("value") > F.col("invested") * F.pow(F.lit(rise), F.col("year"))
    return rows.groupBy(*keys, "year").agg(F.avg((F.col("value") < F.col("invested")).cast("double")).alias("p_loss"), F.avg(high.cast("double")).alias("p_high"))


def path_ratios(paths: DataFrame, years: float, capital: float = 10_000.0) -> DataFrame:
    """``(sharpe, sortino)`` over the growth rates of all paths; Sortino is 10 where no path lost."""
    final = paths.groupBy("sim").agg(F.max_by("value", "day").alias("v")).select((F.pow(F.col("v") / capital, F.lit(1 / years)) - 1).alias("c"))
    agg = final.agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd"), F.stddev_pop(F.when(F.col("c") < 0, F.col("c"))).alias("down"))
    return agg.select(F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0).alias("sharpe"), F.when(F.col("down") > 0, F.col("mean") / F.col("down")).otherwise(10.0).alias("sortino"))
