"""What the panels and tables of a report show, each set from one simulation or one series of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import YEAR
from tidemark.operators import portfolio as pf
from tidemark.operators import studies as sd
from tidemark.plans.catalog import ORACLES, QUERIES, _r, _with, query
from tidemark.plans.extended import _BOOK, _BOOK_DAYS, _BOOK_PATHS, _simulated
from tidemark.session import staged

_YEARS = _BOOK_DAYS // YEAR


def _panels(s: SparkSession, d: str) -> DataFrame:
    """``(portfolio, panel, x, y)``: bands of the values, densities of final values and growth rates, risk and return, and yearly chances of
    each portfolio, all of the same paths."""
    paths = staged(_simulated(s, d), "paths")
    key = ("portfolio",)
    ends = pf.simulated_ends(paths, _BOOK_DAYS / YEAR, keys=key)
    row = lambda df, name, x, y: df.select("portfolio", F.lit(name).alias("panel"), F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
    bands, chances = pf.bands(paths, keys=key), sd.yearly_chances(paths.withColumn("invested", F.lit(10_000.0)), _YEARS, keys=key)
    risk = ends.groupBy("portfolio").agg((F.stddev_pop("cagr") * 100).alias("x"), (F.avg("cagr") * 100).alias("y"))
    parts = [row(bands, n, "day", n) for n in ("p5", "p50", "p95")] + [row(chances, n, "year", n) for n in ("p_loss", "p_high")] + [row(risk, "risk_return", "x", "y")]
    parts.append(row(sd.density(ends, "final", key="portfolio").withColumn("y", F.col("y") * 1e4), "final_density", "k", "y"))
    parts.append(row(sd.density(ends.withColumn("c", F.col("cagr") * 100), "c", key="portfolio"), "growth_density", "k", "y"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _density_sql(value: str, name: str, scale: str = "") -> str:
    return (
        f"SELECT portfolio, '{name}' AS panel, CAST(k AS DOUBLE) AS x, sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / any_value(n) / any_value(h) / sqrt(2 * pi()){scale} AS y FROM (SELECT f.portfolio, k, v, lo + (hi - lo) * k / 199 AS x, h, n FROM "
        f"(SELECT portfolio, {value} AS v FROM bfi) f JOIN (SELECT portfolio, quantile_cont({value}, 0.01) AS lo, quantile_cont({value}, 0.99) AS hi, stddev_samp({value}) * power(count(*), -0.2) AS h, count(*) AS n FROM bfi GROUP BY portfolio) sh ON sh.portfolio = f.portfolio CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS k)) GROUP BY portfolio, k"
    )


_SQL = (
    ", al AS (" + " UNION ALL ".join([*(f"SELECT portfolio, '{n}' AS panel, CAST(day AS DOUBLE) AS x, quantile_cont(value, {q}) AS y FROM bpa WHERE day % 21 = 0 GROUP BY portfolio, day" for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))), *(f"SELECT portfolio, '{n}', CAST(y AS DOUBLE), avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) FROM bpa JOIN (SELECT unnest(range(1, {_YEARS + 1})) AS y) ON day = y * 252 GROUP BY portfolio, y" for n, test in (("p_loss", "value < 10000"), ("p_high", "value > 10000 * power(1.1, y)"))), "SELECT portfolio, 'risk_return', stddev_pop(c) * 100, avg(c) * 100 FROM bfi GROUP BY portfolio", _density_sql("v", "final_density", " * 10000"), _density_sql("c * 100", "growth_density")]) + ")"
    " SELECT portfolio, panel, " + _r("x", "x") + ", " + _r("y", "y", 5) + " FROM al"
)
query("books_simulation_panels", lambda s, d: _panels(s, d).withColumn("y", F.round("y", 5)), _with("prices", _BOOK + _BOOK_PATHS + _SQL))

def _tables(s: SparkSession, d: str) -> DataFrame:
    """``(ticker, part, at, value)``: drawdown episodes by start, returns of months and years, and rolling figures by day, of each series."""
    part = lambda df, name, at, value: df.select("ticker", F.lit(name).alias("part"), at.cast("string").alias("at"), F.col(value).alias("value")).where("value is not null")
    months, rolling = QUERIES["monthly_returns_pivot"](s, d), QUERIES["rolling_metrics_252"](s, d)
    out = part(QUERIES["drawdown_episodes"](s, d), "episode", F.col("start"), "drawdown").unionByName(part(QUERIES["annual_returns"](s, d), "year", F.col("year"), "total"))
    for k in range(1, 13):
        out = out.unionByName(part(months, "month", F.concat(F.col("year").cast("string"), F.lit(f"-{k:02d}")), f"m{k:02d}"))
    for name in ("roll_ret", "roll_vol", "roll_sharpe", "roll_sortino"):
        out = out.unionByName(part(rolling, name, F.col("dt"), name))
    return out


_TABLES = " UNION ALL ".join([
    f"SELECT ticker, 'episode' AS part, CAST(\"start\" AS VARCHAR) AS at, drawdown AS value FROM ({ORACLES['drawdown_episodes']})",
    f"SELECT ticker, 'year', CAST(\"year\" AS VARCHAR), total FROM ({ORACLES['annual_returns']})",
    *(f"SELECT ticker, 'month', CAST(\"year\" AS VARCHAR) || '-{k:02d}', m{k:02d} FROM ({ORACLES['monthly_returns_pivot']}) WHERE m{k:02d} IS NOT NULL" for k in range(1, 13)),
    *(f"SELECT ticker, '{n}', CAST(dt AS VARCHAR), {n} FROM ({ORACLES['rolling_metrics_252']}) WHERE {n} IS NOT NULL" for n in ("roll_ret", "roll_vol", "roll_sharpe", "roll_sortino")),
])
query("analysis_tables", _tables, _TABLES)
