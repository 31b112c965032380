"""More queries of the catalogue: many portfolios, store keeping, studies, objectives, densities. ``QUERIES`` and ``ORACLES`` hold all."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import books as bk
from tidemark.operators import intervals as iv
from tidemark.operators import metrics as m
from tidemark.operators import portfolio as pf
from tidemark.operators import store as st
from tidemark.operators import studies as sd
from tidemark.plans import catalog as c
from tidemark.plans.catalog import GAP, ORACLES, QUERIES, WEIGHTS, _r, _rets, _with, query
from tidemark.session import shared_dir
from tidemark.sources.prices import order_days, prices
from tidemark.streaming.ingest import ingest, latest

#: Portfolios of the queries: (portfolio, ticker, weight).
PORTFOLIOS = [
    ("core", "A", 0.5), ("core", "N", 0.3), ("core", "R", 0.2), ("even", "A", 1 / 3), ("even", "N", 1 / 3), ("even", "R", 1 / 3), ("two", "R", 0.6), ("two", "A", 0.4),
    ("alone", "N", 1.0), ("tilted", "a ", 0.8), ("tilted", "n", 0.2), ("loose", "A", 0.5), ("loose", "X", 0.3),
]
_HELD = [p for p in PORTFOLIOS if p[0] != "loose"]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(cell(v) for v in row) + ')' for row in rows)}) AS t({names}))"


def weights(s: SparkSession, rows: list[tuple] = _HELD) -> DataFrame:
    return s.createDataFrame([(*row, i) for i, row in enumerate(rows)], "portfolio string, ticker string, weight double, position long")


_PW = ", pw AS (SELECT portfolio, upper(trim(ticker)) AS ticker, weight, pos, count(*) OVER (PARTITION BY portfolio) AS k, arg_min(upper(trim(ticker)), pos) OVER (PARTITION BY portfolio) AS benchmark FROM " + _values([(*row, i) for i, row in enumerate(_HELD)], "portfolio, ticker, weight, pos") + ")"
_BOOK = _PW + ", j0 AS (SELECT pw.*, p.dt, p.price, count(*) OVER (PARTITION BY portfolio, p.dt) AS n FROM prices p JOIN pw ON pw.ticker = p.ticker), j AS (SELECT *, dense_rank() OVER (PARTITION BY portfolio ORDER BY dt) - 1 AS day, coalesce(price / lag(price) OVER (PARTITION BY portfolio, ticker ORDER BY dt) - 1, 0) AS r FROM j0 WHERE n = k)"
_LUMP = _BOOK + ", b0 AS (SELECT portfolio, benchmark, dt, sum(weight * r) AS ret, max(CASE WHEN ticker = benchmark THEN r END) AS bench FROM j GROUP BY ALL), bv AS (SELECT *, 10000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY dt)) AS value, 10000.0 AS invested FROM b0)"
_MONTHLY = _BOOK + ", u AS (SELECT *, sum(CASE WHEN day = 0 THEN weight * 10000 / price WHEN day % 21 = 0 THEN weight * 500 / price ELSE 0 END) OVER (PARTITION BY portfolio, ticker ORDER BY dt) AS units FROM j), b0 AS (SELECT portfolio, benchmark, dt, day, sum(price * units) AS value, max(CASE WHEN ticker = benchmark THEN r END) AS bench, 10000.0 + (day // 21) * 500 AS invested FROM u GROUP BY ALL), bv AS (SELECT *, coalesce(value / lag(value) OVER (PARTITION BY portfolio ORDER BY dt) - 1, 0) AS ret FROM b0)"
_BM = ", bd AS (SELECT *, value / max(value) OVER (PARTITION BY portfolio ORDER BY dt) - 1 AS dd, ret - bench AS act, CASE WHEN count(*) OVER y = 252 THEN sum(ret) OVER y END AS s FROM bv WINDOW y AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)), bg AS (SELECT portfolio, benchmark, 10000.0 AS start, max(invested) AS invested, arg_max(value, dt) AS final, count(*) AS n, stddev_samp(ret) * sqrt(252) AS vol, max(s) AS best_year, min(s) AS worst_year, min(dd) AS max_dd, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS down, avg(act) * 252 AS active, stddev_samp(act) * sqrt(252) AS te, corr(ret, bench) AS corr FROM bd GROUP BY ALL), bm AS (SELECT *, power(CASE WHEN invested > 10000 THEN 1 + (final - invested) / ((10000 + invested) / 2) ELSE final / 10000 END, 252.0 / n) - 1 AS cagr FROM bg)"
_BM_OUT = " SELECT portfolio, benchmark, " + ", ".join(_r(x, x, 2) for x in ("start", "invested", "final")) + ", " + ", ".join(_r(x, x) for x in ("cagr", "vol", "best_year", "worst_year", "max_dd")) + ", " + _r("cagr / vol", "sharpe") + ", " + _r("cagr / down", "sortino") + ", " + _r("active", "active") + ", " + _r("te", "te") + ", " + _r("CASE WHEN te > 0 THEN active / te ELSE 0 END", "info_ratio") + ", " + _r("corr", "corr") + " FROM bm"
_MONEY = ("start", "invested", "final")
# a portfolio that is its own benchmark has a tracking error of rounding's size; its ratios are told of two assets or more
_TOLD = " WHERE portfolio <> 'alone'"

# -- many portfolios ---------------------------------------------------------------------------------------------------------------


def _lumps(s: SparkSession, d: str) -> DataFrame:
    return bk.book_metrics(bk.lump_sums(bk.book_returns(prices(s, d), weights(s))))


query("books_lump_sum_metrics", lambda s, d: _lumps(s, d).where("portfolio <> 'alone'"), _with("prices", _LUMP + _BM + _BM_OUT + _TOLD), _MONEY)
query("books_contribution_metrics", lambda s, d: bk.book_metrics(bk.monthly_sums(prices(s, d), weights(s))), _with("prices", _MONTHLY + _BM + _BM_OUT), _MONEY)
query("books_series", lambda s, d: bk.lump_sums(bk.book_returns(prices(s, d), weights(s))).select("portfolio", "dt", "ret", "bench", "value"), _with("prices", _LUMP + " SELECT portfolio, dt, " + _r("ret", "ret") + ", " + _r("bench", "bench") + ", " + _r("value", "value", 2) + " FROM bv"), ("value",))
_ALL = _values(PORTFOLIOS, "portfolio, ticker, weight")
query("books_checked", lambda s, d: bk.checked(weights(s, PORTFOLIOS), prices(s, d)), _with("prices", f", w AS (SELECT portfolio, upper(trim(ticker)) AS ticker, weight FROM {_ALL}), k AS (SELECT DISTINCT ticker AS kt FROM prices), g AS (SELECT portfolio, count(*) AS assets, sum(weight) AS total, coalesce(string_agg(DISTINCT CASE WHEN kt IS NULL THEN ticker END, ',' ORDER BY CASE WHEN kt IS NULL THEN ticker END), '') AS missing FROM w LEFT JOIN k ON kt = ticker GROUP BY portfolio) SELECT portfolio, assets, " + _r("total", "total") + ", missing, abs(total - 1) <= 0.01 AND missing = '' AS valid FROM g"))
query("tickers_union", lambda s, d: bk.tickers_of(weights(s, PORTFOLIOS), prices(s, d)), _with("prices", f"SELECT upper(trim(ticker)) AS ticker FROM {_ALL} UNION SELECT ticker FROM prices"))
query("tickers_missing", lambda s, d: st.without(bk.tickers_of(weights(s, PORTFOLIOS)), prices(s, d)), _with("prices", f"SELECT DISTINCT upper(trim(ticker)) AS ticker FROM {_ALL} WHERE upper(trim(ticker)) NOT IN (SELECT ticker FROM prices)"))


def traded(s: SparkSession, d: str) -> DataFrame:
    """Portfolios that the sales tell: of each region the share of each ticker in the volume, to the nearest hundredth."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.col("l_returnflag").alias("ticker"), "l_quantity")
    places = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = lines.join(places.select("s_suppkey", F.col("r_name").alias("portfolio")), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("portfolio", "ticker").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    total = F.sum("q").over(c.Window.partitionBy("portfolio"))
    order = F.row_number().over(c.Window.partitionBy("portfolio").orderBy("ticker"))
    return sums.select("portfolio", "ticker", (F.floor(F.col("q") / total * 100 + 0.5) / 100).alias("weight"), order.cast("long").alias("position"))


_TRADED = "tw AS (SELECT portfolio, ticker, floor(q / sum(q) OVER (PARTITION BY portfolio) * 100 + 0.5) / 100 AS weight FROM (SELECT r_name AS portfolio, l_returnflag AS ticker, sum(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2))"
_PCT = "CAST(CAST(round_even(weight * 100, 0) AS BIGINT) AS VARCHAR)"
query("traded_weights", lambda s, d: traded(s, d).drop("position"), f"WITH {_TRADED} SELECT portfolio, ticker, {_r('weight', 'weight')} FROM tw")
query("allocation_matrix", lambda s, d: bk.allocation_matrix(traded(s, d), ["A", "N", "R"]), f"WITH {_TRADED} SELECT portfolio, " + ", ".join(_r(f"max(CASE WHEN ticker = '{t}' AND weight > 0.001 THEN weight END)", t) for t in "ANR") + " FROM tw GROUP BY portfolio")
query("allocation_text", lambda s, d: bk.allocation_text(traded(s, d)), f"WITH {_TRADED} SELECT portfolio, regexp_replace(portfolio, '[^A-Za-z0-9_-]+', '_', 'g') || '.csv' AS file_name, portfolio || chr(10) || chr(10) || 'Symbol,Weight' || chr(10) || string_agg(ticker || ',' || {_PCT} || '%', chr(10) ORDER BY ticker) || chr(10) AS text FROM tw GROUP BY portfolio")
query("allocation_parse", lambda s, d: bk.parse_allocations(bk.allocation_text(traded(s, d))).drop("position"), f"WITH {_TRADED} SELECT portfolio, ticker, {_r('round_even(weight * 100, 0) / 100', 'weight')} FROM tw")
query("allocation_links", lambda s, d: bk.links(traded(s, d), "https://example.org/backtest", {"s": "y", "startYear": "2017"}), f"WITH {_TRADED} SELECT portfolio, 'https://example.org/backtest?s=y&startYear=2017&' || string_agg('symbol' || i || '=' || ticker || '&allocation' || i || '_1=' || {_PCT}, '&' ORDER BY i) AS url FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY ticker) AS i FROM tw) GROUP BY portfolio")


def _triples(s: SparkSession, d: str) -> DataFrame:
    """Raw weights of each region: those of its tickers, the first a thousandth of what it is."""
    w = F.col("weight")
    pick = lambda t, k: F.sum(F.when(F.col("ticker") == t, w * k).otherwise(0.0))
    return traded(s, d).groupBy(F.col("portfolio").alias("label")).agg(pick("A", 0.001).alias("w0"), pick("N", 1.0).alias("w1"), pick("R", 2.0).alias("w2"))


_TRIPLES = f"{_TRADED}, tr AS (SELECT portfolio AS label, sum(CASE WHEN ticker = 'A' THEN weight * 0.001 ELSE 0 END) AS a, sum(CASE WHEN ticker = 'N' THEN weight ELSE 0 END) AS b, sum(CASE WHEN ticker = 'R' THEN weight * 2 ELSE 0 END) AS e FROM tw GROUP BY 1)"

_BOOK_SIMS, _BOOK_DAYS = 100, 756


def _simulated(s: SparkSession, d: str) -> DataFrame:
    """Paths of every portfolio, from its own history."""
    rets = bk.book_returns(prices(s, d), weights(s)).where("day > 0").select("portfolio", "dt", "ret")
    return pf.simulated_paths(pf.simulated_books(rets, _BOOK_SIMS, _BOOK_DAYS), keys=("portfolio",))


def _summary(s: SparkSession, d: str) -> DataFrame:
    """Backtests with contributions beside the median growth rates of each portfolio's simulations."""
    simulated = pf.simulation_statistics(_simulated(s, d), _BOOK_DAYS / 252, keys=("portfolio",)).select("portfolio", "median_cagr")
    return bk.summary_rows(bk.book_metrics(bk.monthly_sums(prices(s, d), weights(s))), simulated)


_BOOK_PATHS = (
    f", bh AS (SELECT portfolio, ret, row_number() OVER (PARTITION BY portfolio ORDER BY dt) AS k, count(*) OVER (PARTITION BY portfolio) AS n FROM (SELECT portfolio, dt, sum(weight * r) AS ret FROM j WHERE day > 0 GROUP BY ALL)), bgr AS (SELECT DISTINCT portfolio, n, sim, day FROM bh CROSS JOIN (SELECT unnest(generate_series(0, {_BOOK_SIMS - 1})) AS sim) CROSS JOIN (SELECT unnest(generate_series(1, {_BOOK_DAYS})) AS day)), "
    f"bsr AS (SELECT g.portfolio, sim, day, bh.ret FROM bgr g JOIN bh ON bh.portfolio = g.portfolio AND bh.k = CAST(floor({c._U1} * g.n) AS BIGINT) + 1), bpv AS (SELECT portfolio, sim, day, 10000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio, sim ORDER BY day)) AS value FROM bsr), "
    "bpa AS (SELECT *, value / greatest(max(value) OVER (PARTITION BY portfolio, sim ORDER BY day), 10000) - 1 AS dd FROM bpv), "
    f"bfi AS (SELECT portfolio, sim, arg_max(value, day) AS v, min(dd) AS mdd, power(arg_max(value, day) / 10000, 252.0 / {_BOOK_DAYS}) - 1 AS c FROM bpa GROUP BY portfolio, sim)"
)
query("summary_table", _summary, _with("prices", _MONTHLY + _BM + _BOOK_PATHS + ", dl AS (SELECT x.*, y.m AS median_cagr, y.m - x.cagr AS delta FROM bm x LEFT JOIN (SELECT portfolio, quantile_cont(c, 0.5) AS m FROM bfi GROUP BY portfolio) y ON x.portfolio = y.portfolio) SELECT portfolio, CASE WHEN invested > 10100 THEN 'DCA: $' || format('{:,}', CAST(invested - 10000 AS BIGINT)) ELSE 'Lump Sum' END AS type, " + ", ".join(_r(x, x) for x in ("median_cagr", "cagr", "delta", "vol", "max_dd")) + ", CASE WHEN abs(delta) > 0.05 THEN 'warn' WHEN delta > 0 THEN 'pos' ELSE '' END AS class FROM dl"))
query("books_history_sizes", lambda s, d: pf.history_sizes(bk.book_returns(prices(s, d).where("dt >= date'2001-10-12'"), weights(s)).where("day > 0")), _with("prices", _PW + ", r0 AS (SELECT portfolio, p.dt FROM prices p JOIN pw ON pw.ticker = p.ticker WHERE p.dt >= DATE '2001-10-12' GROUP BY portfolio, p.dt HAVING count(*) = any_value(k)) SELECT portfolio, count(*) - 1 AS days, count(*) - 1 >= 20 AS enough FROM r0 GROUP BY portfolio HAVING count(*) > 1"))
query("books_simulated_statistics", lambda s, d: pf.simulation_statistics(_simulated(s, d), _BOOK_DAYS / 252, keys=("portfolio",)), _with("prices", _BOOK + _BOOK_PATHS + " SELECT portfolio, " + ", ".join((_r("avg(v)", "mean_final", 2), _r("quantile_cont(v, 0.5)", "median_final", 2), _r("avg(c)", "mean_cagr"), _r("quantile_cont(c, 0.5)", "median_cagr"), _r("stddev_pop(c)", "std_cagr"), _r("quantile_cont(mdd, 0.5)", "median_mdd"), _r("min(mdd)", "worst_mdd"), _r("quantile_cont(mdd, 0.05)", "p5_mdd"), _r("avg(CASE WHEN v < 10000 THEN 1.0 ELSE 0.0 END)", "p_loss"), _r("avg(CASE WHEN v >= 20000 THEN 1.0 ELSE 0.0 END)", "p_double"))) + " FROM bfi GROUP BY portfolio"), ("mean_final", "median_final"))

# -- bundles -----------------------------------------------------------------------------------------------------------------------

_BUNDLE = ("cagr_vol_sharpe", "downside_sortino_calmar", "var_cvar", "distribution_shape", "max_drawdown", "best_worst_year")


def _bundle(s: SparkSession, d: str) -> DataFrame:
    """The risk figures of each series; those beside a benchmark are null for the benchmark itself."""
    rets = _rets(s, d)
    parts = [m.summary(rets).drop("n"), m.value_at_risk(rets), m.shape(rets), m.best_worst_year(rets)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "ticker")
    return out.join(m.against_benchmark(rets, "N").drop("n", "cagr"), "ticker", "left")


def _join(names: tuple[str, ...]) -> str:
    return " ".join((f"({ORACLES[names[0]]}) q0", *(f"JOIN ({ORACLES[x]}) q{i} USING (ticker)" for i, x in enumerate(names[1:], 1))))


_RISK = ("cagr", "vol", "down", "max_dd", "avg_dd", "sharpe", "sortino", "calmar", "var", "cvar", "skew", "kurt", "positive_pct", "best_year", "worst_year")
_BENCH = ("beta", "alpha", "r2", "corr", "te", "active", "up_capture", "down_capture", "info_ratio", "treynor")
_FROM = {"cagr": "q0", "vol": "q0", "sharpe": "q0", "max_dd": "q0", "down": "q1", "sortino": "q1", "calmar": "q1", "avg_dd": "q4"}
_RISK_SQL = "SELECT ticker, " + ", ".join(f"{_FROM.get(x, '') + '.' if x in _FROM else ''}{x} AS {x}" for x in _RISK) + ", " + ", ".join(f"bq.{x} AS {x}" for x in _BENCH) + f" FROM {_join(_BUNDLE)} LEFT JOIN ({ORACLES['benchmark_metrics']}) bq USING (ticker)"
query("risk_bundle", _bundle, _RISK_SQL)


def _analysis(s: SparkSession, d: str) -> DataFrame:
    """One row a series: its risk figures, how many drawdowns it had and the deepest, and the last rolling figures."""
    rets = _rets(s, d)
    falls = m.episodes(rets).groupBy("ticker").agg(F.count("*").alias("episodes"), F.min("drawdown").alias("deepest"))
    last = m.rolling(rets).groupBy("ticker").agg(*(F.max_by(x, "dt").alias(f"last_{x}") for x in ("roll_ret", "roll_vol", "roll_sharpe", "roll_sortino")))
    return m.summary(rets).select("ticker", "cagr", "vol", "sharpe", "max_dd").join(falls, "ticker", "left").join(last, "ticker").withColumn("episodes", F.coalesce("episodes", F.lit(0)))


query("analysis_bundle", _analysis, f"SELECT a.ticker, cagr, vol, sharpe, max_dd, coalesce(episodes, 0) AS episodes, deepest, last_roll_ret, last_roll_vol, last_roll_sharpe, last_roll_sortino FROM ({ORACLES['cagr_vol_sharpe']}) a LEFT JOIN (SELECT ticker, count(*) AS episodes, min(drawdown) AS deepest FROM ({ORACLES['drawdown_episodes']}) GROUP BY ticker) e USING (ticker) JOIN (SELECT ticker, " + ", ".join(f"arg_max_null({x}, dt) AS last_{x}" for x in ("roll_ret", "roll_vol", "roll_sharpe", "roll_sortino")) + f" FROM ({ORACLES['rolling_metrics_252']}) GROUP BY ticker) l USING (ticker)")
query("drawdowns_by_severity", lambda s, d: m.episodes(_rets(s, d)).select("ticker", "start", "trough", "drawdown", F.row_number().over(c.Window.partitionBy("ticker").orderBy("drawdown", "start")).cast("long").alias("rank")), f'SELECT ticker, "start", trough, drawdown, row_number() OVER (PARTITION BY ticker ORDER BY drawdown, "start") AS rank FROM ({ORACLES["drawdown_episodes"]})')
query("returns_log_clipped", lambda s, d: _rets(s, d).select("ticker", "dt", sd.clipped_log_return(F.col("ret") * 40).alias("ret")), _with("rets", f"SELECT ticker, dt, {_r('ln(1 + greatest(ret * 40, -0.99))', 'ret')} FROM rets"))
query("returns_finite", lambda s, d: sd.finite(_rets(s, d).withColumn("x", F.when(F.dayofmonth("dt") == 5, float("inf")).when(F.dayofmonth("dt") == 6, float("nan")).otherwise(F.col("ret"))), "x").groupBy("ticker").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), _with("rets", f"SELECT ticker, count(*) AS n, {_r('avg(ret)', 'mean')} FROM rets WHERE extract(day FROM dt) NOT IN (5, 6) GROUP BY ticker"))
query("series_thinned", lambda s, d: sd.thinned(prices(s, d)).select("ticker", "dt", "price"), _with("prices", ", n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM prices) SELECT ticker, dt, " + _r("price", "price", 2) + " FROM n WHERE i % greatest(1, n // 500) = 0 OR i = n - 1"), ("price",))

# -- holdings ----------------------------------------------------------------------------------------------------------------------

_HOLD = ", n AS (SELECT ticker, dt, price, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i FROM prices), y AS (SELECT unnest([1, 3, 5, 10]) AS years), e AS (SELECT x.ticker, y.years, x.dt, x.i, z.price / x.price AS g FROM n x CROSS JOIN y JOIN n z ON z.ticker = x.ticker AND z.i = x.i + 252 * y.years WHERE x.i % 21 = 0), pth AS (SELECT e.ticker, e.years, e.dt, e.g, b.price / max(b.price) OVER (PARTITION BY e.ticker, e.years, e.i ORDER BY b.i) - 1 AS dd FROM e JOIN n b ON b.ticker = e.ticker AND b.i BETWEEN e.i AND e.i + 252 * e.years), hd AS (SELECT ticker, years, dt, any_value(g) AS g, min(dd) * 100 AS dd FROM pth GROUP BY ticker, years, dt) "
query("holdings_with_drawdown", lambda s, d: sd.holdings(prices(s, d)), _with("prices", _HOLD + "SELECT ticker, CAST(years AS BIGINT) AS years, dt, " + _r("(g - 1) * 100", "total_pct") + ", " + _r("(power(g, 1.0 / years) - 1) * 100", "cagr_pct") + ", " + _r("dd", "max_dd_pct") + " FROM hd"))
query("holdings_summary", lambda s, d: sd.holdings(prices(s, d)).groupBy("ticker", "years").agg(F.count("*").alias("n"), F.max("cagr_pct").alias("best"), F.min("cagr_pct").alias("worst"), F.percentile("cagr_pct", 0.5).alias("median"), F.avg("cagr_pct").alias("mean"), F.max("max_dd_pct").alias("mildest_dd"), F.min("max_dd_pct").alias("deepest_dd"), F.percentile("max_dd_pct", 0.5).alias("median_dd"), (F.avg((F.col("total_pct") > 0).cast("double")) * 100).alias("profit_pct")), _with("prices", _HOLD + ", f AS (SELECT ticker, years, (g - 1) * 100 AS t, (power(g, 1.0 / years) - 1) * 100 AS c, dd FROM hd) SELECT ticker, CAST(years AS BIGINT) AS years, count(*) AS n, " + ", ".join((_r("max(c)", "best"), _r("min(c)", "worst"), _r("quantile_cont(c, 0.5)", "median"), _r("avg(c)", "mean"), _r("max(dd)", "mildest_dd"), _r("min(dd)", "deepest_dd"), _r("quantile_cont(dd, 0.5)", "median_dd"), _r("avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END) * 100", "profit_pct"))) + " FROM f GROUP BY ticker, years"))
_SIDES = ("lump_sum", "monthly")


def _sides(s: SparkSession, d: str) -> DataFrame:
    figures = [f(x).alias(f"{n}_{x}") for x in _SIDES for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("median", lambda v: F.percentile(v, 0.5)))]
    return pf.lump_sum_or_monthly(prices(s, d)).groupBy("ticker").agg(*figures, F.count_if(F.col("diff") > 0).alias("wins"), F.count("*").alias("n"))


query("lump_sum_vs_dca_sides", _sides, _with("prices", c._LS + ", ".join(_r(f"{f}", f"{n}_{x}", 2) for x in _SIDES for n, f in (("mean", f"avg({x})"), ("max", f"max({x})"), ("min", f"min({x})"), ("median", f"quantile_cont({x}, 0.5)"))) + ", count(CASE WHEN lump_sum - monthly > 0 THEN 1 END) AS wins, count(*) AS n FROM l GROUP BY ticker"), tuple(f"{n}_{x}" for x in _SIDES for n in ("mean", "max", "min", "median")))
query("lump_sum_vs_dca_histogram", lambda s, d: sd.histogram(pf.lump_sum_or_monthly(prices(s, d)), "diff"), _with("prices", c._LS.rsplit(" SELECT ticker, ", 1)[0] + ", v AS (SELECT lump_sum - monthly AS v FROM l), sp AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, " + _r("any_value(lo) + CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS BIGINT) * any_value((hi - lo) / 30)", "low", 2) + ", count(*) AS n FROM v CROSS JOIN sp GROUP BY 1"), ("low",))

# -- store keeping -----------------------------------------------------------------------------------------------------------------

_SPAN = "DATE '1995-02-01' AS lo, DATE '1996-03-31' AS hi"


def _store(s: SparkSession, d: str) -> DataFrame:
    """What a store would hold: the even months of the first two tickers."""
    return prices(s, d).where("ticker <> 'R' and month(dt) % 2 = 0")


def _want(s: SparkSession, d: str) -> DataFrame:
    return prices(s, d).select("ticker").distinct().selectExpr("ticker", "date'1995-02-01' AS lo", "date'1996-03-31' AS hi")


def _held(s: SparkSession, d: str) -> DataFrame:
    return iv.islands(_store(s, d).select("ticker", "dt"))


def _read(s: SparkSession, d: str) -> DataFrame:
    """Fetched days carry twice the price, so that the answer tells them from those that the store had."""
    source = prices(s, d).withColumn("price", F.col("price") * 2)
    first = s.createDataFrame([("N", dt.date(1995, 3, 15))], "ticker string, first date")
    return st.read_through(_store(s, d), _held(s, d), source, _want(s, d), first)[0]


_ST = ", stored AS (SELECT * FROM prices WHERE ticker <> 'R' AND month(dt) % 2 = 0), s1 AS (SELECT ticker, dt, lag(dt) OVER (PARTITION BY ticker ORDER BY dt) AS pv FROM stored), s2 AS (SELECT *, sum(CASE WHEN date_diff('day', pv, dt) > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY dt) AS g FROM s1), hi AS (SELECT ticker, min(dt) AS a, max(dt) AS b FROM s2 GROUP BY ticker, g)"
query("read_through_scan", _read, _with("prices", _ST + ", w AS (SELECT p.ticker, p.dt, p.price, EXISTS (SELECT 1 FROM hi WHERE hi.ticker = p.ticker AND p.dt BETWEEN a AND b) AS had FROM prices p WHERE p.dt BETWEEN DATE '1995-02-01' AND DATE '1996-03-31' AND (p.ticker <> 'N' OR p.dt >= DATE '1995-03-15')) SELECT ticker, dt, " + _r("CASE WHEN had THEN price ELSE price * 2 END", "price", 2) + " FROM w"), ("price",))
_UNKNOWN = ", days AS (SELECT ticker, CAST(unnest(generate_series(DATE '1995-02-01', DATE '1996-03-31', INTERVAL 1 DAY)) AS DATE) AS dt FROM (SELECT DISTINCT ticker FROM prices)), un AS (SELECT * FROM days WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.ticker = days.ticker AND days.dt BETWEEN a AND b)), k AS (SELECT ticker, dt, date_diff('day', DATE '1970-01-01', dt) - row_number() OVER (PARTITION BY ticker ORDER BY dt) AS g FROM un), need AS (SELECT ticker, min(dt) AS \"start\", max(dt) AS \"end\" FROM k GROUP BY ticker, g)"
_PLAN = " SELECT ticker, \"start\", \"end\", CASE WHEN (SELECT bool_and(\"start\" = DATE '1995-02-01' AND \"end\" = DATE '1996-03-31') FROM need) THEN 'bulk' ELSE 'interval' END AS plan FROM need"
query("fetch_plan_intervals", lambda s, d: st.fetch_plan(_held(s, d), _want(s, d)), _with("prices", _ST + _UNKNOWN + _PLAN))
query("fetch_plan_bulk", lambda s, d: st.fetch_plan(_held(s, d).where("ticker = 'none'"), _want(s, d)), _with("prices", _ST.replace("GROUP BY ticker, g)", "WHERE false GROUP BY ticker, g)") + _UNKNOWN + _PLAN))
query("cached_or_to_download", lambda s, d: st.split_known(_want(s, d).withColumn("hi", F.lit("1995-02-20").cast("date")).withColumn("lo", F.lit("1995-02-10").cast("date")), _held(s, d)), _with("prices", _ST + " SELECT ticker, EXISTS (SELECT 1 FROM hi WHERE hi.ticker = t.ticker AND a <= DATE '1995-02-10' AND b >= DATE '1995-02-20') AS cached FROM (SELECT DISTINCT ticker FROM prices) t"))


def _cooled(s: SparkSession, d: str) -> DataFrame:
    now = dt.datetime(2024, 1, 1, 12)
    failed = s.createDataFrame([("R", dt.date(1995, 2, 1), dt.date(1996, 3, 31), now - dt.timedelta(minutes=30)), ("A", dt.date(1995, 3, 1), dt.date(1995, 3, 31), now - dt.timedelta(hours=2))], "ticker string, start date, end date, failed_at timestamp")
    return st.not_cooling(iv.missing(_held(s, d), _want(s, d)), failed, now)


query("fetch_cooldown", _cooled, _with("prices", _ST + _UNKNOWN + " SELECT * FROM need WHERE NOT (ticker = 'R' AND \"start\" = DATE '1995-02-01' AND \"end\" = DATE '1996-03-31')"))
query("offline_scan", lambda s, d: st.offline(prices(s, d)), _with("prices", "SELECT ticker, dt, " + _r("price", "price", 2) + " FROM prices WHERE dt <= (SELECT min(b) FROM (SELECT max(dt) AS b FROM prices GROUP BY ticker))"), ("price",))


def _known_days(s: SparkSession, d: str) -> DataFrame:
    return iv.islands(order_days(s, d), GAP)


def _meta(s: SparkSession, d: str) -> DataFrame:
    """The table of what a store holds, before an update: two tickers, one with a wrong bound."""
    return st.described(_known_days(s, d)).where("ticker in ('1-URGENT', '2-HIGH')").withColumn("last", F.when(F.col("ticker") == "2-HIGH", F.lit("1990-01-01").cast("date")).otherwise(F.col("last")))


_TEXT = ", dsc AS (SELECT ticker, min(\"start\") AS \"first\", max(\"end\") AS last, '[' || string_agg('{\"start\":\"' || CAST(\"start\" AS VARCHAR) || '\",\"end\":\"' || CAST(\"end\" AS VARCHAR) || '\"}', ',' ORDER BY \"start\") || ']' AS intervals FROM isl GROUP BY ticker)"
_DESC = 'SELECT ticker, "first", last, intervals FROM dsc'
query("metadata_upsert", lambda s, d: st.upserted(_meta(s, d), st.described(_known_days(s, d)).where("ticker <> '1-URGENT'")), _with("isl", _TEXT + " " + _DESC))
query("metadata_rebuilt", lambda s, d: st.described(_known_days(s, d)), _with("isl", _TEXT + " " + _DESC))
query("metadata_without_ticker", lambda s, d: st.without(st.described(_known_days(s, d)), s.createDataFrame([("2-HIGH",)], "ticker string")), _with("isl", _TEXT + " " + _DESC + " WHERE ticker <> '2-HIGH'"))
query("metadata_truncated", lambda s, d: st.described(_known_days(s, d)).limit(0), _with("isl", _TEXT + " " + _DESC + " WHERE false"))
query("metadata_migrated", lambda s, d: st.migrated(st.migrated(st.described(_known_days(s, d)), {"inception": "date", "first": "date", "note": "string"}), {"inception": "date", "note": "string"}), _with("isl", _TEXT + " SELECT ticker, \"first\", last, intervals, CAST(NULL AS DATE) AS inception, CAST(NULL AS VARCHAR) AS note FROM dsc"))


def _inceptions(s: SparkSession, d: str) -> DataFrame:
    old = s.createDataFrame([("1-URGENT", None), ("2-HIGH", dt.date(1980, 1, 1)), ("3-MEDIUM", dt.date(2030, 1, 1))], "ticker string, inception date")
    return st.earlier_inception(old, order_days(s, d).select("ticker", F.col("dt").alias("found")))


query("inception_earlier", _inceptions, _with("od", ", f AS (SELECT ticker, min(dt) AS f FROM od GROUP BY ticker) SELECT o.ticker, least(o.i, f.f) AS inception FROM (VALUES ('1-URGENT', CAST(NULL AS DATE)), ('2-HIGH', DATE '1980-01-01'), ('3-MEDIUM', DATE '2030-01-01')) AS o(ticker, i) LEFT JOIN f ON f.ticker = o.ticker"))
query("gap_report", lambda s, d: st.gap_report(iv.gaps(order_days(s, d), GAP)), f"SELECT ticker, array_to_string(list_slice(a, 1, 5), ', ') AS report, CAST(greatest(len(a) - 5, 0) AS BIGINT) AS more FROM (SELECT ticker, list_sort(list(CAST(\"start\" AS VARCHAR) || '..' || CAST(\"end\" AS VARCHAR))) AS a FROM ({ORACLES['find_gaps']}) GROUP BY ticker)")

def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Prices that come as a stream, then a correction of some months that leaves out odd days."""
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    old = prices(s, d)
    new = old.where("dt between date'1995-03-01' and date'1995-06-30' and day(dt) % 2 = 0").withColumn("price", F.col("price") * 2)
    for rows in (old, new):
        rows.write.mode("append").parquet(f"{base}/in")
        ingest(s.readStream.schema(old.schema).parquet(f"{base}/in"), f"{base}/store", f"{base}/ckpt").awaitTermination()
    return latest(s.read.parquet(f"{base}/store")).select("ticker", "dt", "price")


query("stream_replace_range", _streamed, ORACLES["replace_range_upsert"], ("price",))

# -- objectives --------------------------------------------------------------------------------------------------------------------

_WANTED = {"return": 1.0, "sharpe": 1.0, "volatility": 0.5, "drawdown": 1.0, "sortino": 0.5}
_T = tuple(WEIGHTS)
_MIX = ", g AS (SELECT x / 10.0 AS wa, y / 10.0 AS wn, (10 - x - y) / 10.0 AS wr FROM (SELECT unnest(generate_series(0, 10)) AS x) CROSS JOIN (SELECT unnest(generate_series(0, 10)) AS y) WHERE x + y <= 10), q0 AS (SELECT dt, a / lag(a) OVER (ORDER BY dt) - 1 AS ra, n / lag(n) OVER (ORDER BY dt) - 1 AS rn, r / lag(r) OVER (ORDER BY dt) - 1 AS rr FROM wide), mx AS (SELECT wa, wn, wr, dt, wa * ra + wn * rn + wr * rr AS ret FROM q0 CROSS JOIN g WHERE ra IS NOT NULL)"
_WS = ", ".join(_r(f"CAST({a} AS DOUBLE)", b) for a, b in (("wa", "w0"), ("wn", "w1"), ("wr", "w2")))
_SORTINO = _MIX + ", so AS (SELECT wa, wn, wr, avg(ret) AS mu, count(CASE WHEN ret < 0 THEN 1 END) AS k, stddev_pop(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS down FROM mx GROUP BY ALL), lo AS (SELECT wa, wn, wr, CASE WHEN k < 20 OR down < 0.001 THEN 100 ELSE -(mu * 252 - 0.04) / down END AS loss FROM so)"
query("opt_sortino_losses", lambda s, d: sd.sortino_losses(prices(s, d), _T), _with("wide", _SORTINO + f" SELECT {_WS}, {_r('loss', 'loss')} FROM lo"))
query("opt_max_sortino", lambda s, d: sd.guarded(sd.sortino_losses(prices(s, d), _T), prices(s, d), _T, "Max Sortino"), _with("wide", _SORTINO + f" SELECT 'Max Sortino' AS label, {_WS}, {_r('-loss', 'score')} FROM lo ORDER BY loss, wa, wn LIMIT 1"))
_CUSTOM = _MIX + ", lv AS (SELECT *, sum(ln(1 + greatest(ret, -0.99))) OVER (PARTITION BY wa, wn, wr ORDER BY dt) AS lvl FROM mx), fl AS (SELECT *, lvl - max(lvl) OVER (PARTITION BY wa, wn, wr ORDER BY dt) AS fall FROM lv), cg AS (SELECT wa, wn, wr, avg(ret) * 252 AS ret, greatest(stddev_samp(ret) * sqrt(252), 1e-6) AS vol, 1 - exp(min(fall)) AS mdd, count(CASE WHEN ret < 0 THEN 1 END) AS k, stddev_pop(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS down FROM fl GROUP BY ALL), ba AS (SELECT greatest(abs(avg((ra + rn + rr) / 3) * 252), 0.01) AS br, greatest(stddev_samp((ra + rn + rr) / 3) * sqrt(252), 0.01) AS bv FROM q0 WHERE ra IS NOT NULL), lo AS (SELECT wa, wn, wr, 0.25 * (-ret / br) + 0.25 * (-(ret - 0.04) / vol) + 0.125 * vol / bv + 0.25 * (5 * mdd) + 0.125 * (-CASE WHEN k = 0 THEN 5.0 WHEN down > 0 THEN (ret - 0.04) / down ELSE 0 END / 2) AS loss FROM cg CROSS JOIN ba)"
query("opt_custom_losses", lambda s, d: sd.weighted_losses(prices(s, d), _T, _WANTED), _with("wide", _CUSTOM + f" SELECT {_WS}, {_r('loss', 'loss')} FROM lo"))
query("opt_custom_weighted", lambda s, d: sd.guarded(sd.weighted_losses(prices(s, d), _T, _WANTED), prices(s, d), _T, "Custom"), _with("wide", _CUSTOM + f" SELECT 'Custom' AS label, {_WS}, {_r('-loss', 'score')} FROM lo ORDER BY loss, wa, wn LIMIT 1"))


def _too_short(s: SparkSession, d: str) -> DataFrame:
    few = prices(s, d).where("dt < date'1992-05-01'")
    return sd.guarded(sd.sortino_losses(few, _T), few, _T, "Max Sortino")


query("opt_failed_equal_weights", _too_short, "SELECT 'Max Sortino (FAILED)' AS label, round(1 / 3.0, 6) AS w0, round(1 / 3.0, 6) AS w1, round(1 / 3.0, 6) AS w2, 0.0 AS score")
_CW = {a: f"CASE WHEN {a} / (a + b + e) < 0.001 THEN 0 ELSE {a} / (a + b + e) END" for a in "abe"}
query("opt_cleaned_weights", lambda s, d: sd.cleaned_weights(_triples(s, d), ["w0", "w1", "w2"]), f"WITH {_TRIPLES} SELECT label, " + ", ".join(_r(f"({_CW[a]}) / ({' + '.join(_CW.values())})", f"w{i}") for i, a in enumerate("abe")) + " FROM tr")
query("opt_results_json", lambda s, d: st.result_rows(traded(s, d).groupBy(F.col("portfolio").alias("label")).agg(F.count("*").alias("tickers"), F.max(F.rint(F.col("weight") * 100).cast("long")).alias("largest")), ["tickers"], ["largest"]), f"WITH {_TRADED} SELECT portfolio AS label, '{{\"tickers\":' || count(*) || '}}' AS allocations, '{{\"largest\":' || max(CAST(round_even(weight * 100, 0) AS BIGINT)) || '}}' AS stats FROM tw GROUP BY 1")

# -- simulations -------------------------------------------------------------------------------------------------------------------

_SIMS, _DAYS = 100, 756
_GR = c._GRIDS.replace(f"generate_series(0, {c.SIMS - 1})", f"generate_series(0, {_SIMS - 1})").replace(f"generate_series(1, {c.DAYS})", f"generate_series(1, {_DAYS})")
_FUNDED = _GR + c._DRAWS["bootstrap"] + "gw AS (SELECT sim, day, exp(sum(ln(1 + ret)) OVER (PARTITION BY sim ORDER BY day)) AS g FROM sr), fp AS (SELECT sim, day, g * (10000 + sum(CASE WHEN day % 21 = 0 THEN 500 / g ELSE 0 END) OVER (PARTITION BY sim ORDER BY day)) AS value, 10000.0 + (day // 21) * 500 AS invested FROM gw)"


def _funded(s: SparkSession, d: str) -> DataFrame:
    return sd.funded_paths(pf.simulated_returns(prices(s, d), WEIGHTS, _SIMS, _DAYS, "bootstrap"), amount=500.0)


query("mc_funded_paths", lambda s, d: _funded(s, d).where("day % 63 = 0"), _with("pr", _FUNDED + " SELECT CAST(sim AS BIGINT) AS sim, CAST(day AS BIGINT) AS day, " + _r("value", "value", 2) + ", " + _r("invested", "invested", 2) + " FROM fp WHERE day % 63 = 0"), ("value", "invested"))
query("mc_yearly_chances", lambda s, d: sd.yearly_chances(_funded(s, d), 4), _with("pr", _FUNDED + ", ys AS (SELECT y, least(y * 252, (SELECT max(day) FROM fp)) AS day FROM (SELECT unnest([1, 2, 3, 4]) AS y)) SELECT CAST(y AS BIGINT) AS year, " + _r("avg(CASE WHEN value < invested THEN 1.0 ELSE 0.0 END)", "p_loss") + ", " + _r("avg(CASE WHEN value > invested * power(1.1, y) THEN 1.0 ELSE 0.0 END)", "p_high") + " FROM fp JOIN ys USING (day) GROUP BY y"))
_PTH = c._GRIDS + c._DRAWS["bootstrap"] + c._PATHS
query("mc_path_ratios", lambda s, d: sd.path_ratios(c._paths("bootstrap")(s, d), c.DAYS / 252), _with("pr", _PTH + ", f AS (SELECT arg_max(value, day) / 10000 - 1 AS x FROM pa GROUP BY sim) SELECT " + _r("avg(x) / stddev_pop(x)", "sharpe") + ", " + _r("coalesce(avg(x) / nullif(stddev_pop(CASE WHEN x < 0 THEN x END), 0), 10)", "sortino") + " FROM f"))


def _finals(s: SparkSession, d: str) -> DataFrame:
    return c._paths("bootstrap")(s, d).groupBy("sim").agg(F.max_by("value", "day").alias("v"))


query("mc_final_density", lambda s, d: sd.density(_finals(s, d), "v").withColumn("y", F.col("y") * 1e4), _with("pr", _PTH + ", f AS (SELECT arg_max(value, day) AS v FROM pa GROUP BY sim), sh AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, stddev_samp(v) * power(count(*), -0.2) AS h, count(*) AS n FROM f), gd AS (SELECT k, lo + (hi - lo) * k / 199 AS x, h, n FROM sh, (SELECT unnest(generate_series(0, 199)) AS k)) SELECT CAST(k AS BIGINT) AS k, " + _r("any_value(x)", "x", 2) + ", " + _r("sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / any_value(n) / any_value(h) / sqrt(2 * pi()) * 10000", "y") + " FROM f CROSS JOIN gd GROUP BY k"), ("x",))


# -- what the panels of a report show ----------------------------------------------------------------------------------------------


def _panels(s: SparkSession, d: str) -> DataFrame:
    """``(panel, x, y)``: bands, the density of final values, and yearly chances of simulations."""
    bands = QUERIES["mc_trajectory_bands"](s, d)
    out = QUERIES["mc_final_density"](s, d).select(F.lit("density").alias("panel"), F.col("k").cast("double").alias("x"), "y")
    for name in ("p5", "p50", "p95"):
        out = out.unionByName(bands.select(F.lit(name).alias("panel"), F.col("day").cast("double").alias("x"), F.col(name).alias("y")))
    chances = QUERIES["mc_yearly_chances"](s, d)
    for name in ("p_loss", "p_high"):
        out = out.unionByName(chances.select(F.lit(name).alias("panel"), F.col("year").cast("double").alias("x"), F.col(name).alias("y")))
    return out


def _panel(name: str, x: str, y: str, source: str) -> str:
    return f"SELECT '{name}' AS panel, CAST({x} AS DOUBLE) AS x, {y} AS y FROM ({ORACLES[source]})"


query("simulation_panels", _panels, " UNION ALL ".join([_panel("density", "k", "y", "mc_final_density"), *(_panel(n, "day", n, "mc_trajectory_bands") for n in ("p5", "p50", "p95")), *(_panel(n, "year", n, "mc_yearly_chances") for n in ("p_loss", "p_high"))]))


def _backtest_panels(s: SparkSession, d: str) -> DataFrame:
    """Value, drawdown and rolling growth of a backtest on each day."""
    test = QUERIES["backtest_static_series"](s, d).select("dt", "value", "dd")
    return test.join(QUERIES["rolling_3y_5y"](s, d), "dt")


query("backtest_panels", _backtest_panels, f"SELECT dt, value, dd, roll_3y, roll_5y FROM ({ORACLES['backtest_static_series']}) JOIN ({ORACLES['rolling_3y_5y']}) USING (dt)", ("value",))
query("backtest_dispatch_lump_sum", lambda s, d: pf.run_backtest(prices(s, d), WEIGHTS), f"SELECT dt, value FROM ({ORACLES['backtest_static_series']})", ("value",))
query("backtest_dispatch_strategy", lambda s, d: pf.run_backtest(prices(s, d), WEIGHTS, c.STRATEGIES["dual_momentum"], amount=500.0), f"SELECT dt, value FROM ({ORACLES['dca_strategies']}) WHERE strategy = 'dual_momentum'", ("value",))
