"""``QUERIES`` and the SQL that each must equal, ``ORACLES``. Doubles are rounded on both sides: money to cents, all else to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import RISK_FREE, by, drawdowns, growth, returns
from tidemark.operators import intervals as iv
from tidemark.operators import metrics as m
from tidemark.operators import portfolio as pf
from tidemark.operators import strategies as sg
from tidemark.sources.prices import daily_bars, order_days, prices
from tidemark.streaming.ingest import hourly_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEIGHTS = {"A": 0.5, "N": 0.3, "R": 0.2}
#: Gaps of the order days longer than this are reported.
GAP = 3

# -- what the SQL sides share: common table expressions, in the order in which they build on each other ---------------------------

_CTES = {
    "d": "SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice) AS px, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2",
    "p": "SELECT ticker, dt, avg(px) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS price, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS rn FROM d",
    "prices": "SELECT ticker, dt, price FROM p WHERE rn >= 21",
    "r0": "SELECT ticker, dt, price / lag(price) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM prices",
    "rets": "SELECT * FROM r0 WHERE ret IS NOT NULL",
    "v": "SELECT ticker, dt, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY dt)) AS value FROM rets",
    "dd": "SELECT *, max(value) OVER (PARTITION BY ticker ORDER BY dt) AS peak, value / max(value) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS dd FROM v",
    "wide": "SELECT dt, max(CASE WHEN ticker = 'A' THEN price END) AS a, max(CASE WHEN ticker = 'N' THEN price END) AS n, max(CASE WHEN ticker = 'R' THEN price END) AS r FROM prices GROUP BY dt HAVING count(*) = 3",
    "pr": "SELECT dt, 0.5 * (a / lag(a) OVER (ORDER BY dt) - 1) + 0.3 * (n / lag(n) OVER (ORDER BY dt) - 1) + 0.2 * (r / lag(r) OVER (ORDER BY dt) - 1) AS ret FROM wide",
    "port": "SELECT dt, coalesce(ret, 0) AS ret FROM pr",
    "bt0": "SELECT dt, ret, 10000 * exp(sum(ln(1 + ret)) OVER (ORDER BY dt)) AS value FROM port",
    "bt": "SELECT *, value / max(value) OVER (ORDER BY dt) - 1 AS dd FROM bt0",
    "od": "SELECT DISTINCT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS dt FROM orders",
    "od1": "SELECT *, lag(dt) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM od",
    "od2": f"SELECT *, sum(CASE WHEN date_diff('day', prev, dt) > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY dt) AS island FROM od1",
    "isl": 'SELECT ticker, min(dt) AS "start", max(dt) AS "end", count(*) AS days FROM od2 GROUP BY ticker, island',
    "req": "SELECT DISTINCT ticker, DATE '1994-01-01' AS lo, DATE '1997-12-31' AS hi FROM od UNION ALL SELECT '9-NEVER SEEN', DATE '1994-01-01', DATE '1997-12-31' UNION ALL SELECT '1-URGENT', DATE '1991-01-01', DATE '1992-06-30'",
}
_NEEDS = {"p": ["d"], "prices": ["p"], "r0": ["prices"], "rets": ["r0"], "v": ["rets"], "dd": ["v"], "wide": ["prices"], "pr": ["wide"], "port": ["pr"], "bt0": ["port"], "bt": ["bt0"], "od1": ["od"], "od2": ["od1"], "isl": ["od2"], "req": ["od"]}


def _with(name: str, sql: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(x: str) -> None:
        for y in _NEEDS.get(x, []):
            add(y)
        if x not in order:
            order.append(x)

    for x in name.split():
        add(x)
    return "WITH " + ", ".join(f"{x} AS ({_CTES[x]})" for x in order) + (sql if sql.startswith(", ") else " " + sql)


def _r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0 AS {name}"


def tidy(df: DataFrame, money: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*((F.round(c, 2 if c in money else 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, money: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(run(spark, sf_dir), money)
    if sql:
        ORACLES[name] = sql


def _rets(s: SparkSession, d: str) -> DataFrame:
    return returns(prices(s, d))


# -- series ------------------------------------------------------------------------------------------------------------------

_CAGR = "exp(sum(ln(1 + ret)) * 252 / count(*)) - 1"
_VOL = "stddev_samp(ret) * sqrt(252)"
_DOWN = "coalesce(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252), 0)"

query("bars_ohlcv_hourly", hourly_bars, "SELECT event_type AS ticker, date_trunc('hour', ts) AS hour, " + _r("arg_min(value, (ts, event_id))", "open") + ", " + _r("max(value)", "high") + ", " + _r("min(value)", "low") + ", " + _r("arg_max(value, (ts, event_id))", "close") + ", " + _r("sum(value)", "volume", 2) + " FROM events GROUP BY 1, 2", ("volume",))
query("bars_daily", lambda s, d: daily_bars(s, d), _with("d", f"SELECT ticker, dt, {_r('px', 'px')}, {_r('lo', 'lo', 2)}, {_r('hi', 'hi', 2)}, {_r('vol', 'vol', 2)} FROM d"), ("lo", "hi", "vol"))
query("range_scan_ticker", lambda s, d: prices(s, d).where("ticker = 'A' and dt between date'1995-01-01' and date'1995-12-31'"), _with("prices", f"SELECT ticker, dt, {_r('price', 'price', 2)} FROM prices WHERE ticker = 'A' AND dt BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"), ("price",))
query("distinct_tickers", lambda s, d: prices(s, d).groupBy("ticker").agg(F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last")), _with("prices", 'SELECT ticker, count(*) AS n, min(dt) AS "first", max(dt) AS "last" FROM prices GROUP BY ticker'))
query("returns_simple", _rets, _with("rets", f"SELECT ticker, dt, {_r('ret', 'ret')} FROM rets"))
query("returns_log", lambda s, d: _rets(s, d).select("ticker", "dt", F.log1p("ret").alias("ret")), _with("rets", f"SELECT ticker, dt, {_r('ln(1 + ret)', 'ret')} FROM rets"))
query("returns_zero_filled", lambda s, d: prices(s, d).select("ticker", "dt", F.coalesce(F.col("price") / F.lag("price").over(by()) - 1, F.lit(0.0)).alias("ret")), _with("r0", f"SELECT ticker, dt, {_r('coalesce(ret, 0)', 'ret')} FROM r0"))


def _filled(s: SparkSession, d: str) -> DataFrame:
    p = prices(s, d).withColumn("price", F.when(F.dayofmonth("dt") != 17, F.col("price")))
    p = p.withColumn("price", F.last("price", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    return returns(p)


query("returns_ffill_null", _filled, _with("prices", ", h AS (SELECT ticker, dt, CASE WHEN extract(day FROM dt) <> 17 THEN price END AS price FROM prices), g AS (SELECT ticker, dt, count(price) OVER (PARTITION BY ticker ORDER BY dt) AS k, price FROM h), f AS (SELECT ticker, dt, max(price) OVER (PARTITION BY ticker, k) AS price FROM g), q AS (SELECT ticker, dt, price / lag(price) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM f) SELECT ticker, dt, " + _r("ret", "ret") + " FROM q WHERE ret IS NOT NULL"))
query("price_alignment_inner", lambda s, d: pf.aligned(prices(s, d), tuple(WEIGHTS)).select("dt", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")), _with("wide", f"SELECT dt, {_r('a', 'a', 2)}, {_r('n', 'n', 2)}, {_r('r', 'r', 2)} FROM wide"), ("a", "n", "r"))
query("weighted_portfolio_returns", lambda s, d: pf.portfolio_returns(prices(s, d), WEIGHTS).select("dt", "ret"), _with("port", f"SELECT dt, {_r('ret', 'ret')} FROM port"))
query("cumulative_growth", lambda s, d: _rets(s, d).select("ticker", "dt", growth().alias("value")), _with("v", f"SELECT ticker, dt, {_r('value', 'value')} FROM v"))
query("drawdown_series", lambda s, d: drawdowns(_rets(s, d)).select("ticker", "dt", "dd"), _with("dd", f"SELECT ticker, dt, {_r('dd', 'dd')} FROM dd"))
query("max_drawdown", lambda s, d: m.max_drawdown(_rets(s, d)), _with("dd", f"SELECT ticker, {_r('min(dd)', 'max_dd')}, {_r('coalesce(avg(CASE WHEN dd < 0 THEN dd END), 0)', 'avg_dd')} FROM dd GROUP BY ticker"))
_SUM = f", g AS (SELECT ticker, {_CAGR} AS cagr, {_VOL} AS vol, {_DOWN} AS down, min(dd) AS max_dd, coalesce(avg(CASE WHEN dd < 0 THEN dd END), 0) AS avg_dd, count(*) AS n FROM dd GROUP BY ticker) SELECT ticker, "
_RATIOS = {"sharpe": f"CASE WHEN vol <> 0 THEN (cagr - {RISK_FREE}) / vol ELSE 0 END", "sortino": f"CASE WHEN down <> 0 THEN (cagr - {RISK_FREE}) / down ELSE 0 END", "calmar": "CASE WHEN max_dd <> 0 THEN cagr / abs(max_dd) ELSE 0 END"}
query("cagr_vol_sharpe", lambda s, d: m.summary(_rets(s, d)).select("ticker", "cagr", "vol", "sharpe", "max_dd"), _with("dd", _SUM + ", ".join((_r("cagr", "cagr"), _r("vol", "vol"), _r(_RATIOS["sharpe"], "sharpe"), _r("max_dd", "max_dd"))) + " FROM g"))
query("downside_sortino_calmar", lambda s, d: m.summary(_rets(s, d)).select("ticker", "down", "sortino", "calmar"), _with("dd", _SUM + ", ".join((_r("down", "down"), _r(_RATIOS["sortino"], "sortino"), _r(_RATIOS["calmar"], "calmar"))) + " FROM g"))
query("var_cvar", lambda s, d: m.value_at_risk(_rets(s, d)), _with("rets", ", q AS (SELECT ticker, quantile_cont(ret, 0.05) AS var FROM rets GROUP BY ticker) SELECT ticker, " + _r("any_value(var)", "var") + ", " + _r("avg(CASE WHEN ret <= var THEN ret END)", "cvar") + " FROM rets JOIN q USING (ticker) GROUP BY ticker"))
query("distribution_shape", lambda s, d: m.shape(_rets(s, d)), _with("rets", f"SELECT ticker, {_r('skewness(ret)', 'skew')}, {_r('kurtosis(ret)', 'kurt')}, {_r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * 100', 'positive_pct')} FROM rets GROUP BY ticker"))
_CAP = "CASE WHEN count(CASE WHEN b {0} 0 THEN 1 END) = 0 THEN 0 ELSE (exp(sum(CASE WHEN b {0} 0 THEN ln(1 + ret) END) * 252 / count(CASE WHEN b {0} 0 THEN 1 END)) - 1) / (exp(sum(CASE WHEN b {0} 0 THEN ln(1 + b) END) * 252 / count(CASE WHEN b {0} 0 THEN 1 END)) - 1) * 100 END"
query(
    "benchmark_metrics",
    lambda s, d: m.against_benchmark(_rets(s, d), "N").drop("n"),
    _with("rets", ", j AS (SELECT x.ticker, x.ret, y.ret AS b FROM rets x JOIN rets y ON x.dt = y.dt WHERE x.ticker <> 'N' AND y.ticker = 'N'), g AS (SELECT ticker, count(*) AS k, regr_slope(ret, b) AS beta, regr_intercept(ret, b) * 252 AS alpha, regr_r2(ret, b) AS r2, corr(ret, b) AS corr, stddev_samp(ret - b) * sqrt(252) AS te, avg(ret - b) * 252 AS active, " + _CAGR + " AS cagr, " + _CAP.format(">") + " AS up_capture, " + _CAP.format("<") + " AS down_capture FROM j GROUP BY ticker) SELECT ticker, " + ", ".join(_r(x, x) for x in ("beta", "alpha", "r2", "corr", "te", "active", "cagr", "up_capture", "down_capture")) + ", " + _r("CASE WHEN te <> 0 THEN active / te ELSE 0 END", "info_ratio") + ", " + _r(f"CASE WHEN beta <> 0 THEN (cagr - {RISK_FREE}) / beta ELSE 0 END", "treynor") + " FROM g WHERE k >= 30"),
)
query("covariance_matrix", lambda s, d: m.covariances(_rets(s, d)).select("a", "b", (F.col("cov") * 10_000).alias("cov_bp"), "corr"), _with("rets", "SELECT x.ticker AS a, y.ticker AS b, " + _r("covar_samp(x.ret, y.ret) * 10000", "cov_bp") + ", " + _r("corr(x.ret, y.ret)", "corr") + " FROM rets x JOIN rets y ON x.dt = y.dt GROUP BY 1, 2"))
query("mean_vector", lambda s, d: _rets(s, d).groupBy("ticker").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.min("dt").alias("first"), F.count("*").alias("n")), _with("rets", f"SELECT ticker, {_r('avg(ret)', 'mean')}, {_r('stddev_samp(ret)', 'std')}, min(dt) AS \"first\", count(*) AS n FROM rets GROUP BY ticker"))

# -- rolling, calendar, episodes ----------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
query(
    "rolling_metrics_252",
    lambda s, d: m.rolling(_rets(s, d)),
    _with("rets", f", w AS (SELECT ticker, dt, count(*) {_W} AS k, exp(sum(ln(1 + ret)) {_W}) - 1 AS rr, stddev_samp(ret) {_W} * sqrt(252) AS rv, coalesce(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END) {_W}) * sqrt(252), 0.01) AS dn FROM rets), x AS (SELECT ticker, dt, CASE WHEN k = 252 THEN rr END AS rr, CASE WHEN k = 252 THEN rv END AS rv, CASE WHEN k = 252 THEN dn END AS dn FROM w) SELECT ticker, dt, {_r('rr', 'roll_ret')}, {_r('rv', 'roll_vol')}, {_r(f'(rr - {RISK_FREE}) / nullif(rv, 0)', 'roll_sharpe')}, {_r(f'(rr - {RISK_FREE}) / nullif(dn, 0)', 'roll_sortino')} FROM x"),
)
query(
    "rolling_max_drawdown_252",
    lambda s, d: m.rolling_max_drawdown(_rets(s, d)).where("roll_mdd is not null"),
    _with("v", ", n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS i FROM v), j AS (SELECT e.ticker, e.dt, b.value / max(b.value) OVER (PARTITION BY e.ticker, e.dt ORDER BY b.i) - 1 AS dd FROM n e JOIN n b ON b.ticker = e.ticker AND b.i BETWEEN e.i - 251 AND e.i WHERE e.i >= 252) SELECT ticker, dt, " + _r("min(dd)", "roll_mdd") + " FROM j GROUP BY ticker, dt"),
)
query("rolling_3y_5y", lambda s, d: m.multi_year(pf.backtest(prices(s, d), WEIGHTS), "portfolio").drop("portfolio"), _with("bt", f"SELECT dt, {_r('power(value / lag(value, 755) OVER (ORDER BY dt), 1 / 3.0) - 1', 'roll_3y')}, {_r('power(value / lag(value, 1259) OVER (ORDER BY dt), 1 / 5.0) - 1', 'roll_5y')} FROM bt"))
query("best_worst_year", lambda s, d: m.best_worst_year(_rets(s, d)), _with("rets", f", w AS (SELECT ticker, count(*) {_W} AS k, sum(ret) {_W} AS s FROM rets) SELECT ticker, {_r('max(CASE WHEN k = 252 THEN s END)', 'best_year')}, {_r('min(CASE WHEN k = 252 THEN s END)', 'worst_year')} FROM w GROUP BY ticker"))
_W63 = _W.replace("251", "62")
query("strategy_indicators", lambda s, d: m.indicators(_rets(s, d)).where("vol_y is not null"), _with("rets", f", w AS (SELECT ticker, dt, count(*) {_W63} AS k, avg(ret) {_W63} * 252 AS a, stddev_pop(ret) {_W63} * sqrt(252) AS v, sum(ret) {_W63} AS s FROM rets) SELECT ticker, dt, {_r('a', 'ret_y')}, {_r('v', 'vol_y')}, {_r('s', 'momentum')}, {_r('a / (v + 0.000001)', 'sharpe')} FROM w WHERE k = 63"))
query(
    "drawdown_episodes",
    lambda s, d: m.episodes(_rets(s, d)),
    _with("dd", ", n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS i, sum(CASE WHEN value = peak THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY dt) AS island FROM dd), g AS (SELECT ticker, island, min(dt) AS st, min(i) AS si, arg_min(dt, (dd, i)) AS tr, arg_min(i, (dd, i)) AS ti, min(dd) AS low FROM n GROUP BY ticker, island), e AS (SELECT *, lead(st) OVER (PARTITION BY ticker ORDER BY island) AS re, lead(si) OVER (PARTITION BY ticker ORDER BY island) AS ri FROM g) SELECT ticker, st AS \"start\", tr AS trough, re AS recovery, " + _r("low", "drawdown") + ", CAST(ti - si AS BIGINT) AS length, CAST(ri - ti AS BIGINT) AS recovery_days FROM e WHERE low <= -0.05"),
)
_MONTHS = ", ".join(_r(f"max(CASE WHEN mo = {k} THEN v END)", f"m{k:02d}") for k in range(1, 13))
query(
    "monthly_returns_pivot",
    lambda s, d: m.monthly(_rets(s, d)),
    _with("rets", ", mm AS (SELECT ticker, year(dt) * 12 + month(dt) - 1 AS q, exp(sum(ln(1 + ret))) - 1 AS v FROM rets GROUP BY 1, 2), sp AS (SELECT ticker, unnest(generate_series(min(q), max(q))) AS q FROM mm GROUP BY ticker), al AS (SELECT sp.ticker, sp.q // 12 AS y, sp.q % 12 + 1 AS mo, coalesce(mm.v, 0) AS v FROM sp LEFT JOIN mm ON sp.ticker = mm.ticker AND sp.q = mm.q) SELECT ticker, CAST(y AS BIGINT) AS \"year\", " + _MONTHS + ", " + _r("exp(sum(ln(1 + v))) - 1", "total") + " FROM al GROUP BY ticker, y"),
)
query("annual_returns", lambda s, d: m.annual(_rets(s, d)), _with("rets", 'SELECT ticker, CAST(year(dt) AS BIGINT) AS "year", ' + _r("exp(sum(ln(1 + ret))) - 1", "total") + " FROM rets GROUP BY 1, 2"))

# -- backtests ---------------------------------------------------------------------------------------------------------------

query("backtest_static_series", lambda s, d: pf.backtest(prices(s, d), WEIGHTS).drop("portfolio"), _with("bt", f"SELECT dt, {_r('ret', 'ret')}, {_r('value', 'value', 2)}, {_r('dd', 'dd')} FROM bt"), ("value",))
_WB = "OVER (ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
query(
    "backtest_static_metrics",
    lambda s, d: pf.backtest_metrics(pf.backtest(prices(s, d), WEIGHTS)).drop("portfolio", "n"),
    _with("bt", f", s AS (SELECT *, count(*) {_WB} AS k, sum(ret) {_WB} AS y FROM bt), g AS (SELECT arg_max(value, dt) AS final, count(*) AS n, {_VOL} AS vol, min(dd) AS max_dd, max(CASE WHEN k = 252 THEN y END) AS best_year, min(CASE WHEN k = 252 THEN y END) AS worst_year, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS down FROM s), h AS (SELECT *, power(final / 10000, 252.0 / n) - 1 AS cagr FROM g) SELECT {_r('final', 'final', 2)}, " + ", ".join(_r(x, x) for x in ("vol", "max_dd", "best_year", "worst_year", "down", "cagr")) + ", " + _r("cagr / vol", "sharpe") + ", " + _r("cagr / down", "sortino") + " FROM h"),
    ("final",),
)
_DCA = ", n AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS i FROM wide), u AS (SELECT dt, i, a, n, r, CASE WHEN i = 0 THEN 5000 / a WHEN i % 21 = 0 THEN 250 / a ELSE 0 END AS ua, CASE WHEN i = 0 THEN 3000 / n WHEN i % 21 = 0 THEN 150 / n ELSE 0 END AS un, CASE WHEN i = 0 THEN 2000 / r WHEN i % 21 = 0 THEN 100 / r ELSE 0 END AS ur FROM n) SELECT dt, CAST(i AS BIGINT) AS day, " + _r("a * sum(ua) OVER (ORDER BY dt) + n * sum(un) OVER (ORDER BY dt) + r * sum(ur) OVER (ORDER BY dt)", "value", 2) + ", " + _r("CAST(10000 + (i // 21) * 500 AS DOUBLE)", "invested", 2) + " FROM u"
query("dca_static", lambda s, d: pf.contributions(prices(s, d), WEIGHTS).drop("portfolio"), _with("wide", _DCA), ("value", "invested"))


def _momentum(s: SparkSession, d: str) -> DataFrame:
    return pf.contributions(prices(s, d), WEIGHTS, shares=pf.momentum_shares(WEIGHTS)).drop("portfolio")


def _mom_sql() -> str:
    parts = {"a": 0.5, "n": 0.3, "r": 0.2}
    moved = ", ".join(f"CASE WHEN count(r{x}) OVER l = 63 THEN sum(r{x}) OVER l END AS m{x}" for x in parts)
    rets = ", ".join(f"{x} / lag({x}) OVER (ORDER BY dt) - 1 AS r{x}" for x in parts)
    up = ", ".join(f"m{x} - least(ma, mn, mr) + 0.000001 AS u{x}" for x in parts)
    blend = ", ".join(f"greatest(0.5 * {w} + 0.5 * u{x} / (ua + un + ur), 0.05) AS b{x}" for x, w in parts.items())
    units = ", ".join(f"CASE WHEN i = 0 THEN 10000 * {w} / {x} WHEN i % 21 = 0 THEN coalesce(b{x} / (ba + bn + br), {w}) * 500 / {x} ELSE 0 END AS q{x}" for x, w in parts.items())
    value = " + ".join(f"{x} * sum(q{x}) OVER (ORDER BY dt)" for x in parts)
    return f", kr AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS i, {rets} FROM wide), k0 AS (SELECT *, {moved} FROM kr WINDOW l AS (ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)), k1 AS (SELECT *, {up} FROM k0), k2 AS (SELECT *, CASE WHEN ma IS NULL THEN NULL ELSE 1 END AS ok, {blend} FROM k1), k3 AS (SELECT *, {units.replace('coalesce(b', 'coalesce(ok * b')} FROM k2) SELECT dt, CAST(i AS BIGINT) AS day, " + _r(value, "value", 2) + ", " + _r("CAST(10000 + (i // 21) * 500 AS DOUBLE)", "invested", 2) + " FROM k3"


query("dca_momentum", _momentum, _with("wide", _mom_sql()), ("value", "invested"))
#: What each strategy of the fold buys, as SQL over drawdowns da, dn, dr, their total dt0, volatilities va, vn, vr and momentum ma.
_PV = "(0.5 * va + 0.3 * vn + 0.2 * vr + 0.000001)"
_SCALE = f"CASE WHEN va IS NULL THEN 1 ELSE least(greatest(0.15 / {_PV}, 0.5), 1.5) END"
_CHEAP = "(-{0} - least(-da, -dn, -dr) + 0.01)"
_RV = {x: f"least(0.5 * {w} + 0.5 * {_CHEAP.format('d' + x)} / ({_CHEAP.format('da')} + {_CHEAP.format('dn')} + {_CHEAP.format('dr')}), 0.5)" for x, w in (("a", 0.5), ("n", 0.3), ("r", 0.2))}
_RVT = f"({_RV['a']} + {_RV['n']} + {_RV['r']})"
_EVEN = "greatest(-da, -dn, -dr) - least(-da, -dn, -dr) <= 0.03"
_BUYS = {
    "static": ("0.5", "0.3", "0.2"),
    "buy_dip": tuple(f"CASE WHEN da >= -0.05 THEN {w} ELSE {x} END" for w, x in ((0.5, 0.8), (0.3, 0.12), (0.2, 0.08))),
    "dip_preset": tuple(f"CASE WHEN da >= -0.2 THEN {w} ELSE {x} END" for w, x in ((0.5, 0.5), (0.3, 0.3), (0.2, 0.2))),
    "protect": tuple(f"CASE WHEN dt0 < -0.05 THEN {x} ELSE {w} END" for w, x in ((0.5, 0), (0.3, 1), (0.2, 0))),
    "relative_value": tuple(f"CASE WHEN {_EVEN} THEN {w} ELSE {_RV[x]} / {_RVT} END" for x, w in (("a", 0.5), ("n", 0.3), ("r", 0.2))),
    "opportunistic": tuple(f"CASE WHEN da < -0.05 THEN {x} ELSE {w} END" for w, x in ((0.1, 0.4), (0.54, 0.36), (0.36, 0.24))),
    "volatility_target": tuple(f"{w} / (0.5 * ({_SCALE}) + 0.5)" for w in (f"0.5 * ({_SCALE})", "0.3", "0.2")),
    "dual_momentum": tuple(f"CASE WHEN ma IS NULL OR ma > 0 OR dt0 >= 0 THEN {w} ELSE {x} END" for w, x in ((0.5, 0), (0.3, 1), (0.2, 0))),
    "composite": tuple(f"CASE WHEN da >= -0.05 THEN {w} ELSE {x} END" for w, x in ((0.5, 0.65), (0.3, 0.21), (0.2, 0.14))),
    "conditional": tuple(f"CASE WHEN dt0 < -0.05 AND dn < -0.05 THEN {x} ELSE {w} END" for w, x in ((0.5, 0.5 / 0.7 * 0.4), (0.3, 0.6), (0.2, 0.2 / 0.7 * 0.4))),
}
_W21 = "OVER (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
_BOUGHT = ", ".join("CASE strategy " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in _BUYS.items()) + f" END AS w{x}" for i, x in enumerate("anr"))
# the days one after the other, all strategies together; on a day of a contribution what is held moves, then cash is added
_FOLD = (
    "WITH RECURSIVE " + ", ".join(f"{x} AS ({_CTES[x]})" for x in ("d", "p", "prices", "wide"))
    + ", f0 AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, a, n, r, " + ", ".join(f"{x} / lag({x}) OVER (ORDER BY dt) - 1 AS r{x}" for x in "anr") + " FROM wide)"
    + ", f1 AS (SELECT *, count(ra) " + _W21 + " AS k, " + ", ".join(f"stddev_pop(r{x}) {_W21} * sqrt(252) AS s{x}" for x in "anr") + f", sum(ra) {_W21} AS sm FROM f0)"
    + ", days AS MATERIALIZED (SELECT dt, i, 1 + ra AS ga, 1 + rn AS gn, 1 + rr AS gr, " + ", ".join(f"CASE WHEN k = 21 THEN s{x} END AS v{x}" for x in "anr") + ", CASE WHEN k = 21 THEN sm END AS ma FROM f1)"
    + ", st AS (SELECT CAST(0 AS BIGINT) AS i, dt, strategy, 5000.0::DOUBLE AS ha, 3000.0::DOUBLE AS hn, 2000.0::DOUBLE AS hr, 5000.0::DOUBLE AS pa, 3000.0::DOUBLE AS pn, 2000.0::DOUBLE AS pr, 10000.0::DOUBLE AS top, 10000.0::DOUBLE AS invested, NULL::DOUBLE AS wa, NULL::DOUBLE AS wn, NULL::DOUBLE AS wr, NULL::DOUBLE AS dt0, NULL::DOUBLE AS da, NULL::DOUBLE AS dn, NULL::DOUBLE AS dr FROM days, (SELECT unnest([" + ", ".join(f"'{k}'" for k in _BUYS) + "]) AS strategy) WHERE i = 0"
    + " UNION ALL SELECT i, dt, strategy, ha + CASE WHEN pays THEN 500 * wa ELSE 0 END, hn + CASE WHEN pays THEN 500 * wn ELSE 0 END, hr + CASE WHEN pays THEN 500 * wr ELSE 0 END, pa, pn, pr, top, invested + CASE WHEN pays THEN 500 ELSE 0 END, " + ", ".join(f"CASE WHEN pays THEN {x} END" for x in ("wa", "wn", "wr", "dt0", "da", "dn", "dr"))
    + f" FROM (SELECT *, {_BOUGHT} FROM (SELECT *, ha / pa - 1 AS da, hn / pn - 1 AS dn, hr / pr - 1 AS dr, (ha + hn + hr) / top - 1 AS dt0, i % 21 = 0 AS pays FROM (SELECT i, dt, strategy, ha, hn, hr, greatest(pa, ha) AS pa, greatest(pn, hn) AS pn, greatest(pr, hr) AS pr, greatest(top, ha + hn + hr) AS top, invested, va, vn, vr, ma FROM (SELECT y.i, y.dt, st.strategy, st.ha * ga AS ha, st.hn * gn AS hn, st.hr * gr AS hr, pa, pn, pr, top, invested, va, vn, vr, ma FROM st JOIN days y ON y.i = st.i + 1)))))"
)


_SAFE = {"risk_off_allocation": {"N": 1.0}}
_DIP = {"type": "buy_the_dip", "params": {"target_ticker": "A", "threshold": 0.05}}
#: The strategies of the queries.
STRATEGIES = {
    "static": {},
    "buy_dip": _DIP,
    "dip_preset": {"type": "dip_preset", "params": {"target_ticker": "A"}},
    "protect": {"type": "drawdown_protection", "params": _SAFE | {"threshold": 0.05}},
    "relative_value": {"type": "relative_value", "params": {"threshold": 0.03}},
    "opportunistic": {"type": "crypto_opportunistic", "params": {"crypto_ticker": "A", "equity_ticker": "N", "dip_threshold": 0.05}},
    "volatility_target": {"type": "volatility_target", "params": {"equity_tickers": ["A"]}},
    "dual_momentum": {"type": "dual_momentum", "params": {"equity_ticker": "A", "safe_ticker": "N"}},
    "composite": {"type": "composite", "params": {"parts": [({}, 1.0), (_DIP, 1.0)]}},
    "conditional": {"type": "conditional", "params": {"below": -0.05, "then": {"type": "buy_the_dip", "params": {"target_ticker": "N", "threshold": 0.05, "aggressive_weight": 0.6}}}},
}


def _book(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("p", t, w, i) for i, (t, w) in enumerate(WEIGHTS.items())], "portfolio string, ticker string, weight double, position long")


def _folds(s: SparkSession, d: str) -> DataFrame:
    p = prices(s, d)
    return sg.strategy_values(p, _book(s), sg.strategy_log(p, _book(s), STRATEGIES))


query("dca_strategies", lambda s, d: _folds(s, d).select("strategy", "dt", "value", "invested"), _FOLD + " SELECT strategy, dt, " + _r("ha + hn + hr", "value", 2) + ", " + _r("invested", "invested", 2) + " FROM st", ("value", "invested"))


def _dca_metrics(s: SparkSession, d: str) -> DataFrame:
    """Final value and growth rate of each strategy over what was invested on average."""
    g = _folds(s, d).groupBy("strategy").agg(F.max_by("value", "dt").alias("final"), F.max("invested").alias("invested"), F.count("*").alias("n"))
    base = 1 + (F.col("final") - F.col("invested")) / ((F.lit(10_000.0) + F.col("invested")) / 2)
    return g.select("strategy", "final", "invested", F.when(base > 0, F.pow(base, 252 / F.col("n")) - 1).alias("cagr"))


_FINAL = ", g AS (SELECT strategy, arg_max(ha + hn + hr, dt) AS v, max(invested) AS inv, count(*) AS n FROM st GROUP BY strategy) "
query("strategy_comparison", _dca_metrics, _FOLD + _FINAL + "SELECT strategy, " + _r("v", "final", 2) + ", " + _r("inv", "invested", 2) + ", " + _r("power(1 + (v - inv) / ((10000 + inv) / 2), 252.0 / n) - 1", "cagr") + " FROM g", ("final", "invested"))
_LOGGED = {"portfolio_dd": "dt0"} | {f"share_{x}": f"w{x}" for x in "anr"} | {f"dd_{x}": f"d{x}" for x in "anr"}


def _log(s: SparkSession, d: str) -> DataFrame:
    rows = sg.strategy_log(prices(s, d), _book(s), STRATEGIES).where("block > 0")
    return rows.select("strategy", "dt", F.col("fall").alias("portfolio_dd"), *(F.col("shares")[i].alias(f"share_{x}") for i, x in enumerate("anr")), *(F.col("falls")[i].alias(f"dd_{x}") for i, x in enumerate("anr")))


query("decision_log", _log, _FOLD + " SELECT strategy, dt, " + ", ".join(_r(v, k) for k, v in _LOGGED.items()) + " FROM st WHERE wa IS NOT NULL")

# -- timing ------------------------------------------------------------------------------------------------------------------

_ENTRY = ", n AS (SELECT ticker, dt, price, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i FROM prices), y AS (SELECT unnest([1, 3, 5, 10]) AS years), e AS (SELECT x.ticker, y.years, x.dt, z.price / x.price AS g FROM n x CROSS JOIN y JOIN n z ON z.ticker = x.ticker AND z.i = x.i + 252 * y.years WHERE x.i % 21 = 0) "
query("entry_points", lambda s, d: pf.entry_points(prices(s, d)), _with("prices", _ENTRY + "SELECT ticker, CAST(years AS BIGINT) AS years, dt, " + _r("(g - 1) * 100", "total_pct") + ", " + _r("(power(g, 1.0 / years) - 1) * 100", "cagr_pct") + " FROM e"))
query("entry_points_summary", lambda s, d: pf.entry_points(prices(s, d)).groupBy("ticker", "years").agg(F.count("*").alias("n"), F.max("cagr_pct").alias("best"), F.min("cagr_pct").alias("worst"), F.percentile("cagr_pct", 0.5).alias("median"), F.avg("cagr_pct").alias("mean"), (F.avg((F.col("total_pct") > 0).cast("double")) * 100).alias("profit_pct")), _with("prices", _ENTRY + ", f AS (SELECT ticker, years, (g - 1) * 100 AS t, (power(g, 1.0 / years) - 1) * 100 AS c FROM e) SELECT ticker, CAST(years AS BIGINT) AS years, count(*) AS n, " + ", ".join((_r("max(c)", "best"), _r("min(c)", "worst"), _r("quantile_cont(c, 0.5)", "median"), _r("avg(c)", "mean"), _r("avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END) * 100", "profit_pct"))) + " FROM f GROUP BY ticker, years"))
_LS = ", n AS (SELECT ticker, dt, price, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i, lead(price, 1260) OVER (PARTITION BY ticker ORDER BY dt) AS z, " + " + ".join(f"1000 / lead(price, {k * 21}) OVER (PARTITION BY ticker ORDER BY dt)" for k in range(12)) + " AS u FROM prices), l AS (SELECT ticker, dt, z / price * 12000 AS lump_sum, z * u AS monthly FROM n WHERE i % 21 = 0 AND z IS NOT NULL AND u IS NOT NULL) SELECT ticker, "
query("lump_sum_vs_dca", lambda s, d: pf.lump_sum_or_monthly(prices(s, d)), _with("prices", _LS + "dt, " + ", ".join((_r("lump_sum", "lump_sum", 2), _r("monthly", "monthly", 2), _r("lump_sum - monthly", "diff", 2))) + " FROM l"), ("lump_sum", "monthly", "diff"))
query("lump_sum_vs_dca_summary", lambda s, d: pf.lump_sum_or_monthly(prices(s, d)).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.percentile("diff", 0.5).alias("median_diff"), F.avg((F.col("diff") > 0).cast("double")).alias("win_rate")), _with("prices", _LS + "count(*) AS n, " + ", ".join((_r("avg(lump_sum - monthly)", "mean_diff", 2), _r("quantile_cont(lump_sum - monthly, 0.5)", "median_diff", 2), _r("avg(CASE WHEN lump_sum > monthly THEN 1.0 ELSE 0.0 END)", "win_rate"))) + " FROM l GROUP BY ticker"), ("mean_diff", "median_diff"))

# -- intervals ---------------------------------------------------------------------------------------------------------------


def _known(s: SparkSession, d: str) -> DataFrame:
    return iv.islands(order_days(s, d), GAP)


def _asked(s: SparkSession, d: str) -> DataFrame:
    span = order_days(s, d).select("ticker").distinct().selectExpr("ticker", "date'1994-01-01' AS lo", "date'1997-12-31' AS hi")
    return span.unionByName(s.range(1).selectExpr("'9-NEVER SEEN' AS ticker", "date'1994-01-01' AS lo", "date'1997-12-31' AS hi")).unionByName(s.range(1).selectExpr("'1-URGENT' AS ticker", "date'1991-01-01' AS lo", "date'1992-06-30' AS hi"))


query("date_islands", _known, _with("isl", "SELECT * FROM isl"))
query("find_gaps", lambda s, d: iv.gaps(order_days(s, d), GAP), _with("od1", f"SELECT ticker, CAST(prev + INTERVAL 1 DAY AS DATE) AS \"start\", CAST(dt - INTERVAL 1 DAY AS DATE) AS \"end\", CAST(date_diff('day', prev, dt) AS BIGINT) AS days FROM od1 WHERE date_diff('day', prev, dt) > {GAP}"))
query("interval_bounds", lambda s, d: _known(s, d).groupBy("ticker").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")), _with("isl", 'SELECT ticker, min("start") AS "start", max("end") AS "end", count(*) AS n FROM isl GROUP BY ticker'))
query("interval_union", lambda s, d: iv.union(_known(s, d).select("ticker", "start", F.date_add("end", 5).alias("end"))), _with("isl", ', x AS (SELECT ticker, "start" AS a, CAST("end" + INTERVAL 5 DAY AS DATE) AS b FROM isl), y AS (SELECT *, max(b) OVER (PARTITION BY ticker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x), z AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY a, b) AS g FROM y) SELECT ticker, min(a) AS "start", max(b) AS "end" FROM z GROUP BY ticker, g'))
query("interval_coverage", lambda s, d: iv.coverage(_known(s, d), _asked(s, d)), _with("isl req", ', c AS (SELECT req.ticker, lo, hi, greatest(date_diff(\'day\', greatest("start", lo), least("end", hi)) + 1, 0) AS n, "start" <= lo AND "end" >= hi AS w FROM req LEFT JOIN isl ON isl.ticker = req.ticker) SELECT ticker, CAST(coalesce(sum(n), 0) AS BIGINT) AS covered_days, CAST(date_diff(\'day\', lo, hi) + 1 AS BIGINT) AS requested_days, ' + _r("coalesce(sum(n), 0) / CAST(date_diff('day', lo, hi) + 1 AS DOUBLE)", "ratio") + ", bool_or(coalesce(w, false)) AS whole FROM c GROUP BY ticker, lo, hi"))
query("interval_missing", lambda s, d: iv.missing(_known(s, d), _asked(s, d)), _with("isl req", ", days AS (SELECT ticker, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt FROM req), un AS (SELECT days.ticker, days.lo, days.dt FROM days WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.ticker = days.ticker AND days.dt BETWEEN isl.\"start\" AND isl.\"end\")), k AS (SELECT ticker, lo, dt, date_diff('day', DATE '1970-01-01', dt) - row_number() OVER (PARTITION BY ticker, lo ORDER BY dt) AS g FROM un) SELECT ticker, min(dt) AS \"start\", max(dt) AS \"end\" FROM k GROUP BY ticker, lo, g"))
query("interval_json_roundtrip", lambda s, d: iv.from_text(iv.to_text(_known(s, d))), _with("isl", 'SELECT ticker, "start", "end" FROM isl'))
query("coverage_report", lambda s, d: order_days(s, d).groupBy("ticker").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count("*").alias("days")).join(_known(s, d).groupBy("ticker").agg(F.count("*").alias("intervals")), "ticker"), _with("od isl", ', i AS (SELECT ticker, count(*) AS intervals FROM isl GROUP BY ticker) SELECT od.ticker, min(dt) AS "first", max(dt) AS "last", count(*) AS days, any_value(intervals) AS intervals FROM od JOIN i ON i.ticker = od.ticker GROUP BY od.ticker'))
query("latest_common_date", lambda s, d: prices(s, d).groupBy("ticker").agg(F.min("dt").alias("a"), F.max("dt").alias("b")).agg(F.max("a").alias("global_start"), F.min("b").alias("latest_common")), _with("prices", ", b AS (SELECT min(dt) AS x, max(dt) AS y FROM prices GROUP BY ticker) SELECT max(x) AS global_start, min(y) AS latest_common FROM b"))
query("stale_tickers", lambda s, d: order_days(s, d).groupBy("ticker").agg(F.max("dt").alias("last")).crossJoin(order_days(s, d).agg(F.max("dt").alias("now"))).select("ticker", "last", F.datediff("now", "last").cast("long").alias("behind")), _with("od", ", l AS (SELECT ticker, max(dt) AS last FROM od GROUP BY ticker) SELECT ticker, last, CAST(date_diff('day', last, (SELECT max(dt) FROM od)) AS BIGINT) AS behind FROM l"))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    old = prices(s, d)
    new = old.where("dt between date'1995-03-01' and date'1995-06-30' and day(dt) % 2 = 0").withColumn("price", F.col("price") * 2)
    return iv.replace_range(old, new)


query("replace_range_upsert", _upsert, _with("prices", ", nw AS (SELECT ticker, dt, price * 2 AS price FROM prices WHERE dt BETWEEN DATE '1995-03-01' AND DATE '1995-06-30' AND extract(day FROM dt) % 2 = 0), sp AS (SELECT ticker, min(dt) AS lo, max(dt) AS hi FROM nw GROUP BY ticker), al AS (SELECT prices.* FROM prices LEFT JOIN sp ON sp.ticker = prices.ticker WHERE lo IS NULL OR dt < lo OR dt > hi UNION ALL SELECT * FROM nw) SELECT ticker, dt, " + _r("price", "price", 2) + " FROM al"), ("price",))


def _repair(s: SparkSession, d: str) -> DataFrame:
    """What a metadata table that lost a ticker and has a wrong bound needs."""
    true = order_days(s, d).groupBy("ticker").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    kept = true.where("ticker <> '1-URGENT'").select("ticker", F.when(F.col("ticker") == "2-HIGH", F.date_add("first", 1)).otherwise(F.col("first")).alias("f"), F.col("last").alias("l"))
    same = F.col("first").eqNullSafe(F.col("f")) & F.col("last").eqNullSafe(F.col("l"))
    return true.join(kept, "ticker", "full_outer").select("ticker", "first", "last", F.when(F.col("f").isNull(), "CREATE").when(same, "OK").otherwise("FIXING").alias("status"))


query("metadata_repair_diff", _repair, _with("od", "SELECT ticker, min(dt) AS \"first\", max(dt) AS \"last\", CASE WHEN ticker = '1-URGENT' THEN 'CREATE' WHEN ticker = '2-HIGH' THEN 'FIXING' ELSE 'OK' END AS status FROM od GROUP BY ticker"))

# -- optimisation and simulation ---------------------------------------------------------------------------------------------

_GRID = ", g AS (SELECT x / 10.0 AS wa, y / 10.0 AS wn, (10 - x - y) / 10.0 AS wr FROM (SELECT unnest(generate_series(0, 10)) AS x) CROSS JOIN (SELECT unnest(generate_series(0, 10)) AS y) WHERE x + y <= 10), q AS (SELECT a / lag(a) OVER (ORDER BY dt) - 1 AS ra, n / lag(n) OVER (ORDER BY dt) - 1 AS rn, r / lag(r) OVER (ORDER BY dt) - 1 AS rr FROM wide), k AS (SELECT avg(ra) AS ea, avg(rn) AS en, avg(rr) AS er, var_samp(ra) AS aa, var_samp(rn) AS nn, var_samp(rr) AS cc, covar_samp(ra, rn) AS an, covar_samp(ra, rr) AS ar, covar_samp(rn, rr) AS nr FROM q WHERE ra IS NOT NULL), s AS (SELECT wa, wn, wr, 252 * (wa * ea + wn * en + wr * er) AS ret, wa * (wa * aa + wn * an + wr * ar) AS ca, wn * (wa * an + wn * nn + wr * nr) AS cn, wr * (wa * ar + wn * nr + wr * cc) AS c3 FROM g CROSS JOIN k), o AS (SELECT *, sqrt(252 * (ca + cn + c3)) AS vol, sqrt(ca + cn + c3) AS sd FROM s) "
_POINT = ", ".join((_r("CAST(wa AS DOUBLE)", "w0"), _r("CAST(wn AS DOUBLE)", "w1"), _r("CAST(wr AS DOUBLE)", "w2"), _r("ret", "ret"), _r("vol", "vol"), _r("CASE WHEN vol <> 0 THEN (ret - 0.04) / vol ELSE 0 END", "sharpe")))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return pf.score_weights(prices(s, d), tuple(WEIGHTS)).withColumn("risk_spread", F.col("risk_spread") * 1e6)


query("opt_grid", _scores, _with("wide", _GRID + "SELECT " + _POINT + ", " + _r("(power(ca / sd - sd / 3, 2) + power(cn / sd - sd / 3, 2) + power(c3 / sd - sd / 3, 2)) * 1000000", "risk_spread") + " FROM o"))
query("opt_min_volatility", lambda s, d: _scores(s, d).drop("risk_spread").orderBy("vol", "w0", "w1").limit(1), _with("wide", _GRID + "SELECT " + _POINT + " FROM o ORDER BY vol, wa, wn LIMIT 1"))
query("opt_top_n", lambda s, d: _scores(s, d).drop("risk_spread").orderBy(F.desc("sharpe"), "w0", "w1").limit(10), _with("wide", _GRID + "SELECT " + _POINT + " FROM o ORDER BY sharpe DESC, wa, wn LIMIT 10"))

SIMS, DAYS = 200, 252
_U = "((((({sim} * 7919 + {day} * 104729 + {seed}) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) / 2147483648.0"
_U1 = _U.format(sim="sim", day="day", seed=42)
_GRIDS = f", gr AS (SELECT sim, day FROM (SELECT unnest(generate_series(0, {SIMS - 1})) AS sim) CROSS JOIN (SELECT unnest(generate_series(1, {DAYS})) AS day)), h AS (SELECT ret, row_number() OVER (ORDER BY dt) AS k, count(*) OVER () AS n FROM pr WHERE ret IS NOT NULL), "
_Z = {k: f"sqrt(-2 * ln(greatest({_U.format(sim='sim', day='day', seed=42 + 2 * k)}, 1e-9))) * cos({_U.format(sim='sim', day='day', seed=43 + 2 * k)} * 2 * pi())" for k in range(3)}
# the root of a matrix of three rows, written out
_CORRELATED = (
    "q AS (SELECT a / lag(a) OVER (ORDER BY dt) - 1 AS ra, n / lag(n) OVER (ORDER BY dt) - 1 AS rn, r / lag(r) OVER (ORDER BY dt) - 1 AS rr FROM wide), mo AS (SELECT avg(ra) AS ea, avg(rn) AS en, avg(rr) AS er, var_samp(ra) AS aa, var_samp(rn) AS nn, var_samp(rr) AS cc, covar_samp(ra, rn) AS an, covar_samp(ra, rr) AS ar, covar_samp(rn, rr) AS nr FROM q WHERE ra IS NOT NULL), "
    "l1 AS (SELECT *, sqrt(aa) AS l11, an / sqrt(aa) AS l21, ar / sqrt(aa) AS l31 FROM mo), l2 AS (SELECT *, sqrt(nn - l21 * l21) AS l22 FROM l1), l3 AS (SELECT *, (nr - l31 * l21) / l22 AS l32 FROM l2), l4 AS (SELECT *, sqrt(cc - l31 * l31 - l32 * l32) AS l33 FROM l3), "
    f"zs AS (SELECT sim, day, {_Z[0]} AS z0, {_Z[1]} AS z1, {_Z[2]} AS z2 FROM gr), xs AS (SELECT sim, day, ea - 0.5 * aa + l11 * z0 AS xa, en - 0.5 * nn + l21 * z0 + l22 * z1 AS xn, er - 0.5 * cc + l31 * z0 + l32 * z1 + l33 * z2 AS xr FROM zs CROSS JOIN l4), "
    "sr AS (SELECT sim, day, 0.5 * ({a}) + 0.3 * ({n}) + 0.2 * ({r}) AS ret FROM xs), "
)
_DRAWS = {
    "bootstrap": f"sr AS (SELECT sim, day, h.ret FROM gr JOIN h ON h.k = CAST(floor({_U1} * (SELECT max(n) FROM h)) AS BIGINT) + 1), ",
    "gbm": _CORRELATED.format(a="exp(xa) - 1", n="exp(xn) - 1", r="exp(xr) - 1"),
    "parametric": _CORRELATED.format(a="xa", n="xn", r="xr"),
}
_PATHS = "pv AS (SELECT sim, day, 10000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY sim ORDER BY day)) AS value FROM sr), pa AS (SELECT *, value / greatest(max(value) OVER (PARTITION BY sim ORDER BY day), 10000) - 1 AS dd FROM pv) "


def _paths(method: str) -> Query:
    return lambda s, d: pf.simulated_paths(pf.simulated_returns(prices(s, d), WEIGHTS, SIMS, DAYS, method))


for _method in ("bootstrap", "gbm", "parametric"):
    query(f"mc_{_method}_paths", _paths(_method), _with("pr wide", _GRIDS + _DRAWS[_method] + _PATHS + f"SELECT CAST(sim AS BIGINT) AS sim, CAST(day AS BIGINT) AS day, {_r('value', 'value', 2)}, {_r('dd', 'dd')} FROM pa"), ("value",))
query("mc_statistics", lambda s, d: pf.simulation_statistics(_paths("bootstrap")(s, d), DAYS / 252), _with("pr", _GRIDS + _DRAWS["bootstrap"] + _PATHS + ", f AS (SELECT sim, arg_max(value, day) AS v, min(dd) AS mdd, arg_max(value, day) / 10000 - 1 AS c FROM pa GROUP BY sim) SELECT " + ", ".join((_r("avg(v)", "mean_final", 2), _r("quantile_cont(v, 0.5)", "median_final", 2), _r("avg(c)", "mean_cagr"), _r("quantile_cont(c, 0.5)", "median_cagr"), _r("stddev_pop(c)", "std_cagr"), _r("quantile_cont(mdd, 0.5)", "median_mdd"), _r("min(mdd)", "worst_mdd"), _r("quantile_cont(mdd, 0.05)", "p5_mdd"), _r("avg(CASE WHEN v < 10000 THEN 1.0 ELSE 0.0 END)", "p_loss"), _r("avg(CASE WHEN v >= 20000 THEN 1.0 ELSE 0.0 END)", "p_double"))) + " FROM f"), ("mean_final", "median_final"))
query("mc_trajectory_bands", lambda s, d: pf.bands(_paths("bootstrap")(s, d)), _with("pr", _GRIDS + _DRAWS["bootstrap"] + _PATHS + "SELECT CAST(day AS BIGINT) AS day, " + ", ".join(_r(f"quantile_cont(value, {q})", n, 2) for q, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))) + " FROM pa WHERE day % 21 = 0 GROUP BY day"), ("p5", "p50", "p95"))

#: The full size: too slow as SQL, so these have none; the queries above are the same code in small.
FULL_SIMS, FULL_DAYS = 10_000, 2520


def _full_paths(s: SparkSession, d: str) -> DataFrame:
    return pf.simulated_paths(pf.simulated_returns(prices(s, d), WEIGHTS, FULL_SIMS, FULL_DAYS, "bootstrap"))


query("mc_statistics_full", lambda s, d: pf.simulation_statistics(_full_paths(s, d), FULL_DAYS / 252))
query("mc_trajectory_bands_full", lambda s, d: pf.bands(_full_paths(s, d)))
