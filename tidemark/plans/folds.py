"""Strategies over many portfolios: the keyed fold, its decisions, and what the configurations say."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import strategies as sg
from tidemark.plans.catalog import STRATEGIES, _r, _with, query
from tidemark.plans.extended import _HELD, _values, weights
from tidemark.sources.prices import prices

#: The portfolios of the folds; "pair" lacks a ticker that some strategies ask for, "alone" is all in one.
BOOKS = [*_HELD, ("heavy", "R", 0.7), ("heavy", "N", 0.2), ("heavy", "A", 0.1), ("pair", "A", 0.5), ("pair", "R", 0.5)]
FOLDED = STRATEGIES | {
    "momentum": {"type": "momentum", "params": {"lookback": 63}},
    "momentum_short": {"type": "momentum", "params": {"lookback": 10, "tilt_strength": 1.0, "min_weight": 0.0}},
    "volatility_long": {"type": "volatility_target", "params": {"lookback": 126, "target_vol": 0.3, "equity_tickers": ["A", "R"]}},
    "unprotected": {"type": "drawdown_protection", "params": {}},
}

# -- the same in SQL: lists in the order of tickers ------------------------------------------------------------------------------------


def _each(expression: str) -> str:
    return f"list_transform(range(1, len(base) + 1), lambda k: {expression})"


def _norm(x: str) -> str:
    return f"list_transform({x}, lambda v: v / list_sum({x}))"


def _at(ticker: str, of: str) -> str:
    return f"{of}[list_position(tk, '{ticker}')]"


def _dip(ticker: str, threshold: float, most: float) -> str:
    others = f"(list_sum(base) - {_at(ticker, 'base')})"
    return f"CASE WHEN {_at(ticker, 'falls')} < -{threshold} THEN {_each(f"CASE WHEN tk[k] = '{ticker}' THEN {most} WHEN {others} > 0 THEN base[k] / {others} * (1 - {most}) ELSE 0 END")} ELSE base END"


def _safe(ticker: str) -> str:
    return f"CASE WHEN list_contains(tk, '{ticker}') THEN {_each(f"CASE WHEN tk[k] = '{ticker}' THEN 1.0 ELSE 0 END")} ELSE {_each('0.0')} END"


def _tilt(m: str, tilt: float, least: float) -> str:
    up = f"({m}[k] - list_min({m}) + 0.000001) / (list_sum({m}) - len(base) * list_min({m}) + len(base) * 0.000001)"
    return f"CASE WHEN {m}[1] IS NULL THEN base ELSE {_norm(_each(f'greatest({1 - tilt} * base[k] + {tilt} * {up}, {least})'))} END"


def _target(v: str, target: float, risky: str) -> str:
    scale = f"least(greatest({target} / (list_sum({_each(f'{v}[k] * base[k]')}) + 0.000001), 0.5), 1.5)"
    scaled = _each(f"CASE WHEN tk[k] IN ({risky}) THEN base[k] * {scale} ELSE base[k] END")
    return f"CASE WHEN {v}[1] IS NULL THEN base ELSE {_norm(scaled)} END"


_CHEAP = "(-falls[k] + list_max(falls) + 0.01) / (list_max(falls) * len(base) - list_sum(falls) + 0.01 * len(base))"
_OWN = f"CASE WHEN {_at('A', 'falls')} < -0.05 THEN 0.4 ELSE 0.1 END"
_BUYS = {
    "static": "base",
    "buy_dip": _dip("A", 0.05, 0.8),
    "dip_preset": _dip("A", 0.2, 0.5),
    "protect": f"CASE WHEN fall < -0.05 THEN {_safe('N')} ELSE base END",
    "relative_value": f"CASE WHEN list_max(falls) - list_min(falls) > 0.03 THEN {_norm(_each(f'least(0.5 * base[k] + 0.5 * {_CHEAP}, 0.5)'))} ELSE base END",
    "opportunistic": f"CASE WHEN list_contains(tk, 'A') AND list_contains(tk, 'N') THEN {_each(f"CASE WHEN tk[k] = 'A' THEN {_OWN} ELSE base[k] * (1 - ({_OWN})) / (1 - {_at('A', 'base')}) END")} ELSE base END",
    "volatility_target": _target("v21", 0.15, "'A'"),
    "dual_momentum": f"CASE WHEN coalesce({_at('A', 'm21')} > 0, true) OR fall >= 0 THEN base ELSE {_safe('N')} END",
    "composite": _norm(_each(f"(base[k] + ({_dip('A', 0.05, 0.8)})[k]) / 2")),
    "conditional": f"CASE WHEN fall < -0.05 THEN {_dip('N', 0.05, 0.6)} ELSE base END",
    "momentum": _tilt("m63", 0.5, 0.05),
    "momentum_short": _tilt("m21", 1.0, 0.0),
    "volatility_long": _target("v126", 0.3, "'A', 'R'"),
    "unprotected": "base",
}
_FIGURES = ", ".join(f"CASE WHEN count(q) OVER w{n} = {n} THEN {f} OVER w{n}{more} END AS {x}{n}" for n in (21, 63, 126) for x, f, more in (("v", "stddev_pop(q)", " * sqrt(252)"), ("m", "sum(q)", "")))
_LISTS = ", ".join(f"list({x} ORDER BY ticker) AS {y}" for x, y in [("ticker", "tk"), ("weight", "base"), ("price", "p"), ("1 + r", "g"), *((f"{x}{n}", f"{x}{n}") for n in (21, 63, 126) for x in "vm")])


def _zip(a: str, b: str, f: str) -> str:
    return f"list_transform(range(1, len(base) + 1), lambda k: {f.format(a=f'{a}[k]', b=f'{b}[k]')})"


_BOOK_FOLD = (
    ", pw AS (SELECT portfolio, upper(trim(ticker)) AS ticker, weight, count(*) OVER (PARTITION BY portfolio) AS c FROM " + _values(BOOKS, "portfolio, ticker, weight") + ")"
    ", j0 AS (SELECT pw.*, p.dt, p.price, count(*) OVER (PARTITION BY portfolio, p.dt) AS n FROM prices p JOIN pw ON pw.ticker = p.ticker)"
    ", j1 AS (SELECT *, dense_rank() OVER (PARTITION BY portfolio ORDER BY dt) - 1 AS day, price / lag(price) OVER (PARTITION BY portfolio, ticker ORDER BY dt) - 1 AS q FROM j0 WHERE n = c)"
    f", j2 AS (SELECT *, coalesce(q, 0) AS r, {_FIGURES} FROM j1 WINDOW " + ", ".join(f"w{n} AS (PARTITION BY portfolio, ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (21, 63, 126)) + ")"
    f", days AS MATERIALIZED (SELECT portfolio, day, dt, {_LISTS} FROM j2 GROUP BY portfolio, day, dt)"
    ", st AS (SELECT portfolio, strategy, day, dt, list_transform(base, lambda v: v * 10000.0) AS held, list_transform(base, lambda v: v * 10000.0) AS peaks, list_sum(base) * 10000.0 AS top, 10000.0::DOUBLE AS invested, CAST(NULL AS DOUBLE[]) AS shares, CAST(NULL AS DOUBLE) AS fall, CAST(NULL AS DOUBLE[]) AS falls FROM days, (SELECT unnest([" + ", ".join(f"'{k}'" for k in FOLDED) + "]) AS strategy) WHERE day = 0"
    f" UNION ALL SELECT portfolio, strategy, day, dt, CASE WHEN pays THEN {_zip('held', 'buys', '{a} + 500 * {b}')} ELSE held END, peaks, top, invested + CASE WHEN pays THEN 500 ELSE 0 END, CASE WHEN pays THEN buys END, CASE WHEN pays THEN fall END, CASE WHEN pays THEN falls END"
    " FROM (SELECT *, CASE WHEN NOT pays THEN NULL " + " ".join(f"WHEN strategy = '{k}' THEN {v}" for k, v in _BUYS.items()) + " END AS buys"
    f" FROM (SELECT *, {_zip('held', 'peaks', '{a} / {b} - 1')} AS falls, list_sum(held) / top - 1 AS fall, day % 21 = 0 AS pays"
    f" FROM (SELECT * EXCLUDE (peaks, top), {_zip('peaks', 'held', 'greatest({a}, {b})')} AS peaks, greatest(top, list_sum(held)) AS top"
    f" FROM (SELECT y.*, st.strategy, {_zip('st.held', 'y.g', '{a} * {b}')} AS held, st.peaks, st.top, st.invested FROM st JOIN days y ON y.portfolio = st.portfolio AND y.day = st.day + 1)))))"
)


def _log(s: SparkSession, d: str) -> DataFrame:
    return sg.strategy_log(prices(s, d), weights(s, BOOKS), FOLDED)


def _fold_sql(sql: str) -> str:
    return _with("prices", _BOOK_FOLD + sql).replace("WITH ", "WITH RECURSIVE ", 1)


query("books_strategy_values", lambda s, d: sg.strategy_values(prices(s, d), weights(s, BOOKS), _log(s, d)).drop("day"), _fold_sql(" SELECT portfolio, strategy, dt, " + _r("list_sum(held)", "value", 2) + ", " + _r("invested", "invested", 2) + " FROM st"), ("value", "invested"))
query("books_strategy_decisions", lambda s, d: _log(s, d).where("block > 0").select("portfolio", "strategy", "dt", F.col("fall").alias("portfolio_dd"), F.explode(F.arrays_zip("tickers", "shares", "falls")).alias("a")).select("portfolio", "strategy", "dt", "portfolio_dd", F.col("a.tickers").alias("ticker"), F.col("a.shares").alias("share"), F.col("a.falls").alias("asset_dd")), _fold_sql(", lg AS (SELECT st.portfolio, strategy, st.dt, fall, unnest(tk) AS ticker, unnest(shares) AS sh, unnest(falls) AS fl FROM st JOIN days ON days.portfolio = st.portfolio AND days.day = st.day WHERE shares IS NOT NULL) SELECT portfolio, strategy, dt, " + _r("fall", "portfolio_dd") + ", ticker, " + _r("sh", "share") + ", " + _r("fl", "asset_dd") + " FROM lg"))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """What each configuration says, beside how often it bought something else than the weights."""
    told = s.createDataFrame([(k, json.dumps(sg.strategy_from(v).summary())) for k, v in FOLDED.items()], "strategy string, summary string")
    base = weights(s, BOOKS).selectExpr("portfolio", "upper(trim(ticker)) AS ticker", "weight").groupBy("portfolio").agg(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "weight"))), lambda x: x["weight"]).alias("base"))
    moved = F.exists(F.zip_with("shares", "base", lambda a, b: F.abs(a - b)), lambda x: x > 1e-9)
    counts = _log(s, d).where("block > 0").join(base, "portfolio").groupBy("strategy").agg(F.count("*").alias("decisions"), F.count_if(moved).alias("moved"))
    return counts.join(told, "strategy")


query("strategy_summaries", _summaries, _fold_sql(", sm(strategy, summary) AS (VALUES " + ", ".join(f"('{k}', '{json.dumps(sg.strategy_from(v).summary())}')" for k, v in FOLDED.items()) + "), cn AS (SELECT st.strategy, count(*) AS decisions, count(CASE WHEN list_max(list_transform(range(1, len(base) + 1), lambda k: abs(shares[k] - base[k]))) > 1e-9 THEN 1 END) AS moved FROM st JOIN days ON days.portfolio = st.portfolio AND days.day = st.day WHERE shares IS NOT NULL GROUP BY st.strategy) SELECT cn.strategy, decisions, moved, summary FROM cn JOIN sm ON sm.strategy = cn.strategy"))
