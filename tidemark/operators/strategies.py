"""Strategies from configurations, and the fold of what a portfolio holds under each, keyed by (portfolio, strategy), all in columns.

A strategy says how the cash of a contribution is shared among the assets, from the drawdowns of what is held and from figures of the last
returns. Between two contributions nothing is bought, so the fold goes from one contribution to the next: its state is the units of each
asset, the peaks of their values and the peak of the whole. Values of single days are a join of prices with the units held then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import YEAR
from tidemark.operators.books import held_days, tidy_weights

#: Rows that every strategy's figures look back at least.
LEAST_LOOKBACK = 21
SMALL = 1e-6


@dataclass(frozen=True)
class State:
    """What a strategy sees on the day of a contribution: arrays in the order of ``tickers``. Volatility and momentum are null until there are
    enough returns."""

    tickers: Column
    base: Column
    falls: Column
    fall: Column
    volatility: Callable[[int], Column]
    momentum: Callable[[int], Column]


@dataclass(frozen=True)
class Strategy:
    name: str
    shares: Callable[[State], Column]
    lookback: int = 0
    told: dict[str, str] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return max(LEAST_LOOKBACK, self.lookback)

    def summary(self) -> dict[str, str]:
        return {"name": self.name, **self.told}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _place(state: State, ticker: str) -> Column:
    """Where a ticker stands, -1 if the portfolio lacks it."""
    return (F.array_position(state.tickers, ticker.upper()) - 1).cast("int")


def _over_sum(shares: Column) -> Column:
    return _let(shares, lambda x: _let(_sum(x), lambda s: F.transform(x, lambda v: v / s)))


def _percent(x: float) -> str:
    return f"{x * 100:.0f}%"


def static() -> Strategy:
    return Strategy("Static DCA", lambda s: s.base)


def buy_the_dip(ticker: str, threshold: float = 0.10, aggressive: float = 0.80) -> Strategy:
    """Most of the cash into one asset while it is down; the rest at the weights of the others."""

    def shares(s: State) -> Column:
        at = _place(s, ticker)
        others = _sum(s.base) - F.get(s.base, at)
        bought = F.transform(s.base, lambda w, k: F.when(k == at, aggressive).when(others > 0, w / others * (1 - aggressive)).otherwise(0.0))
        return F.when(F.get(s.falls, at) < -threshold, bought).otherwise(s.base)

    return Strategy(f"Buy the Dip ({ticker.upper()})", shares, told={"target": ticker.upper(), "threshold": _percent(threshold), "aggressive_weight": _percent(aggressive)})


def momentum(lookback: int = 63, tilt: float = 0.5, least: float = 0.05) -> Strategy:
    """The weights blended with how much more each asset's last returns sum to than the lowest's."""

    def shares(s: State) -> Column:
        def tilted(m: Column) -> Column:
            up = _over_sum(_let(F.array_min(m), lambda low: F.transform(m, lambda x: x - low + SMALL)))
            return _over_sum(F.zip_with(s.base, up, lambda w, u: F.greatest((1 - tilt) * w + tilt * u, F.lit(least))))

        return _let(s.momentum(lookback), lambda m: F.when(m.isNull(), s.base).otherwise(tilted(m)))

    return Strategy("Momentum Tilt", shares, lookback)


def volatility_target(target: float = 0.15, lookback: int = 21, risky: tuple[str, ...] = ()) -> Strategy:
    """The risky assets scaled by how far the weighted volatility is from the target, by 0.5 to 1.5."""

    def shares(s: State) -> Column:
        names = F.array(*(F.lit(t.upper()) for t in risky)).cast("array<string>")

        def scaled(v: Column) -> Column:
            scale = F.least(F.greatest(target / (_sum(F.zip_with(v, s.base, lambda x, w: x * w)) + SMALL), F.lit(0.5)), F.lit(1.5))
            return _over_sum(_let(scale, lambda x: F.zip_with(s.base, s.tickers, lambda w, t: F.when(F.array_contains(names, t), w * x).otherwise(w))))

        return _let(s.volatility(lookback), lambda v: F.when(v.isNull(), s.base).otherwise(scaled(v)))

    return Strategy("Volatility Target", shares, lookback)


def drawdown_protection(threshold: float = 0.15, safe: dict[str, float] | None = None) -> Strategy:
    """A safe allocation while the portfolio is down; without one the weights. Tickers that the portfolio lacks take their part with them, and
    if none is left, nothing is bought."""
    wanted = {t.upper(): float(w) for t, w in (safe or {}).items()}

    def shares(s: State) -> Column:
        if not wanted:
            return s.base
        by_ticker = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
        picked = F.transform(s.tickers, lambda t: F.coalesce(F.try_element_at(by_ticker, t), F.lit(0.0)))
        evened = _let(picked, lambda x: _let(_sum(x), lambda n: F.transform(x, lambda v: v / F.when(n > 0, n).otherwise(1.0))))
        return F.when(s.fall < -threshold, evened).otherwise(s.base)

    return Strategy("Drawdown Protection", shares)


def relative_value(threshold: float = 0.10, most: float = 0.50) -> Strategy:
    """Half the weights, half how far each asset is down, once assets differ by more than the threshold; none above ``most`` before all
    are brought to a sum of 1."""

    def shares(s: State) -> Column:
        def tilted(v: Column) -> Column:
            cheap = _over_sum(_let(F.array_min(v), lambda low: F.transform(v, lambda x: x - low + 0.01)))
            return _over_sum(F.zip_with(s.base, cheap, lambda w, c: F.least(F.greatest(0.5 * w + 0.5 * c, F.lit(0.0)), F.lit(most))))

        return _let(F.transform(s.falls, lambda x: -x), lambda v: F.when(F.array_max(v) - F.array_min(v) > threshold, tilted(v)).otherwise(s.base))

    return Strategy("Relative Value", shares)


def opportunistic(ticker: str, beside: str | None = None, threshold: float = 0.25, normal: float = 0.10, dip: float = 0.40) -> Strategy:
    """A small share of one asset, a large one while it is down; the others at their weights. The weights if the portfolio lacks either ticker."""

    def shares(s: State) -> Column:
        at = _place(s, ticker)
        own = F.when(F.get(s.falls, at) < -threshold, dip).otherwise(normal)
        others = 1 - F.get(s.base, at)
        bought = _let(own, lambda x: F.transform(s.base, lambda w, k: F.when(k == at, x).when(others > 0, w * (1 - x) / others).otherwise(0.0)))
        there = (at >= 0) if beside is None else (at >= 0) & (_place(s, beside) >= 0)
        return F.when(there, bought).otherwise(s.base)

    return Strategy(f"Opportunistic ({ticker.upper()})", shares, told={"ticker": ticker.upper(), "dip_threshold": _percent(threshold), "normal_weight": _percent(normal), "dip_weight": _percent(dip)})


def composite(parts: list[tuple[Strategy, float]]) -> Strategy:
    """The weighted mean of what several strategies buy, brought to a sum of 1."""
    total = sum(w for _, w in parts)

    def shares(s: State) -> Column:
        out = None
        for strategy, weight in parts:
            own = _scaled(strategy.shares(s), weight / total)
            out = own if out is None else F.zip_with(out, own, lambda a, b: a + b)
        return _over_sum(out)

    return Strategy(f"Composite({', '.join(p.name for p, _ in parts)})", shares, max((p.lookback for p, _ in parts), default=0))


def _scaled(values: Column, by: float) -> Column:
    return F.transform(values, lambda v: v * by)


def conditional(condition: Callable[[State], Column], then: Strategy, otherwise: Strategy, name: str = "Conditional") -> Strategy:
    return Strategy(name, lambda s: F.when(condition(s), then.shares(s)).otherwise(otherwise.shares(s)), max(then.lookback, otherwise.lookback))


def dual_momentum(equity: str, safe: str) -> Strategy:
    """The weights while the equity's last returns sum to more than 0, are not known yet, or the portfolio lacks it; else safety in any
    drawdown. What is looked back on is the least that the fold has."""

    def rising(s: State) -> Column:
        return F.coalesce(F.get(s.momentum(LEAST_LOOKBACK), _place(s, equity)) > 0, F.lit(True))

    return conditional(rising, static(), drawdown_protection(0.0, {safe: 1.0}), f"Dual Momentum ({equity.upper()}/{safe.upper()})")


#: Makers by the type in a configuration, from its parameters (by either of their two names where there are two) and their usual values.
KINDS: dict[str, Callable[[Callable], Strategy]] = {
    "static": lambda get: static(),
    "buy_the_dip": lambda get: buy_the_dip(get("target_ticker", "VOO"), get("threshold", 0.10), get("aggressive_weight", 0.80)),
    "dip_preset": lambda get: buy_the_dip(get("target_ticker", "BTC-USD"), get("threshold", 0.20), get("aggressive_weight", 0.50)),
    "momentum": lambda get: momentum(get("lookback momentum_lookback", 63), get("tilt_strength", 0.5), get("min_weight", 0.05)),
    "volatility_target": lambda get: volatility_target(get("target_vol", 0.15), get("lookback vol_lookback", 21), tuple(get("equity_tickers", ()) or ())),
    "drawdown_protection": lambda get: drawdown_protection(get("threshold dd_threshold", 0.15), get("risk_off_allocation", {})),
    "relative_value": lambda get: relative_value(get("threshold rebalance_threshold", 0.10), get("max_tilt", 0.50)),
    "crypto_opportunistic": lambda get: opportunistic(get("crypto_ticker", "BTC-USD"), get("equity_ticker", "VOO"), get("dip_threshold", 0.25), get("normal_weight", 0.10), get("dip_weight", 0.40)),
    "dual_momentum": lambda get: dual_momentum(get("equity_ticker", "VOO"), get("safe_ticker", "BND")),
}


def strategy_from(config: dict | None) -> Strategy:
    """A strategy from ``{"type": ..., "params": {...}}``, static without one; "composite" has ``parts`` of (configuration, weight), and
    "conditional" a portfolio drawdown ``below`` which ``then`` holds, else ``otherwise``. An unknown type is an error."""
    config = config or {}
    kind, params = config.get("type", "static"), config.get("params", {})
    if kind == "composite":
        return composite([(strategy_from(c), w) for c, w in params["parts"]])
    if kind == "conditional":
        return conditional(lambda s: s.fall < params["below"], strategy_from(params["then"]), strategy_from(params.get("otherwise")))
    if kind not in KINDS:
        raise ValueError(f"unknown strategy type: {kind}")
    return KINDS[kind](lambda names, usual: next((params[n] for n in names.split() if n in params), usual))


def _blocks(prices: DataFrame, weights: DataFrame, lookbacks: list[int], every: int) -> DataFrame:
    """``(portfolio, block, end, dt, days, assets)``: the rows from after one contribution to the next; days has the prices of each row, assets
    the highest and last price and the figures of each asset at the end, both in the order of tickers."""
    w = Window.partitionBy("portfolio", "ticker").orderBy("day")
    rows = held_days(prices, weights).withColumn("r", F.col("price") / F.lag("price").over(w) - 1)
    for n in lookbacks:
        last = w.rowsBetween(1 - n, 0)
        known = F.count("r").over(last) == n
        rows = rows.withColumns({f"vol_{n}": F.when(known, F.stddev_pop("r").over(last) * F.sqrt(F.lit(float(YEAR)))), f"mom_{n}": F.when(known, F.sum("r").over(last))})
    rows = rows.withColumn("block", F.ceil(F.col("day") / every))
    figures = [f"{kind}_{n}" for n in lookbacks for kind in ("vol", "mom")]
    ends = rows.groupBy("portfolio", "block", "ticker").agg(F.max("price").alias("high"), F.max_by("price", "day").alias("last"), *(F.max_by(x, "day").alias(x) for x in figures), F.max("day").alias("end"), F.max("dt").alias("dt"))
    ends = ends.groupBy("portfolio", "block").agg(F.max("end").alias("end"), F.max("dt").alias("dt"), F.array_sort(F.collect_list(F.struct("ticker", "high", "last", *figures))).alias("assets"))
    days = rows.groupBy("portfolio", "block", "day").agg(F.array_sort(F.collect_list(F.struct("ticker", "price"))).alias("p"))
    days = days.groupBy("portfolio", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "p"))), lambda d: F.transform(d["p"], lambda x: x["price"])).alias("days"))
    return ends.join(days, ["portfolio", "block"])


def strategy_log(prices: DataFrame, weights: DataFrame, strategies: dict[str, dict], capital: float = 10_000.0, amount: float = 500.0, every: int = 21) -> DataFrame:
    """``(portfolio, strategy, block, dt, tickers, shares, fall, falls, units)``: what each portfolio of ``weights`` (portfolio, ticker, weight,
    position) bought under each of ``strategies`` (name: configuration) on the days of contributions, and what it holds afterwards; block 0 is
    the start, without shares. An array is as long as a portfolio has assets, and a fold as its series has contributions."""
    made = {name: strategy_from(config) for name, config in strategies.items()}
    lookbacks = sorted({LEAST_LOOKBACK, *(s.rows for s in made.values())})
    held = tidy_weights(weights).groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("ticker", "weight"))).alias("w"))
    held = held.select("portfolio", F.transform("w", lambda x: x["ticker"]).alias("tickers"), F.transform("w", lambda x: x["weight"]).alias("base"))
    series = _blocks(prices, weights, lookbacks, every).groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("block", "end", "dt", "days", "assets"))).alias("blocks"))
    rows = series.join(held, "portfolio").withColumn("strategy", F.explode(F.array(*(F.lit(n) for n in made)))).repartition("portfolio", "strategy")

    def figure(block: Column, name: str) -> Column:
        values = F.transform(block["assets"], lambda a: a[name])
        return F.when(~F.exists(values, lambda x: x.isNull()), values)

    def shares(block: Column, falls: Column, fall: Column) -> Column:
        out = F.col("base")
        for name, strategy in made.items():
            # of composites all parts see the longest lookback
            state = State(F.col("tickers"), F.col("base"), falls, fall, lambda _, n=strategy.rows: figure(block, f"vol_{n}"), lambda _, n=strategy.rows: figure(block, f"mom_{n}"))
            out = F.when(F.col("strategy") == name, strategy.shares(state)).otherwise(out)
        return out

    def prices_of(block: Column) -> Column:
        return F.transform(block["assets"], lambda a: a["last"])

    def step(s: Column, b: Column) -> Column:
        values = F.transform(b["days"], lambda d: _sum(F.zip_with(s["units"], d, lambda u, p: u * p)))
        high = F.zip_with(s["units"], b["assets"], lambda u, a: u * a["high"])
        seen = F.struct(F.zip_with(s["peaks"], high, lambda a, c: F.greatest(a, c)).alias("peaks"), F.greatest(s["top"], F.array_max(values)).alias("top"), F.zip_with(s["units"], prices_of(b), lambda u, p: u * p).alias("held"))

        def decide(x: Column) -> Column:
            falls = F.zip_with(x["held"], x["peaks"], lambda h, p: (h - p) / F.when(p != 0, p).otherwise(1.0))
            fall = F.when(x["top"] > 0, (_sum(x["held"]) - x["top"]) / x["top"]).otherwise(0.0)
            return _let(F.struct(falls.alias("falls"), fall.alias("fall")), lambda y: _let(shares(b, y["falls"], y["fall"]), lambda z: bought(x, y, z)))

        def bought(x: Column, y: Column, z: Column) -> Column:
            paid = F.zip_with(z, prices_of(b), lambda v, p: v * amount / p)
            units = F.zip_with(s["units"], paid, lambda u, v: u + v)
            entry = F.struct(b["block"].alias("block"), b["dt"].alias("dt"), z.alias("shares"), y["fall"].alias("fall"), y["falls"].alias("falls"), units.alias("units"))
            return F.struct(units.alias("units"), x["peaks"].alias("peaks"), x["top"].alias("top"), F.concat(s["log"], F.array(entry)).alias("log"))

        # a last block without a contribution changes nothing that is told
        return F.when(b["end"] % every == 0, _let(seen, decide)).otherwise(s)

    first = F.col("blocks")[0]
    entry = "array<struct<block:bigint,dt:date,shares:array<double>,fall:double,falls:array<double>,units:array<double>>>"
    value = F.transform("base", lambda w: w * capital)
    units = F.zip_with(value, prices_of(first), lambda v, p: v / p)
    start = F.struct(units.alias("units"), value.alias("peaks"), _sum(value).alias("top"), F.array().cast(entry).alias("log"))
    later = F.slice("blocks", 2, F.size("blocks")) if amount > 0 else F.slice("blocks", 1, 0)
    log = F.aggregate(later, start, step, lambda s: s["log"])
    none = F.lit(None)
    begun = F.struct(F.lit(0).cast("bigint").alias("block"), first["dt"].alias("dt"), none.cast("array<double>").alias("shares"), none.cast("double").alias("fall"), none.cast("array<double>").alias("falls"), units.alias("units"))
    return rows.select("portfolio", "strategy", "tickers", F.explode(F.concat(F.array(begun).cast(entry), log)).alias("e")).select("portfolio", "strategy", "tickers", "e.*")


def strategy_values(prices: DataFrame, weights: DataFrame, log: DataFrame, capital: float = 10_000.0, amount: float = 500.0, every: int = 21) -> DataFrame:
    """``(portfolio, strategy, dt, day, value, invested)`` from a ``strategy_log`` over the same prices and weights."""
    days = held_days(prices, weights).groupBy("portfolio", "dt", "day").agg(F.array_sort(F.collect_list(F.struct("ticker", "price"))).alias("p"))
    # without cash to add all days are of the start
    block = F.floor(F.col("day") / every) if amount > 0 else F.lit(0)
    rows = days.withColumn("block", block.cast("long")).join(log.select("portfolio", "block", "strategy", "units"), ["portfolio", "block"])
    value = _sum(F.zip_with("units", "p", lambda u, x: u * x["price"]))
    return rows.select("portfolio", "strategy", "dt", "day", value.alias("value"), (F.lit(capital) + F.col("block") * amount).cast("double").alias("invested"))
