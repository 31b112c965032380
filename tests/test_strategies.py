"""Strategies: edge cases of single decisions, and the fold against a plain loop."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import strategies as sg

DAY = dt.date(2020, 1, 1)
SCHEMA = "portfolio string, ticker string, weight double, position long"


def _shares(spark, config, tickers, base, falls, fall, figures=None):
    strategy = sg.strategy_from(config)
    arr = lambda xs, kind="double": F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>") if xs is not None else F.lit(None).cast(f"array<{kind}>")
    state = sg.State(arr(tickers, "string"), arr(base), arr(falls), F.lit(fall), lambda _: arr(figures), lambda _: arr(figures))
    return spark.range(1).select(strategy.shares(state).alias("s")).first()["s"]


def test_dip_is_bought_past_the_threshold(spark):
    dip = {"type": "buy_the_dip", "params": {"target_ticker": "c", "threshold": 0.1, "aggressive_weight": 0.5}}
    assert _shares(spark, dip, "ABC", [0.5, 0.3, 0.2], [0.0, 0.0, -0.25], -0.1) == pytest.approx([0.3125, 0.1875, 0.5])
    assert _shares(spark, dip, "ABC", [0.5, 0.3, 0.2], [-0.5, 0.0, -0.1], -0.1) == [0.5, 0.3, 0.2]
    assert _shares(spark, dip, "ABD", [0.5, 0.3, 0.2], [-0.5, -0.5, -0.5], -0.5) == [0.5, 0.3, 0.2]
    # alone in its portfolio, its part is bought and no more
    assert _shares(spark, dip, "C", [1.0], [-0.5], -0.5) == [0.5]


def test_protection_without_a_safe_allocation_keeps_the_weights(spark):
    assert _shares(spark, {"type": "drawdown_protection"}, "AB", [0.6, 0.4], [-0.5, -0.5], -0.5) == [0.6, 0.4]
    safe = {"type": "drawdown_protection", "params": {"threshold": 0.2, "risk_off_allocation": {"b": 0.3, "Z": 0.7}}}
    assert _shares(spark, safe, "AB", [0.6, 0.4], [0.0, 0.0], -0.21) == [0.0, 1.0]
    assert _shares(spark, safe, "AB", [0.6, 0.4], [0.0, 0.0], -0.2) == [0.6, 0.4]
    assert _shares(spark, safe, "AC", [0.6, 0.4], [0.0, 0.0], -0.9) == [0.0, 0.0]


def test_opportunistic_where_all_is_in_one_asset(spark):
    config = {"type": "crypto_opportunistic", "params": {"crypto_ticker": "A", "equity_ticker": "B"}}
    assert _shares(spark, config, "ABC", [1.0, 0.0, 0.0], [-0.5, 0.0, 0.0], -0.5) == [0.4, 0.0, 0.0]
    assert _shares(spark, config, "ABC", [0.5, 0.3, 0.2], [-0.1, 0.0, 0.0], -0.5) == pytest.approx([0.1, 0.54, 0.36])
    assert _shares(spark, config, "AC", [0.5, 0.5], [-0.5, 0.0], -0.5) == [0.5, 0.5]


def test_momentum_tilts_and_keeps_a_least(spark):
    config = {"type": "momentum", "params": {"tilt_strength": 0.5, "min_weight": 0.05}}
    got = _shares(spark, config, "AB", [0.5, 0.5], [0.0, 0.0], 0.0, [0.3, 0.1])
    up = (0.2 + 1e-6) / (0.2 + 2e-6)
    assert got == pytest.approx([0.25 + 0.5 * up, 0.25 + 0.5 * (1 - up)])
    assert _shares(spark, config, "AB", [0.5, 0.5], [0.0, 0.0], 0.0, None) == [0.5, 0.5]
    # either name of a parameter
    assert sg.strategy_from({"type": "momentum", "params": {"momentum_lookback": 40}}).rows == 40 == sg.strategy_from({"type": "momentum", "params": {"lookback": 40}}).rows
    assert sg.strategy_from({"type": "momentum", "params": {"lookback": 5}}).rows == 21


def test_unknown_type_is_an_error():
    with pytest.raises(ValueError, match="unknown strategy type"):
        sg.strategy_from({"type": "none such"})


def test_summaries():
    assert sg.strategy_from({"type": "buy_the_dip", "params": {"target_ticker": "a"}}).summary() == {"name": "Buy the Dip (A)", "target": "A", "threshold": "10%", "aggressive_weight": "80%"}
    assert sg.strategy_from(None).summary() == {"name": "Static DCA"}


def test_fold_is_a_loop_over_days(spark):
    n = 90
    price = {t: [100 + 10 * k + 15 * math.sin(i / (5 + 3 * k)) for i in range(n)] for k, t in enumerate("AB")}
    rows = spark.createDataFrame([(t, DAY + dt.timedelta(days=i), p) for t, ps in price.items() for i, p in enumerate(ps)], "ticker string, dt date, price double")
    book = spark.createDataFrame([("x", "B", 0.7, 0), ("x", "A", 0.3, 1)], SCHEMA)
    config = {"type": "relative_value", "params": {"threshold": 0.05, "max_tilt": 0.6}}
    log = sg.strategy_log(rows, book, {"s": config}, 1000.0, 50.0, 7)
    got = {r["day"]: (r["value"], r["invested"]) for r in sg.strategy_values(rows, book, log, 1000.0, 50.0, 7).collect()}
    base = [0.3, 0.7]
    held, peaks, paid = [1000 * w for w in base], [1000 * w for w in base], 1000.0
    for day in range(n):
        if day:
            held = [h * price[t][day] / price[t][day - 1] for h, t in zip(held, "AB", strict=True)]
            peaks = [max(a, b) for a, b in zip(peaks, held, strict=True)]
            if day % 7 == 0:
                v = [1 - h / p for h, p in zip(held, peaks, strict=True)]
                shares = base
                if max(v) - min(v) > 0.05:
                    up = [x - min(v) + 0.01 for x in v]
                    mixed = [min(0.5 * w + 0.5 * u / sum(up), 0.6) for w, u in zip(base, up, strict=True)]
                    shares = [x / sum(mixed) for x in mixed]
                held, paid = [h + 50 * s for h, s in zip(held, shares, strict=True)], paid + 50
        assert got[day] == pytest.approx((sum(held), paid), rel=1e-9)
    assert len(got) == n
    # without cash to add nothing is decided, and the start drifts
    still = sg.strategy_log(rows, book, {"s": config}, 1000.0, 0.0, 7)
    assert still.count() == 1
    last = sg.strategy_values(rows, book, still, 1000.0, 0.0, 7).orderBy(F.desc("day")).first()
    assert last["value"] == pytest.approx(sum(1000 * w * price[t][-1] / price[t][0] for t, w in zip("AB", base, strict=True))) and last["invested"] == 1000
    assert sg.strategy_log(rows.limit(0), book, {"s": config}).count() == 0


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("A", DAY, 1.0)], "ticker string, dt date, price double")
    log = sg.strategy_log(rows, spark.createDataFrame([("x", "A", 1.0, 0)], SCHEMA), {"s": {}})
    plan = log._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
