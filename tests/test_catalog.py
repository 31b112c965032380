"""Every query of the catalogue against its SQL, and closed forms on small series."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

from tidemark.functions.series import returns
from tidemark.operators import intervals as iv
from tidemark.operators import metrics as m
from tidemark.operators import portfolio as pf
from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "supplier", "nation", "region"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else str(v)[:10] if isinstance(v, (dt.date, pd.Timestamp)) else v
    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    got, want = _rows(QUERIES[name](spark, SF).toPandas()), _rows(sql.sql(ORACLES[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-2)) for x, y in zip(a, b, strict=True)), (a, b)


def _series(spark, values, name="ret"):
    return spark.createDataFrame([("x", DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], f"ticker string, dt date, {name} double")


def test_doubling_in_a_year(spark):
    row = m.summary(_series(spark, [2 ** (1 / 252) - 1] * 252)).first()
    assert math.isclose(row["cagr"], 1.0, rel_tol=1e-6)
    assert row["max_dd"] == pytest.approx(0, abs=1e-12) and row["down"] == 0


def test_fall_of_a_fifth(spark):
    assert m.max_drawdown(_series(spark, [0.1, -0.2])).first()["max_dd"] == pytest.approx(-0.2)


def test_open_episode(spark):
    rows = m.episodes(_series(spark, [0.01, -0.1, 0.2, -0.2])).orderBy("start").collect()
    assert [r["recovery"] is None for r in rows] == [False, True]


def test_missing_half_year(spark):
    known = spark.createDataFrame([("x", DAY, dt.date(2020, 6, 30))], "ticker string, start date, end date")
    asked = spark.createDataFrame([("x", DAY, dt.date(2020, 12, 31)), ("y", DAY, DAY)], "ticker string, lo date, hi date")
    got = {(r["ticker"], r["start"], r["end"]) for r in iv.missing(known, asked).collect()}
    assert got == {("x", dt.date(2020, 7, 1), dt.date(2020, 12, 31)), ("y", DAY, DAY)}
    assert iv.coverage(known, asked).where("ticker = 'x'").first()["ratio"] == pytest.approx(182 / 366)


def test_islands_merge_over_a_week(spark):
    days = [8, 9, 10, 11, 12, 15, 16, 17, 18, 19]
    d = spark.createDataFrame([("x", dt.date(2024, 1, k)) for k in days], "ticker string, dt date")
    assert iv.islands(d).count() == 1


def test_text_that_is_not_json_has_no_intervals(spark):
    assert iv.from_text(spark.createDataFrame([("x", "not valid json")], "ticker string, intervals string")).count() == 0


def test_contributions_without_returns(spark):
    flat = spark.createDataFrame([(t, DAY + dt.timedelta(days=i), 10.0) for t in "AB" for i in range(253)], "ticker string, dt date, price double")
    last = pf.contributions(flat, {"A": 0.6, "B": 0.4}).orderBy("day", ascending=False).first()
    assert last["value"] == pytest.approx(16_000) and last["invested"] == 16_000


def test_fold_equals_closed_form(spark):
    p = spark.createDataFrame([(t, DAY + dt.timedelta(days=i), 10.0 + (i * k) % 7) for k, t in enumerate("ABC", 1) for i in range(100)], "ticker string, dt date, price double")
    w = {"A": 0.5, "B": 0.3, "C": 0.2}
    fold = {r["dt"]: r["value"] for r in pf.run_backtest(p, w, {}, amount=500.0).collect()}
    for r in pf.contributions(p, w).collect():
        assert fold[r["dt"]] == pytest.approx(r["value"], rel=1e-9)


def test_least_volatile_mix(spark):
    grid = pf.simplex(spark, 3, 10)
    assert grid.count() == 66 and grid.where("abs(w0 + w1 + w2 - 1) > 1e-9").count() == 0


def test_empty_tables(spark):
    none = returns(spark.createDataFrame([], "ticker string, dt date, price double"))
    for f in (m.summary, m.episodes, m.rolling, m.monthly, m.shape, m.value_at_risk):
        assert f(none).count() == 0


def test_stream_ingest_counts_a_batch_once(spark, tmp_path):
    from tidemark.streaming.ingest import ingest, latest

    schema = "ticker string, dt date, price double"
    _series(spark, [1, 2], "price").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert latest(spark.read.parquet(str(tmp_path / "store"))).count() == 2


def test_simulation_of_the_default_size(spark):
    got = QUERIES["mc_trajectory_bands_full"](spark, SF).toPandas().sort_values("day")
    assert got["day"].tolist() == list(range(21, 2521, 21))
    assert (got["p5"] < got["p50"]).all() and (got["p50"] < got["p95"]).all()
    # of ten years in ten thousand simulations, half end below the median of their statistics
    stats = QUERIES["mc_statistics_full"](spark, SF).toPandas().iloc[0]
    assert abs(stats["median_final"] / got["p50"].iloc[-1] - 1) < 1e-4
