"""A stored table whose steps are lost, repeated or crossed; waits after failures; percentiles, tiles and drawn weights."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import wide as wd
from tidemark.operators.portfolio import gathered
from tidemark.operators.ranks import exact_percentiles
from tidemark.operators.studies import density, price_column
from tidemark.functions.series import sliding_fall
from tidemark.sources.stored import PRICES, Conflict, PriceStore
from tidemark.streaming.cooldown import EVENTS, allowed

DAY = dt.date(2020, 1, 1)


def _days(spark, ticker, first, n, price):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(days=first + i), float(price)) for i in range(n)], PRICES)


def test_a_step_lost_before_its_commit_counts_for_nothing(spark, tmp_path):
    store = PriceStore(spark, f"file://{tmp_path}/p", buckets=4)
    store.replace_range(_days(spark, "a", 0, 10, 1).unionByName(_days(spark, "b", 0, 5, 2)))
    before = sorted(map(tuple, store.prices().collect()))
    commit = store._commit
    store._commit = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        store.replace_range(_days(spark, "a", 2, 3, 9))
    store._commit = commit
    assert store.version == 1 and sorted(map(tuple, store.prices().collect())) == before
    # sent again, it counts once; another reader of the folder sees it, and the version before
    store.replace_range(_days(spark, "a", 2, 3, 9))
    other = PriceStore(spark, f"file://{tmp_path}/p", buckets=4)
    assert other.prices().where("price = 9").count() == 3 and other.prices().count() == 15
    assert sorted(map(tuple, other.prices(version=1).collect())) == before


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (PriceStore(spark, f"file://{tmp_path}/p", buckets=2) for _ in range(2))
    base = two.version
    one.replace_days(_days(spark, "a", 0, 3, 1))
    with pytest.raises(Conflict):
        two._commit(base, {})
    # a step starts over from the version that came first
    real, first = PriceStore._versions, [[0]]
    two._versions = lambda: first.pop() if first else real(two)
    two.replace_days(_days(spark, "a", 2, 2, 5))
    assert sorted(r["price"] for r in one.prices().collect()) == [1, 1, 5, 5]


def test_deleting_repairing_and_results(spark, tmp_path):
    store = PriceStore(spark, f"file://{tmp_path}/p", buckets=3)
    store.replace_range(_days(spark, "a", 0, 10, 1).unionByName(_days(spark, "b", 30, 5, 2)).unionByName(_days(spark, "a", 40, 2, 1)))
    told = {r["ticker"]: r for r in store.held().collect()}
    assert told["a"]["last"] == DAY + dt.timedelta(days=41) and told["a"]["intervals"].count("start") == 2 and told["b"]["inception"] is None
    store.found_inception(spark.createDataFrame([("b", DAY), ("c", DAY)], "ticker string, found date"))
    assert store.held().where("ticker = 'b'").first()["inception"] == DAY and store.held().count() == 2
    store.truncate()
    assert store.held().count() == 0 and store.prices().count() == 17
    store.repair()
    assert store.held().count() == 2
    store.delete(spark.createDataFrame([("a",), ("none",)], "ticker string"))
    assert [r["ticker"] for r in store.prices().select("ticker").distinct().collect()] == ["b"] == [r["ticker"] for r in store.held().collect()]
    store.delete(spark.createDataFrame([("b",)], "ticker string"))
    assert store.prices().count() == 0 and store.held().count() == 0
    store.migrate({"note": "string"})
    store.replace_range(_days(spark, "b", 0, 1, 1))
    assert store.held().columns[-1] == "note" and store.held().count() == 1
    row = spark.createDataFrame([("x", "{}", "{}")], "label string, allocations string, stats string")
    store.append_results(row)
    store.append_results(row)
    assert store.results().count() == 2 and PriceStore(spark).results().count() == 0


def test_waiting_after_a_failure(spark, tmp_path):
    noon = dt.datetime(2024, 1, 1, 12)
    row = lambda kind, minutes: ("t", DAY, DAY, kind, noon + dt.timedelta(minutes=minutes))
    files = [[row("asked", 0), row("failed", 1), row("asked", 2)], [row("asked", 60)], [row("asked", 61), row("failed", 61)], [row("asked", 130), row("failed", 125)], [row("asked", 200)]]
    for rows in files:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    allowed(events).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(int((r["at"] - noon).total_seconds() // 60) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    # a failure of the same instant counts first; an hour after the last one a request goes again
    assert got == [0, 200]


def test_percentiles_of_a_key_that_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random()])) for _ in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", {"a": 0.0, "b": 0.3, "c": 1.0}, size=100).collect()}
    hot = [v for k, v in rows if k == "hot"]
    assert [got["hot"][x] for x in "abc"] == pytest.approx(np.percentile(hot, [0, 30, 100]).tolist())
    assert [got["one"][x] for x in "abc"] == [5, 5, 5] and got["two"]["b"] == pytest.approx(1.3) and len(got) == 3


def test_tiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 23))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 1.0
    rows = [(f"a{j:02d}", DAY + dt.timedelta(days=i), float(x[i, j])) for i in range(40) for j in range(23) if not np.isnan(x[i, j])]
    got = {(r["a"], r["b"]): r for r in wd.covariance_tiles(spark.createDataFrame(rows, "asset string, dt date, ret double").repartition(3), tile=4).collect()}
    assert len(got) == 23 * 24 // 2
    for (a, b), r in got.items():
        p, q = x[:, int(a[1:])], x[:, int(b[1:])]
        ok = ~np.isnan(p) & ~np.isnan(q)
        c = np.cov(p[ok], q[ok])
        assert r["n"] == ok.sum() and r["cov"] == pytest.approx(c[0, 1], abs=1e-12)
        assert r["corr"] is None if 5 in (int(a[1:]), int(b[1:])) else r["corr"] == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]))


def test_tiles_meet_without_copies_of_the_returns(spark):
    """Series of many periods, names beyond ASCII, a repeated period, and a plan in which no return is copied for each tile."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1300, 9))
    names = ["a", "Z", "ä", "\U0001f600", "￮", "10", "9", "b", ""]
    x[:900, 7] = np.nan
    x[901:, 8] = np.nan
    rows = [(names[j], DAY + dt.timedelta(days=i), float(x[i, j])) for i in range(1300) for j in range(9) if not np.isnan(x[i, j])]
    rows += [rows[0], ("lone", DAY, 1.0), ("none", DAY, None), (None, DAY, 1.0), ("nan", DAY, float("nan"))]
    tiles = wd.covariance_tiles(spark.createDataFrame(rows, "asset string, dt date, ret double").repartition(3), tile=3)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan
    got = {(r["a"], r["b"]): (r["n"], r["cov"]) for r in tiles.collect()}
    want = {}
    for i in range(9):
        for j in range(9):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if names[i] <= names[j] and ok.sum() > 1:
                want[names[i], names[j]] = (ok.sum(), pytest.approx(np.cov(x[ok, i], x[ok, j])[0, 1], abs=1e-12))
    assert got == want and ("", "b") not in got
    assert wd.covariance_tiles(spark.createDataFrame([], "asset string, dt date, ret double")).count() == 0


def test_written_pairs_of_like_values_lie_together(spark, tmp_path):
    rng, days = np.random.default_rng(6), [DAY + dt.timedelta(days=i) for i in range(40)]
    names, x = [f"a{i}" for i in range(1000)], 0.3 * rng.normal(size=(40, 1000))
    x[:, 7] = 0.5  # has no correlation
    rows = spark.createDataFrame(pd.DataFrame({"asset": np.repeat(names, 40), "dt": days * 1000, "ret": x.T.ravel()}), "asset string, dt date, ret double")
    pairs = wd.covariance_tiles(rows).withColumns({c: F.round(c, 6) for c in ("cov", "corr")})
    pairs.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    out.repartition(1).sortWithinPartitions("a", "b").write.parquet(f"{tmp_path}/by_name")
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))
    assert size("out") < 0.9 * size("by_name")
    got, cov = pd.concat(map(pd.read_parquet, (tmp_path / "out").glob("*.parquet"))), np.cov(x.T)
    i, j = (got[c].str[1:].astype(int).to_numpy() for c in "ab")
    assert len(got) == 1000 * 1001 // 2 > wd.ROWS and not got.duplicated(["a", "b"]).any() and (got["a"] <= got["b"]).all() and (got["n"] == 40).all()
    assert got["cov"].to_numpy() == pytest.approx(cov[i, j], abs=1e-6)
    flat = (i == 7) | (j == 7)
    assert (got["corr"].isna() == flat).all()
    assert got["corr"].to_numpy()[~flat] == pytest.approx((cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)) + (cov == 0)))[i, j][~flat], abs=1e-6)


def test_drawn_weights_fill_the_simplex(spark):
    w = wd.drawn_weights(spark, 12, 4000).toPandas().drop(columns="i").to_numpy()
    assert w.sum(axis=1) == pytest.approx(1) and (w >= 0).all()
    # as even as all weights are: each has the mean 1 / n, and is above x with the chance (1 - x) ^ (n - 1)
    assert w.mean(axis=0) == pytest.approx(1 / 12, rel=0.03)
    assert (w > 0.2).mean() == pytest.approx(0.8**11, rel=0.1)


def test_falls_within_sliding_frames(spark):
    rng = random.Random(9)
    v = [rng.uniform(1, 2) for _ in range(57)]
    rows = spark.createDataFrame([("x", i, p, p, 0.0) for i, p in enumerate(v)], "ticker string, i long, high double, low double, fall double")
    for n in (1, 2, 7, 30):
        got = {r["i"]: (r["win_high"], r["win_fall"]) for r in sliding_fall(rows, n).collect()}
        for i in range(57):
            frame = v[i - n + 1 : i + 1]
            want = (max(frame), min(frame[b] / max(frame[: b + 1]) - 1 for b in range(n))) if i >= n - 1 else (None, None)
            assert got[i] == pytest.approx(want) if want[0] is not None else got[i] == want


@pytest.mark.parametrize("n, error", [(3000, 1e-12), (40_000, 1e-6)])
def test_density_is_the_direct_sum(spark, n, error):
    rng = np.random.default_rng(4)
    v = rng.normal(size=n)
    got = density(spark.createDataFrame(pd.DataFrame({"v": v})), "v", points=50).orderBy("k").toPandas()
    h = v.std(ddof=1) * n**-0.2
    want = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
    assert got["y"].to_numpy() == pytest.approx(want, abs=error)
    assert density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0


def test_gather_by_array_and_by_join(spark):
    history = spark.createDataFrame([(DAY + dt.timedelta(days=i), float(i)) for i in range(300)], "dt date, ret double").repartition(3)
    grid = spark.range(20).selectExpr("id AS sim").selectExpr("sim", "explode(sequence(1L, 30L)) AS day")
    one = sorted(map(tuple, gathered(grid, history, 42).collect()))
    assert one == sorted(map(tuple, gathered(grid, history, 42, most=10).collect())) and len(one) == 600
    plan = gathered(grid, history, 42)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and gathered(grid, history.where("false"), 42).count() == 0
    with pytest.raises(ValueError, match="insufficient common history"):
        gathered(grid, history.limit(19), 42, least=20)


def test_price_columns():
    assert price_column(["x", "Close", "Adj Close"]) == "Adj Close" and price_column(["price", "Close"]) == "Close"
    with pytest.raises(ValueError, match="no price column"):
        price_column(["Open"])
