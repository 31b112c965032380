"""What is stored, streamed, ranked or tiled: a price table with committed steps, waits after failures, exact percentiles, many assets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import intervals as iv
from tidemark.operators import store as st
from tidemark.operators import wide as wd
from tidemark.operators.ranks import exact_percentiles
from tidemark.plans.catalog import ORACLES, _r, _with, query
from tidemark.plans.extended import _ST, _UNKNOWN, _held, _want
from tidemark.session import shared_dir, staged
from tidemark.sources.prices import prices
from tidemark.sources.stored import PriceStore
from tidemark.streaming.cooldown import EVENTS, allowed

# -- a stored table ----------------------------------------------------------------------------------------------------------------


def _loaded(s: SparkSession, d: str) -> PriceStore:
    """A store with all prices, then a correction of some months that leaves out odd days."""
    old = prices(s, d)
    store = PriceStore(s)
    store.replace_range(old)
    store.replace_range(old.where("dt between date'1995-03-01' and date'1995-06-30' and day(dt) % 2 = 0").withColumn("price", F.col("price") * 2))
    return store


_SOLD = ORACLES["replace_range_upsert"]
query("stored_prices", lambda s, d: _loaded(s, d).prices(), _SOLD, ("price",))
query("stored_prices_of_one", lambda s, d: _loaded(s, d).prices(tickers=["N"]), f"SELECT * FROM ({_SOLD}) WHERE ticker = 'N'", ("price",))
query("stored_prices_before", lambda s, d: _loaded(s, d).prices(version=1), _with("prices", "SELECT ticker, dt, " + _r("price", "price", 2) + " FROM prices"), ("price",))


def _deleted(s: SparkSession, d: str) -> PriceStore:
    store = _loaded(s, d)
    store.delete(s.createDataFrame([("R",)], "ticker string"))
    return store


query("stored_without_a_ticker", lambda s, d: _deleted(s, d).prices(), f"SELECT * FROM ({_SOLD}) WHERE ticker <> 'R'", ("price",))
_TOLD = (
    f"WITH so AS ({_SOLD}), s1 AS (SELECT ticker, dt, lag(dt) OVER (PARTITION BY ticker ORDER BY dt) AS pv FROM so), s2 AS (SELECT *, sum(CASE WHEN date_diff('day', pv, dt) > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY dt) AS g FROM s1), "
    "hi AS (SELECT ticker, min(dt) AS a, max(dt) AS b FROM s2 GROUP BY ticker, g), "
    "held AS (SELECT ticker, min(a) AS \"first\", max(b) AS last, '[' || string_agg('{\"start\":\"' || CAST(a AS VARCHAR) || '\",\"end\":\"' || CAST(b AS VARCHAR) || '\"}', ',' ORDER BY a) || ']' AS intervals FROM hi GROUP BY ticker) "
)
_HELD_OUT = 'SELECT ticker, "first", last, intervals, CAST(NULL AS DATE) AS inception FROM held'
query("stored_held", lambda s, d: _loaded(s, d).held(), _TOLD + _HELD_OUT)
query("stored_held_without_a_ticker", lambda s, d: _deleted(s, d).held(), _TOLD + _HELD_OUT + " WHERE ticker <> 'R'")


def _repaired(s: SparkSession, d: str, steps: int) -> PriceStore:
    """Told inceptions and a new column, then forgotten and told anew."""
    store = _loaded(s, d)
    store.found_inception(prices(s, d).groupBy("ticker").agg(F.date_sub(F.min("dt"), 30).alias("found")).where("ticker <> 'A'"))
    store.migrate({"note": "string", "inception": "date"})
    if steps > 0:
        store.truncate()
    if steps > 1:
        store.repair()
    return store


query("stored_inceptions", lambda s, d: _repaired(s, d, 0).held(), _TOLD + "SELECT ticker, \"first\", last, intervals, CASE WHEN ticker <> 'A' THEN CAST(\"first\" - INTERVAL 30 DAY AS DATE) END AS inception, CAST(NULL AS VARCHAR) AS note FROM held")
query("stored_truncated", lambda s, d: _repaired(s, d, 1).held(), _TOLD + "SELECT ticker, \"first\", last, intervals, CAST(NULL AS DATE) AS inception, CAST(NULL AS VARCHAR) AS note FROM held WHERE ticker NOT IN (SELECT ticker FROM so)")
query("stored_repaired", lambda s, d: _repaired(s, d, 2).held(), _TOLD + 'SELECT ticker, "first", last, intervals, CAST(NULL AS DATE) AS inception, CAST(NULL AS VARCHAR) AS note FROM held')


def _results(s: SparkSession, d: str) -> DataFrame:
    """Figures of each series, appended in two steps and read back."""
    store = PriceStore(s)
    rows = prices(s, d).groupBy("ticker").agg(F.count("*").alias("days"), F.year(F.min("dt")).alias("from_year")).withColumnRenamed("ticker", "label")
    told = st.result_rows(rows, ["days"], ["from_year"])
    store.append_results(told.where("label <= 'A'"))
    store.append_results(told.where("label > 'A'"))
    return store.results()


query("stored_results", _results, _with("prices", "SELECT ticker AS label, '{\"days\":' || count(*) || '}' AS allocations, '{\"from_year\":' || extract(year FROM min(dt)) || '}' AS stats FROM prices GROUP BY ticker"))

# -- a stream of requests ------------------------------------------------------------------------------------------------------------

#: Minutes after the first at which all intervals are asked for, and after which some fail.
ASKED, FAILED = (0, 40, 90), (5, 45)


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Every missing interval asked for at three instants; those that begin on an odd day fail after the first, those that end on one after the
    second."""
    need = staged(iv.missing(_held(s, d), _want(s, d)), "need")
    at = lambda m: F.expr(f"timestamp'2024-01-01 12:00:00' + interval {m} minutes")
    parts = [need.withColumns({"kind": F.lit("asked"), "at": at(m)}) for m in ASKED]
    parts += [need.where(odd).withColumns({"kind": F.lit("failed"), "at": at(m)}) for m, odd in zip(FAILED, ("day(start) % 2 = 1", "day(end) % 2 = 1"), strict=True)]
    base = f"{shared_dir(s)}/requests-{uuid.uuid4().hex}"
    # a file for what comes up to each instant, read one after the other
    for rows in ((parts[0],), (parts[3], parts[1]), (parts[4], parts[2])):
        every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        every.coalesce(1).write.mode("append").parquet(f"{base}/in")
    events = s.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    allowed(events).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


_INSTANT = "TIMESTAMP '2024-01-01 12:00:00' + INTERVAL ({}) MINUTE"
_ASKS = ", asks AS (SELECT need.*, m FROM need, (SELECT unnest([0, 40, 90]) AS m)), fails AS (SELECT *, 5 AS f FROM need WHERE extract(day FROM \"start\") % 2 = 1 UNION ALL SELECT *, 45 FROM need WHERE extract(day FROM \"end\") % 2 = 1)"
query("stream_cooldown", lambda s, d: _requests(s, d).select("ticker", "start", "end", F.col("at").cast("string").alias("at")), _with("prices", _ST + _UNKNOWN + _ASKS + " SELECT ticker, \"start\", \"end\", strftime(" + _INSTANT.format("m") + ", '%Y-%m-%d %H:%M:%S') AS at FROM asks a WHERE NOT EXISTS (SELECT 1 FROM fails f WHERE f.ticker = a.ticker AND f.\"start\" = a.\"start\" AND f.\"end\" = a.\"end\" AND f <= m AND m - f < 60)").replace("AND f <= m AND m - f < 60", "AND f.f <= m AND m - f.f < 60"))

# -- percentiles at size -----------------------------------------------------------------------------------------------------------

_WANTED = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
_QUANTILES = ", ".join(_r(f"quantile_cont(CAST(l_extendedprice AS DOUBLE), {q})", name) for name, q in _WANTED.items())


def _sales(s: SparkSession, d: str, key: Column) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select(key.alias("key"), F.col("l_extendedprice").cast("double").alias("price"))


query("percentiles_of_one_key", lambda s, d: exact_percentiles(_sales(s, d, F.lit("all")), "key", "price", _WANTED, size=50_000), f"SELECT 'all' AS key, {_QUANTILES} FROM lineitem")
query("percentiles_by_status", lambda s, d: exact_percentiles(_sales(s, d, F.col("l_linestatus")), "key", "price", _WANTED, size=50_000), f"SELECT l_linestatus AS key, {_QUANTILES} FROM lineitem GROUP BY 1")

# -- many assets --------------------------------------------------------------------------------------------------------------------


def _monthly(s: SparkSession, d: str, asset: Column) -> DataFrame:
    """``(asset, dt, ret)``: changes of the mean price of an asset's sales from one month to the next that has any."""
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(asset.alias("asset"), F.trunc("l_shipdate", "month").alias("dt"), "l_extendedprice").groupBy("asset", "dt").agg(F.avg("l_extendedprice").alias("p"))
    return rows.select("asset", "dt", (F.col("p") / F.lag("p").over(Window.partitionBy("asset").orderBy("dt")) - 1).alias("ret")).where("ret is not null")


def _monthly_sql(asset: str) -> str:
    return f"WITH m AS (SELECT {asset} AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), q AS (SELECT asset, dt, p / lag(p) OVER (PARTITION BY asset ORDER BY dt) - 1 AS ret FROM m), r AS (SELECT * FROM q WHERE ret IS NOT NULL)"


query("covariance_of_suppliers", lambda s, d: wd.covariance_tiles(_monthly(s, d, F.col("l_suppkey").cast("string"))), _monthly_sql("CAST(l_suppkey AS VARCHAR)") + " SELECT x.asset AS a, y.asset AS b, count(*) AS n, " + _r("covar_samp(x.ret, y.ret)", "cov") + ", " + _r("corr(x.ret, y.ret)", "corr") + " FROM r x JOIN r y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY 1, 2 HAVING count(*) >= 2")
_POINTS, _ASSETS = 2000, 14
_STEPS = wd.steps_of(_ASSETS)
_LINES = (
    ", k AS (SELECT list(asset ORDER BY asset) AS names, list(m ORDER BY asset) AS m FROM (SELECT asset, avg(ret) AS m FROM r GROUP BY 1)), c AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y ON x.dt = y.dt GROUP BY 1, 2), cl AS (SELECT list(row ORDER BY a) AS cov FROM (SELECT a, list(cov ORDER BY b) AS row FROM c GROUP BY a))"
    f", e AS (SELECT i, [{', '.join(f'-ln(greatest((i + 1) * {a!r}::DOUBLE % 1.0, 1e-12))' for a in _STEPS)}] AS e FROM range({_POINTS}) t(i)), w AS (SELECT i, list_transform(e, lambda v: v / list_sum(e)) AS w FROM e)"
    f", o AS (SELECT i, w, 252 * list_sum(list_transform(range(1, {_ASSETS + 1}), lambda j: w[j] * k.m[j])) AS ret, sqrt(252 * list_sum(list_transform(range(1, {_ASSETS + 1}), lambda j: w[j] * list_sum(list_transform(range(1, {_ASSETS + 1}), lambda l: w[l] * cl.cov[j][l]))))) AS vol FROM w, k, cl) "
)


def _drawn(s: SparkSession, d: str) -> DataFrame:
    rows, names = wd.drawn_scores(_monthly(s, d, F.concat("l_linestatus", F.lit("/"), F.col("l_linenumber").cast("string"))), _POINTS)
    return rows


query("opt_drawn_weights", _drawn, _monthly_sql("l_linestatus || '/' || l_linenumber") + _LINES + "SELECT i, " + ", ".join(_r(f"w[{k + 1}]", f"w{k}") for k in range(_ASSETS)) + ", " + _r("ret", "ret") + ", " + _r("vol", "vol") + ", " + _r("(ret - 0.04) / vol", "sharpe") + " FROM o")
query("opt_drawn_best", lambda s, d: _drawn(s, d).orderBy(F.desc("sharpe"), "i").limit(10).select("i", "ret", "vol", "sharpe"), _monthly_sql("l_linestatus || '/' || l_linenumber") + _LINES + "SELECT i, " + _r("ret", "ret") + ", " + _r("vol", "vol") + ", " + _r("(ret - 0.04) / vol", "sharpe") + " FROM o ORDER BY (ret - 0.04) / vol DESC, i LIMIT 10")
