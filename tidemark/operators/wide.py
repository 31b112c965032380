"""Many assets: covariances tile by tile, and weights drawn by a low-discrepancy sequence where a grid has too many points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import YEAR, ratio
from tidemark.session import staged

#: Assets of a tile, and values of a tile, at most (a single asset may have more).
TILE, VALUES = 1024, 1 << 20
#: Parts of the tiles: each two parts meet in a task.
PARTS = 200
#: Periods, and rows of the result, that a task holds as matrices at a time.
PERIODS, ROWS = 512, 1 << 16
_SUMS = "a string, b string, n long, cov double, corr double"


def _series(held: pa.ListScalar) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray]:
    """The assets of a tile, and of all their values the period, the asset's place and the value."""
    names, days, rets = held.values.flatten()
    return names.to_pylist(), days.flatten(), np.repeat(np.arange(len(names)), np.diff(days.offsets.to_numpy())), rets.flatten().to_numpy()


def _moments(x: tuple, y: tuple) -> list[np.ndarray]:
    """For each asset of x and each of y, over the periods that both have: how many, the sums of both, of their product and of their squares."""
    day = pa.concat_arrays([x[1], y[1]]).dictionary_encode().indices.to_numpy()
    sides, shared = np.split(day, [len(x[1])]), np.ones(day.max(initial=-1) + 1, bool)
    for d in sides:
        shared &= np.bincount(d, minlength=len(shared)) > 0
    place, total = np.cumsum(shared) - 1, [np.zeros((len(x[0]), len(y[0]))) for _ in range(6)]
    rows = []
    for (names, _, who, ret), d in zip((x, y), sides, strict=True):
        keep = np.flatnonzero(shared[d])
        keep = keep[np.argsort(place[d[keep]], kind="stable")]
        rows.append((len(names), place[d[keep]], who[keep], ret[keep]))
    for low in range(0, int(shared.sum()), PERIODS):
        dense = []
        for assets, at, who, ret in rows:
            i, j = np.searchsorted(at, [low, low + PERIODS])
            v, there = np.zeros((PERIODS, assets)), np.zeros((PERIODS, assets))
            v[at[i:j] - low, who[i:j]], there[at[i:j] - low, who[i:j]] = ret[i:j], 1
            dense += [v, there]
        a, ma, b, mb = dense
        for t, (left, right) in zip(total, ((ma, mb), (a, mb), (ma, b), (a, b), (a * a, mb), (ma, b * b)), strict=True):
            t += left.T @ right
    return total


def _gram(batches):
    """Covariances of the assets of two tiles over the periods that both have; of one tile with itself each pair once."""
    for batch in batches:
        for lo, hi, left, right in zip(*(batch.column(c) for c in ("lo", "hi", "x", "y")), strict=True):
            x, y = _series(left), _series(right)
            total = _moments(x, y)
            names = sorted({*x[0], *y[0]})
            rank = {a: k for k, a in enumerate(names)}
            p, q = (np.array([rank[a] for a in side[0]], np.int32) for side in (x, y))
            names, step, parts = pa.array(names, pa.string()), max(1, ROWS // len(q)), []
            for k in range(0, len(p), step):
                n, sx, sy, sxy, sxx, syy = (t[k : k + step] for t in total)
                own = p[k : k + step]
                keep = n >= 2
                if lo == hi:
                    keep &= own[:, None] <= q
                i, j = np.nonzero(keep)
                n, sx, sy, sxy, sxx, syy = (t[keep] for t in (n, sx, sy, sxy, sxx, syy))
                cov, vx, vy = (sxy - sx * sy / n) / (n - 1), (sxx - sx * sx / n) / (n - 1), (syy - sy * sy / n) / (n - 1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    corr = np.where((vx > 0) & (vy > 0), cov / np.sqrt(vx * vy), np.nan)
                parts.append((np.minimum(own[i], q[j]), np.maximum(own[i], q[j]), n.astype(np.int64), cov, corr))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            # like values lie together, so that rounded ones take less disk
            order = np.argsort(np.abs(columns[-1]), kind="stable")
            for k in range(0, len(order), ROWS):
                a, b, n, cov, corr = (c[order[k : k + ROWS]] for c in columns)
                pair = [names.take(pa.array(x)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*pair, pa.array(n), pa.array(cov), pa.array(corr, mask=np.isnan(corr))], names=["a", "b", "n", "cov", "corr"])


def covariance_tiles(returns: DataFrame, tile: int = TILE) -> DataFrame:
    """``(a, b, n, cov, corr)`` for every two assets (a <= b) of ``returns`` (asset, dt, ret) with two common periods or more: sample covariance and
    correlation over the periods that both have.

    Assets are dealt to tiles of about ``tile`` series, fewer where these are long. A tile is a row; each two tiles meet in a row of the tiles' product
    with themselves, which reads them from where they were written once, so what is shuffled and written follows the returns, not the
    pairs. A row's pairs come ordered by how strongly they correlate. Of a period that repeats one value counts; rows with nulls count for nothing.
    """
    rows = returns.select(F.col("asset").cast("string").alias("asset"), "dt", F.col("ret").cast("double").alias("ret")).na.drop()
    series = rows.groupBy("asset").agg(F.collect_list(F.struct("dt", "ret")).alias("s")).select("asset", F.col("s.dt").alias("days"), F.col("s.ret").alias("rets"))
    series = staged(series, "series")
    assets, values = series.agg(F.count("*"), F.coalesce(F.sum(F.size("days")), F.lit(0))).first()
    tiles = max(1, -(-assets // tile), -(-values // VALUES))
    held = series.groupBy(F.pmod(F.xxhash64("asset"), F.lit(tiles)).alias("k")).agg(F.collect_list(F.struct("asset", "days", "rets")).alias("held"))
    # as many parts as tiles, else few tasks would do most pairs
    held = staged(held, "tiles").repartitionByRange(min(tiles, PARTS), "k")
    side = lambda k, x: held.select(F.col("k").alias(k), F.col("held").alias(x))
    # of two tiles either may come first, so that each meets half of the others
    return side("lo", "x").crossJoin(side("hi", "y")).where("lo = hi or (lo < hi) = ((lo + hi) % 2 = 0)").mapInArrow(_gram, _SUMS)


# -- drawn weights ---------------------------------------------------------------------------------------------------------------


def steps_of(n: int) -> list[float]:
    """The steps of a Kronecker sequence in ``n`` dimensions: powers of the inverse of the root above 1 of x^(n+1) = x + 1."""
    x = 2.0
    for _ in range(200):
        x = (1 + x) ** (1 / (n + 1))
    return [x ** -(k + 1) for k in range(n)]


def drawn_weights(spark: SparkSession, n: int, points: int) -> DataFrame:
    """``(i, w0, ..., wn-1)``: points spread evenly over all weights of ``n`` assets, from a counter alone: numbers from 0 to 1 become exponential ones,
    which are brought to a sum of 1."""
    rows = spark.range(points).withColumnRenamed("id", "i")
    u = [(F.col("i") + 1) * F.lit(a) % 1.0 for a in steps_of(n)]
    rows = rows.select("i", *((-F.log(F.greatest(x, F.lit(1e-12)))).alias(f"e{k}") for k, x in enumerate(u)))
    total = sum((F.col(f"e{k}") for k in range(n)), F.lit(0.0))
    return rows.select("i", *((F.col(f"e{k}") / total).alias(f"w{k}") for k in range(n)))


def drawn_scores(returns: DataFrame, points: int = 5000, risk_free: float = 0.04, most: int = 64) -> tuple[DataFrame, list[str]]:
    """``(i, w0, ..., ret, vol, sharpe)`` of drawn weights for the assets of ``returns`` (asset, dt, ret), and the assets in the order of the weights;
    no more than ``most`` assets. Moments are of the periods that each two assets share; the points are scored where they are made."""
    cov = covariance_tiles(returns)
    means = returns.groupBy(F.col("asset").cast("string").alias("asset")).agg(F.avg("ret").alias("m")).orderBy("asset").limit(most + 1).collect()
    if len(means) > most:
        raise ValueError(f"more than {most} assets")
    names = [r["asset"] for r in means]
    n, place = len(names), {a: k for k, a in enumerate(names)}
    square = np.zeros((n, n))
    for r in cov.collect():
        square[place[r["a"]], place[r["b"]]] = square[place[r["b"]], place[r["a"]]] = r["cov"]
    rows = drawn_weights(returns.sparkSession, n, points)

    def dot(values: list[float]) -> Column:
        return sum((F.col(f"w{k}") * float(v) for k, v in enumerate(values)), F.lit(0.0))

    ret = dot([r["m"] for r in means]) * YEAR
    var = sum((F.col(f"w{i}") * dot(square[i].tolist()) for i in range(n)), F.lit(0.0))
    scored = rows.withColumns({"ret": ret, "vol": F.sqrt(var * YEAR)})
    return scored.withColumn("sharpe", ratio(F.col("ret") - risk_free, F.col("vol"))), names
