"""Comparing all rows that share a key, in groups of bounded size.

Rows of a frequent key are dealt at random to tiles, and each pair of tiles meets in a square of its own, so no group follows the
frequency of a key; rare keys share groups. Inside a group a task gets the runs of equal keys as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

#: Rows of a tile, and about as many in a group of rare keys.
TILE = 2048
#: Broadcast the sizes of at most so many keys (about 50 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 300_000


def _with_sizes(df: DataFrame, key: str) -> tuple[int, DataFrame]:
    """The rows of the keys that several rows have: how many, and with the column size."""
    size = staged(df.groupBy(key).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    rows, keys = size.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    return rows, df.join(F.broadcast(size) if keys <= BROADCAST_KEYS else size, key)


def tiled(df: DataFrame, key: str, by: list[str], tile: int = TILE, rows: int | None = None) -> DataFrame:
    """``df`` with columns part, lo, hi, side: group by the first three; side is -1 for rows of tile lo, 1 for those of tile hi, and 0
    where the two are one. Keys that one row has are left out. ``by``: columns that tell a key's rows apart. ``rows``: the number of
    rows of a ``df`` whose column size has the number of its key's rows (about; above 1 where there are more); without it they are counted.
    """
    if rows is None:
        rows, rows_of = _with_sizes(df, key)
    else:
        rows_of = df.where("size > 1")
    rows_of = rows_of.withColumn("tiles", F.ceil(F.col("size") / tile)).withColumn("own", F.pmod(F.xxhash64(key, *by), F.col("tiles")))
    others = F.when(F.col("tiles") > 1, F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    both = rows_of.withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    part = F.pmod(F.xxhash64(key, F.lit("part")), F.lit(max(1, -(-rows // tile))))
    return both.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": side, "part": part}).drop("tiles", "own", "other", "size")


def short_runs(table: pa.Table, key: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, place)``: the rows of all runs of at most ``most`` equal keys that are to be compared with themselves, run after run, and
    where each stands in its run; so that many short runs are worked on together."""
    k, side = table.column(key).to_numpy(), table.column("side").to_numpy()
    order = np.argsort(k, kind="stable")
    order = order[side[order] == 0]
    k = k[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(k)))
    place = np.arange(len(k)) - np.repeat(first, size)
    short = np.repeat(size <= most, size)
    return order[short], place[short]


def runs(table: pa.Table, key: str, longer_than: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(left, right)`` row numbers of each run of equal keys; the same array twice where the run is to be compared with itself, if
    it is ``longer_than`` so many rows."""
    k, side = table.column(key).to_numpy(), table.column("side").to_numpy()
    order = np.argsort(k, kind="stable")
    k = k[order]
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True]))) if len(k) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = order[a:b]
        if side[own[0]] == 0:
            if len(own) > max(1, longer_than):
                yield own, own
        else:
            left, right = own[side[own] < 0], own[side[own] > 0]
            if len(left) and len(right):
                yield left, right


def _least(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each row of the matrix the least label among the columns that it links; a few rows at a time."""
    top = np.iinfo(np.int64).max
    return np.concatenate([np.where(linked[i : i + 128], labels[None, :], top).min(axis=1) for i in range(0, len(linked), 128)])


def spanning(left: np.ndarray, right: np.ndarray, linked: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(name, name)`` that hold together what the matrix ``linked`` links, no more than one a row. ``name``: of all rows."""
    own = left is right
    i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    linked, left, right = linked[np.ix_(i, j)], left[i], right[j]
    a, b = name[left], name[right]
    while True:
        new_a = np.minimum(a, _least(linked, b))
        new_b = new_a if own else np.minimum(b, _least(linked.T, new_a))
        if (new_a == a).all() and (own or (new_b == b).all()):
            break
        a, b = new_a, new_b
    at, root = (left, a) if own else (np.concatenate((left, right)), np.concatenate((a, b)))
    moved = name[at] != root
    return name[at][moved], root[moved]


def grouped(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy("part", "lo", "hi").applyInArrow(run, schema)
