"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product is at least ``tau``. Two near vectors are likely to pass a filter
together, so vectors that share a filter are compared. The directions are a product code: one codeword from each of
several blocks of (randomly turned) dimensions, so a vector's filters are found by list decoding, block by block, keeping a
partial choice only while the best that can follow still reaches ``tau``. How many directions there are, and ``tau``, follow from the
number of vectors and their dimensions: about ``SHARED`` filters are expected to hold both vectors of a pair at the threshold, whatever the
size. Where few dimensions make caps so wide that they would compare most pairs, one filter that all pass compares each pair.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.tiles import grouped, runs, spanning, tiled
from tidemark.session import staged

#: Filters that a pair at the threshold shares on average; the share of pairs that share none falls exponentially.
SHARED = 16
#: Vectors that pass a filter, on average.
PASSING = 48
#: Blocks of dimensions, and codes with turns and codewords of their own: a vector that lies badly for one code lies well for others.
BLOCKS, CODES = 2, 8
#: Vectors of any dimensions that are compared each with each.
FEW = 2048
#: Share of all pairs beyond which the filters would not spare enough comparisons.
MOST = 0.5
_ANGLES = np.linspace(0, math.pi, 40_001)


@functools.cache
def _cap(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each angle, the density of directions at it from a fixed one, and the share of directions within it."""
    density = np.sin(_ANGLES) ** (dims - 2) if dims > 2 else np.ones(len(_ANGLES))
    within = np.concatenate(([0], np.cumsum((density[1:] + density[:-1]) / 2))) * _ANGLES[1]
    return density / within[-1], within / within[-1]


@functools.cache
def plan(n: int, cosine: float, dims: int = 64) -> tuple[float, int]:
    """``tau`` in standard deviations of a random inner product, and codewords of a block, for ``n`` vectors; one codeword means that all
    pairs are to be compared."""
    every = -math.inf, 1
    if n <= FEW or dims <= 2 or not 0 < cosine < 1:
        return every
    density, within = _cap(dims)
    # a cap at least as wide as the angle of a pair, else few caps hold both
    wide = max(float(np.interp(min(0.06, PASSING / n), within, _ANGLES)), math.acos(cosine))
    t, one = math.cos(wide), float(np.interp(wide, _ANGLES, within))
    x = np.linspace(0, wide, 4001)[1:]
    needed = np.clip((t - cosine * np.cos(x)) / (math.sqrt(1 - cosine**2) * np.sin(x)), -1, 1)
    inner = np.interp(np.arccos(needed), _ANGLES, _cap(dims - 1)[1])
    both = float(np.sum(np.interp(x, _ANGLES, density) * inner) * (x[1] - x[0]))
    if SHARED * one * one / both >= MOST:
        return every
    return t * math.sqrt(dims), max(2, math.ceil((SHARED / CODES / both) ** (1 / BLOCKS)))


def _kind(words: int) -> type:
    return np.int32 if CODES * words**BLOCKS < 1 << 31 else np.int64


class Code:
    """The filters for vectors of ``dims`` dimensions; every task makes the same ones."""

    def __init__(self, dims: int, tau: float, words: int, number: int):
        rng = np.random.default_rng((dims, number))
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.tau = tau / math.sqrt(dims)
        self.blocks = []
        for cols in np.array_split(np.arange(dims), min(BLOCKS, dims)):
            c = rng.standard_normal((words, len(cols)))
            self.blocks.append((cols, c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(len(cols) / dims)))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` for every filter that each unit vector passes."""
        turned = unit @ self.turn
        scores = [turned[:, cols] @ c.T for cols, c in self.blocks]
        row, name, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            rest = sum((x.max(axis=1) for x in scores[k + 1 :]), np.zeros(len(unit)))
            reach = total[:, None] + s[row]
            i, j = np.nonzero(reach >= (self.tau - rest[row])[:, None])
            row, name, total = row[i], name[i] * s.shape[1] + j, reach[i, j]
        return row, name


def decode(unit: np.ndarray, tau: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` over all codes, by row, then by filter."""
    row, name = zip(*(code(unit.shape[1], tau, words, k).decode(unit) for k in range(CODES if words > 1 else 1)), strict=True)
    name = np.concatenate([x + k * words**BLOCKS for k, x in enumerate(name)])
    row = np.concatenate(row)
    order = np.lexsort((name, row))
    return row[order], name[order]


_CODES: dict[tuple, Code] = {}


def code(dims: int, tau: float, words: int, number: int) -> Code:
    key = dims, tau, words, number
    if key not in _CODES:
        _CODES[key] = Code(*key)
    return _CODES[key]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(v: np.ndarray) -> bytes:
    """The vector's bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def _unpacked(raw: list[bytes], dims: int) -> np.ndarray:
    return _unit(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dims else np.float64).astype(np.float64) for v in raw]))


def _filters(n: int, cosine: float):
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                vectors = batch.column("embedding").to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for dims in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dims)
                    x = np.array([vectors[i] for i in rows], np.float64)
                    tau, words = plan(n, cosine, int(dims))
                    row, name = decode(_unit(x), tau, words)
                    name = name.astype(_kind(words))
                    ends = np.searchsorted(row, np.arange(len(rows) + 1))
                    lists = [name[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(rows), batch.column("weight").take(rows), pa.array([_packed(v) for v in x], pa.binary()), pa.array([v.tobytes() for v in lists], pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(np.full(len(rows), dims), pa.int64())],
                        names=["node", "weight", "vector", "filters", "passed", "dims"],
                    )

    return run


def _before(lists: list[np.ndarray], name: int) -> np.ndarray:
    """For each row the filters before ``name`` as a set of bits, over those that any row has."""
    short = [x[: np.searchsorted(x, name)] for x in lists]
    flat = np.concatenate(short)
    names, place = np.unique(flat, return_inverse=True)
    bits = np.zeros((len(lists), 64 * max(1, -(-len(names) // 64))), bool)
    bits[np.repeat(np.arange(len(lists)), [len(x) for x in short]), place] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _compare(n: int, cosine: float):
    """Of each run: edges that hold linked vectors together, and how many others each is linked with. A pair is counted in the first
    filter that both pass, so it counts once whatever they share."""

    def run(table: pa.Table) -> pa.Table:
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        vector, lists = table.column("vector").to_pylist(), table.column("filters").to_pylist()
        name, dims = table.column("filter").to_numpy(), table.column("dims").to_numpy()
        out: list[list] = [[], [], []]
        for left, right in runs(table, "key"):
            x = _unpacked([vector[i] for i in left], int(dims[left[0]]))
            y = x if left is right else _unpacked([vector[i] for i in right], int(dims[left[0]]))
            linked = x @ y.T >= cosine
            if left is right:
                np.fill_diagonal(linked, False)
            i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(i):
                continue
            a, b = spanning(left, right, linked, node)
            out[0].append(a), out[1].append(b), out[2].append(np.zeros(len(a), np.int64))
            rows, cols, linked = left[i], right[j], linked[np.ix_(i, j)]
            bits = _before([np.frombuffer(lists[r], _kind(plan(n, cosine, int(dims[r]))[1])) for r in np.concatenate((rows, cols))], int(name[rows[0]]))
            bi, bj, back = bits[: len(rows)], bits[len(rows) :], np.zeros(len(cols), np.int64)
            count = np.zeros(len(rows), np.int64)
            for k in range(len(rows)):
                with_k = np.flatnonzero(linked[k])
                first = with_k[~(bj[with_k] & bi[k]).any(axis=1)]
                count[k] = weight[cols[first]].sum()
                back[first] += weight[rows[k]]
            for at, found in ((rows, count), (cols, back))[: 1 if left is right else 2]:
                out[0].append(node[at]), out[1].append(node[at]), out[2].append(found)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "n"), columns, strict=True)})

    return run


def embedding_links(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings`` (vec_id, embedding; other columns are left alone).

    Two vectors link if a filter brings them together and their cosine, in double precision, is at least ``cosine``; equal vectors are one class
    with a weight, so copies are not expanded. component_id is the least vec_id reachable. Null or empty vectors, zero ones and
    those with null or non-finite components link with nothing (component_id = vec_id, kept); so do vectors of
    different lengths with each other. Repeated rows each return a row and count as a vector each; a null vec_id takes
    part in links, is never the least, and is not kept if it has a component. An empty table gives an empty result.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = e.select("vec_id", F.when(good, F.col("embedding")).alias("embedding")).withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    valid = rows.where("node is not null")
    node = staged(valid.groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")), "nodes")
    n = node.count()
    decoded = staged(node.mapInArrow(_filters(n, cosine), "node long, weight long, vector binary, filters binary, passed array<long>, dims long"), "decoded")
    keyed = decoded.select("node", "weight", "vector", "filters", F.explode("passed").alias("filter"), "dims").withColumn("key", F.xxhash64("dims", "filter"))
    found = staged(grouped(tiled(keyed, "key", ["node"]), _compare(n, cosine), "a long, b long, n long"), "found")
    component = staged(connected_components(found.select("a", "b")), "component")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    placed = node.select("node", "first", "weight").join(component, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    done = placed.join(least, "component").select("node", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("least"))
    out = rows.select("vec_id", "node").join(done, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
