"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

A document's set is its distinct k-word shingles (``text.shingle_sets``). Two sets with Jaccard similarity of ``t`` or more
differ in at most ``(1 - t) / (1 + t) * (|x| + |y|)`` shingles. Sizes fall into bands a factor ``1 / t**2`` wide; for the pairs
whose larger set lies in a band that bound is one number ``d``. The shingles' value range is cut into more than ``d`` tiles, so
two linked sets agree in the whole content of a tile: each set sends one key for each tile that it fills, and sets that
share a key are candidates. No candidate is lost: a set that fills ``d`` tiles or fewer sends each shingle as a key as well.

Candidates are compared in bulk: the bits in which two parity bitmaps differ bound the overlap from above, and only what passes
has its sorted arrays intersected. Equal sets are one class from the start, so copies are never expanded. Sets that share a key
are first compared with the smallest of them. Of keys that then still span several components the bitmaps are compared in square tiles of
bounded size, which gives clusters of sets that may link; within a cluster sets are compared, again in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.text import mix, parts, shingle_sets, signed
from tidemark.llm.tiles import grouped, runs, spanning, tiled
from tidemark.session import small_enough, staged

#: Bits of a bitmap; sets of a few hundred shingles leave it sparse enough to bound well.
BITS = 1024
#: Sets in one side of a square tile when bitmaps are compared, and when the sets are there too.
TILE, SETS_TILE = 512, 512
#: Broadcast the sizes of at most so many keys that sets share (24 bytes each); beyond it the keys of all sets are shuffled once more.
BROADCAST_KEYS = 2_000_000
#: Broadcast a table of document ids up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def bands(t: float) -> list[tuple[int, int, int]]:
    """``(first size, last size, d)`` of each band, from the first in which different sets can link."""
    out, first = [], 1
    while first < 1 << 40:
        last = max(first, math.ceil(first / t**2) - 1)
        d = math.floor((1 - t) / (1 + t) * 2 * last + 1e-9)
        if d:
            out.append((first, last, d))
        first = last + 1
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the shingles hashed to each of some bits, packed: a power of two of them, ``BITS`` or about two to four a shingle."""
    m = max(BITS, 1 << int(2 * len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1)


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of so many bytes from a larger one: halves laid on each other keep the parities."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _run_bits(column: pa.ChunkedArray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of both sides of a run, folded to the smallest among them, as rows of 64-bit numbers."""
    x, y = ([np.frombuffer(column[int(i)].as_buffer(), np.uint8) for i in rows] for rows in (left, right))
    size = min(map(len, x + y))
    return tuple(np.concatenate([folded(v, size) for v in side]).view(np.uint64).reshape(len(side), -1) for side in (x, y))


def _bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))


def tile_keys(s: np.ndarray, t: float, all_bands: list[tuple[int, int, int]]) -> np.ndarray:
    """Keys of one sorted set: its own band's tiles, and the next band's if a partner can lie there."""
    n, out = len(s), []
    for i, (first, last, d) in enumerate(all_bands):
        if n > last or n < math.ceil(first * t - 1e-9):
            continue
        # a few tiles more than needed, for those that a small set of the band leaves empty
        m = np.uint64(math.ceil((d + 1) * (1 + 1.3 * math.exp(-first * t / (d + 1)))) + 3)
        tile = ((s >> np.uint64(32)) * m) >> np.uint64(32)
        head = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        inner = mix(s + np.uint64(0x51ED270B))
        out.append(mix(np.add.reduceat(inner, head) + tile[head] * np.uint64(0xA24BAED4963EE407) + np.uint64(i * 2 + 1)))
        if len(head) <= d:
            out.append(mix(inner + np.uint64(0x9FB21C651E98DF25 + i)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sketches(k: int, t: float):
    def run(batches):
        b = bands(t)
        for batch in parts(batches):
            ids = batch.column("doc_id").to_pylist()
            sets = shingle_sets(batch.column("text"), k)
            whole = [(int(signed(mix(s).sum(keepdims=True))[0]), int(signed(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True))[0])) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "h1": pa.array([w[0] for w in whole], pa.int64()),
                    "h2": pa.array([w[1] for w in whole], pa.int64()),
                    "bits": pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                    "keys": pa.array([signed(tile_keys(s, t, b)) for s in sets], pa.list_(pa.int64())),
                }
            )

    return run


def _shingles(k: int):
    def run(batches):
        for batch in parts(batches):
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            sa, sb, keep = batch.column("sa"), batch.column("sb"), []
            for i in range(len(batch)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sa, sb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlap_bound(na: np.ndarray, nb: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether bit counts and sizes allow a link: the sets differ in at least ``differing`` shingles."""
    both = np.minimum((na + nb - differing) // 2, np.minimum(na, nb))
    return 100 * both >= percent * (na + nb - both)


def _bound_pairs(percent: int):
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            differing = np.array([_bits_apart(*(np.frombuffer(v.as_buffer(), np.uint8) for v in pair)) for pair in zip(batch.column("xa"), batch.column("xb"), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_overlap_bound(na, nb, differing, percent)))

    return run


def _plausible(percent: int):
    """Edges that hold together those sets of a key, of different components, whose bitmaps allow a link."""

    def run(table: pa.Table) -> pa.Table:
        node, n, comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
        out = [np.zeros((2, 0), np.int64)]
        for left, right in runs(table, "key"):
            x, y = _run_bits(table.column("bits"), left, right)
            linked = np.zeros((len(left), len(right)), bool)
            for k, i in enumerate(left):
                differing = np.bitwise_count(y ^ x[k]).sum(axis=1, dtype=np.int64)
                linked[k] = _overlap_bound(n[right], n[i], differing, percent) & (comp[right] != comp[i])
            out.append(np.stack(spanning(left, right, linked, node)))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    return run


def _linked_sets(percent: int):
    """Links between the sets of one cluster: bitmaps first, then sorted arrays; what is held together already is not compared again."""

    def run(table: pa.Table) -> pa.Table:
        node, n, comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
        sets = table.column("s")
        read = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
        out: tuple[list, list] = ([], [])
        for left, right in runs(table, "key"):
            parent: dict[int, int] = {}

            def find(x, parent=parent):
                while (y := parent.get(x, x)) != x:
                    parent[x] = parent.get(y, y)
                    x = y
                return x

            mine, theirs = _run_bits(table.column("bits"), left, right)
            for k, i in enumerate(left):
                after = k + 1 if left is right else 0
                others = right[after:]
                differing = np.bitwise_count(theirs[after:] ^ mine[k]).sum(axis=1, dtype=np.int64)
                maybe = _overlap_bound(n[others], n[i], differing, percent) & (comp[others] != comp[i])
                x = read(i)
                for j in others[maybe][np.argsort(differing[maybe], kind="stable")]:
                    p, q = find(int(comp[i])), find(int(comp[j]))
                    if p == q:
                        continue
                    both = len(np.intersect1d(x, read(j), assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        parent[max(p, q)] = min(p, q)
                        out[0].append(min(node[i], node[j]))
                        out[1].append(max(node[i], node[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _exact(pairs: DataFrame, reps: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (columns a, b) that link: bitmap bound first, then the sorted arrays of what passes."""
    side = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("x" + c))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    near = staged(near.mapInArrow(_bound_pairs(percent), "a long, b long").distinct(), "pairs")
    sets = _sets(near.select("a").union(near.select("b")), documents, k)
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("s").alias("s" + c))
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long")


def _sets(nodes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """``(doc_id, s)``: the sorted shingles of the documents in the one column of ``nodes``."""
    wanted = nodes.toDF("doc_id").distinct()
    if small_enough(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    # repeated rows of one doc_id hold one text by contract of the id; where they do not, one of their sets is used
    return staged(documents.join(wanted, "doc_id", "left_semi").mapInArrow(_shingles(k), "doc_id long, s binary").dropDuplicates(["doc_id"]), "sets")


def ngram_jaccard_join(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``documents`` (doc_id, text; other columns are left alone).

    Two documents link when ``100 * |intersection| >= percent * |union|``; component_id is the smallest doc_id reachable.
    Null or empty texts have no shingles and link with nothing (component_id = doc_id). Repeated rows each return a row. A null
    doc_id returns n_shingles and a null component. Texts of any length count whole. An empty table gives an empty result.
    """
    t = percent / 100
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = staged(docs.mapInArrow(_sketches(k, t), "doc_id long, n long, h1 long, h2 long, bits binary, keys array<long>"), "sketch")
    same = ["h1", "h2", "n"]
    full = sketch.where("n > 0 and doc_id is not null")
    node = full.groupBy(*same).agg(F.min("doc_id").alias("node"))
    member = full.select("doc_id", *same).join(node, same).select("doc_id", "node").distinct()
    kept = staged(member.where("doc_id = node").select("doc_id").distinct(), "kept")
    kept = F.broadcast(kept) if small_enough(kept, BROADCAST_ROWS) else kept
    # the keys are by far the widest column, and are read once for counting and once for joining
    firsts = full.join(kept, "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    reps = staged(firsts.select("node", "n", "bits").dropDuplicates(["node"]), "reps")
    keyed = firsts.select("node", F.explode("keys").alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = staged(keyed.join(F.broadcast(sizes) if small_enough(sizes, BROADCAST_KEYS) else sizes, "key"), "shared")
    stars = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(_exact(stars, reps, docs, k, percent), "links")
    found = staged(connected_components(links), "found")

    placed = shared.where("size > 2").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("size").alias("size"), mark).where("low <> high")
    # keys with equal members are compared once
    first = staged(open_keys.groupBy("mark", "size").agg(F.min("key").alias("key")), "first")
    members = placed.join(first.select("key"), "key", "left_semi").join(reps.select("node", "n", "bits"), "node").select("key", "node", "n", "comp", "bits")
    near = staged(grouped(tiled(members, "key", ["node"], TILE), _plausible(percent), "a long, b long").distinct(), "near")
    if near.limit(1).count():
        # what may link lies in one cluster, where each set is once, and not once for each key
        clusters = staged(connected_components(near).withColumnRenamed("component", "key"), "clusters")
        rows = clusters.join(reps.select("node", "n", "bits"), "node").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        rows = rows.join(_sets(clusters.select("node"), docs, k).withColumnRenamed("doc_id", "node"), "node")
        more = staged(grouped(tiled(rows, "key", ["node"], SETS_TILE), _linked_sets(percent), "a long, b long").distinct(), "more")
        found = staged(connected_components(links.unionByName(more)), "found")

    nodes = member.join(found, "node", "left").select(F.col("doc_id"), F.coalesce("component", "node").alias("component"))
    # repeated rows of one doc_id with different texts would sit in several components: they take the least
    nodes = nodes.groupBy("doc_id").agg(F.min("component").alias("component"))
    return sketch.select("doc_id", F.col("n").alias("n_shingles")).join(nodes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
