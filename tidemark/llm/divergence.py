"""How far the sources of a language are from each other in their words: an audit by systolic rotation.

Every (lang, source) group has a vector of term counts. The terms of a language are dealt to shards of bounded size, and the groups to
a fixed number of slots, so a partition holds the compressed vectors of a slot's groups over one shard. These stay where they are; in each
round of a round-robin tournament the vectors of other slots come to them, every two slots meeting once, and a meeting works out
both directions of each pair. In the first round the language's own vector comes to every slot, and a heap for each group
keeps the terms that stand out most. What is in both vectors or in neither follows from few numbers, so a meeting costs what the
two vectors hold.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import _FOLDED, LOWER, as_array, blocks, parts, segment_hashes, word_spans
from tidemark.session import staged

#: Bytes of text whose terms are counted together.
SLICE = 8 << 20
#: Counts of a shard, about.
ENTRIES = 400_000
#: Slots of a language's groups, an even number; the tournament has one round less.
SLOTS = 8
SCALE = 1_000_000_000
#: What separates terms: all ASCII bytes but letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_COUNTS = "lang string, source string, term string, n long, docs long"
_VECTORS = "lang string, shard int, source string, size int, data binary, terms binary"
_VALUES = "lang string, source string, part string, item string, value long"


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The segments of lower-cased bytes as strings."""
    size = end - start
    ends = np.cumsum(size)
    flat = LOWER[data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(flat))


def _count_terms(batches):
    """For each slice of the texts the counts of each term in each group, and the documents that have it."""
    for batch in parts(batches, SLICE):
        held, hashes, starts, sizes, rows, offset = [], [], [], [], [], 0
        for own, b, at in blocks(as_array(batch.column("text"))):
            start, end = word_spans(b, at, _BETWEEN)
            hashes.append(segment_hashes(b, start, end, _FOLDED))
            starts.append(start + offset)
            sizes.append(end - start)
            rows.append(np.repeat(own, np.diff(np.searchsorted(start, at))))
            held.append(b)
            offset += len(b)
        if not sum(map(len, hashes)):
            continue
        h, start, size, row = (np.concatenate(x) for x in (hashes, starts, sizes, rows))
        distinct, first, term = np.unique(h, return_index=True, return_inverse=True)
        # one number for a term in a document, then for a term in a group
        pair, n = np.unique(row * len(distinct) + term, return_counts=True)
        names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        number: dict[tuple, int] = {}
        group = np.array([number.setdefault((x["lang"], x["source"]), len(number)) for x in names.to_pylist()], np.int64)
        cell, of = np.unique(group[pair // len(distinct)] * len(distinct) + pair % len(distinct), return_inverse=True)
        terms = _strings(np.concatenate(held), start[first], start[first] + size[first]).take(pa.array(cell % len(distinct)))
        langs, sources = (pa.array([k[i] for k in number], pa.string()).take(pa.array(cell // len(distinct))) for i in (0, 1))
        columns = [langs, sources, terms.cast(pa.string()), pa.array(np.bincount(of, n).astype(np.int64)), pa.array(np.bincount(of).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _COUNTS.split(", ")])


def share(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(10^9 (n + 1) / (total + terms))``, exactly: digits of a long division, three at a time."""
    whole, rest = np.divmod(np.asarray(n, np.int64) + 1, total + terms)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total + terms)
        whole = whole * 1000 + digits
    return whole + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)``; shares stay below 2^31, so the square fits."""
    return (p - q) ** 2 // q


class Vector:
    """A group's shares over a shard: where it has counts, and what all other terms have."""

    def __init__(self, row: dict):
        self.source = row["source"]
        raw = pa.decompress(row["data"], 12 * row["size"], codec="zstd", asbytes=True) if row["size"] else b""
        self.at = np.cumsum(np.frombuffer(raw, np.uint32, row["size"]), dtype=np.int64)
        self.p = share(np.frombuffer(raw, np.int64, row["size"], 4 * row["size"]), row["total"], row["terms_of_lang"])
        self.rest = int(share(np.zeros(1, np.int64), row["total"], row["terms_of_lang"])[0])


def _squeezed(at: np.ndarray, n: np.ndarray) -> bytes:
    return pa.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + n.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """The vectors of a shard; the row without a source is the language's own, with the terms in their order."""
    lang, shard = (x.as_py() for x in key)
    named = table.column("term").combine_chunks().dictionary_encode()
    order = pc.sort_indices(named.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[named.indices.to_numpy()]
    source = table.column("source").combine_chunks().dictionary_encode()
    code, n = source.indices.to_numpy().astype(np.int64), table.column("n").to_numpy()
    order_of = np.lexsort((at, code))
    at, code, n = at[order_of], code[order_of], n[order_of]
    total = np.zeros(len(order), np.int64)
    np.add.at(total, at, n)
    rows = [(lang, shard, None, len(order), _squeezed(np.arange(len(order)), total), b" ".join(x.encode() for x in named.dictionary.take(pa.array(order)).to_pylist()))]
    edge = np.searchsorted(code, np.arange(len(source.dictionary) + 1))
    for name, a, b in zip(source.dictionary.to_pylist(), edge[:-1], edge[1:], strict=True):
        rows.append((lang, shard, name, int(b - a), _squeezed(at[a:b], n[a:b]), None))
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(_VECTORS.split(", "), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True))})


def _met(left: list[Vector], right: list[Vector], own: bool) -> list[tuple[str, str, int]]:
    """``(source, item, value)`` for both directions of all pairs: the sum over the terms that either has of what they differ there from terms
    that neither has. ``own``: the two lists are one, and each pair counts once."""
    top = max([int(v.at[-1]) + 1 for v in (*left, *right) if len(v.at)], default=0)
    p_of, q_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
    out = []

    def directed(a: Vector, b: Vector, at_a: np.ndarray, only_b: np.ndarray) -> int:
        none = int(excess(np.int64(a.rest), np.int64(b.rest)))
        return int(excess(a.p, at_a).sum()) + int(excess(np.int64(a.rest), only_b).sum()) - none * (len(a.at) + len(only_b))

    for j, b in enumerate(right):
        q_of[b.at] = b.p
        for a in left[:j] if own else left:
            p_of[a.at] = a.p
            of_b, of_a = q_of[a.at], p_of[b.at]
            out.append((a.source, b.source, directed(a, b, np.where(of_b > 0, of_b, b.rest), b.p[of_a == 0])))
            out.append((b.source, a.source, directed(b, a, np.where(of_a > 0, of_a, a.rest), a.p[of_b == 0])))
            p_of[a.at] = 0
        q_of[b.at] = 0
    return out


def _told(lang: str | None, rows: list[tuple]) -> pa.Table:
    source, part, item, value = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def _meeting(resident: pa.Table, visiting: pa.Table) -> pa.Table:
    """A round's meeting of two slots over a shard; nothing where one of them is free."""
    if not len(resident) or not len(visiting):
        return _told(None, [])
    here, there = ([Vector(r) for r in t.to_pylist()] for t in (resident, visiting))
    return _told(resident.column("lang")[0].as_py(), [(a, "pair", b, v) for a, b, v in _met(here, there, False)])


def _at_home(most: int):
    """The first round: pairs within a slot, and the terms by which each group exceeds its language, the first ``most`` by a heap."""

    def run(resident: pa.Table, language: pa.Table) -> pa.Table:
        if not len(resident):
            return _told(None, [])
        here = [Vector(r) for r in resident.to_pylist()]
        rows = [(a, "pair", b, v) for a, b, v in _met(here, here, True)]
        for row in language.to_pylist():
            whole, terms = Vector(row), row["terms"].split(b" ")
            for v in here:
                q = whole.p[v.at]
                up = np.flatnonzero(v.p > q)
                f = excess(v.p[up], q[up])
                if len(f) > most:
                    up, f = (x[f >= np.partition(f, len(f) - most)[len(f) - most]] for x in (up, f))
                # terms are in their order, so of equal values the lesser place comes first
                rows += [(v.source, "term", terms[i].decode(), -x) for x, i in heapq.nsmallest(most, zip((-f).tolist(), v.at[up].tolist(), strict=True))]
        return _told(resident.column("lang")[0].as_py(), rows)

    return run


def partner(slot: int, turn: int) -> int:
    """The slot that ``slot`` meets in round ``turn`` (from 1): all but the last stand in a circle, of which one meets the last."""
    circle = SLOTS - 1
    if slot == circle:
        return next(i for i in range(circle) if 2 * i % circle == turn % circle)
    other = (turn - slot) % circle
    return circle if other == slot else other


def term_counts(documents: DataFrame, least_documents: int) -> DataFrame:
    """``(lang, source, term, n, is_first)`` of the terms kept by a language; is_first marks one row of each term."""
    counts = documents.mapInArrow(_count_terms, _COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    first = F.row_number().over(w.orderBy("source")) == 1
    return counts.withColumns({"in_docs": F.sum("docs").over(w), "is_first": first}).where(F.col("in_docs") >= least_documents).select("lang", "source", "term", "n", "is_first")


def source_divergence(documents: DataFrame, least_documents: int = 3, most: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from each other one of its language ("pair", all ranks), and the
    terms by which it exceeds its language ("term", the first ``most``), for ``documents`` (text, lang, source; other columns are
    left alone).

    Null text, lang and source count as empty. A language keeps the terms of ``least_documents`` or more of its documents; repeated rows
    are documents of their own. A group without terms has its pairs too. Texts of any length are read whole. An empty
    table gives an empty result.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = staged(term_counts(docs, least_documents), "terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.col("is_first").cast("long")).alias("terms_of_lang"), F.ceil(F.count("*") / ENTRIES).cast("int").alias("shards"))
    langs = staged(langs, "langs")
    groups = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs.select("lang", "terms_of_lang", "shards"), "lang", "left").na.fill(0, ["total", "terms_of_lang", "shards"])
    slot = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) % SLOTS).cast("int")
    groups = staged(groups.withColumn("slot", slot), "groups")

    dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    vectors = staged(dealt.select("lang", "shard", "source", "term", "n").groupBy("lang", "shard").applyInArrow(_pack, _VECTORS), "vectors")
    every = groups.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    own = vectors.where("source is not null").select("lang", "shard", "source", "size", "data")
    resident = staged(every.join(own, ["lang", "shard", "source"], "left").na.fill(0, ["size"]), "resident")
    language = vectors.where("source is null").join(langs.drop("shards"), "lang").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))

    where = ("lang", "shard", "slot")
    stay = resident.groupBy(*where)
    met = stay.cogroup(language.groupBy(*where)).applyInArrow(_at_home(most), _VALUES)
    for turn in range(1, SLOTS):
        # of two slots the lesser stays, and the other's vectors come to it
        goes = F.array(*(F.lit(partner(i, turn) if partner(i, turn) < i else -1) for i in range(SLOTS)))
        visiting = resident.withColumn("slot", goes[F.col("slot")]).where("slot >= 0")
        met = met.unionByName(stay.cogroup(visiting.groupBy(*where)).applyInArrow(_meeting, _VALUES))
    met = staged(met, "met")

    a, b = groups.select("lang", "source", "total", "terms_of_lang"), groups.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b"))
    p, q = (f"(1 + {SCALE} div ({x} + terms_of_lang))" for x in ("total", "total_b"))
    both = a.join(b, "lang").where("source <> item").withColumn("apart", F.expr(f"if(terms_of_lang = 0, 0L, terms_of_lang * (({p} - {q}) * ({p} - {q}) div {q}))"))
    sums = met.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = both.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("apart") + F.coalesce("value", F.lit(0).cast("long"))).alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(w).cast("int")
    terms = met.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= most)
    return pairs.withColumn("rank", rank).unionByName(terms)
