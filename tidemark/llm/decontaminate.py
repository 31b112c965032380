"""Benchmark decontamination by spaced seeds.

Fixed masks look at some of the words in a run and ignore the others, so a hash survives substitutions at the ignored places. The masks
are chosen so that any 12 aligned words with at most two substitutions contain the words of some mask. The hashes of the documents
are joined with those of the benchmark; around each hit the two texts are compared along the hit's diagonal, and
it counts if some window of 12 aligned words has 10 or more in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import mix, parts, signed, word_hashes
from tidemark.session import staged

#: Found by search: 1 is looked at, 0 ignored; together they leave no two substitutions in 12 words unseen.
MASKS = ("11101011", "11010111", "1110010011")
#: Words of a window, and how many of them must agree.
WINDOW, SAME = 12, 10
#: Items of so many words up to a window are found whole, but for one word; one half of theirs is then as it was.
ONE_OFF = 8
#: Items of fewer words name nothing inside a text: they count only where they are the whole of one.
LEAST = 5
#: A benchmark of at most so many words is sent to the executors (about 100 bytes a word); with a larger one the seeds of both are joined.
BROADCAST_WORDS = 300_000
#: Pairs of equal seeds looked at together.
TOGETHER = 1 << 20
FOUND = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_same long"


def masked_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the looked-at words of the mask laid at each word."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = (out ^ h[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return mix(out)


def seeds_for(words: int) -> list[str]:
    """Masks for an item of so many words: one of fewer than ``ONE_OFF`` must be found word for word, one of fewer than ``WINDOW`` by either half."""
    if words >= WINDOW:
        return list(MASKS)
    half = words // 2
    return ["1" * half + "0" * (words - half), "0" * half + "1" * (words - half)] if words >= ONE_OFF else ["1" * words] if words else []


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct rows, in order."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


class Seeds:
    """The masked hashes of a block of items, ready to be looked up."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.tables = {}
        rows: dict[str, list] = {}
        for i, w in enumerate(words):
            for mask in seeds_for(len(w)):
                m = masked_hashes(w, mask)
                rows.setdefault(mask, []).append((m, np.full(len(m), i), np.arange(len(m))))
        for mask, parts in rows.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bits = max(16, int(len(h)).bit_length() + 5)
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.tables[mask] = (h[order], item[order], place[order], seen, np.uint64(64 - bits))

    def hits(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct ``(text, item, place of the item's first word)`` rows. Where words repeat, equal seeds make many pairs on few diagonals:
        pairs are looked at in bounded numbers, and only the diagonals are kept."""
        out = [np.zeros((0, 3), np.int64)]
        for mask, (known, item, place, seen, shift) in self.tables.items():
            m = masked_hashes(h, mask)
            maybe = np.flatnonzero(seen[m >> shift])
            text = np.searchsorted(at, maybe, side="right") - 1
            inside = maybe + len(mask) <= at[text + 1]
            maybe, text = maybe[inside], text[inside]
            low, high = np.searchsorted(known, m[maybe]), np.searchsorted(known, m[maybe], side="right")
            n = high - low
            found = np.flatnonzero(n)
            for part in np.split(found, np.flatnonzero(np.diff(np.cumsum(n[found]) // TOGETHER)) + 1):
                k = n[part]
                ends = np.cumsum(k)
                row = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low[part] - (ends - k), k)
                out.append(_distinct(np.stack((np.repeat(text[part], k), item[row], np.repeat(maybe[part], k) - place[row]), axis=1)))
                if sum(len(x) for x in out) > TOGETHER:
                    out = [_distinct(np.concatenate(out))]
        return _distinct(np.concatenate(out))

    def overlap(self, h: np.ndarray, low: int, high: int, item: int, place: int) -> tuple[int, int, int, int] | None:
        """``(start in the text, start in the item, words, words in common)`` of the longest overlap on this diagonal."""
        return overlap(h, low, high, self.words[item], place)


def overlap(h: np.ndarray, low: int, high: int, w: np.ndarray, place: int) -> tuple[int, int, int, int] | None:
    """As ``Seeds.overlap``, for the words of one item."""
    a, b = max(low, place), min(high, place + len(w))
    size = min(WINDOW, len(w))
    need = SAME if len(w) >= WINDOW else size - (len(w) >= ONE_OFF)
    if b - a < size or len(w) < LEAST and high - low != len(w):
        return None
    same = h[a:b] == w[a - place : b - place]
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(total[size:] - total[:-size] >= need)
    if not len(good):
        return None
    best = max(np.split(good, np.flatnonzero(np.diff(good) > size) + 1), key=lambda r: r[-1] - r[0])
    first, last = int(best[0]), int(best[-1]) + size
    agreed = np.flatnonzero(same[first:last]) + first
    first, last = int(agreed[0]), int(agreed[-1]) + 1
    return a + first - low, a + first - place, last - first, int(total[last] - total[first])


def _better(got: tuple, old: tuple | None) -> bool:
    """Whether an overlap is longer than another, or has more in common, or comes first."""
    return old is None or (-got[2], -got[3], got) < (-old[2], -old[3], old)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _find(shared):
    def run(batches):
        seeds = Seeds(*shared.value)
        for batch in parts(batches):
            h, at = word_hashes(batch.column("text"))
            ids, best = batch.column("doc_id").to_pylist(), {}
            for text, item, place in seeds.hits(h, at).tolist():
                got = seeds.overlap(h, int(at[text]), int(at[text + 1]), item, place)
                if got and _better(got, best.get((text, item))):
                    best[text, item] = got
            yield _table([(ids[text], seeds.ids[item], *got) for (text, item), got in best.items()])

    return run


def _words(batches):
    """Rows ``(row, doc_id, words)``."""
    for batch in parts(batches):
        h, at = word_hashes(batch.column("text"))
        words = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(words, pa.binary())], names=["row", "doc_id", "words"])


def _seeds(name: str, sizes: list[int] | None):
    """Rows ``(seed, name, place)``: the seeds of texts, or of items if ``sizes`` is None; those of a text also by the lengths of short items."""

    def run(batches):
        for batch in batches:
            for i, words in zip(batch.column(name).to_pylist(), batch.column("words"), strict=True):
                w = np.frombuffer(words.as_buffer(), np.uint64)
                masks = seeds_for(len(w)) if sizes is None else [*MASKS, *(m for n in sizes for m in seeds_for(n))]
                found = [masked_hashes(w, mask) for mask in masks]
                n = [len(x) for x in found]
                place = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
                seed = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), pa.array(np.full(len(seed), i, np.int64)), pa.array(place, pa.int64())], names=["seed", name, "place"])

    return run


def _compare(batches):
    for batch in batches:
        out = []
        for doc, item, x, y, places in zip(*(batch.column(c) for c in ("doc_id", "item_id", "words", "item_words", "places")), strict=True):
            h, w = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            best = None
            for place in places.as_py():
                got = overlap(h, 0, len(h), w, place)
                if got and _better(got, best):
                    best = got
            if best:
                out.append((doc.as_py(), item.as_py(), *best))
        yield _table(out)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The overlaps by a join of the seeds: a document's row and an item meet on a seed, and their diagonals are compared once each."""
    rows = staged(staged(docs.withColumn("row", F.monotonically_increasing_id()), "rows").mapInArrow(_words, "row long, doc_id long, words binary"), "words")
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "numbered")
    sizes = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    of_items = items.mapInArrow(_seeds("item", None), "seed long, item long, place long").withColumnRenamed("place", "item_place")
    hits = rows.mapInArrow(_seeds("row", sizes), "seed long, row long, place long").join(of_items, "seed")
    diagonals = hits.select("row", "item", (F.col("place") - F.col("item_place")).alias("at")).distinct().groupBy("row", "item").agg(F.sort_array(F.collect_list("at")).alias("places"))
    both = diagonals.join(rows, "row").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    return both.select("doc_id", "item_id", "words", "item_words", "places").mapInArrow(_compare, FOUND)


def _items(batches):
    for batch in batches:
        h, at = word_hashes(batch.column("text"))
        words = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.binary()), pa.array(at[1:] - at[:-1], pa.int64())], names=["item_id", "words", "n"])


def contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, doc_start, item_start, n_words, n_same)``: the longest overlap of each document and item that share
    a passage (places and lengths in words). Documents without one are not in the result.

    ``documents``: doc_id, text; ``benchmark``: item_id, text; other columns are left alone. Null or empty texts share
    nothing. Two of twelve words may differ, and one of an item of eight to eleven words; items of five to seven count where they occur word
    for word, shorter ones where they are a document's whole text. Repeated rows each return their rows; null ids are returned as null. Empty tables give an empty result.
    A benchmark of up to ``broadcast_words`` words is looked up in the tasks; the seeds of a larger one are joined with the documents'.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, "item_id long, words binary, n long")
    items = staged(items.where("n > 0"), "items")
    if (items.agg(F.sum("n")).first()[0] or 0) > broadcast_words:
        return _joined(docs, items)
    rows = items.orderBy("item_id", "words").toPandas()
    block = ([None if x != x else int(x) for x in rows["item_id"]], [np.frombuffer(w, np.uint64) for w in rows["words"]])
    return docs.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(block)), FOUND)


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that share a passage with the benchmark, all columns as they were. Rows without a doc_id stay."""
    found = contaminated(documents, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("found")).distinct()
    # the caller's columns travel in a struct, so that none clashes with what is joined
    rows = documents.select(F.struct("*").alias("row")).join(found, F.col("row.doc_id").cast("long") == F.col("found"), "left_anti")
    return rows.select(*(F.col("row")[c].alias(c) for c in documents.columns))
