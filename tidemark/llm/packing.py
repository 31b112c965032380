"""Best-two-fit packing of whole token sequences.

Documents become ids by a public tokenizer, and an end id. Only those longer than a sequence are cut: into full pieces, the first of
which may be shorter. Pieces are dealt at random to shards of bounded size, whose number follows the corpus; each shard is
packed by itself, which costs no more than about one unfilled sequence a shard. A bin is filled greedily with the largest
piece that fits; then its smallest piece gives way to two unpacked ones that fit the widened gap more tightly, if there are two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import parts
from tidemark.llm.tokens import encoder
from tidemark.session import staged

#: Pieces packed together.
SHARD = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def _pieces(file: str, size: int, end_id: int, with_ids: bool):
    def run(batches):
        coder = encoder(file)
        for batch in parts(batches, 2 << 20):
            ids, at = coder.encode(batch.column("text"))
            rows, out = [], []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                whole = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(whole), size)):
                    part = whole[start : start + length].tobytes()
                    rows.append((doc, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        out.append(part)
            doc, k, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            made = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(out, pa.binary())} if with_ids else {}))

    return run


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and its place in the bin. No piece is longer than ``size`` or shorter than 1."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=size + 1)
    stop = np.cumsum(count)
    left = count.copy()
    mask = sum(1 << int(n) for n in np.flatnonzero(left))
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal mask
        left[n] -= 1
        if not left[n]:
            mask &= ~(1 << n)
        return int(order[stop[n] - left[n] - 1])

    number = 0
    while mask:
        gap, held = size, []
        while (n := (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            held.append((take(n), n))
            gap -= n
        # what is unpacked is longer than the gap, and two of them must fit the gap widened by the smallest piece
        if gap and held and held[-1][1] >= gap + 2:
            wide = gap + held[-1][1]
            near = np.where(left[: wide + 1] > 0, np.arange(wide + 1), 0)
            best = np.maximum.accumulate(near)
            first = np.flatnonzero(near)
            second = best[wide - first]
            twice = (second == first) & (left[first] < 2)
            second = np.where(twice, best[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            k = int(np.argmax(both)) if len(both) else 0
            if len(both) and both[k] > held[-1][1]:
                at, n = held.pop()
                order[stop[n] - left[n] - 1] = at
                left[n] += 1
                mask |= 1 << n
                held += [(take(int(x)), int(x)) for x in (first[k], second[k])]
        place = 0
        for i, n in held:
            bins[i], places[i] = number, place
            place += n
        number += 1
    return bins, places


def _pack(size: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        bins, places = best_two_fit(pdf["length"].to_numpy(np.int64), size)
        return pdf.drop(columns="shard").assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=places)

    return run


def best_fit_packing(documents: DataFrame, size: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard: int = SHARD) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of ``documents`` (doc_id, text; other
    columns are left alone).

    A null or empty text is the end id alone. Every row is packed, repeated rows and null doc_ids too. Texts of any length
    are taken whole. An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = staged(docs.mapInArrow(_pieces(tokenizer, size, end_id, False), PIECES), "pieces")
    shards = max(1, round(pieces.count() / shard))
    # the order of rows in the written pieces is fixed, so a task that runs again deals them alike
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(_pack(size), PIECES + ", sequence_id long, offset long")


def packed_sequences(documents: DataFrame, packed: DataFrame, size: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids, doc_ids)``: the sequences themselves; ids are little-endian unsigned 32-bit numbers."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.mapInArrow(_pieces(tokenizer, size, end_id, True), PIECES + ", ids binary").select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    on = [packed[c].eqNullSafe(ids[c]) for c in ("doc_id", "piece", "ids_crc32")]
    placed = packed.join(ids, on).select("sequence_id", F.struct("offset", packed["doc_id"], "ids", "length").alias("p"))
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return whole.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"]).alias("n_tokens"), joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
