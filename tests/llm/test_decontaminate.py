"""Decontamination against a comparison of all windows, by both ways of meeting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dc
from tidemark.session import ship

WORDS = [f"w{i}" for i in range(400)]


def _tables(spark, texts, items):
    ship(spark)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def _brute(texts, items):
    out = set()
    for d, t in enumerate(texts):
        x = (t or "").lower().split()
        for i, u in enumerate(items):
            y = (u or "").lower().split()
            if not y:
                continue
            size = min(12, len(y))
            # items of eight to eleven words may differ in one
            need = 10 if len(y) >= 12 else size - (len(y) >= 8)
            if len(y) < 5:
                hit = x == y
            else:
                hit = any(sum(p == q for p, q in zip(x[a : a + size], y[b : b + size], strict=True)) >= need for a in range(len(x) - size + 1) for b in range(len(y) - size + 1))
            if hit:
                out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [dc.BROADCAST_WORDS, 0])
def test_equals_all_windows(spark, limit):
    rng = random.Random(4)
    items = [" ".join(rng.choices(WORDS, k=k)) for k in (1, 3, 5, 9, 11, 12, 13, 30, 60, 8, 10)] + [None, "", "same " * 40]
    texts = [None, "", "same " * 300, *items[:5]]
    for _ in range(40):
        w = rng.choices(WORDS, k=rng.randrange(5, 60))
        y = rng.choice(items[:11]).split()
        part = y[(a := rng.randrange(max(1, len(y) - 11))) : a + rng.randrange(8, 20)]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = rng.choice(WORDS)
        texts.append(" ".join([*w[:7], *part, *w[7:]]))
    docs, bench = _tables(spark, texts, items)
    got = dc.contaminated(docs, bench, limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == _brute(texts, items) and len(got) == len(_brute(texts, items))
    for r in got:
        x, y = texts[r["doc_id"]].split(), items[r["item_id"]].split()
        part = list(zip(x[r["doc_start"] :][: r["n_words"]], y[r["item_start"] :][: r["n_words"]], strict=True))
        assert len(part) == r["n_words"] and sum(a == b for a, b in part) == r["n_same"]


@pytest.mark.parametrize("limit", [dc.BROADCAST_WORDS, 0])
def test_null_ids_and_repeated_rows(spark, limit):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "x a b c d e f g h"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d z f g h"), (None, "a b c d e f g h"), (7, "a b c d z f g h")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_same"]) for r in dc.contaminated(docs, bench, limit).collect()), key=str)
    assert got == sorted([(d, i, n) for d in (1, 1, None) for i, n in ((7, 7), (7, 7), (None, 8))], key=str)


def test_repeated_words_stay_small():
    item, text = np.full(1000, 7, np.uint64), np.full(10_000, 7, np.uint64)
    seeds = dc.Seeds([1], [item])
    hits = seeds.hits(text, np.array([0, len(text)]))
    assert len(hits) == 10_000 + 1000 - 2 * len(min(dc.MASKS, key=len)) + 1
    found = [dc.overlap(text, 0, len(text), item, int(p)) for p in hits[:, 2]]
    assert max(x[2] for x in found if x) == 1000


def test_decontaminated_keeps_clashing_columns(spark):
    docs, bench = _tables(spark, ["a b c d e f", "x y", None], ["a b c d e f"])
    docs = docs.withColumns({"found": F.lit(1), "row": F.lit(2), "item_id": F.lit(3), "_found": F.lit(4)})
    got = dc.decontaminated(docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))), bench)
    assert got.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got.collect()) == [(False, 1, "x y"), (False, 2, None), (True, None, "x y")]
    assert dc.decontaminated(docs.limit(0), bench).count() == 0 and dc.decontaminated(docs, bench.limit(0)).count() == 3
