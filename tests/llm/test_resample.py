"""Resampling towards a target distribution, against a plain reading of its definition."""

import collections
import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm.queries import QUERIES
from tidemark.llm.resample import importance_resample, ranked
from tidemark.session import ship

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def expected(docs, target, percent=5):
    of = [(doc_id, *features(text)) for doc_id, text in docs]
    s, t = collections.Counter(b for _, _, f in of for b in f), collections.Counter(b for x in target for b in features(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, n, f in of:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([doc_id, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_query_on_the_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op13_importance_resample"](spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(dict(got.dtypes).values()) == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, target)


def test_nulls_ties_repeats_clashes_and_long_texts(spark):
    ship(spark)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Straße", "x", "y2", "ÉCOLE", "漢字", "a-b", "Z"]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for _ in range(60)]
    texts += [None, "", " .. ", "...lead word", "trail word!!", "word " * 30_000]
    docs = [(i, x) for i, x in enumerate(texts)] + [(7, texts[7])] * 3 + [(None, "no id at all " * 9)] * 2 + [(7, "another text of the same id " * 5)]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, bucket string, key int").repartition(5)
    target = ["x y2 école", None, "漢字 a b"]
    goal = spark.createDataFrame([(x, 0) for x in target], "text string, key int")
    for percent in (5, 50, 100):
        assert sorted(map(tuple, importance_resample(table, goal, percent).collect()), key=str) == expected(docs, target, percent)
    assert importance_resample(table.limit(0), goal).count() == 0
    assert sorted(map(tuple, importance_resample(table, goal.limit(0)).collect()), key=str) == expected(docs, [])


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(300)).alias("score"))
    got = ranked(rows, [F.col("score").desc(), F.col("id").asc()], 3000, size=200).collect()
    order = sorted(got, key=lambda r: (-r["score"], r["id"]))
    assert [r["rank"] for r in order] == [*range(1, 3001), *[None] * 2000]
