"""The seatings against exact sums over all of them, and scores that do not follow the layout."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_model as lm
from tidemark.session import ship


def _stirling(n, t, d):
    """Ways to seat n customers of a dish at t tables, weighted by a discount."""
    if n == 0 or t == 0:
        return float(n == t)
    return _stirling(n - 1, t - 1, d) + (n - 1 - t * d) * _stirling(n - 1, t, d)


@pytest.mark.parametrize("n, p", [((5, 2), (0.3, 0.1)), ((3, 3, 1), (0.05, 0.4, 0.2)), ((9,), (0.6,))])
def test_gibbs_equals_the_sum_over_all_seatings(n, p):
    d, s = 0.5, lm.STRENGTH
    total, tables, value = 0.0, np.zeros(len(n)), np.zeros(len(n))
    for t in itertools.product(*(range(1, k + 1) for k in n)):
        w = math.prod(s + k * d for k in range(sum(t))) * math.prod(_stirling(a, b, d) * q**b for a, b, q in zip(n, t, p, strict=True))
        total += w
        tables += w * np.array(t)
        value += w * np.array([(a - d * b + (s + d * sum(t)) * q) / (s + sum(n)) for a, b, q in zip(n, t, p, strict=True)])
    # many rooms alike, side by side
    rooms, k = 4000, len(n)
    room = np.repeat(np.arange(rooms), k)
    parent = np.tile(p, rooms)
    r = lm.Rooms(room, np.tile(n, rooms), parent, np.random.default_rng(1), 60, discount=d)
    for _ in range(60):
        r.sweep(parent)
    assert r.t.reshape(rooms, k).mean(axis=0) == pytest.approx(tables / total, rel=0.04)
    assert r.predictive(parent).reshape(rooms, k).mean(axis=0) == pytest.approx(value / total, rel=0.02)
    for i in np.flatnonzero(np.tile(n, rooms) > 1)[:50]:
        j = np.searchsorted(r.live, i)
        own = r.size[r.start[j] : r.start[j] + r.t[i]]
        assert own.sum() == np.tile(n, rooms)[i] and own.min() >= 1


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 30, 500)
    parent = rng.random(500)
    parent /= parent.sum()
    r = lm.Rooms(np.zeros(500, np.int64), n, parent, rng, 3)
    r.sweep(parent)
    assert r.predictive(parent).sum() == pytest.approx(1)
    # a room that is split in two: each half is told how many customers there are in all
    halves = []
    for own in (np.arange(500) % 2 == 0, np.arange(500) % 2 == 1):
        h = lm.Rooms(np.zeros(own.sum(), np.int64), n[own], parent[own], rng, 3, np.array([n.sum() / n[own].sum()]))
        h.sweep(parent[own])
        halves.append(h.predictive(parent[own]).sum())
    assert sum(halves) == pytest.approx(1, abs=0.05)


def test_speller_is_a_distribution():
    words = [b"ab", b"abc", b"b", "é".encode(), b""]
    keys, n = lm.spell(words)
    u, inverse = np.unique(keys, return_inverse=True)
    speller = lm.Speller(u, np.bincount(inverse))
    alphabet = bytes(x for x in range(256) if x not in (0x20, 0x0A))
    one = [bytes([x]) for x in alphabet]
    # one symbol and more, or the end, or a space at once
    first = sum(10 ** (speller.log10([x])[0]) for x in one)
    assert 0 < first < 1 and (speller.log10(words) < 0).all()
    context = np.arange(256) | 0x20 << 8 | 0x20 << 16
    p = speller.rest[0][context >> 8] * speller.one[context & 0xFFFF]
    known = np.isin(context, speller.known)
    p[known] = speller.value[np.searchsorted(speller.known, context[known])]
    assert p.sum() == pytest.approx(1, abs=1e-9)


def _docs(spark, texts):
    ship(spark)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _text(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(n))


def test_layout_and_splitting_of_frequent_words(spark, monkeypatch):
    docs = _docs(spark, [_text(i, 80) for i in range(120)] + [None, ""])
    scores = lambda df: df.orderBy("doc_id").toPandas()["score"].to_numpy()
    one = scores(lm.score_texts(docs.coalesce(1)))
    assert scores(lm.score_texts(docs.repartition(11))) == pytest.approx(one, rel=1e-9)
    monkeypatch.setattr(lm, "FREQUENT", 300)
    monkeypatch.setattr(lm, "PART", 8000)
    monkeypatch.setattr(lm, "WORD_PART", 16000)
    many = scores(lm.score_texts(docs.repartition(3)))
    assert many.sum() == pytest.approx(one.sum(), rel=0.02)


def test_rows_repeat_and_columns_clash(spark):
    docs = _docs(spark, ["a b c", "a b c", None]).unionByName(_docs(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = lm.score_texts(docs.unionByName(docs).withColumns({"chunk": F.lit(1), "part": F.lit(2), "held_out": F.lit("h"), "score": F.lit(0)}))
    assert got.count() == 8 and got.where("doc_id is null and not held_out").count() == 2
    assert got.where("doc_id = 2").select("n_tokens").distinct().collect()[0][0] == 1
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_unseen_words_of_any_length_have_a_finite_score(spark):
    import zlib

    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = random.Random(7)
    odd = ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (1, 8, 20, 28, 40, 60, 80, 120, 160, 400, 2000)]
    odd += ["https://example.org/a/very/long/path?with=query&and=more", "漢字" * 200, "é" * 90, "\x00\x01" * 50]
    texts = {i: f"see {w} ok" for i, w in zip(held, odd, strict=False)}
    rows = [(i, texts.get(i, _text(i, 30) + " see this ok")) for i in range(held[len(odd)])]
    ship(spark)
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    scores = [got[i]["score"] for i in held[: len(odd)]]
    assert all(math.isfinite(x) for x in scores) and all(math.isfinite(r["score"]) for r in got.values())
    # a longer word costs more, each byte no more than a uniform choice and the way down to it
    assert scores[:11] == sorted(scores[:11], reverse=True) and -2000 * 6 < scores[10] < -2000


def test_logarithms_equal_probabilities_where_both_can_be_told():
    rng = np.random.default_rng(5)
    n = rng.integers(0, 6, 400)
    room = np.sort(rng.integers(0, 40, 400))
    parent = rng.random(400) / 200
    a = lm.Rooms(room, n, parent, np.random.default_rng(3), lm.BURN + lm.AVERAGED)
    b = lm.Rooms(room, n, parent, np.random.default_rng(3), lm.BURN + lm.AVERAGED)
    mean = np.zeros(400)
    for k in range(lm.BURN + lm.AVERAGED):
        b.sweep(parent)
        if k >= lm.BURN:
            mean += b.predictive(parent) / lm.AVERAGED
    assert a.averaged(parent, np.log10(parent)) == pytest.approx(np.log10(mean), rel=1e-12)
