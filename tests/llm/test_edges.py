"""Nulls, repeated rows, empty tables and clashing columns for the operators that other files do not cover; searches against brute force."""

import itertools
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import secret_scan as ss
from tidemark.llm.cap_filters import FEW, embedding_links
from tidemark.llm.language_id import accepted, language_id
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.token_counts import token_counts
from tidemark.session import ship

SF = "/root/testdata/sf0.01/documents.parquet"
CLASH = ("keys", "n", "node", "h1", "component_id", "spans", "piece", "tokens", "fingerprint", "rank", "hit", "lang_pred", "score", "shard", "row")


def _docs(spark):
    ship(spark)
    rows = [(1, "alpha beta gamma", "en", "s"), (1, "alpha beta gamma", "en", "s"), (None, "delta", None, None), (2, None, "de", "s"), (3, "", "de", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH})


@pytest.mark.parametrize("run, n", [(token_counts, 3), (best_fit_packing, 5), (language_id, 5), (ss.scan_secrets, 5), (ngram_jaccard_join, 5)])
def test_odd_rows(spark, run, n):
    docs = _docs(spark)
    assert run(docs).count() == n and run(docs.limit(0)).count() == 0


def test_accepted_keeps_columns(spark):
    docs = _docs(spark)
    assert accepted(docs).columns == docs.columns and accepted(docs.limit(0)).count() == 0


def test_jaccard_of_ninety_with_a_hot_passage(spark):
    ship(spark)
    rng = random.Random(2)
    hot = [f"h{i}" for i in range(40)]
    texts = []
    for i in range(150):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((2, 3, 5, 40, 90)))]
        texts.append(hot + own if i % 3 else own)
    texts += [[*t[:-1], "z"] for t in texts[:60]] + texts[:30] + [[*t, "a"] for t in texts[40:90]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        sets = [{tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in texts]
        comp = list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs.repartition(5), k, percent).collect()}
        assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


@pytest.mark.parametrize("others", [1000, FEW + 3000])
def test_embedding_pairs_at_the_threshold(spark, others):
    """Few vectors, all pairs of which are compared, and more, which meet in their filters."""
    ship(spark)
    rng = np.random.default_rng(3)
    a, z = rng.standard_normal((2, 500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.93, (500, 1))
    x = np.concatenate((a, cos * a + np.sqrt(1 - cos**2) * z, rng.standard_normal((others, 64))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50_000, None), (50_001, [float("inf")] * 64), (50_002, [0.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "part": F.lit(2), "n_links": F.lit(3)})
    got = embedding_links(table).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert (got["n_links"].to_numpy()[: len(x)] <= want).all() and got["n_links"].sum() >= 0.98 * want.sum()
    assert (got.loc[50_000:, "n_links"] == 0).all() and (got["kept"] == (got.index == got["component_id"])).all()


def test_planted_keys_of_other_kinds_are_found(spark):
    ship(spark)
    rng = random.Random(1)
    letters, planted, rows = string.ascii_letters + string.digits, {}, []
    for i, r in enumerate(spark.read.parquet(SF).select("doc_id", "text").where("text is not null").orderBy("doc_id").collect()):
        text = r["text"]
        if i % 6 == 0 and " " in text:
            value = ("ghp_" + "".join(rng.choices(letters, k=36)), "".join(rng.choices(letters, k=32)), "xoxb-" + "".join(rng.choices(letters, k=30)))[i // 6 % 3]
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), value)
            text = " ".join(words)
            planted[r["doc_id"]] = (text.index(value), text.index(value) + len(value))
        rows.append((r["doc_id"], text))
    hits = false = 0
    for r in ss.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        added = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("crf")]
        a, z = planted.get(r["doc_id"], (-1, -1))
        hits += any(s < z and a < e for s, e in added)
        false += sum(not (s < z and a < e) for s, e in added)
    assert hits >= 0.9 * len(planted) and false <= 0.02 * len(rows)
