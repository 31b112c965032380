"""The audit of sources against a plain reading of its definition."""

import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import divergence
from tidemark.llm.divergence import SLOTS, partner, share, source_divergence
from tidemark.llm.queries import QUERIES
from tidemark.session import ship

SMALL = "/root/testdata/sf0.001"


def expected(docs, most=200):
    rows = []
    by_lang = collections.defaultdict(list)
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        by_lang[lang or ""].append((source or "", terms))
    for lang, of in by_lang.items():
        in_docs = collections.Counter(t for _, ts in of for t in set(ts))
        kept = [t for t, n in in_docs.items() if n >= 3]
        count = collections.defaultdict(collections.Counter)
        for source, ts in of:
            count[source].update(t for t in ts if in_docs[t] >= 3)
        whole = sum(count.values(), collections.Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in shares:
            pairs = [(-sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o) for o in shares if o != s]
            terms = [(-((shares[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[s][t] > 0 and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most])):
                rows += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(rows)


def test_every_two_slots_meet_once():
    met = [frozenset((i, partner(i, turn))) for turn in range(1, SLOTS) for i in range(SLOTS)]
    assert all(partner(partner(i, turn), turn) == i != partner(i, turn) for turn in range(1, SLOTS) for i in range(SLOTS))
    assert collections.Counter(met) == {frozenset(x): 2 for x in itertools.combinations(range(SLOTS), 2)}


def test_shares_are_exact():
    for total, terms in ((0, 1), (7, 3), (10**13, 10**9), (9 * 10**14, 12345)):
        n = np.array([0, 1, 5, total // 3, total])
        assert share(n, total, terms).tolist() == [1 + 10**9 * (int(x) + 1) // (total + terms) for x in n]


def test_query_on_the_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "source", "text").collect()]
    got = QUERIES["op11_source_divergence"](spark, SMALL)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == expected(docs)


def test_nulls_ties_repeats_clashes_and_many_shards(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    rng = random.Random(4)
    words = ["Straße", "ÉCOLE", "x", "Y", "漢字", "it's", "a1b", "zz", "zZ", "don", "éa", "\U00010000b", "￮"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é", "z", "s4", "s5", "s6", "s7", "s8"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    docs += [("fr", "only", "one document here"), ("fr", "other", None), ("it", "alone", "x x x"), ("", "", "x y"), ("en", "s1", "word " * 200_000), ("en", "empty", "12 34")] + [docs[0]] * 3
    table = spark.createDataFrame([(*d, "clash", 1.0) for d in docs], "lang string, source string, text string, term string, slot double").repartition(4)
    assert sorted(map(tuple, source_divergence(table).collect())) == expected(docs)
    assert sorted(map(tuple, source_divergence(table, most=2).collect())) == expected(docs, 2)
    assert source_divergence(table.limit(0)).count() == 0
    assert sorted(map(tuple, source_divergence(table.withColumn("text", F.lit(None).cast("string"))).collect())) == expected([(a, b, None) for a, b, _ in docs])
