"""Each stage of the pipeline on planted rows, and what all of them keep."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm.packing import best_fit_packing, best_two_fit, packed_sequences
from tidemark.llm.tokens import encoder
from tidemark.session import ship

ALPHABETS = {"aa": "abcde", "bb": "klmno", "cc": "uvwxz"}


def _prose(rng, lang, words=60, per_line=12):
    w = ["".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(3, 9))) for _ in range(words)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, words, per_line))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents, the ids that must go and why, and the folder of the tables."""
    ship(spark)
    rng = random.Random(3)
    rows, gone = [], {}
    for i in range(120):
        lang = sorted(ALPHABETS)[i % 3]
        rows.append([i, _prose(rng, lang), lang, "s", 0])
    item = _prose(rng, "aa", 24, 24)
    rows.append([200, None, None, "s", 0])
    rows.append([201, "12 34 !", None, "s", 0])
    rows.append([202, "", "aa", "s", 0])
    gone |= dict.fromkeys((200, 201, 202), "language")
    rows.append([210, rows[5][1], rows[5][2], "s", 0])
    gone[210] = "a copy, all of whose lines go"
    # one line of another document among lines of its own
    rows.append([211, _prose(rng, "bb") + "\n" + rows[1][1].split("\n")[2], "bb", "s", 0])
    near = rows[8][1].replace("\n", " ").split()
    rows[8][1] = " ".join(near)
    near[30] = "zzzz"
    # the same words in lines cut elsewhere, so that line dedup leaves it to the shingles
    rows.append([212, "\n".join(" ".join(near[i : i + 25]) for i in range(0, 60, 25)), "cc", "s", 0])
    gone[212] = "a near copy"
    leak = item.split()
    leak[7] = "eeee"
    rows.append([213, _prose(rng, "aa", 24) + " " + " ".join(leak), "aa", "s", 0])
    gone[213] = "a benchmark passage"
    base = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
    return rows, gone, f"file://{base}"


def test_stages_drop_what_is_planted_and_no_more(spark, planted):
    rows, gone, sf = planted
    docs, had = spark.read.parquet(f"{sf}/documents.parquet"), {r[0] for r in rows}
    dropped = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        dropped[name], had = had - left, left
    assert dropped["language_id"] == {200, 201, 202} and dropped["decontamination"] == {213}
    assert dropped["line_dedup"] | dropped["ngram_jaccard"] == {210, 212}
    text = {r["doc_id"]: r for r in docs.collect()}
    assert len(text[211]["text"].split("\n")) == 5 and text[211]["n_chars"] == len(text[211]["text"])
    assert all(text[i]["text"] == rows[i][1] for i in range(120))
    packed = cp.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed["doc_id"]) == set(text) == {r[0] for r in rows} - set(gone)


def test_run_equals_the_stages_on_empty_and_clashing_tables(spark, planted, tmp_path):
    rows, gone, sf = planted
    assert {r["doc_id"] for r in cp.run(spark, sf).select("doc_id").collect()} == {r[0] for r in rows} - set(gone)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({x: F.lit(1) for x in ("gone", "found", "row", "component_id", "n_dropped")})
    for name, stage in cp.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_pieces_and_sequences_are_those_of_the_tokenizer(spark):
    ship(spark)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.choice((3, 50, 700, 5000)))) for _ in range(25)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = best_fit_packing(docs)
    pieces = {(r["doc_id"], r["piece"]): r for r in packed.collect()}
    ids, at = encoder("byte_bpe_50k.json").encode(texts)
    n = 0
    for i in range(len(texts)):
        whole, start = [*ids[at[i] : at[i + 1]].tolist(), 0], 0
        for k in range(-(-len(whole) // 2048)):
            r = pieces[i, k]
            part = whole[start : start + r["length"]]
            assert r["start"] == start and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            assert k == 0 or r["length"] == 2048
            start, n = start + r["length"], n + 1
        assert start == len(whole)
    assert n == len(pieces)
    whole = packed_sequences(docs, packed).collect()
    assert sum(r["n_tokens"] for r in whole) == len(ids) + len(texts) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


def test_two_smaller_pieces_take_the_place_of_the_smallest():
    bins, _ = best_two_fit(np.array([75, 15, 12, 11]), 100)
    assert bins[0] == bins[2] == bins[3] and bins[1] != bins[0]
