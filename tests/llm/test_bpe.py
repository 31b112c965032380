"""Encoding and decoding by replayed merges, held against the library's own encoder."""

import base64
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm.bpe_replay import MANY, Merges, bpe_decode, bpe_digests, bpe_encode, ranks_of
from tidemark.llm.queries import QUERIES
from tidemark.session import ship

RANKS = "byte_bpe_multi_50k.tiktoken"
SMALL = "/root/testdata/sf0.001"


@functools.cache
def library():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text: str | None) -> tuple:
    coder = library()
    ids = np.array(coder.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode_bytes(ids.tolist())).hexdigest()


def test_random_texts(spark):
    ship(spark)
    rng = random.Random(5)
    letters = "abcdehllorst  '\n\tsdé漢字АбЯ09._-　 \u0085😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(100)]
    texts += ["", None, "a" * 3001, "ab" * 2000, " " * 500, "\n\n \n", "don't we'll I'd", "<|endoftext|>", "x" * 70_000 + " y"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    coder = library()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe_encode(docs).collect()}
    assert got == {i: coder.encode_ordinary(x or "") for i, x in enumerate(texts)}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe_decode(bpe_encode(docs)).collect()}
    assert back == {i: (x or "").encode() for i, x in enumerate(texts)}


def test_order_of_merges():
    """A vocabulary in which a merge makes a pair of a lower rank, which comes before the word's next place of the higher one; many words at
    once and few give the same."""
    tokens = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"bc": 258, b"abab": 259, b"cc": 260, b"ccc": 261}
    coder = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=tokens, special_tokens={})
    merges = Merges(tokens)
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for some in (words, words[: MANY // 2], ["ababab", "ab" * 40, "c" * 33]):
        ids, size = merges.replay([w.encode() for w in some])
        own = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
        # the library takes a whole word that is a token as it is; here only merges are compared
        alone = [(w, x) for w, x in zip(some, own, strict=True) if w.encode() not in tokens]
        assert all(x == coder.encode_ordinary(w) for w, x in alone) and alone


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = QUERIES["op12_byte_bpe"](spark, SMALL).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(rows) == len(texts) and all(tuple(r)[1:] == expected(texts[r["doc_id"]]) for r in rows)


def test_nulls_repeats_clashes_and_an_empty_table(spark):
    ship(spark)
    rows = [(1, "two words", "x"), (1, "two words", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, bpe_digests(docs).collect()), key=str)
    assert got == sorted(((r[0], *expected(r[1])) for r in rows), key=str)
    assert bpe_digests(docs.limit(0)).count() == 0 and bpe_encode(docs.limit(0)).count() == 0
    assert len(ranks_of(public_tokenizers.path(RANKS))) == 50256
