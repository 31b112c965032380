"""Line dedup against all pairs: copies, and lines of which some words are replaced, by length."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import _lines, _shared, _Words, block_keys, dedup_lines, edit_similarity, line_groups, votes
from tidemark.session import ship

WORDS = "the of and river stone cloud maple tiger harbor window silver garden planet velvet copper meadow lantern".split()


def _docs(spark, texts, schema="doc_id long, text string"):
    ship(spark)
    return spark.createDataFrame(list(enumerate(texts)), schema)


def _line(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


def _replaced(rng, words, k):
    out = list(words)
    for p in rng.sample(range(len(out)), k):
        out[p] = rng.choice(WORDS) + str(rng.randrange(30, 60))
    return out


@pytest.mark.parametrize("n, changes", [(5, 1), (8, 1), (10, 1), (10, 2), (14, 2), (20, 1), (20, 2), (20, 4), (30, 6), (50, 5), (50, 10), (120, 24)])
def test_recall_of_edited_lines(spark, n, changes):
    rng = random.Random(n * 100 + changes)
    pairs = [(x, _replaced(rng, x, changes)) for x in (_line(rng, n) for _ in range(150))]
    docs = _docs(spark, ["\n".join(" ".join(p[side]) for p in pairs) for side in (0, 1)])
    gone = {r["line_no"] for r in line_groups(docs).where("doc_id = 1 and not kept").collect()}
    want = {i for i, p in enumerate(pairs) if edit_similarity(*p, 0.8)}
    assert gone <= want and len(gone) >= 0.9 * len(want) and want


CELLS = [(5, 1, "put"), (6, 1, "cut"), (8, 1, "new"), (9, 1, "put"), (10, 1, "new"), (10, 2, "new"), (10, 2, "cut"), (11, 2, "cut"), (12, 2, "new"), (12, 2, "put"), (14, 2, "new"), (15, 3, "new"), (16, 3, "cut"), (20, 2, "new"), (20, 4, "new"), (20, 4, "cut"), (20, 4, "put"), (30, 6, "new"), (30, 6, "cut"), (40, 8, "new"), (80, 16, "new"), (80, 16, "cut"), (120, 24, "new")]


@pytest.mark.parametrize("letters", [(1, 3), (2, 5), (4, 9)])
def test_recall_by_length_of_words_and_kind_of_edit(spark, letters):
    """Words replaced, taken out or put in, up to a fifth of a line: of each kind at least nine in ten lines are found."""
    rng = random.Random(letters[0])
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(*letters)))
    left, right, want = [], [], {}
    for cell in CELLS:
        n, k, kind = cell
        for _ in range(120):
            x = [word() for _ in range(n)]
            y = list(x)
            for p in sorted(rng.sample(range(n), k), reverse=True):
                y[p : p + 1] = {"new": [word()], "cut": [], "put": [y[p], word()]}[kind]
            if edit_similarity(x, y, 0.8):
                want[len(right)] = cell
            left.append(x)
            right.append(y)
    docs = _docs(spark, ["\n".join(" ".join(x) for x in side) for side in (left, right)])
    gone = {r["line_no"] for r in line_groups(docs).where("doc_id = 1 and not kept").collect()}
    found = {cell: [sum(want[i] == cell for i in gone if i in want), sum(c == cell for c in want.values())] for cell in CELLS}
    assert all(n > 60 and hits >= 0.9 * n for hits, n in found.values()), found
    # what goes beside is similar to another line than its own
    assert len(gone - want.keys()) <= 0.01 * len(right)


def test_equals_all_pairs_on_real_lines(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lines = [(r["doc_id"], i, x.encode().lower().split()) for r in docs.where("text is not null").collect() for i, x in enumerate(r["text"].split("\n"))]
    lines = sorted(x for x in lines if x[2])
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = {}
    sets = [set(x[2]) for x in lines]
    for j, (_, _, words) in enumerate(lines):
        i = known.setdefault(tuple(words), j)
        if i != j:
            parent[find(j)] = find(i)
    rep = sorted(known.values())
    for a, i in enumerate(rep):
        for j in rep[a + 1 :]:
            x, y = lines[i][2], lines[j][2]
            low, high = sorted((len(x), len(y)))
            if low >= 5 and low >= 0.8 * high and len(sets[i] & sets[j]) >= 0.4 * low and find(i) != find(j) and edit_similarity(x, y, 0.8):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    groups = {}
    for i in range(len(lines)):
        groups.setdefault(find(i), []).append(i)
    want = {lines[i][:2] for g in groups.values() for i in sorted(g)[1:]}
    got = {(r["doc_id"], r["line_no"]) for r in line_groups(docs).where("not kept").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_lines_of_long_texts_and_short_copies(spark):
    rng = random.Random(5)
    far = [" ".join(_line(rng, 12)) for _ in range(9000)]
    texts = ["\n".join(far), "x\n\n" + far[8999].upper() + "  \nx", None, "", "\n\n"]
    got = {r["doc_id"]: r for r in dedup_lines(_docs(spark, texts)).collect()}
    assert got[0]["n_dropped"] == 0 and got[0]["text"] == texts[0]
    assert got[1]["text"] == "x\n" and got[1]["n_dropped"] == 2 and got[1]["n_lines"] == 4
    assert [got[i]["text"] for i in (2, 3, 4)] == texts[2:] and [got[i]["n_lines"] for i in (2, 3, 4)] == [0, 1, 3]


def test_a_hot_line_and_its_variants(spark):
    rng = random.Random(6)
    hot = _line(rng, 20)
    texts = [" ".join(hot if i % 2 else _replaced(rng, hot, 2)) + "\n" + " ".join(_line(rng, 9)) for i in range(600)]
    got = dedup_lines(_docs(spark, texts).repartition(8)).agg(F.sum("n_dropped")).first()[0]
    assert got == 599


def test_clashing_columns_nulls_and_repeated_rows(spark):
    ship(spark)
    rows = [(1, "a b c d e", 7, "u"), (1, "a b c d e", 8, "v"), (None, "a b c d e", 9, None), (2, "A b c d e", None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped long, h string").withColumns({"drop": F.lit(1), "row": F.lit(2), "line_no": F.lit(3), "keys": F.lit(4), "_drop": F.lit(5)})
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "h", "drop", "row", "line_no", "keys", "_drop", "n_lines", "n_dropped"]
    kept = {r["h"]: (r["text"], r["n_dropped"]) for r in got.collect()}
    assert kept["w"] == ("", 1) and kept[None] == ("a b c d e", 0) and len(kept) == 4
    assert dedup_lines(docs.limit(0)).count() == 0


def test_keys_of_several_lines_are_counted_once_a_line(spark):
    """Copies of a line count once, the sizes are those of all pairs, and upper bits tell keys apart."""
    ship(spark)
    rng = random.Random(8)
    h = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    keys = [[rng.randrange(400) for _ in range(rng.randrange(6))] + ([2**40 - 1] if i % 2 else []) for i in range(300)]
    rows = [(h[i], keys[i]) for i in range(300)] * 3 + [(h[1], keys[1])] * 2000
    want: dict = {}
    for x, ks in zip(h, keys, strict=True):
        for k in ks:
            want.setdefault(k, set()).add(x)
    got = {r["key"]: r["size"] for r in _shared(spark.createDataFrame(rows, "h long, keys array<long>").repartition(5)).collect()}
    assert got == {k: len(v) for k, v in want.items() if len(v) > 1}
    # one word once or twice gives equal bits of a block, and other numbers of words
    words = np.array([7] * 12 + [7] * 13, np.uint64)
    found, at = block_keys(words, np.full(25, 9), np.array([0, 12, 25]))
    assert at[1] and not {*(found[: at[1]] >> np.uint64(24)).tolist()} & {*(found[at[1] :] >> np.uint64(24)).tolist()}


def test_copies_that_a_task_meets_have_keys_once():
    rng = random.Random(9)
    texts = [_line(rng, n) for n in (6, 12, 30, 90)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [" ".join(texts[i % 4]) + "\n" + " ".join(texts[0]).upper() for i in range(40)]})
    got = pa.Table.from_batches(_lines(5)(iter([rows.slice(0, 20), rows.slice(20)]))).to_pylist()
    assert len(got) == 80 and len({x["h"] for x in got}) == 4
    assert sorted(len({x["h"]} if x["keys"] else ()) for x in got) == [0] * 76 + [1] * 4


def test_pairs_told_apart_together_are_those_of_counted_edits():
    rng = random.Random(10)
    pairs = []
    for n in [*range(1, 40), 70, 130, 300]:
        for few in (3, 12, 1000):
            x = [f"w{rng.randrange(few)}" for _ in range(n)]
            for k in range(8):
                y = list(x)
                for _ in range(rng.randrange(n // 3 + 2)):
                    p = rng.randrange(len(y) + 1)
                    y[p : p + rng.randrange(2)] = [f"w{rng.randrange(few)}"] * rng.randrange(2)
                pairs.append((x, rng.sample(y, len(y)) if k == 7 else y))
    size = len(pairs)
    words = _Words(pa.array([" ".join(p[side]) for side in (0, 1) for p in pairs]), 0.8)
    want = [edit_similarity(*p, 0.8) for p in pairs]
    assert words.similar(np.arange(size), np.arange(size, 2 * size)).tolist() == want and 0.2 * size < sum(want) < 0.8 * size


def test_votes_are_those_of_most_hashes_in_runs_of_any_length():
    rng = np.random.default_rng(11)
    n = np.array([1, 2, 3, 64, 65, 200, 255, 256, 300, 5, 70001])
    start = np.array([7, 0, 3, 11, 2, 1, 90, 40, 5, 9, 13])
    h = rng.integers(0, 2**64, 80000, np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    want = [np.packbits(2 * bits[a : a + k].sum(axis=0, dtype=np.int64) > k).view(np.uint64)[0] for a, k in zip(start, n, strict=True)]
    assert votes(h, start, n).tolist() == [int(x) for x in want]
    assert len(votes(h, start[:0], n[:0])) == 0
