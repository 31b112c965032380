"""Importance resampling towards a target distribution, over hashed n-grams from a position table.

The words of a document become rows with their positions; ``lead()`` over the document brings the words that follow next to each, so a row
holds the runs of one to three words that begin there. Each run is hashed to a bucket; a bucket's gain is the logarithm of how much more
of the target than of the documents falls into it, a document's weight the sum over its runs. Documents are then drawn without
replacement by the highest weights after Gumbel noise from their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import staged

#: What is between words once A-Z are lower-cased: the ASCII characters that are neither digits nor letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents ranked by one task, about.
RANKED = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def buckets(texts: DataFrame, order: int, size: int) -> DataFrame:
    """A row for each feature of ``texts`` (text, and a key of one or more columns): its ``bucket`` with the key; null where a run would go
    beyond the text, so that every key has a row.

    Texts are dealt out by key before they are taken apart: what is shuffled is the text once, and the windows over the words of a
    document find them together.
    """
    rest = [c for c in texts.columns if c != "text"]
    words = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), BETWEEN)
    # the first row stays though it be empty, and begins no run
    rows = texts.repartition(*rest).select(*rest, F.posexplode(words).alias("pos", "word")).where("word <> '' or pos = 0")
    w = Window.partitionBy(*rest).orderBy("pos")
    rows = rows.select(*rest, "word", *(F.lead("word", k).over(w).alias(f"next{k}") for k in range(1, order)))
    runs = [F.concat_ws(" ", "word", *(f"next{j}" for j in range(1, k + 1))) for k in range(order)]
    whole = [F.col("word") != "", *(F.col(f"next{k}").isNotNull() & (F.col("word") != "") for k in range(1, order))]
    hashed = [F.when(there, (F.crc32(run.cast("binary")) % size).cast("int")) for run, there in zip(runs, whole, strict=True)]
    return rows.select(*rest, F.explode(F.array(*hashed)).alias("bucket"))


def bucket_counts(texts: DataFrame, order: int, size: int) -> DataFrame:
    """``(bucket, n)`` of all features of ``texts``."""
    return buckets(texts, order, size).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, size: int) -> DataFrame:
    """``(bucket, gain)`` of every bucket from the counts of both sides; no more than ``size`` rows."""
    spark = raw.sparkSession
    every = spark.range(size).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    # both totals over the buckets, no more rows than that
    w = Window.partitionBy(F.lit(0))
    s, t = (F.col(c).cast("double") for c in ("s", "t"))
    all_s, all_t = (F.sum(c).over(w).cast("double") for c in ("s", "t"))
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size)))).alias("gain"))


def gumbel(seed: int, doc_id: Column) -> Column:
    """Noise in thousandths, from the id alone; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, by: list[Column], most: int, size: int = RANKED) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... in the order of ``by`` for the first ``most``, null beyond. Rows are dealt out by ranges of the order,
    each range is numbered by itself, and begins where those before it end."""
    parts = max(1, -(-rows.count() // size))
    dealt = staged(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "ranges")
    before, first = [], 0
    for part, n in dealt.groupBy("part").count().orderBy("part").collect():
        before.append((part, first))
        first += n
    starts = rows.sparkSession.createDataFrame(before, "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("before")
    return dealt.join(starts, "part").withColumn("rank", number).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("part", "before")


def importance_resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, order: int = 3, size: int = 10_000, seed: int = 42) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``documents`` (doc_id, text) against ``target`` (text); other columns
    are left alone.

    ``percent`` of the documents with at least ``least_words`` words are drawn. A null text has no words; without features the weight is
    0. Repeated rows each return a row and count each; of equal scores the smaller doc_id comes first, a null one last. Texts of any length
    are read whole. An empty table gives an empty result, an empty target only tells all buckets apart by the documents.
    """
    # a key of its own for each row: ids may repeat or be null
    docs = documents.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = bucket_counts(target.select(F.monotonically_increasing_id().alias("key"), "text"), order, size)
    # one plan, so that both readings of the words share the shuffle of the texts
    gain = gains(bucket_counts(docs, order, size), wanted, size)
    # at most ``size`` rows are broadcast
    weighed = buckets(docs, order, size).join(F.broadcast(gain), "bucket", "left").groupBy("key", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0).cast("long")).alias("weight"))
    scored = staged(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(seed, F.col("doc_id"))).alias("score")), "scored")
    # so many features has a text of so many words
    enough = F.col("n_features") >= sum(max(least_words - k, 0) for k in range(order))
    able = scored.where(enough)
    out = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], percent * able.count() // 100)
    return out.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
