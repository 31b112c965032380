"""Delta-maintained token counts by source, language and tokenizer version.

Changes come as signed rows: +1 for an inserted document, -1 for a deleted one, and a revised count as both. A batch of changes is
summed to one row a group and appended under its batch id; a commit names the batch and the attempt that counts, once. The totals are
the sums over committed attempts: a batch that is committed again, or whose first attempt was lost half-way, counts once.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text import parts
from tidemark.llm.tokens import encoder
from tidemark.session import shared_dir, staged

GROUP = ["source", "lang", "tokenizer"]
COUNTED = "doc_id long, source string, lang string, fingerprint string, tokens long"
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string, attempt string"
_COMMITS = "batch string, attempt string"
_BASE = "source string, lang string, tokenizer string, docs long, tokens long"


def _count(file: str):
    def run(batches):
        coder = encoder(file)
        for batch in parts(batches, 2 << 20):
            _, at = coder.encode(batch.column("text"))
            n = pa.array(at[1:] - at[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "fingerprint")), n], names=["doc_id", "source", "lang", "fingerprint", "tokens"])

    return run


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, source, lang, fingerprint, tokens)`` of every row; a null text is empty, with no tokens."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.md5(text.cast("binary")).alias("fingerprint"), text.alias("text"))
    return docs.mapInArrow(_count(tokenizer), COUNTED)


def changes(counted: DataFrame, sign: int, tokenizer: str) -> DataFrame:
    """Signed rows for documents that come (+1) or go (-1)."""
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"))


def revised(before: DataFrame, after: DataFrame, tokenizer: str) -> DataFrame:
    """Signed rows for documents whose count, source or language is another now."""
    return changes(before, -1, tokenizer).unionByName(changes(after, 1, tokenizer))


class TokenRollup:
    """The totals under a folder that all executors share; ``path`` None makes a new one there.

    A commit is a folder named by its batch, which can exist once: of two writers of one batch the second to commit changes nothing, whatever
    their clocks say. ``compact`` sums up what is committed, so that reading stays cheap.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}"
        for name, schema in (("deltas", _DELTAS), ("commits/name=none", _COMMITS), ("base/gen=0", _BASE), ("included/gen=0", "batch string")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _counting(self) -> DataFrame:
        """The attempt that counts of each batch; should a file system have let two in, the least."""
        return self._table("commits", _COMMITS).groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def _generation(self) -> int:
        return self._table("included", "batch string, gen int").agg(F.max("gen")).first()[0] or 0

    def committed(self, batch: str) -> bool:
        return bool(self._table("commits", _COMMITS).where(F.col("batch") == batch).limit(1).count())

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds a batch of signed rows (source, lang, tokenizer, docs, tokens); False, and no change, if it is there already."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        summed = signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        summed.coalesce(1).withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)}).write.mode("append").parquet(f"{self.path}/deltas")
        return self._name(batch, attempt)

    def _name(self, batch: str, attempt: str) -> bool:
        """Makes the attempt count; False if another one does."""
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"))
        try:
            row.write.mode("error").parquet(f"{self.path}/commits/name={hashlib.sha256(batch.encode()).hexdigest()}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return False
        return True

    def _rows(self, gen: int) -> DataFrame:
        new = self._counting().join(self._table(f"included/gen={gen}", "batch string"), "batch", "left_anti")
        rows = self._table("deltas", _DELTAS).join(new, ["batch", "attempt"], "left_semi").select(*GROUP, "docs", "tokens")
        return rows.unionByName(self._table(f"base/gen={gen}", _BASE))

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)``; a group from which all has gone is left out."""
        rows = self._rows(self._generation())
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Writes a new base of all batches committed by now; it counts once the list of its batches is written. One compaction at a time."""
        gen = self._generation()
        batches = staged(self._counting(), "batches")
        old = self._table("deltas", _DELTAS).join(batches, ["batch", "attempt"], "left_semi").join(self._table(f"included/gen={gen}", "batch string"), "batch", "left_anti").select(*GROUP, "docs", "tokens")
        summed = old.unionByName(self._table(f"base/gen={gen}", _BASE)).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        summed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base/gen={gen + 1}")
        batches.select("batch").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/included/gen={gen + 1}")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Totals after three batches over ``documents`` (doc_id, text, source, lang; other columns are left alone).

    "load" inserts every row under the tokenizer's name; "end" revises each count by the end id that packing adds; "copies" deletes
    all but one row of each text (the least doc_id stays, nulls after all others). "load" is then sent once more, as a
    job that is run again would, and counts once. Null sources and languages are groups of their own; a null text is
    empty; an empty table gives an empty result.
    """
    version = tokenizer.rsplit(".", 1)[0]
    counted = staged(count_tokens(documents, tokenizer), "counted")
    ended = counted.withColumn("tokens", F.col("tokens") + 1)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang", "tokens")).alias("kept")
    kept = ended.groupBy("fingerprint").agg(first).select("kept.*")
    rollup = TokenRollup(documents.sparkSession)
    rollup.commit("load", changes(counted, 1, version))
    rollup.commit("end", revised(counted, ended, version))
    rollup.commit("copies", changes(ended, -1, version).unionByName(changes(kept, 1, version)))
    rollup.commit("load", changes(counted, 1, version))
    return rollup.totals()
