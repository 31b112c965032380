"""A stored price table: data files by bucket of tickers, and a manifest for each committed step.

A step reads the buckets that it touches, writes them anew, and commits a manifest that names the files of every bucket and of the two side
tables (what the store holds of each ticker, and appended results). A manifest is a folder numbered by its version, which can exist once: of two
writers from one version the second fails and starts over from the new one. Files of a step that was lost before its commit are named by no
manifest, so they count for nothing. The store must be on a file system that refuses to make a folder twice (a cluster's shared one, not
a plain object store).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators import store as st
from tidemark.session import shared_dir, staged

PRICES = "ticker string, dt date, price double"
HELD = "ticker string, first date, last date, intervals string, inception date"
RESULTS = "label string, allocations string, stats string"
_MANIFEST = "part string, path string"
#: Buckets of tickers.
BUCKETS = 16
#: Steps that start over before giving up.
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another step was committed from the same version first."""


def _no_later(held: DataFrame) -> DataFrame:
    """An inception that is known is no later than the first price."""
    return held.withColumn("inception", F.when(F.col("inception").isNotNull(), F.least("inception", "first")))


class PriceStore:
    """The table under ``path`` (None makes a new one in the shared folder)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, tolerance: int = iv.TOLERANCE):
        self.spark, self.buckets, self.tolerance = spark, buckets, tolerance
        self.path = path or f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}"
        if not self._versions():
            try:
                self._commit(-1, {})
            except Conflict:
                pass  # another one has begun it

    # -- manifests ----------------------------------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        try:
            rows = self.spark.read.schema(_MANIFEST + ", version int").parquet(f"{self.path}/manifest")
            return [r[0] for r in rows.select("version").distinct().orderBy("version").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    @property
    def version(self) -> int:
        return self._versions()[-1]

    def _parts(self, version: int) -> dict[str, str]:
        """The files that a version is made of: one row for each bucket and side table."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").where("path is not null")
        return {r["part"]: r["path"] for r in rows.collect()}

    def _commit(self, base: int, parts: dict[str, str]) -> int:
        # a marker row, as a manifest without rows would not be seen among the versions
        rows = self.spark.createDataFrame([("version", None), *parts.items()], _MANIFEST).coalesce(1)
        try:
            rows.write.mode("error").parquet(f"{self.path}/manifest/version={base + 1}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise Conflict(f"version {base + 1} is there already") from e
        return base + 1

    def _step(self, change: Callable[[int, dict[str, str]], dict[str, str]]) -> int:
        """Commits what ``change`` writes over a version: the parts that are other files now. Starts over if another step came first."""
        for left in reversed(range(ATTEMPTS)):
            base = self.version
            parts = self._parts(base)
            try:
                return self._commit(base, parts | change(base, parts))
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    # -- reading ------------------------------------------------------------------------------------------------------------------

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def prices(self, version: int | None = None, tickers: list[str] | None = None) -> DataFrame:
        """``(ticker, dt, price)`` as of a version; of ``tickers`` alone only their buckets are read."""
        parts = self._parts(self.version if version is None else version)
        wanted = None if tickers is None else self._touched(self.spark.createDataFrame([(t,) for t in tickers], "ticker string"))
        rows = self._read([p for k, p in sorted(parts.items()) if k.isdigit() and (wanted is None or int(k) in wanted)], PRICES)
        return rows if tickers is None else rows.where(F.col("ticker").isin(*tickers))

    def held(self, version: int | None = None) -> DataFrame:
        """``(ticker, first, last, intervals, inception, ...)``: what the store holds of each ticker; with the columns that were added."""
        path = self._parts(self.version if version is None else version).get("held")
        return self.spark.read.parquet(path) if path else self.spark.createDataFrame([], HELD)

    def results(self) -> DataFrame:
        """``(label, allocations, stats)`` of all appended results."""
        return self._read([p for k, p in self._parts(self.version).items() if k.startswith("results-")], RESULTS)

    # -- steps --------------------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("ticker"), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def _rewritten(self, parts: dict[str, str], touched: list[int], change: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, str], str]:
        """Writes the touched buckets as ``change`` makes them of their rows; their new paths, and the folder of the step."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        old = self._read([parts[str(b)] for b in touched if str(b) in parts], PRICES)
        change(old).select("ticker", "dt", "price").withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/prices")
        # a bucket that is empty now has no folder
        left = {r[0] for r in self.spark.read.schema(PRICES + ", bucket int").parquet(f"{folder}/prices").select("bucket").distinct().collect()} if touched else set()
        return {str(b): f"{folder}/prices/bucket={b}" if b in left else None for b in touched}, folder

    def _described(self, rows: DataFrame) -> DataFrame:
        return st.described(iv.islands(rows.select("ticker", "dt"), self.tolerance))

    def _held_as(self, table: DataFrame, folder: str) -> dict[str, str]:
        table.coalesce(1).write.parquet(f"{folder}/held")
        return {"held": f"{folder}/held"}

    def _replace(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        # read more than once below
        new = staged(new.select("ticker", "dt", "price"), "new")
        touched = self._touched(new)

        def change(base: int, parts: dict[str, str]) -> dict[str, str]:
            fresh, folder = self._rewritten(parts, touched, lambda old: merge(old, new))
            rows = self._read([p for p in fresh.values() if p], PRICES).join(new.select("ticker").distinct(), "ticker", "left_semi")
            held = self.held(base)
            extra = [c for c in held.columns if c not in ("first", "last", "intervals")]
            told = _no_later(self._described(rows).join(held.select(*extra), "ticker", "left"))
            return fresh | self._held_as(st.upserted(held, told.select(*held.columns)), folder)

        return self._step(change)

    def replace_range(self, new: DataFrame) -> int:
        """From the first to the last of its new days (ticker, dt, price) a ticker has these and no others; what is held is told anew."""
        return self._replace(new, iv.replace_range)

    def replace_days(self, new: DataFrame) -> int:
        """The new days take the place of the same days; all others stay."""
        return self._replace(new, iv.replace_days)

    def delete(self, tickers: DataFrame) -> int:
        """Takes out tickers (ticker): their prices, and what is told of them."""
        gone = tickers.select("ticker").distinct()
        touched = self._touched(gone)

        def change(base: int, parts: dict[str, str]) -> dict[str, str]:
            fresh, folder = self._rewritten(parts, touched, lambda old: st.without(old, gone))
            return fresh | self._held_as(st.without(self.held(base), gone), folder)

        return self._step(change)

    def _side(self, change: Callable[[DataFrame, int], DataFrame]) -> int:
        return self._step(lambda base, _: self._held_as(change(self.held(base), base), f"{self.path}/data/{uuid.uuid4().hex}"))

    def found_inception(self, seen: DataFrame) -> int:
        """An earlier first day (ticker, found) takes the place of what was known, of tickers that the store knows."""
        return self._side(lambda held, _: st.earlier_inception(held, seen).select(*held.columns))

    def truncate(self) -> int:
        """Forgets what is told of all tickers; the prices stay."""
        return self._side(lambda held, _: held.where("false"))

    def migrate(self, columns: dict[str, str]) -> int:
        """Adds the columns (name: type) that are not there yet."""
        return self._side(lambda held, _: st.migrated(held, columns))

    def repair(self) -> int:
        """Tells what is held anew from the prices, whatever was told; inceptions that were known stay."""

        def anew(held: DataFrame, base: int) -> DataFrame:
            extra = held.select("ticker", *(c for c in held.columns if c not in ("ticker", "first", "last", "intervals")))
            told = self._described(self.prices(base)).join(extra, "ticker", "left")
            return _no_later(told).select(*held.columns)

        return self._side(anew)

    def append_results(self, rows: DataFrame) -> int:
        """Appends results (label, allocations, stats)."""

        def change(base: int, parts: dict[str, str]) -> dict[str, str]:
            name = f"results-{uuid.uuid4().hex}"
            rows.select("label", "allocations", "stats").write.parquet(f"{self.path}/data/{name}")
            return {name: f"{self.path}/data/{name}"}

        return self._step(change)
