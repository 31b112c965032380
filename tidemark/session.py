"""Session helpers shared by every query: shipping this package to the executors, and shared working tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package (once for each Spark application)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        out = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "tidemark_src.zip"
        out.write_bytes(packed.getvalue())
        spark.sparkContext.addPyFile(str(out))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        named = _LOCAL[app]
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; looks at no more than one row beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows
