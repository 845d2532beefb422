"""What several operators share: the package on the executors, written tables, batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path, shared_root, written  # noqa: F401  (for the operators)

#: Rows that a Python operator has in its hands at a time.
ROWS = 256
_shipped: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="corvane-"), f"{package.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(name)
    _shipped.append(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that an operator reads, under its own names; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def release() -> None:
    """Memory that a Python worker no longer uses goes back to the system: workers are used again, and wait with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def texts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of at most so many rows at a time; Spark bounds a batch by bytes, this what is made of it."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            del part
        del b
        release()
    release()
