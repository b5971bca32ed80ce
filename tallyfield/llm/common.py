"""Shared helpers: the library's scratch folder and settled tables, and shipping this package to executors."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, settle

__all__ = ["batches_of", "id_bucket", "only", "scratch", "settle", "ship", "table", "tool"]

_shipped: set[str] = set()
_tool: dict[Hashable, object] = {}


def tool(key: Hashable, make: Callable[[], object]) -> object:
    """What `make` gives, kept for the next tasks of this Python worker until one asks for another key.

    Workers outlive stages, so tools with tables of words would else add up over the stages of a pipeline.
    """
    if key not in _tool:
        _tool.clear()
        _tool[key] = make()
    return _tool[key]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tallyfield-")), "tallyfield.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs planned inside send so many rows at most to Python at once; for tables of large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else, so that clashing extra columns cannot interfere."""
    return df.select(*[F.col(f"`{n}`") for n in names])
