"""Tables written to the shared folder, so that later steps start from files and a lost executor repeats only its tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rasterecho.plans.workspace import new_folder

__all__ = ["forget", "give_back", "keep", "mark", "release", "small_batches", "track"]


#: By application, the tables kept since ``track``.
_kept: dict[str, list[str]] = {}


def keep(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{name}")
    df.write.parquet(path)
    if spark.sparkContext.applicationId in _kept:
        _kept[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(df.schema).parquet(path)


def track(spark: SparkSession) -> None:
    """From now on the names of kept tables are remembered, for ``release``."""
    _kept[spark.sparkContext.applicationId] = []


def mark(spark: SparkSession) -> int:
    """How many tables were kept since ``track`` or the last release; a place for ``release`` to start or stop at."""
    return len(_kept.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, start: int = 0, stop: int | None = None) -> None:
    """Empties the tables kept since ``track`` or the last release, or those between two marks: for when what was made of them has been
    written elsewhere.

    Without ``track`` nothing is emptied.
    """
    paths = _kept.get(spark.sparkContext.applicationId, [])
    nothing = spark.range(0).coalesce(1)
    for path in paths[start:stop]:
        nothing.write.mode("overwrite").parquet(path)
    del paths[start:stop]


def forget(spark: SparkSession) -> None:
    """Ends ``track``; what was kept stays."""
    _kept.pop(spark.sparkContext.applicationId, None)


#: Bytes of an Arrow batch: a worker and its JVM hold a batch several times over, as rows, as Arrow and as what is made of it.
BATCH_BYTES = 4_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to the workers in batches of about ``BATCH_BYTES``. Only for what runs inside, so its results must be kept there."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """At the end of a task: memory that is free but still held by this worker goes back to the system, as Spark reuses workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
