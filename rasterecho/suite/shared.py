"""Tables several queries start from, written once per session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import assign_runs
from ..plans.scan import ScanResult, feedback_scan
from ..plans.workspace import stored
from .fixtures import raster
from .sqlgen import RESETS, RUNS

_made: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def px(spark: SparkSession, sf: str) -> DataFrame:
    """The main raster as a stored table."""
    return once(spark, sf, "px", lambda: stored(raster(spark, sf), "px"))


def px_jobs(spark: SparkSession, sf: str, *runs: str) -> DataFrame:
    """Pixels with run id and settings."""
    base = px(spark, sf)
    return base.join(assign_runs(base, [RUNS[r] for r in runs]), "seq")


def resets(spark: SparkSession, sf: str) -> DataFrame:
    """The listed reset frames of every sequence."""
    listed = F.explode(F.array(*[F.lit(v) for v in RESETS])).alias("frame")
    return px(spark, sf).select("seq").distinct().select("seq", listed)


def whole_scan(spark: SparkSession, sf: str) -> ScanResult:
    """Every run of the suite over every frame without listed resets."""
    return once(spark, sf, "scan", lambda: feedback_scan(px(spark, sf), list(RUNS.values())))


def run_scan(spark: SparkSession, sf: str, run: str) -> ScanResult:
    """One run of the suite over every frame without listed resets: what a query on that run alone needs."""
    return once(spark, sf, f"scan {run}", lambda: feedback_scan(px(spark, sf), [RUNS[run]]))


def pair_scan(spark: SparkSession, sf: str, *runs: str) -> ScanResult:
    """Some runs of the suite in one scan without counters, as a query that compares their pixels needs."""
    return once(spark, sf, f"scan {' '.join(runs)}", lambda: feedback_scan(px(spark, sf), [RUNS[r] for r in runs], counters=False))


def reset_scan(spark: SparkSession, sf: str, run: str) -> ScanResult:
    """One run with resets in the middle, without counters."""
    return once(spark, sf, f"resets {run}", lambda: feedback_scan(px(spark, sf), [RUNS[run]], resets(spark, sf), counters=False))
