"""Targets meet pairs of raster rows and are not grouped again."""

import pytest
from pyspark.sql import functions as F

from rasterecho.operators.gather import bilinear, taps


@pytest.fixture
def source(spark):
    """Rows 0, 1 and 3 of a raster of 5 x 4; row 2 is missing."""
    return spark.createDataFrame([("s", 1, y, x, float(10 * y + x)) for y in (0, 1, 3) for x in range(4)], "seq string, frame int, y int, x int, k float")


def targets(spark, places, h=5):
    rows = [("s", 1, i, 0, x, y, 4, h) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "seq string, frame int, y int, x int, sx float, sy float, w int, h int")


def test_targets_are_not_grouped(spark, source):
    plan = bilinear(targets(spark, [(0.0, 0.0)]), source, ("k",), ("seq", "frame"))._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("sx#" in line for line in grouped)


def test_rows_that_lack_a_neighbour(spark, source):
    at = targets(spark, [(1.5, 0.5), (0.25, 1.5), (3.0, 2.5), (9.0, 3.0), (1.0, 4.0)])
    got = {r.y: (r.t0_k, r.t1_k, r.t2_k, r.t3_k) for r in taps(at, source, ("k",), ("seq", "frame")).collect()}
    # Row 1 has none below it, row 2 is not there but the one below it is; of row 4 there is nothing.
    assert got == {0: (1, 2, 11, 12), 1: (10, 11, None, None), 2: (None, None, 33, 33), 3: (33, 33, None, None)}


def test_last_row_is_its_own_lower_row(spark, source):
    at = targets(spark, [(0.0, 9.0), (2.0, 2.0)], h=2)
    got = {r.y: (r.t0_k, r.t2_k) for r in taps(at, source, ("k",), ("seq", "frame")).collect()}
    assert got == {0: (10, 10), 1: (12, 12)}
    beyond = taps(targets(spark, [(0.0, 9.0)], h=3), source, ("k",), ("seq", "frame"))
    assert beyond.where(F.col("t0_k").isNotNull() | F.col("t2_k").isNotNull()).count() == beyond.count() == 0
