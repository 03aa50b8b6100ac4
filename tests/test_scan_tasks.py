"""A scan of one run computes that run alone, and its tasks hold a bounded number of pixels."""

import pytest

from rasterecho.operators import step
from rasterecho.operators.quality import checked_dims
from rasterecho.suite import raster_queries as R
from rasterecho.suite import shared
from rasterecho.suite import sqlgen as S

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_pixels():
    assert [step.tasks_for(n) for n in (None, 0, 1, step.PIXELS_PER_TASK, step.PIXELS_PER_TASK + 1)] == [1, 1, 1, 1, 2]


@pytest.mark.parametrize("run", ["hard_target", "refresh"])
def test_dealt_step_is_the_same(spark, run):
    """Dealt to a given number of tasks, a step unfolds in as many, and its pixels are those of the merged one."""
    cur, prev, blocks = R.step_inputs(spark, SF, S.RUNS[run])
    semantics = step.Semantics.of(S.RUNS[run])
    plain, dealt = (step.step_lines(cur, prev, blocks, semantics, tasks=n) for n in (None, 13))
    assert dealt.rdd.getNumPartitions() == 13
    order = [*step.KEY, "y"]
    columns = [*order, *step.HISTORY, "n_changed", "n_valid"]
    assert dealt.select(columns).orderBy(order).collect() == plain.select(columns).orderBy(order).collect()


def test_one_run_is_scanned(spark):
    assert [r.run_id for r in shared.run_scan(spark, SF, "hard_full").lines.select("run_id").distinct().collect()] == ["hard_full"]
    lines = shared.reset_scan(spark, SF, "hard_full").lines
    assert [r.run_id for r in lines.select("run_id").distinct().collect()] == ["hard_full"] and "n_pixels" not in lines.columns


def test_places_are_counted_without_collecting(spark):
    """Lines of 130 pixels: whole, with a hole beside a repeated pixel in another word of bits, and with a place below 0."""
    def frame(n, places):
        return [("s", n, y, x, *[0.5] * 9) for y in (0, 1) for x in places]

    rows = frame(1, range(130)) + frame(2, [*range(129), 64]) + frame(3, [-1, *range(1, 130)]) + frame(4, [*range(64), 64, 64, *range(66, 130)])
    px = spark.createDataFrame(rows, "seq string, frame int, y int, x int, " + ", ".join(f"{c} float" for c in R.CHANNELS))
    dims = checked_dims(px)
    assert "collect_set" not in dims._jdf.queryExecution().optimizedPlan().toString()
    got = {r.frame: (r.h, r.w, r.input_error) for r in dims.orderBy("frame").collect()}
    bad = "each pixel must be given once"
    assert got == {1: (2, 130, None), 2: (2, 129, bad), 3: (2, 130, bad), 4: (2, 130, bad)}
