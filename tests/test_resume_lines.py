"""Stored color meets its coverage line by line, without a broadcast."""

import numpy as np
from pyspark.sql import functions as F

from rasterecho.plans.resume import resume_hard
from rasterecho.plans.workspace import stored
from tests.rasters import gray, px_frame, px_rows


def test_lines_meet_without_a_broadcast_of_pixels(spark):
    matte = np.arange(6, dtype=np.float32).reshape(2, 3) / 8
    px = stored(px_frame(spark, *[px_rows("s", f, gray(2, 3, 0.25 * f), matte=matte / f) for f in (1, 2)]), "px")
    # One pixel of the stored color is missing, another of the raster.
    color = px.select(F.lit("one").alias("run_id"), "seq", "frame", "y", "x", "r", "g", "b", "a").where("NOT (y = 1 AND x = 1)")
    last = stored(spark.createDataFrame([("one", "s", 2)], "run_id string, seq string, frame int"), "last")
    state = resume_hard(stored(color, "color"), px.where("NOT (y = 0 AND x = 0)"), last)
    got = {r.y: (r.frame, r.w, r.h, list(r.r), list(r.k)) for r in state.collect()}
    assert got == {0: (2, 2, 2, [0.5] * 2, [1 / 16, 2 / 16]), 1: (2, 2, 2, [0.5] * 2, [3 / 16, 5 / 16])}
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
