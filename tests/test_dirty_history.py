"""Non-finite history and illegal coverage never reach the output."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasters import gray, px_frame, px_rows

from rasterecho.model import assign_runs, run_row
from rasterecho.operators.blocks import prepare_blocks
from rasterecho.operators.step import Semantics, pack_lines, step_pixels


def stepped(spark, run, history, cover, matte, beauty=0.25):
    h, w = cover.shape
    px = px_frame(spark, px_rows("s", 2, gray(h, w, beauty), None, matte))
    jobs = assign_runs(px, [run])
    cur = pack_lines(px, ("r", "g", "b", "a", "m")).join(jobs, "seq").withColumns(
        {"seg": F.lit(1), "h": F.lit(h), "live": F.lit(True)})
    old = px_frame(spark, px_rows("s", 1, history, None, cover)).withColumns({"run_id": F.lit("r"), "seg": F.lit(1)})
    prev = pack_lines(old, ("r", "g", "b", "a", "m"), ("run_id", "seq", "seg")).withColumnRenamed("m", "k")
    blocks = prepare_blocks(px.join(jobs, "seq")).withColumn("seg", F.lit(1))
    return step_pixels(cur, prev, blocks, Semantics.of(run), checked=False).orderBy("y", "x").toPandas()


@pytest.mark.parametrize("bad", [np.nan, np.inf, -np.inf])
def test_full_frame_rejects_bad_color(spark, bad):
    history = gray(1, 2, 1.0)
    history[0, 0, 0] = bad
    out = stepped(spark, run_row("r", history_source="FULL_FRAME", persistence=1.0, block_size=1),
                  history, np.ones((1, 2), np.float32), np.ones((1, 2), np.float32))
    assert out["o_r"].tolist() == [0.25, 1.0]
    assert out["covered"].tolist() == [False, True]


def test_target_only_rejects_illegal_coverage(spark):
    cover = np.array([[1.5, 1.0]], np.float32)
    out = stepped(spark, run_row("r", persistence=1.0, block_size=1), gray(1, 2, 1.0), cover, np.ones((1, 2), np.float32))
    assert out["o_r"].tolist() == [0.25, 1.0]
    assert np.isfinite(out["o_r"]).all()
