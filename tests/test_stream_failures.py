"""A stream says what stands still, and why."""

import numpy as np
import pytest
from rasters import gray, px_frame, px_rows

from rasterecho.model import EXTREME, run_row
from rasterecho.streaming.feedback import StreamTables, failed_sequences, finished_frames, step


def frame(seq, number):
    return px_rows(seq, number, gray(2, 4, 0.25 * number), matte=np.full((2, 4), 0.5, np.float32))


def arrive(spark, tables, runs, batch_id, *frames):
    px_frame(spark, *frames).write.mode("overwrite").parquet(f"{tables.arrived}/batch={batch_id}")
    step(spark, tables, runs, batch_id, 1)


def stood(spark, tables, batch_id=None):
    return {(r.run_id, r.seq): (r.frame, r.reason) for r in failed_sequences(spark, tables, batch_id).collect()}


def test_stopped_sequences_are_rows(spark, tmp_path):
    tables, runs = StreamTables(str(tmp_path)), [run_row("a", **EXTREME)]
    assert stood(spark, tables) == {}
    hole = frame("bad", 2).drop(index=3)
    arrive(spark, tables, runs, 0, frame("good", 1), frame("bad", 1), hole, frame("late", 3), frame("zero", 0))
    reason = "beauty must cover the whole frame"
    first = {
        ("a", "bad"): (2, reason), ("a", "late"): (3, "frame 1 has not arrived, later ones wait"),
        ("a", "zero"): (0, "frame 0 lies before the first frame 1"),
    }
    assert stood(spark, tables) == first
    arrive(spark, tables, runs, 1, frame("good", 2), frame("bad", 3))
    assert stood(spark, tables) == first
    # The missing pixel and the missing frames arrive.
    arrive(spark, tables, runs, 2, frame("bad", 2).iloc[[3]], frame("late", 1), frame("late", 2))
    assert stood(spark, tables) == {("a", "zero"): first["a", "zero"]} and stood(spark, tables, 0) == first
    done = {(r.seq, r.frame) for r in finished_frames(spark, tables).select("seq", "frame").distinct().collect()}
    assert done == {("good", 1), ("good", 2), *((s, f) for s in ("bad", "late") for f in (1, 2, 3))}


@pytest.mark.parametrize("others", [[], [run_row("a", **EXTREME)]])
def test_invalid_run_is_a_row(spark, tmp_path, others):
    tables, runs = StreamTables(str(tmp_path)), [*others, run_row("b", mode="TRIAL")]
    for batch_id in (0, 1):
        arrive(spark, tables, runs, batch_id, frame("s", batch_id + 1))
        rows = failed_sequences(spark, tables).collect()
        assert [(r.run_id, r.seq) for r in rows] == [("b", "s")] and rows[0].reason.startswith("invalid run: ")
