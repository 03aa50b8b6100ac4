"""Bad frames, runs and stored states stop what depends on them and nothing else."""

import numpy as np
import pytest
from rasters import gray, px_frame, px_rows, state_lines

from rasterecho.model import EXTREME, run_row
from rasterecho.operators.quality import checked_dims
from rasterecho.plans.scan import feedback_scan


def clip(seq, frames=2, spoil=None, at=1):
    parts = [px_rows(seq, f, gray(2, 4, 0.25 * f), matte=np.full((2, 4), 0.5, np.float32)) for f in range(1, frames + 1)]
    if spoil:
        parts[at - 1] = spoil(parts[at - 1].copy())
    return parts


def put(column, value):
    def change(rows):
        rows.loc[3, column] = value
        return rows

    return change


SPOILT = {
    "hole": (lambda rows: rows.drop(index=3), "beauty must cover the whole frame"),
    "nan": (put("r", np.nan), "beauty must contain only finite values"),
    "inf": (put("vr", np.inf), "motion must contain only finite values"),
    "matte": (put("m", 1.5), "matte coverage must be between 0 and 1"),
    "twice": (lambda rows: rows.iloc[[*range(8), 0]], "each pixel must be given once"),
}


def test_bad_frames_and_runs(spark):
    px = px_frame(spark, *clip("good"), *[f for name, (spoil, _) in SPOILT.items() for f in clip(name, spoil=spoil, at=2)])
    result = feedback_scan(px, [run_row("a", **EXTREME), run_row("b", mode="TRIAL"), run_row("c", block_size=0)])
    failed = {(r.run_id, r.seq): (r.frame, r.reason) for r in result.failures.collect()}
    assert {k: v for k, v in failed.items() if k[0] == "a"} == {("a", name): (2, why) for name, (_, why) in SPOILT.items()}
    for run in "bc":
        assert {k[1]: v[0] for k, v in failed.items() if k[0] == run} == {s: 1 for s in ("good", *SPOILT)}
    assert all(v[1].startswith("invalid run: ") for k, v in failed.items() if k[0] in "bc")
    done = {(r.run_id, r.seq, r.frame) for r in result.lines.select("run_id", "seq", "frame").distinct().collect()}
    assert done == {("a", s, 1) for s in SPOILT} | {("a", "good", 1), ("a", "good", 2)}


BALANCED = {
    "same line": lambda rows: rows.iloc[[0, 1, 2, 2, 4, 5, 6, 7]],
    "other line": lambda rows: rows.iloc[[0, 1, 2, 4, 4, 5, 6, 7]],
    "moved out": lambda rows: rows.assign(x=[0, 1, 2, 3, -1, 1, 2, 3]),
}


def test_holes_beside_repeats(spark):
    """A pixel missing and another repeated leave the totals of a frame as they should be."""
    px = px_frame(spark, *clip("good"), *[f for name, spoil in BALANCED.items() for f in clip(name, spoil=spoil, at=2)])
    result = feedback_scan(px, [run_row("a", **EXTREME)])
    assert {(r.seq, r.frame, r.reason) for r in result.failures.collect()} == {(name, 2, "each pixel must be given once") for name in BALANCED}
    done = {(r.seq, r.frame) for r in result.lines.select("seq", "frame").distinct().collect()}
    assert done == {(s, 1) for s in BALANCED} | {("good", 1), ("good", 2)}
    line_for_line = clip("lines", 1)[0].assign(y=[0] * 4 + [2] * 4).iloc[[*range(8), 0, 1, 2, 3]]
    assert [r.input_error for r in checked_dims(px_frame(spark, line_for_line)).collect()] == ["each pixel must be given once"]


def test_no_wave_at_all(spark):
    result = feedback_scan(px_frame(spark, *clip("s")), [run_row("a")], max_waves=0)
    assert result.waves == 0 and result.lines.count() == 0 and result.failures.count() == 0


@pytest.mark.parametrize("cover", [0.5, np.nan, 2.0])
def test_stored_state(spark, cover):
    px = px_frame(spark, *clip("s", 2))
    state = state_lines(spark, "a", "s", 1, gray(2, 4, 0.5), np.full((2, 4), cover, np.float32))
    result = feedback_scan(px, [run_row("a", **EXTREME)], state=state)
    frames = [r.frame for r in result.lines.select("frame").distinct().collect()]
    if cover == 0.5:
        assert frames == [2] and result.failures.count() == 0
    else:
        assert frames == [] and [tuple(r) for r in result.failures.collect()] == [("a", "s", 1, "stored history is not usable")]
