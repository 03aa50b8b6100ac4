"""Coverage in log steps equals coverage frame by frame, bit for bit."""

import numpy as np
from rasters import px_frame, px_rows

from rasterecho.model import run_row
from rasterecho.plans.coverage import prefix_rounds
from rasterecho.plans.scan import feedback_scan
from rasterecho.plans.workspace import stored


def test_equals_the_waves(spark):
    """Decays whose products are rounded, a reset, and a run that needs waves beside them."""
    rng = np.random.default_rng(11)
    frames = [px_rows("s", i, np.ones((2, 3, 4), np.float32), rng.integers(-2, 3, (2, 3, 4)).astype(np.float32), (rng.random((2, 3)) * (rng.random((2, 3)) < 0.4)).astype(np.float32)) for i in range(1, 7)]
    px = stored(px_frame(spark, *frames), "px")
    still = {"mode": "TRAIL", "history_source": "FULL_FRAME", "trail_motion_mix": 0.0, "block_size": 2}
    runs = [run_row("a", trail_decay=0.9137, **still), run_row("b", trail_decay=0.995, **still), run_row("c", mode="TRAIL", block_size=2)]
    resets = spark.createDataFrame([("s", 5)], "seq string, frame int")
    fast = feedback_scan(px, runs, resets, color=False, counters=False)
    slow = feedback_scan(px, runs, resets, counters=False)
    found = lambda r: sorted(map(tuple, r.coverage().select("run_id", "frame", "y", "x", "cov").collect()))
    assert found(fast) == found(slow) and len(found(fast)) == 3 * 6 * 6
    assert fast.waves == 4  # those of the run that gathers


def test_long_segments_take_few_rounds(spark):
    """147 frames in eight rounds, against a loop in single precision."""
    rng = np.random.default_rng(2)
    mattes = (rng.random((147, 4)) * (rng.random((147, 4)) < 0.05)).astype(np.float32)
    rows = [("r", "s", 1, i, 0, 0.97, m.tolist()) for i, m in enumerate(mattes)]
    lines = spark.createDataFrame(rows, "run_id string, seq string, seg int, pos int, y int, trail_decay double, k array<float>")
    names = []

    def write(df, name):
        names.append(name)
        return stored(df, "round")

    got = {r.pos: r.k for r in prefix_rounds(lines, 147, write).select("pos", "k").collect()}
    assert len(names) == 8
    cover = np.zeros(4, np.float32)
    for i, m in enumerate(mattes):
        cover = np.maximum(m, np.float32(0.97) * cover)
        assert got[i] == [float(v) for v in cover]
