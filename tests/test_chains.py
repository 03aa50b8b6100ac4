"""Segments of small frames are advanced by one task each, without waves, and give what waves of lines give."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasters import px_frame, px_rows
from test_whole_frames import noise

from rasterecho.model import run_row
from rasterecho.operators import step
from rasterecho.operators.blocks import prepare_blocks_once
from rasterecho.operators.chains import _blocks, chain_tasks
from rasterecho.plans.scan import feedback_scan

BENT = {"motion_channels": "BA", "reverse_motion": True, "flip_x": True, "motion_gain": 1.5, "motion_clamp": 3.0}
RUNS = [
    run_row("hard", block_size=3, **BENT),
    run_row("hard_full", history_source="FULL_FRAME", invalid_history_fallback="SAME_PIXEL_HISTORY", block_size=100, flip_y=True),
    run_row("trail", mode="TRAIL", block_size=4, motion_quantization=0.0, persistence=0.7, refresh_probability=0.5, seed=-5),
    run_row("trail_full", mode="TRAIL", history_source="FULL_FRAME", block_size=2, diffusion=1.5, seed=2**40, trail_motion_mix=0.3, **BENT),
]


def noisy(spark, *sequences):
    px = px_frame(spark, *[px_rows(name, n, *noise(n + i, 5, 7)) for i, name in enumerate(sequences) for n in (1, 2, 3, 4, 5)])
    # A frame without any matte, lines without, and a missing value that no check refuses.
    m = F.when((F.col("frame") == 3) & (F.col("seq") == "s") | (F.col("y") == 1), 0).otherwise(F.col("m")).cast("float")
    return px.withColumns({"m": m, "g": F.when((F.col("y") != 1) | (F.col("x") != 2), F.col("g"))})


def outcome(scan):
    lines = scan.lines.withColumn("hit", F.sort_array("hit")).orderBy("run_id", "seq", "frame", "y").select(
        *step.KEY, "frame", "y", "w", "h", *step.HISTORY, *step.COUNT_COLUMNS, "hit", "reset")
    return lines.collect(), scan.failures.collect(), scan.waves


def test_chains_give_what_waves_give(spark, monkeypatch):
    px = noisy(spark, "s", "t")
    resets = spark.createDataFrame([("t", 4)], "seq string, frame int")
    chains = feedback_scan(px, RUNS, resets)
    got = outcome(chains)
    # One table for all frames; before, one for each wave.
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{chains.root}/*")} == {"plan", "chains"}
    # A batch ends inside a frame.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert outcome(feedback_scan(px, RUNS, resets)) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(step, "FRAME_PIXELS", 1)
    assert outcome(feedback_scan(px, RUNS, resets)) == got and len(got[0]) == 4 * 2 * 5 * 5


def test_a_stored_state_is_the_start_of_a_chain(spark):
    px = noisy(spark, "s").withColumn("g", F.coalesce("g", F.lit(0.25).cast("float")))
    whole = feedback_scan(px, RUNS, counters=False)
    state = feedback_scan(px, RUNS, counters=False, max_waves=2).last_state()
    rest = feedback_scan(px, RUNS, counters=False, state=state)
    order = ["run_id", "seq", "frame", "y", "x"]
    assert rest.pixels().orderBy(order).collect() == whole.pixels().where("frame > 2").orderBy(order).collect()


def test_blocks_are_those_of_the_operator(spark):
    """Displacement and refresh in NumPy are those that Spark prepares, bit for bit."""
    px = noisy(spark, "s").where("frame = 2")
    runs = spark.createDataFrame([(r["run_id"], "s", 2, *[r[n] for n in r if n != "run_id"]) for r in RUNS],
                                 "run_id string, seq string, frame int, " + ", ".join(f"{n} {t}" for n, (t, _) in _settings()))
    rows = px.toPandas().sort_values(["y", "x"])
    cur = {c: (rows[c].to_numpy(np.float32).reshape(5, 7), None) for c in ("m", "vr", "vg", "vb", "va")}
    found = {(r.run_id, r.by, r.bx): (r.dx, r.dy, r.refresh) for r in prepare_blocks_once(px, runs).collect()}
    mine = {}
    for run in RUNS:
        dx, dy, refresh = _blocks(2, run, cur, {})
        mine |= {(run["run_id"], y, x): (float(dx[y, x]), float(dy[y, x]), bool(refresh[y, x])) for y, x in np.ndindex(dx.shape)}
    assert mine == found and any(r[2] for r in found.values())


def _settings():
    from rasterecho.model import SETTINGS

    return SETTINGS.items()


@pytest.mark.parametrize("pixels, chains, tasks", [(0, 0, 1), (10, 3, 3), (10, 10**6, 32), (10**9, 10**6, 2000)])
def test_tasks_follow_the_pixels(pixels, chains, tasks):
    assert chain_tasks(pixels, chains, 8) == tasks
