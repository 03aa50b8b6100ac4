"""Small frames meet their history in one task, and history is moved once."""

import numpy as np
import pytest
from rasters import gray, px_frame, px_rows

from rasterecho.model import run_row
from rasterecho.operators import step
from rasterecho.plans.scan import feedback_scan
from rasterecho.suite import raster_queries as R
from rasterecho.suite import sqlgen as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unbroadcast(spark):
    """Plans as large tables get them."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ("-1", "false")):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def shuffles(df):
    """Exchanges that are written: those that read another's files do not count."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum(" Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in lines)


@pytest.mark.parametrize("run", ["hard_target", "refresh"])
def test_lines_history_and_blocks_are_moved_once(spark, unbroadcast, tmp_path, run):
    tables = []
    for i, df in enumerate(R.step_inputs(spark, SF, S.RUNS[run])):
        df.write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.schema(df.schema).parquet(f"{tmp_path}/{i}"))
    semantics = step.Semantics.of(S.RUNS[run])
    whole, lines = (step.step_lines(*tables, semantics, tasks=5, whole=w) for w in (True, False))
    assert shuffles(whole) == 3
    order = [*step.KEY, "y"]
    columns = [*order, *step.HISTORY, *step.COUNT_COLUMNS]
    assert whole.select(columns).orderBy(order).collect() == lines.select(columns).orderBy(order).collect()


def noise(seed, h, w):
    rng = np.random.default_rng(seed)
    beauty = gray(h, w, 0) + (rng.integers(0, 256, (h, w, 4)) / 256).astype(np.float32)
    motion = rng.integers(-9, 10, (h, w, 4)).astype(np.float32) / 2
    return beauty, motion, (rng.integers(0, 5, (h, w)) / 4).astype(np.float32)


def test_small_and_large_frames_in_one_scan(spark, monkeypatch):
    """Frames on either side of the bound give what they give when all are small, in sizes that blocks do not divide."""
    sizes = {"small": (5, 7), "large": (11, 9), "edge": (6, 10)}
    px = px_frame(spark, *[px_rows(name, n, *noise(n, *size)) for name, size in sizes.items() for n in (1, 2, 3)])
    runs = [
        run_row("target", mode="TRAIL", block_size=4),
        run_row("full", mode="TRAIL", history_source="FULL_FRAME", invalid_history_fallback="SAME_PIXEL_HISTORY",
                trail_motion_mix=0.5, block_size=3, diffusion=2.0, refresh_probability=0.25),
    ]

    def outcome(bound):
        monkeypatch.setattr(step, "FRAME_PIXELS", bound)
        scan = feedback_scan(px, runs)
        order = ["run_id", "seq", "frame", "y", "x"]
        return scan.pixels().orderBy(order).collect(), scan.diagnostics().orderBy("run_id", "seq", "frame_number").collect()

    mixed = outcome(60)
    assert len(mixed[0]) == 2 * 3 * (35 + 99 + 60)
    assert mixed == outcome(1000) == outcome(1)
