"""Hand-valued recursions; all cases run in one scan, each run on its own sequence."""

import numpy as np
import pytest
from rasters import dense, gray, px_frame, px_rows

from rasterecho.model import run_row
from rasterecho.plans.scan import feedback_scan

FULL = {"history_source": "FULL_FRAME"}
PLAIN = {"block_size": 1, "motion_quantization": 0.0}
TRAIL = {"mode": "TRAIL", **PLAIN}


def matte(*values):
    return np.array([values], np.float32)


def colors(*rgba):
    return np.array([rgba], np.float32)


def vectors(*dx):
    out = np.zeros((1, len(dx), 4), np.float32)
    out[0, :, 0] = dx
    return out


RED, BLUE = (1, 0, 0, 1), (0, 0, 1, 1)

CASES = {
    # persistence 0.5 halves the first frame again and again
    "halving": (
        run_row("halving", persistence=0.5, **FULL, **PLAIN),
        [(gray(1, 1, v), None, matte(1)) for v in (1, 0, 0)],
    ),
    # a target that appears later may show old background only with whole-frame history
    "preroll_full": (run_row("preroll_full", persistence=1.0, **FULL, **PLAIN),
                     [(colors(RED), None, matte(0)), (colors(BLUE), None, matte(1))]),
    "preroll_target": (run_row("preroll_target", persistence=1.0, **PLAIN),
                       [(colors(RED), None, matte(0)), (colors(BLUE), None, matte(1))]),
    # the published case has one block over the whole row, so unmatted pixels move with the target
    "trail_mix": (run_row("trail_mix", trail_decay=1.0, trail_motion_mix=0.25, persistence=1.0, **FULL,
                          **{**TRAIL, "block_size": 3}),
                  [(gray(1, 3, 0), None, matte(0.8, 0, 0)), (gray(1, 3, 0), vectors(1, 1, 1), matte(0, 1, 0))]),
    "trail_full": (run_row("trail_full", trail_decay=0.5, trail_motion_mix=0.0, persistence=1.0, **FULL, **TRAIL),
                   [(colors(RED, BLUE), None, matte(1, 1)), (colors((0, 0, 0, 0), BLUE), None, matte(0, 1))]),
    "trail_decay": (run_row("trail_decay", trail_decay=0.5, persistence=1.0, **FULL, **TRAIL),
                    [(gray(1, 1, 1), None, matte(1)), (gray(1, 1, 0), None, matte(0)), (gray(1, 1, 0), None, matte(0))]),
    "edge": (run_row("edge", persistence=1.0, **PLAIN),
             [(gray(1, 2, 0) + np.array([[[1], [100]]], np.float32) * [1, 1, 1, 0], None, matte(1, 0)),
              (gray(1, 2, 0), vectors(0.5, 0.5), matte(0, 1))]),
    "frozen": (run_row("frozen", persistence=0.0, **FULL, **PLAIN), [(gray(1, 2, v), None, matte(1, 1)) for v in (1, 0.25)]),
}


@pytest.fixture(scope="module")
def results(spark):
    frames, runs = [], []
    for name, (run, content) in CASES.items():
        runs.append(run)
        frames += [px_rows(name, i, b.astype(np.float32), v, m) for i, (b, v, m) in enumerate(content, start=1)]
    px = px_frame(spark, *frames)
    own = spark.createDataFrame([(n, n) for n in CASES], "run_id string, seq string")
    scan = feedback_scan(px, runs, assignments=own)
    return scan.pixels().cache(), scan.diagnostics().toPandas().set_index(["run_id", "frame_number"])


def values(results, run, frame, *columns):
    return [v.ravel().tolist() for v in dense(results[0], frame, columns, run_id=run)]


def test_halving(results):
    assert [values(results, "halving", f, "r")[0][0] for f in (1, 2, 3)] == [1.0, 0.5, 0.25]


def test_preroll(results):
    assert [v[0] for v in values(results, "preroll_full", 2, "r", "b")] == [1.0, 0.0]
    assert [v[0] for v in values(results, "preroll_target", 2, "r", "b")] == [0.0, 1.0]


def test_trail_mix(results):
    (cover,) = values(results, "trail_mix", 2, "cov")
    np.testing.assert_allclose(cover, [0.6, 1, 0], atol=1e-7)


def test_trail_full(results):
    r, g, b, a, cover = values(results, "trail_full", 2, "r", "g", "b", "a", "cov")
    assert [r[0], g[0], b[0], a[0]] == [0.5, 0, 0, 0.5]
    assert [r[1], g[1], b[1], a[1]] == [0, 0, 1, 1]
    assert cover == [0.5, 1]


def test_trail_decay(results):
    assert values(results, "trail_decay", 2, "r", "cov") == [[0.5], [0.5]]
    assert values(results, "trail_decay", 3, "r", "cov") == [[0.125], [0.25]]


def test_matte_edge_keeps_background_out(results):
    (r,) = values(results, "edge", 2, "r")
    assert r == [0.0, 0.5]


def test_zero_persistence_is_beauty(results):
    assert values(results, "frozen", 2, "r")[0] == [0.25, 0.25]
    assert results[1].loc[("frozen", 2), "historical_blend_pixels"] == 0


def test_reset_frames_use_no_history(results):
    first = results[1].xs(1, level="frame_number")
    assert first["reset"].all() and (first["primary_history_attempts"] == 0).all()
