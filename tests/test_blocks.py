"""Published block means, decode cases and hash values."""

import numpy as np
from rasters import gray, px_frame, px_rows

from rasterecho.model import assign_runs, run_row
from rasterecho.operators.blocks import motion_clamp, motion_decode, prepare_blocks


def test_decode_clamps_length_and_keeps_direction(spark):
    motion = np.zeros((1, 2, 4), np.float32)
    motion[0, :, 2:] = [[3, -4], [-0.5, 0.5]]
    px = px_frame(spark, px_rows("s", 1, gray(1, 2, 0), motion, np.ones((1, 2), np.float32)))
    run = run_row("r", motion_channels="BA", reverse_motion=True, flip_x=True, flip_y=True, motion_gain=2.0, motion_clamp=5.0)
    rows = motion_clamp(motion_decode(px.join(assign_runs(px, [run]), "seq"))).orderBy("x").collect()
    assert [(r.du, r.dv) for r in rows] == [(3.0, -4.0), (-1.0, 1.0)]


def test_jitter_and_refresh_golden(spark):
    px = px_frame(spark, px_rows("s", 4, gray(3, 5, 0), None, np.ones((3, 5), np.float32)))
    run = run_row("r", block_size=2, motion_quantization=0.0, diffusion=0.25, refresh_probability=0.5, seed=17)
    pdf = prepare_blocks(px.join(assign_runs(px, [run]), "seq")).toPandas().sort_values(["by", "bx"])
    # The published jitter of this seed.
    expected = [
        [0.05323072, -0.24754515], [0.01144829, -0.21040809], [-0.05177774, -0.23570475],
        [-0.00952731, 0.16988355], [-0.05223134, -0.09983194], [0.13204958, -0.01923102],
    ]
    np.testing.assert_allclose(pdf[["dx", "dy"]].to_numpy(), expected, rtol=0, atol=5e-9)
    assert pdf["refresh"].tolist() == [False, True, False, False, False, False]


def test_block_larger_than_frame_is_one_block(spark):
    motion = np.zeros((2, 3, 4), np.float32)
    motion[..., 0] = [[1, 2, 3], [4, 5, 6]]
    px = px_frame(spark, px_rows("s", 1, gray(2, 3, 0), motion, np.ones((2, 3), np.float32)))
    (row,) = prepare_blocks(px.join(assign_runs(px, [run_row("r", block_size=99, motion_quantization=0.0)]), "seq")).collect()
    assert (row.by, row.bx, row.dx) == (0, 0, 3.5)
