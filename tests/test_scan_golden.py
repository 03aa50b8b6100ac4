"""Published digests of one step on a 5x7 frame: byte-exact output and coverage."""

import hashlib

import numpy as np
import pytest
from rasters import dense, px_frame, px_rows, state_lines

from rasterecho.model import run_row
from rasterecho.plans.scan import feedback_scan

# Settings, and the digests of output and coverage that they must give.
CASES = [
    ("HARD_LOCALIZED", "RG", True,
     "ff8b4547ef26ebc1fec4771f4f30f3e75ab6461c187cfa1893c498b536bef24d",
     "e8de9f98cd3d3bdfae0814809225b6b26ca94aa6fa6bd2c2dfc3984a666a3dac"),
    ("TRAIL", "BA", False,
     "91293ce961af06f27a9cee2f04df77aeac9605ca75370b7109f25ea8114996d0",
     "0019af03c8312cc2216ae05a9f576e2e5fd216b23702073e9caa6529514489c8"),
]


@pytest.mark.parametrize("mode, channels, reverse, output_digest, cover_digest", CASES)
def test_digests(spark, mode, channels, reverse, output_digest, cover_digest):
    x, y = np.meshgrid(np.arange(7, dtype=np.float32), np.arange(5, dtype=np.float32))
    one = np.ones_like(x)

    def image(*channels_):
        return np.dstack(channels_).astype(np.float32)

    beauty = image(x / 10, y / 10, (x + y) / 20, one)
    history = image((x + 1) / 8, (y + 1) / 6, (x + 2 * y) / 16, one)
    cover = np.where((x + y) % 4 == 0, 0.25, 1.0).astype(np.float32)
    matte = np.where((2 * x + y) % 5 == 0, 0.25, ((x + y) % 3 != 0)).astype(np.float32)
    motion = image(x % 3 - 1, y % 3 - 1, (x + y) % 4 - 1.5, (2 * y + x) % 5 - 2)
    run = run_row(
        "r", mode=mode, trail_decay=0.73, persistence=0.81, block_size=3, motion_channels=channels,
        reverse_motion=reverse, flip_x=True, flip_y=True, motion_gain=1.7, motion_clamp=1.9,
        motion_quantization=0.25, diffusion=0.2, refresh_probability=0.35, seed=23,
    )
    px = px_frame(spark, px_rows("s", 11, beauty, motion, matte))
    result = feedback_scan(px, [run], state=state_lines(spark, "r", "s", 10, history, cover))
    pixels = result.pixels()
    out = np.dstack(dense(pixels, 11, "rgba"))
    (covered,) = dense(pixels, 11, ["cov"])
    assert hashlib.sha256(np.ascontiguousarray(out).tobytes()).hexdigest() == output_digest
    assert hashlib.sha256(np.ascontiguousarray(covered).tobytes()).hexdigest() == cover_digest
