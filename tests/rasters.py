"""Dense arrays to pixel rows and back, for small hand-made fixtures."""

import numpy as np
import pandas as pd

from rasterecho.model import PX_SCHEMA


def px_rows(seq, frame, beauty, motion=None, matte=None):
    h, w = beauty.shape[:2]
    y, x = np.indices((h, w))
    motion = np.zeros((h, w, 4), np.float32) if motion is None else motion
    matte = np.zeros((h, w), np.float32) if matte is None else matte
    columns = {"seq": seq, "frame": frame, "y": y.ravel(), "x": x.ravel()}
    columns |= {c: beauty[..., i].ravel() for i, c in enumerate("rgba")}
    columns |= {c: motion[..., i].ravel() for i, c in enumerate(("vr", "vg", "vb", "va"))}
    columns["m"] = matte.ravel()
    return pd.DataFrame(columns)


def px_frame(spark, *frames):
    whole = pd.concat(frames)
    for c in ("frame", "y", "x"):
        whole[c] = whole[c].astype("int32")
    return spark.createDataFrame(whole, PX_SCHEMA)


def gray(h, w, value):
    out = np.full((h, w, 4), value, np.float32)
    out[..., 3] = 1
    return out


def state_lines(spark, run_id, seq, frame, color, cover):
    h, w = cover.shape
    rows = [
        (run_id, seq, frame, y, w, h, *[color[y, :, i].tolist() for i in range(4)], cover[y].tolist())
        for y in range(h)
    ]
    schema = (
        "run_id string, seq string, frame int, y int, w int, h int, r array<float>, g array<float>, "
        "b array<float>, a array<float>, k array<float>"
    )
    return spark.createDataFrame(rows, schema)


def dense(pixels, frame, columns, run_id=None, seq=None):
    """The named columns of one frame as arrays (h, w)."""
    where = pixels.where(pixels.frame == frame)
    if run_id is not None:
        where = where.where(where.run_id == run_id)
    if seq is not None:
        where = where.where(where.seq == seq)
    pdf = where.toPandas().sort_values(["y", "x"])
    shape = (pdf.y.max() + 1, pdf.x.max() + 1)
    return [pdf[c].to_numpy(np.float32).reshape(shape) for c in columns]
