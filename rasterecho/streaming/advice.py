"""Advice once per run and sequence on a stream of frame counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.diagnostics import (
    HISTORY_USE_RATIO_MAX,
    MIN_ELIGIBLE_FRAMES,
    OUTPUT_CHANGE_RATIO_MAX,
)

MEASURES = (
    "pixel_count", "target_matte_pixels", "primary_history_attempts", "historical_blend_pixels",
    "changed_output_pixels",
)
STATE = "next long, eligible long, " + ", ".join(f"{m} long" for m in MEASURES) + ", told boolean, waiting array<long>"
OUTPUT = "run_id string, seq string, frame_number int"
WIDTH = 2 + len(MEASURES)


def advise(frames: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running totals after each of the frames (columns: frame, reset, measures), and where the advice holds.

    ``totals``: eligible frames and measures before the first of them.
    """
    counted = frames[:, 1] == 0
    sums = totals + np.cumsum(np.column_stack([counted, frames[:, 2:] * counted[:, None]]), axis=0)
    eligible, pixels, target, attempts, used, changed = sums.T
    quiet = (used <= HISTORY_USE_RATIO_MAX * attempts) & (changed <= OUTPUT_CHANGE_RATIO_MAX * pixels)
    return sums, counted & (eligible >= MIN_ELIGIBLE_FRAMES) & (target > 0) & quiet


def _first_actionable(key: tuple, batches: Iterator[pd.DataFrame], state, first_frame: int, buffer: int) -> Iterator[pd.DataFrame]:
    """Add the frames of a group that are now without a gap to its totals; emit the first at which the advice holds."""
    start = (first_frame, *[0] * (1 + len(MEASURES)), False, [])
    upto, *totals, told, waiting = state.get if state.exists else start
    arrived = [np.array(waiting, np.int64).reshape(-1, WIDTH)]
    arrived += [pdf[["frame_number", "reset", *MEASURES]].to_numpy(np.int64) for pdf in batches]
    rows = np.concatenate(arrived)
    _, once = np.unique(rows[:, 0], return_index=True)
    rows = rows[once]
    rows = rows[rows[:, 0] >= upto]
    ready = rows[rows[:, 0] == upto + np.arange(len(rows))]
    rest = rows[len(ready) :]
    if len(rest) > buffer:
        raise ValueError(f"{len(rest)} frames of {key} wait for frame {upto + len(ready)}; at most {buffer} may")
    hits = []
    if len(ready):
        sums, holds = advise(ready, np.array(totals, np.int64))
        totals = sums[-1].tolist()
        if holds.any() and not told:
            told = True
            hits.append((*key, int(ready[holds.argmax(), 0])))
    state.update((int(upto + len(ready)), *totals, told, rest.ravel().tolist()))
    yield pd.DataFrame(hits, columns=["run_id", "seq", "frame_number"])


def stream_advice_once(diag: DataFrame, *, first_frame: int = 1, buffer: int = 10_000) -> DataFrame:
    """One row per run and sequence, when its advice first becomes actionable.

    Frames may arrive in any order, and more than once: those after a gap wait in the group's state, at most ``buffer`` of them, until
    the gap is filled. So the frame that is told is the same as with ordered arrival.
    """
    wanted = diag.select("run_id", "seq", "frame_number", "reset", *MEASURES)
    return wanted.groupBy("run_id", "seq").applyInPandasWithState(
        lambda key, batches, state: _first_actionable(key, batches, state, first_frame, buffer), OUTPUT, STATE, "append", "NoTimeout"
    )
