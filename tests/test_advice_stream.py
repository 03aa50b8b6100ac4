"""The advice of a stream does not depend on the order in which frames arrive."""

import random

import numpy as np
import pandas as pd
import pytest

from rasterecho.streaming.advice import MEASURES, _first_actionable, advise


class State:
    """What a group keeps between batches."""

    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def frames(seed, n=40):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"frame_number": np.arange(1, n + 1), "reset": np.arange(n) % 9 == 0})
    for m in MEASURES:
        rows[m] = rng.integers(0, 100, n)
    rows["pixel_count"] = 1000
    rows["changed_output_pixels"] = np.where(np.arange(n) < 6, 20, 2)
    rows["historical_blend_pixels"] = np.where(np.arange(n) < 6, 5, 0)
    return rows


def told(batches, buffer=1000):
    state, out = State(), []
    for batch in batches:
        for pdf in _first_actionable(("r", "s"), iter([batch]), state, 1, buffer):
            out += pdf.values.tolist()
    return out, state


def by_rows(rows):
    """Frame by frame, as the rule reads."""
    totals = np.zeros(1 + len(MEASURES), np.int64)
    for row in rows.itertuples(index=False):
        values = np.array([[row.frame_number, row.reset, *[getattr(row, m) for m in MEASURES]]], np.int64)
        sums, holds = advise(values, totals)
        totals = sums[-1]
        if holds[0]:
            return [["r", "s", row.frame_number]]
    return []


@pytest.mark.parametrize("seed", range(6))
def test_any_order(seed):
    rows = frames(seed)
    want = by_rows(rows)
    assert want
    random.seed(seed)
    order = random.sample(range(len(rows)), len(rows))
    shuffled = [rows.iloc[order[i : i + 5]] for i in range(0, len(rows), 5)]
    ordered, last = told([rows.iloc[i : i + 7] for i in range(0, len(rows), 7)])
    assert ordered == want
    again, state = told([*shuffled, shuffled[0], rows])  # repeated rows count once
    assert again == want and state.get == last.get and state.get[-1] == []


def test_a_gap_holds_and_the_buffer_is_bounded():
    rows = frames(0)
    out, state = told([rows.iloc[1:30]])
    assert out == [] and state.get[0] == 1 and len(state.get[-1]) == 29 * (2 + len(MEASURES))
    with pytest.raises(ValueError, match="wait for frame 1"):
        told([rows.iloc[1:30]], buffer=10)
