"""Whole segments of small frames, each advanced by one task from its first frame to its last (C1-C8, E1-E10 in NumPy).

A frame needs the output of the frame before it, so the frames of a segment follow each other anyway. Where a frame is small
(``step.small_frame``), a task takes a segment as a stream of lines sorted by frame and holds one frame and the state of its runs, so
lines are moved once for all runs that share the segment, history is not moved at all, and no row is made for a pixel. Frames that
are larger go by waves of lines (``step.advance``). Results are those of ``blocks.prepare_blocks`` and ``step.advance``, bit for bit.

A segment has no gap, so ``frame - pos`` is the frame it begins with: with ``seq``, that is the name of a chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MIX
from ..functions.pixel import COLOR
from ..model import FLOAT_MAX, FLOAT_TINY, SETTING_NAMES
from .blocks import DIFFUSE_X, DIFFUSE_Y, MOTION_SETTINGS, REFRESH
from .step import COUNT_COLUMNS, HISTORY, Semantics

MOTION = ("vr", "vg", "vb", "va")
#: Rows of a chain, in this order within a frame: stored state, what the runs do with the frame, its lines.
SEED, FRAME, LINE = -1, 0, 1
#: Pixels of lines that one task sorts, some 40 bytes each.
CHAIN_PIXELS = 500_000
#: Lines that a worker holds before it gives them back.
LINES_OUT = 4_000
#: The change above which a pixel counts as changed.
CHANGE = np.float32(1e-6)
ONE, ZERO = np.float32(1), np.float32(0)


def chain_tasks(pixels: int, chains: int, cores: int) -> int:
    """Tasks for so many pixels of lines: what one sorts does not grow with the data, and few pixels still use all cores."""
    return max(1, -(-pixels // CHAIN_PIXELS), min(4 * cores, chains))


def advance_chains(
    lines: DataFrame, frames: DataFrame, seeds: DataFrame | None, *, color: bool, counters: bool, tasks: int, spread: int = 1,
) -> DataFrame:
    """Every line of ``frames``, as ``step.clean_start`` and ``step.advance`` give them.

    ``lines``: seq, frame, y, arrays r g b a m and the motion that the runs read, of all lines of these frames. ``frames``: run_id, seq, seg, frame, pos, h, w,
    live_hard, live_trail and the settings; those of a chain follow each other. ``seeds``: KEY, pos, frame, y, w, h, arrays r g b a k,
    of the frame before the first of a chain where that has ``pos`` above 0. The runs of a chain go to ``spread`` tasks.
    """
    part = F.pmod(F.hash("run_id"), F.lit(spread)).cast("int").alias("part")
    chain = (F.col("frame") - F.col("pos")).alias("chain")
    live = F.when(F.col("mode") == "TRAIL", F.col("live_trail")).otherwise(F.col("live_hard")).alias("live")
    told = F.struct("run_id", "seg", "pos", live, *SETTING_NAMES)
    heads = frames.select("seq", chain, part, "frame", "h", "w", told.alias("run")).groupBy("seq", "chain", "part", "frame").agg(
        F.max("h").alias("h"), F.max("w").alias("w"), F.sort_array(F.collect_list("run")).alias("runs")
    )
    channels = (*(COLOR if color else ()), "m", *[c for c in MOTION if c in lines.columns])
    place = ("seq", "chain", "part", "frame")
    bare, told_type = F.lit(None).cast("array<float>"), heads.schema["runs"].dataType
    none, nobody = F.lit(None).cast(told_type), F.lit(None).cast("string")

    def row(kind: int, y, run_id, runs, held: dict) -> list:
        return [*place, F.lit(kind).alias("kind"), y.alias("y"), F.col("h"), F.col("w"), run_id.alias("run_id"), runs.alias("runs"),
                *[(held.get(c, bare)).alias(c) for c in channels]]

    # A few small rows for each frame, so the lines need no sorting to meet them.
    spots = heads.select(*place, "h", "w").hint("shuffle_hash")
    met = lines.select("seq", "frame", "y", *channels).join(spots, ["seq", "frame"])
    rows = met.select(*row(LINE, F.col("y"), nobody, none, {c: F.col(c) for c in channels}))
    rows = rows.unionByName(heads.select(*row(FRAME, F.lit(0), nobody, F.col("runs"), {})))
    if seeds is not None:
        held = {c: F.col(c) for c in COLOR if color} | {"m": F.col("k")}
        rows = rows.unionByName(seeds.select("*", chain, part).select(*row(SEED, F.col("y"), F.col("run_id"), none, held)))
    order = ("seq", "chain", "part", "frame", "kind", "run_id", "y")
    dealt = rows.repartition(tasks, "seq", "chain", "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(_worker(color, counters), _schema(counters))


def _schema(counters: bool) -> str:
    counts = [f"{c} {'double' if c[0] in 'sx' else 'bigint'}" for c in COUNT_COLUMNS] + ["hit array<struct<by:int,bx:int>>"]
    return ", ".join([
        "run_id string, seq string, seg int, frame int, y int, w int, h int", *[f"{c} array<float>" for c in HISTORY],
        *(counts if counters else []), "reset boolean",
    ])


def _worker(color: bool, counters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, states = _Out(color, counters), None, {}
        with np.errstate(all="ignore"):
            for rows, i, j in _groups(batches):
                head = rows.slice(i, 1).select(["seq", "chain", "part", "frame", "kind", "h", "w", "run_id", "runs"]).to_pylist()[0]
                here = (head["seq"], head["chain"], head["part"])
                if here != key:
                    key, states = here, {}
                h, w = head["h"], head["w"]
                if head["kind"] == SEED:
                    held = (*(COLOR if color else ()), "m")
                    states[head["run_id"]] = np.stack([_values(rows, c, i, j, h, w)[0] for c in held])
                    continue
                cur = {c: _values(rows, c, i + 1, j, h, w) for c in (*(COLOR if color else ()), "m", *MOTION) if c in rows.schema.names}
                means: dict = {}
                for run_ in head["runs"]:
                    states[run_["run_id"]] = _one(out, head["seq"], head["frame"], run_, cur, states.get(run_["run_id"]), means, color, counters)
                if out.lines >= LINES_OUT:
                    yield out.take()
            if out.lines:
                yield out.take()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """The rows of each stored state and of each frame, wherever a batch ends: a table and the first and last place."""
    kept = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        kind, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "y"))
        starts = np.flatnonzero((kind == FRAME) | ((kind == SEED) & (y == 0))).tolist()
        for i, j in zip(starts, starts[1:]):
            yield rows, i, j
        kept = rows.slice(starts[-1])
    if kept is not None:
        yield kept, 0, kept.num_rows


def _values(rows: pa.RecordBatch, name: str, i: int, j: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The arrays of the rows from ``i`` to ``j`` as a frame, with 0 for a missing value, and where values are missing."""
    flat = rows.column(name).slice(i, j - i).flatten()
    if len(flat) != h * w:
        raise ValueError(f"a frame of {h} x {w} has {len(flat)} values of {name}")
    lost = None
    if flat.null_count:
        lost = flat.is_null().to_numpy(zero_copy_only=False).reshape(h, w)
        flat = flat.fill_null(0)
    return flat.to_numpy(zero_copy_only=False).reshape(h, w), lost


def _one(out: _Out, seq: str, frame: int, run: dict, cur: dict, prev: np.ndarray | None, means: dict, color: bool, counters: bool) -> np.ndarray:
    """One frame of one run: its lines are given out, and its state is returned."""
    m = cur["m"][0]
    h, w = m.shape
    shown = COLOR if color else ()
    state = np.stack([*[cur[c][0] for c in shown], m])
    lost = {c: cur[c][1] for c in shown if cur[c][1] is not None}
    target = m > 0
    counts = None
    if counters:
        zero, none = np.zeros(h, np.int64), np.zeros(h)
        counts = {c: none if c[0] in "sx" else zero for c in COUNT_COLUMNS}
        n, s = np.count_nonzero(target, axis=1), _sums(m)
        counts |= {"n_pixels": np.full(h, w), "n_target": n, "n_effect": n, "s_target": s, "s_effect": s}
    hits: dict[int, list] = {}
    reset = run["pos"] == 0
    semantics = Semantics.of(run)
    if not reset and run["live"]:
        busy = np.arange(h) if semantics.trail else np.flatnonzero(target.any(axis=1))
        if busy.size:
            if prev is None:
                raise ValueError(f"{run['run_id']}, {seq}: frame {frame} has no history")
            found, facts = _step(busy, state, prev, _blocks(frame, run, cur, means), run, semantics, color, counters)
            state[:, busy] = found
            for c in lost:
                lost[c] = lost[c].copy()
                lost[c][busy] = False
            if counters:
                hits = facts.pop("hit")
                counts = {c: v.copy() if c in facts else v for c, v in counts.items()}
                for c, v in facts.items():
                    counts[c][busy] = v
    out.add(run, seq, frame, state, lost, counts, hits, reset)
    return state


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of lines from left to right in double precision."""
    return np.cumsum(values, axis=1, dtype=np.float64)[:, -1]


def _clip(value: np.ndarray) -> np.ndarray:
    return np.fmax(np.fmin(value, FLOAT_MAX), -FLOAT_MAX).astype(np.float32)


def _blocks(frame: int, run: dict, cur: dict, means: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacement and refresh of each block of a frame; runs that read motion alike share the means in ``means``."""
    way = tuple(run[n] for n in MOTION_SETTINGS)
    if way not in means:
        means[way] = _means(run, cur)
    dx, dy = means[way]
    step, spread, chance = run["motion_quantization"], run["diffusion"], run["refresh_probability"]
    if step >= FLOAT_TINY:
        dx, dy = (_clip(np.rint(d.astype(np.float64) / step) * step) for d in (dx, dy))
    if spread > 0:
        dx, dy = (
            _clip(d.astype(np.float64) + (2.0 * _unit_random(run["seed"], frame, d.shape, stream) - 1.0) * spread)
            for d, stream in ((dx, DIFFUSE_X), (dy, DIFFUSE_Y))
        )
    refresh = _unit_random(run["seed"], frame, dx.shape, REFRESH) < chance if chance > 0 else np.zeros(dx.shape, bool)
    return dx, dy, refresh


def _means(run: dict, cur: dict) -> tuple[np.ndarray, np.ndarray]:
    m = cur["m"][0]
    h, w = m.shape
    back = -1.0 if run["reverse_motion"] else 1.0
    pair = MOTION[:2] if run["motion_channels"] == "RG" else MOTION[2:]
    flips = (-1.0 if run[n] else 1.0 for n in ("flip_x", "flip_y"))
    ux, uy = (cur[c][0].astype(np.float64) * back * flip for c, flip in zip(pair, flips))
    gain, limit = run["motion_gain"], min(run["motion_clamp"], FLOAT_MAX)
    length = np.sqrt(ux * ux + uy * uy)
    scale = np.where(length > 0, np.minimum(gain, limit / length), gain)
    weight, size = m.astype(np.float64), run["block_size"]
    tops, lefts = np.arange(0, h, size), np.arange(0, w, size)

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(values, lefts, axis=1), tops, axis=0)

    whole = total(weight)
    return tuple(
        np.where(whole > 0, total((u * scale).astype(np.float32).astype(np.float64) * weight) / whole, 0.0).astype(np.float32) for u in (ux, uy)
    )


def _unit_random(seed: int, frame: int, shape: tuple[int, int], stream: int) -> np.ndarray:
    """The numbers of ``hashing.with_unit_random`` for all blocks of a frame."""
    by, bx = np.indices(shape).astype(np.uint64)

    def const(value: int) -> np.uint64:
        return np.uint64(value & (2**64 - 1))

    mixed = const(seed) ^ const(frame * MIX["frame"]) ^ by * const(MIX["block_y"]) ^ bx * const(MIX["block_x"])
    mixed = (mixed ^ const(stream * MIX["stream"])) + const(MIX["increment"])
    for bits, factor in ((30, "first"), (27, "second")):
        mixed = (mixed ^ (mixed >> np.uint64(bits))) * const(MIX[factor])
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _lerp(low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return low * (ONE - weight) + high * weight


def _on_grid(value: np.ndarray, size: int) -> np.ndarray:
    return np.maximum(np.minimum(value, np.float32(size - 1)), ZERO)


def _step(
    busy: np.ndarray, state: np.ndarray, prev: np.ndarray, blocks: tuple, run: dict, semantics: Semantics, color: bool, counters: bool,
) -> tuple[np.ndarray, dict]:
    """E1-E10 for the lines ``busy`` of a frame: ``state`` has its color and matte, ``prev`` color and coverage of the frame before."""
    h, w = state.shape[1:]
    dx, dy, refresh = blocks
    size = run["block_size"]
    by, across = busy // size, np.arange(w) // size
    sy = busy.astype(np.float32)[:, None] - dy[by]
    cy = _on_grid(sy, h)
    low = np.floor(cy)
    top = low.astype(np.int64)
    wy = (cy - low)[:, across]
    sx = np.arange(w, dtype=np.float32) - dx[by][:, across]
    cx = _on_grid(sx, w)
    x0 = cx.astype(np.int64)
    x1 = np.minimum(x0 + 1, w - 1)
    wx = cx - x0.astype(np.float32)
    valid = ((sy >= 0) & (sy <= np.float32(h - 1)))[:, across] & (sx == cx)
    upper, lower = (top * w)[:, across], (np.minimum(top + 1, h - 1) * w)[:, across]
    history = prev
    if not semantics.full:
        history = np.concatenate([prev[:-1] * prev[-1], prev[-1:]])
    flat = history.reshape(len(history), -1)
    t0, t1, t2, t3 = (np.take(flat, at, axis=1) for at in (upper + x0, upper + x1, lower + x0, lower + x1))
    sampled = _lerp(_lerp(t0, t1, wx), _lerp(t2, t3, wx), wy)
    m, q = state[-1, busy], sampled[-1]
    decay, mix = run["trail_decay"] or 0.0, run["trail_motion_mix"] or 0.0
    keep = np.float32(decay)
    own_used = np.zeros(valid.shape, bool)
    if semantics.full:
        covered = used = valid
        source = np.where(valid, sampled[:-1], ZERO)
        if semantics.same_pixel:
            own_used, used = ~valid, np.ones(valid.shape, bool)
            source = np.where(valid, sampled[:-1], prev[:-1, busy])
        k = m
        if semantics.trail:
            spread = np.float32(1.0 - mix) * prev[-1, busy] + np.float32(mix) * np.where(valid, q, ZERO)
            k = _unit(np.maximum(m, keep * _unit(spread)))
        effect = k
    else:
        q = np.where(valid, q, ZERO)
        covered = used = valid & (q > 0)
        moved = np.where(covered, keep * q, ZERO)
        source = np.where(valid, sampled[:-1], ZERO) / np.where(covered, q, ONE)
        k = np.maximum(m, moved) if semantics.trail else m
        effect = m * q + (ONE - m) * moved if semantics.trail else m * q
    again = refresh[by][:, across]
    persistence = run["persistence"] or 0.0
    full_weight = np.where(used, np.float32(persistence) * effect, ZERO)
    blend = np.where(again, ZERO, full_weight)
    beauty = state[:-1, busy]
    made = np.concatenate([_lerp(beauty, source, blend), k[None]]) if color else k[None]
    facts: dict = {}
    if counters:
        change = np.abs(made[:3] - beauty[:3]).max(axis=0)
        felt, count = effect > 0, lambda flags: np.count_nonzero(flags, axis=1)
        facts = {
            "n_effect": count(felt), "s_effect": _sums(effect), "n_attempt": count(felt), "n_valid": count(felt & covered),
            "n_own_attempt": count(felt & ~covered) if semantics.fallback == "SAME_PIXEL_HISTORY" else 0,
            "n_own_valid": count(felt & own_used), "n_refresh": count(again & (full_weight > 0)), "n_blend": count(blend > 0),
            "s_blend": _sums(blend), "n_changed": count(change > CHANGE), "s_change": _sums(change), "x_change": change.max(axis=1),
        }
        hits: dict[int, list] = {}
        struck = again & felt & used if persistence > 0 and again.any() else again[:0]
        for line in np.flatnonzero(struck.any(axis=1)).tolist():
            row = int(by[line])
            hits[int(busy[line])] = [{"by": row, "bx": int(b)} for b in np.unique(across[struck[line]])]
        facts["hit"] = hits
    return made, facts


def _unit(value: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(value, ONE), ZERO)


class _Out:
    """Finished lines until they are given back."""

    def __init__(self, color: bool, counters: bool):
        self.color, self.counters = color, counters
        self.clear()

    def clear(self) -> None:
        self.lines, self.frames = 0, []

    def add(self, *frame) -> None:
        self.frames.append(frame)
        self.lines += frame[3].shape[1]

    def take(self) -> pa.RecordBatch:
        """The lines as one batch."""
        frames = self.frames
        sizes = [f[3].shape[1:] for f in frames]
        each = np.array([h for h, _ in sizes])

        def repeated(values: list, kind: pa.DataType) -> pa.Array:
            return pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(frames)), each)))

        widths = np.repeat([w for _, w in sizes], each)
        ends = pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32))
        columns = {
            "run_id": repeated([f[0]["run_id"] for f in frames], pa.string()), "seq": repeated([f[1] for f in frames], pa.string()),
            "seg": repeated([f[0]["seg"] for f in frames], pa.int32()), "frame": repeated([f[2] for f in frames], pa.int32()),
            "y": pa.array(np.concatenate([np.arange(h) for h in each]).astype(np.int32)), "w": pa.array(widths.astype(np.int32)),
            "h": pa.array(np.repeat(each, each).astype(np.int32)),
        }
        for i, c in enumerate(HISTORY if self.color else ("k",)):
            values = np.concatenate([f[3][i].ravel() for f in frames])
            lost = None
            if any(c in f[4] for f in frames):
                lost = np.concatenate([(f[4][c] if c in f[4] else np.zeros(f[3].shape[1:], bool)).ravel() for f in frames])
            columns[c] = pa.ListArray.from_arrays(ends, pa.array(values, pa.float32(), mask=lost))
        if not self.color:
            bare = pa.ListArray.from_arrays(pa.array(np.zeros(len(widths) + 1, np.int32)), pa.array([], pa.float32()))
            columns = {c: columns.get(c, bare) for c in (*[n for n in columns if n != "k"], *HISTORY)}
        if self.counters:
            for c in COUNT_COLUMNS:
                kind = pa.float64() if c[0] in "sx" else pa.int64()
                columns[c] = pa.array(np.concatenate([f[5][c] for f in frames]), kind)
            hits = [f[6].get(y, []) for f, h in zip(frames, each) for y in range(h)]
            columns["hit"] = pa.array(hits, pa.list_(pa.struct([("by", pa.int32()), ("bx", pa.int32())])))
        columns["reset"] = repeated([f[7] for f in frames], pa.bool_())
        self.clear()
        return pa.RecordBatch.from_pydict(columns)
