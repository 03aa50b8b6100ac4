"""One feedback step for many frames at once (E1-E10, with D1-D6 inside).

Rows here are *lines*: one row per raster row with one float array per channel. A line is never wider
than its raster, so no group grows with the data, and a shuffle moves 4 bytes per value instead of a
full row per pixel. All pixels of a line that share a block share one displacement, so a step joins
each segment (line, block) with one pair of history lines and ships only the slice it can touch,
instead of exploding four taps per pixel.

Frames of a bounded number of pixels need less: their lines, history and blocks are each moved once, to the task of the
frame, and segments find their history there (``whole_frames``). Larger frames are never gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..model import ENUMS

KEY = ["run_id", "seq", "seg"]
HISTORY = ("r", "g", "b", "a", "k")

SEMANTICS = ("mode", "history_source", "invalid_history_fallback")

# Per-line partial counters; frame counters are their sums.
COUNT_COLUMNS = (
    "n_pixels", "n_target", "s_target", "n_effect", "s_effect", "n_attempt", "n_valid",
    "n_own_attempt", "n_own_valid", "n_refresh", "n_blend", "s_blend", "n_changed", "s_change", "x_change",
)


#: Pixels that one task of a step unfolds and sorts, some 350 bytes each.
PIXELS_PER_TASK = 50_000


#: Pixels of the largest frame whose history is gathered in one row, 20 bytes each.
FRAME_PIXELS = 65_536


@dataclass(frozen=True)
class Semantics:
    """The three settings that choose the expressions of a step; all others stay columns."""

    mode: str
    history_source: str
    fallback: str

    @classmethod
    def of(cls, run: dict[str, object]) -> "Semantics":
        return cls(run["mode"], run["history_source"], run["invalid_history_fallback"])

    @classmethod
    def present(cls, runs: DataFrame) -> list["Semantics"]:
        """The legal combinations that a table of runs holds: at most eight, however many runs there are."""
        legal = [F.col(n).isin(*ENUMS[n]) for n in SEMANTICS]
        rows = runs.select(*SEMANTICS).where(legal[0] & legal[1] & legal[2]).distinct().collect()
        return sorted((cls.of(r.asDict()) for r in rows), key=str)

    @property
    def trail(self) -> bool:
        return self.mode == "TRAIL"

    @property
    def full(self) -> bool:
        return self.history_source == "FULL_FRAME"

    @property
    def same_pixel(self) -> bool:
        return self.full and self.fallback == "SAME_PIXEL_HISTORY"

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(
            (F.col("mode") == self.mode)
            & (F.col("history_source") == self.history_source)
            & (F.col("invalid_history_fallback") == self.fallback)
        )


def tasks_for(pixels: int | None, each: int | None = None) -> int:
    """Tasks that this many pixels are dealt to, so that what a task unfolds or sorts does not grow with the data."""
    return max(1, -(-(pixels or 0) // (each or PIXELS_PER_TASK)))


def pack_lines(
    px: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("seq", "frame"), tasks: int | None = None,
) -> DataFrame:
    """Pixels to lines: one shuffle on the raster row, groups as wide as the raster; to ``tasks`` tasks, if given."""
    px = px.repartition(tasks, *keys, "y") if tasks else px
    packed = px.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", *columns))).alias("_p"))
    return packed.select(*keys, "y", F.size("_p").alias("w"), *[F.col(f"_p.{c}").alias(c) for c in columns])


def unpack_lines(lines: DataFrame, columns: dict[str, str], keys: tuple[str, ...]) -> DataFrame:
    """Lines to pixels; ``columns`` maps array name to pixel column name."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return lines.select(*keys, "y", F.posexplode(zipped).alias("x", "_v")).select(
        *keys, "y", "x", *[F.col(f"_v.{c}").alias(n) for c, n in columns.items()]
    )


def clean_start(cur: DataFrame, *, color: bool = True, counters: bool = True, reset: bool = True) -> DataFrame:
    """A reset frame is its own beauty and its coverage is its matte."""
    lines = _untouched(cur, color).withColumn("reset", F.lit(reset))
    return lines if counters else _bare(lines)


def _untouched(cur: DataFrame, color: bool = True) -> DataFrame:
    bare = F.array().cast("array<float>")
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    matte_sum = F.aggregate("m", F.lit(0.0), lambda s, v: s + v.cast("double"))
    target = F.aggregate("m", zero, lambda n, v: n + F.when(v > 0, 1).otherwise(0))
    counts = {name: none if name[0] in "sx" else zero for name in COUNT_COLUMNS}
    counts |= {
        "n_pixels": F.col("w").cast("bigint"), "n_target": target, "n_effect": target,
        "s_target": matte_sum, "s_effect": matte_sum,
    }
    return cur.select(
        *KEY, "frame", "y", "w", "h",
        *[F.col(c) if color else bare.alias(c) for c in P.COLOR],
        F.col("m").alias("k"),
        *[c.alias(n) for n, c in counts.items()],
        F.array().cast("array<struct<by:int,bx:int>>").alias("hit"),
    )


def segments_of_lines(busy: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each line cut at its block borders, with the history row and the column range it reads."""
    rows = blocks.groupBy(*KEY, "by").agg(
        F.sort_array(F.collect_list(F.struct("bx", "dx", "dy", "refresh"))).alias("blk")
    )
    cut = (
        busy.selectExpr(*KEY, "y", "w", "h", "block_size", "CAST(floor(y / block_size) AS INT) AS by")
        .join(rows, [*KEY, "by"])
        .select(*KEY, "y", "w", "h", "block_size", F.inline("blk"))
    )
    ends = cut.selectExpr(
        "*", "bx * block_size AS x_first", "least(bx * block_size + block_size - 1, w - 1) AS x_last"
    )
    low, high = (P.on_grid_finite(f"(CAST({x} AS FLOAT) - dx)", "w") for x in ("x_first", "x_last"))
    return ends.selectExpr(
        *KEY, "y", "bx", "dx", "dy", "refresh",
        f"CAST(floor({P.on_grid_finite('(CAST(y AS FLOAT) - dy)', 'h')}) AS INT) AS top",
        f"CAST(floor({low}) AS INT) AS lo",
        f"least(CAST(floor({high}) AS INT) + 1, w - 1) AS hi",
    )


def row_pairs(prev: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each history line with the line below it, so both taps of a column come from one row."""
    below = prev.select(*KEY, (F.col("y") - 1).alias("y"), *[F.col(c).alias(f"l_{c}") for c in columns])
    upper = prev.select(*KEY, "y", *[F.col(c).alias(f"u_{c}") for c in columns])
    return upper.join(below, [*KEY, "y"], "left").select(
        *KEY, F.col("y").alias("top"), *[f"u_{c}" for c in columns],
        *[F.coalesce(f"l_{c}", f"u_{c}").alias(f"l_{c}") for c in columns],
    )


def fetch(segs: DataFrame, prev: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The part of history each segment can touch: slices ``u_*`` of its upper row and ``l_*`` of the lower."""
    return segs.join(row_pairs(prev, columns), [*KEY, "top"]).selectExpr(
        *KEY, "y", "bx", "dx", "dy", "refresh", "lo",
        *[f"slice({row}_{c}, lo + 1, hi - lo + 1) AS {row}_{c}" for row in "ul" for c in columns],
    )


def small_frame() -> Column:
    return F.col("h").cast("bigint") * F.col("w") <= FRAME_PIXELS


def advance(
    cur: DataFrame, prev: DataFrame, blocks: DataFrame, semantics: Semantics,
    *, color: bool = True, checked: bool = True, counters: bool = True, tasks: int | None = None, whole: bool = False,
) -> DataFrame:
    """The next state of every line in ``cur``.

    ``cur``: KEY, frame, y, w, h, live, arrays r g b a m, and the settings.
    ``prev``: KEY, y, arrays r g b a and coverage k, of the frame before.
    ``blocks``: KEY, by, bx, dx, dy, refresh.
    ``color=False`` follows coverage only; ``checked=False`` also tests history for bad values; ``tasks`` share the pixels.
    ``whole`` says that all frames are small, and that of each all history lines and blocks are there.
    Lines that cannot hold any effect skip the gather and pass through.
    """
    idle = clean_start(cur.where(~_busy(semantics)), color=color, counters=counters, reset=False)
    busy = cur.where(_busy(semantics))
    return step_lines(
        busy, prev, blocks, semantics, color=color, checked=checked, counters=counters, tasks=tasks, whole=whole
    ).unionByName(idle)


def _busy(semantics: Semantics) -> Column:
    return F.col("live") if semantics.trail else F.col("live") & (F.array_max("m") > 0)


def _bare(lines: DataFrame) -> DataFrame:
    return lines.drop(*COUNT_COLUMNS, "hit")


def step_lines(
    busy: DataFrame, prev: DataFrame, blocks: DataFrame, semantics: Semantics,
    *, color: bool = True, checked: bool = True, counters: bool = True, tasks: int | None = None, whole: bool = False,
) -> DataFrame:
    """The step itself, for lines that take part."""
    pixels = step_pixels(busy, prev, blocks, semantics, color=color, checked=checked, tasks=tasks, whole=whole)
    out = P.COLOR if color else ()
    packed = F.sort_array(F.collect_list(F.struct("x", *[f"o_{c}" for c in out], "k"))).alias("_p")
    sums = _line_counters(semantics) if counters else []
    lines = pixels.groupBy(*KEY, "frame", "y", "w", "h").agg(packed, *sums)
    bare = F.array().cast("array<float>")
    return lines.select(
        *KEY, "frame", "y", "w", "h",
        *[(F.col(f"_p.o_{c}") if color else bare).alias(c) for c in P.COLOR],
        F.col("_p.k").alias("k"),
        *([*COUNT_COLUMNS, "hit"] if counters else []),
        F.lit(False).alias("reset"),
    )


def whole_frames(
    busy: DataFrame, prev: DataFrame, blocks: DataFrame, fetched: tuple[str, ...], own: tuple[str, ...], tasks: int | None,
) -> DataFrame:
    """Segments of small frames with the history they read, from one row of history and one of blocks for each frame.

    All rows and blocks of a frame are there, so a place in an array is a row of the raster or a block of its grid.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, *KEY) if tasks else df.repartition(*KEY)

    rows = dealt(prev.select(*KEY, "y", *fetched)).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("y", *fetched))).alias("_h"))
    rows = rows.select(*KEY, *[F.col(f"_h.{c}").alias(f"h_{c}") for c in fetched])
    grid = dealt(blocks.select(*KEY, "by", "bx", "dx", "dy", "refresh")).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("by", "bx", "dx", "dy", "refresh"))).alias("_b")
    )
    lines = dealt(busy).join(rows, KEY).join(grid, KEY)
    kept = (*busy.columns, *[f"h_{c}" for c in fetched])
    across = "CAST((w + block_size - 1) DIV block_size AS INT)"
    cut = lines.selectExpr(*kept, f"inline(slice(_b, CAST(y DIV block_size AS INT) * {across} + 1, {across}))").drop("by")
    low, high = (P.on_grid_finite(f"(CAST({x} AS FLOAT) - dx)", "w") for x in (
        "(bx * block_size)", "least(bx * block_size + block_size - 1, w - 1)"))
    at = cut.selectExpr(
        *kept, "bx", "dx", "dy", "refresh",
        f"CAST(floor({P.on_grid_finite('(CAST(y AS FLOAT) - dy)', 'h')}) AS INT) AS top",
        f"CAST(floor({low}) AS INT) AS lo", f"least(CAST(floor({high}) AS INT) + 1, w - 1) AS hi",
    )
    sides = (("u", "top"), ("l", "least(top + 1, h - 1)"))
    return at.selectExpr(
        *busy.columns, "bx", "dx", "dy", "refresh", "lo", *[f"get(h_{c}, y) AS p_{c}" for c in own],
        *[f"slice(get(h_{c}, {row}), lo + 1, hi - lo + 1) AS {side}_{c}" for side, row in sides for c in fetched],
    )


def line_segments(
    busy: DataFrame, prev: DataFrame, blocks: DataFrame, fetched: tuple[str, ...], own: tuple[str, ...], tasks: int | None,
) -> DataFrame:
    """Segments of frames of any size with the history they read, each from the pair of lines it joins."""
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, *KEY, "y") if tasks else df

    touched = fetch(segments_of_lines(busy, blocks), prev, fetched)
    here = dealt(busy)
    if own:
        here = here.join(dealt(prev.select(*KEY, "y", *[F.col(c).alias(f"p_{c}") for c in own])), [*KEY, "y"])
    return dealt(touched).join(here, [*KEY, "y"])


def step_pixels(
    busy: DataFrame, prev: DataFrame, blocks: DataFrame, semantics: Semantics,
    *, color: bool = True, checked: bool = True, tasks: int | None = None, whole: bool = False,
) -> DataFrame:
    """One row per pixel with its output, next coverage and the facts the counters need.

    Lines unfold to many times their size in a shuffle, so merging small shuffle partitions makes tasks that spill. With
    ``tasks`` they meet in that many, which are not merged.
    """
    fetched = HISTORY if color or not checked else ("k",)
    own = ()
    if semantics.same_pixel or (semantics.full and semantics.trail):
        own = fetched if semantics.same_pixel or not checked else ("k",)
    beauty = P.COLOR if color else ()
    here = busy.select(*KEY, "frame", "y", "w", "h", *RUN_COLUMNS, "block_size", *beauty, "m")
    met = (whole_frames if whole else line_segments)(here, prev, blocks, fetched, own, tasks)
    # What is constant along a segment is worked out once per segment, before its pixels are unfolded;
    # that also keeps the loop body small enough for the JVM to compile.
    kept = (*KEY, "frame", "y", "w", "h", *RUN_COLUMNS)
    arrays = (*beauty, "m", *[f"p_{c}" for c in own])
    cut = met.selectExpr(
        *KEY, "frame", "y", "w", "h", *[f"nvl({c}, 0D) AS {c}" for c in RUN_COLUMNS], *arrays,
        "nvl(bx, 0) AS bx", "nvl(block_size, 1) AS block_size", "nvl(dx, 0F) AS dx", "nvl(refresh, false) AS refresh",
        "nvl(lo, 0) AS lo", "CAST(nvl(y, 0) AS FLOAT) - nvl(dy, 0F) AS sy",
        *[f"{row}_{c}" for row in "ul" for c in fetched],
    ).selectExpr(
        *kept, *arrays, "bx", "dx", "refresh", "lo", *[f"{row}_{c}" for row in "ul" for c in fetched],
        f"nvl({P.inside_finite('sy', 'h')}, false) AS y_valid", f"{P.on_grid_finite('sy', 'h')} AS cy",
        "CAST(y DIV block_size AS INT) AS by", "bx * block_size AS x_first", "nvl(w, 1) - 1 AS x_max",
        "slice(m, bx * block_size + 1, block_size) AS m_block",
    ).selectExpr("*", "nvl(cy - CAST(floor(cy) AS FLOAT), 0F) AS wy")
    # Inner loop: the pixels of one block, driven by its slice of the matte.
    at = cut.selectExpr(
        *kept, *beauty, *[f"p_{c}" for c in own], "by", "bx", "x_first", "x_max", "dx", "refresh", "lo",
        "y_valid", "wy", *[f"{row}_{c}" for row in "ul" for c in fetched], "posexplode(m_block) AS (i, m)",
    ).selectExpr("*", "x_first + i AS x")
    at = at.selectExpr("*", "CAST(x AS FLOAT) - dx AS sx")
    at = at.selectExpr("*", "greatest(least(sx, CAST(x_max AS FLOAT)), 0F) AS cx").selectExpr("*", "CAST(cx AS INT) AS x0")
    at = at.selectExpr("*", "x0 - lo AS i0", "least(x0 + 1, x_max) - lo AS i1")
    columns = (("t0", "u", "i0"), ("t1", "u", "i1"), ("t2", "l", "i0"), ("t3", "l", "i1"))
    return _combine(
        at.selectExpr(
            *kept, "x", "by", "bx", "refresh", "y_valid AND sx = cx AS valid",
            "cx - CAST(x0 AS FLOAT) AS wx", "wy",
            *[f"nvl(get({c}, x), 0F) AS b_{c}" for c in beauty], "nvl(m, 0F) AS m",
            *[f"nvl(get(p_{c}, x), 0F) AS p_{c}" for c in own],
            *[f"nvl(get({row}_{c}, {index}), 0F) AS {tap}_{c}" for tap, row, index in columns for c in fetched],
        ),
        semantics, color, checked,
    )


RUN_COLUMNS = ("persistence", "trail_decay", "trail_motion_mix")


def _combine(at: DataFrame, semantics: Semantics, color: bool, checked: bool) -> DataFrame:
    """Taps to output: ``at`` has t0..t3 (and p for the same pixel), wx, wy, valid, m and beauty b_*."""
    four, here = P.taps(checked), P.Tap("p", checked)
    shown = P.COLOR if color else ()
    kept = (*KEY, "frame", "y", "x", "w", "h", "by", "bx", "m", "persistence", "refresh",
            *[f"b_{c}" for c in shown])
    own = [c for c in at.columns if c.startswith("p_")]
    if semantics.full:
        seen = at.selectExpr(
            *kept, *own, "trail_decay", "trail_motion_mix",
            f"{P.full_usable(four)} AS covered",
            *[f"{P.full_color(four, c)} AS w_{c}" for c in shown],
            *([f"{P.full_cover(four)} AS q", f"{P.full_cover_usable(four)} AS q_ok"] if semantics.trail else []),
        )
        own_ok = f"(NOT covered AND {here.color_ok})" if semantics.same_pixel else "false"
        kept_cover = here.cover if checked else P.pick(here.cover_ok, here.cover)
        cover = P.trail_full(kept_cover, "q", "q_ok") if semantics.trail else "m"
        from_own = {c: P.pick(own_ok, here.color(c), f"w_{c}") if semantics.same_pixel else f"w_{c}" for c in shown}
        ready = seen.selectExpr(
            *kept, "covered", f"{own_ok} AS own_used", f"covered OR {own_ok} AS used",
            *[f"{P.pick(f'(covered OR {own_ok})', v)} AS s_{c}" for c, v in from_own.items()],
            f"{cover} AS k",
        ).selectExpr("*", "k AS effect")
    else:
        seen = at.selectExpr("*", f"{P.target_cover(four)} AS q").selectExpr(
            "*", f"{P.target_usable(four, 'q')} AS covered"
        )
        seen = seen.selectExpr(
            *kept, "q", "covered", f"{P.trail_target('q', 'covered')} AS moved",
            *[f"{P.target_color(four, c, 'q', 'covered')} AS s_{c}" for c in shown],
        )
        trail = semantics.trail
        ready = seen.selectExpr(
            *kept, "covered", "false AS own_used", "covered AS used", *[f"s_{c}" for c in shown],
            f"{'greatest(m, moved)' if trail else 'm'} AS k",
            f"{'m * q + (1F - m) * moved' if trail else 'm * q'} AS effect",
        )
    weighed = ready.selectExpr(
        "*", f"{P.pick('used', 'CAST(persistence AS FLOAT) * effect')} AS full_weight"
    ).selectExpr("*", f"{P.pick('refresh', '0F', 'full_weight')} AS blend")
    if not color:
        return weighed
    return weighed.selectExpr("*", *[f"{P.blend(f'b_{c}', f's_{c}', 'blend')} AS o_{c}" for c in P.COLOR])


def _line_counters(semantics: Semantics) -> list[Column]:
    counts_own = semantics.fallback == "SAME_PIXEL_HISTORY"
    measures = {
        "n_pixels": "count(1)",
        "n_target": "count_if(m > 0)",
        "s_target": "sum(CAST(m AS DOUBLE))",
        "n_effect": "count_if(effect > 0)",
        "s_effect": "sum(CAST(effect AS DOUBLE))",
        "n_attempt": "count_if(effect > 0)",
        "n_valid": "count_if(effect > 0 AND covered)",
        "n_own_attempt": "count_if(effect > 0 AND NOT covered)" if counts_own else "max(0L)",
        "n_own_valid": "count_if(effect > 0 AND own_used)",
        "n_refresh": "count_if(refresh AND full_weight > 0)",
        "n_blend": "count_if(blend > 0)",
        "s_blend": "sum(CAST(blend AS DOUBLE))",
        "n_changed": f"count_if({P.change()} > {P.CHANGE_EPSILON})",
        "s_change": f"sum(CAST({P.change()} AS DOUBLE))",
        "x_change": f"max(CAST({P.change()} AS DOUBLE))",
        "hit": "collect_set(CASE WHEN refresh AND effect > 0 AND used AND persistence > 0 "
               "THEN struct(by, bx) END)",
    }
    return [F.expr(f"{e} AS {n}") for n, e in measures.items()]
