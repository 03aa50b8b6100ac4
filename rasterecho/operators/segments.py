"""Frame-level planning: reset parsing, dimensions, segments (B6, F1, F2). One small row per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reset_frames(expression: Column) -> Column:
    """the distinct whole numbers of a comma-separated list, in order."""
    parts = F.filter(F.transform(F.split(expression, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: p.cast("int"))))


def frame_dims(px: DataFrame) -> DataFrame:
    """Height, width and whether any matte is present, per frame."""
    return px.groupBy("seq", "frame").agg(
        (F.max("y") + 1).alias("h"),
        (F.max("x") + 1).alias("w"),
        (F.max("m") > 0).alias("has_matte"),
    )


def resolution_change(dims: DataFrame, policy: str = "ERROR") -> DataFrame:
    """The frames whose size differs from the frame before, and what the policy makes of it."""
    order = Window.partitionBy("seq").orderBy("frame")
    before = dims.withColumns({"old_h": F.lag("h").over(order), "old_w": F.lag("w").over(order)})
    differs = (F.col("old_h") != F.col("h")) | (F.col("old_w") != F.col("w"))
    return before.where(differs).select(
        "seq", "frame", "old_h", "old_w", "h", "w", F.lit(policy).alias("outcome")
    )


def segments(
    frames: DataFrame, resets: DataFrame | None = None, keys: tuple[str, ...] = ("seq",),
    *, policy: str = "ERROR", continues: bool = False,
) -> DataFrame:
    """add ``reset, seg, pos`` and ``state_error``.

    ``frames`` has the keys, frame, h, w. A frame resets when it is the first, listed in ``resets``
    (keys or just seq, plus frame), or of another size under policy RESET. ``continues`` marks
    sequences whose first frame carries on from a stored state, so it does not reset by itself.
    A gap in the frame numbers, a size change under ERROR or, where ``frames`` has the column, an
    ``input_error`` stops the sequence there.
    """
    order = Window.partitionBy(*keys).orderBy("frame")
    listed = F.lit(False)
    if resets is not None:
        on = [c for c in resets.columns if c in frames.columns]
        frames = frames.join(resets.distinct().withColumn("_listed", F.lit(True)), on, "left")
        listed = F.coalesce(F.col("_listed"), F.lit(False))
    first = F.lag("frame").over(order).isNull()
    resized = F.coalesce(
        (F.lag("h").over(order) != F.col("h")) | (F.lag("w").over(order) != F.col("w")), F.lit(False)
    )
    gap = F.coalesce(F.lag("frame").over(order) != F.col("frame") - 1, F.lit(False))
    marked = frames.withColumns(
        {
            "reset": listed | (resized & F.lit(policy == "RESET")) | (F.lit(False) if continues else first),
            "_stop": F.when(gap, F.lit("missing frame before"))
            .when(resized & F.lit(policy != "RESET"), F.lit("resolution changed"))
            .otherwise(F.col("input_error") if "input_error" in frames.columns else F.lit(None).cast("string")),
        }
    )
    numbered = marked.withColumns(
        {
            "seg": F.sum(F.col("reset").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "state_error": F.first("_stop", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).drop("_stop", *(["_listed"] if resets is not None else []))
    within = Window.partitionBy(*keys, "seg").orderBy("frame")
    return numbered.withColumns(
        {"seg": F.col("seg").cast("int"), "pos": (F.row_number().over(within) - 1).cast("int")}
    )


def with_live(planned: DataFrame, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``live`` is false where no effect is possible, so the step skips the frame.

    Without a trail only the frame's own matte counts; with one, any matte since the segment began.
    """
    so_far = Window.partitionBy(*keys, "seg").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return planned.withColumns(
        {"live_hard": F.col("has_matte"), "live_trail": F.max("has_matte").over(so_far)}
    )
