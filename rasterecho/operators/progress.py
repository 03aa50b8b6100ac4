"""Two-phase workflows: hand-off, progress and failure attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PASSES


def handoff(published: DataFrame, requests: DataFrame) -> DataFrame:
    """the input of the second phase: exactly the paths the first phase published.

    ``published`` comes from the catalog comparison (seq, frame, pass, path, error); ``requests`` has
    seq, frame_start, frame_end. A sequence with any missing or doubtful pass is not handed over.
    """
    frames = published.where(F.col("error").isNull()).groupBy("seq", "frame").agg(
        *[F.max(F.when(F.col("pass") == p, F.col("path"))).alias(p) for p in PASSES],
        F.count_distinct("pass").alias("_passes"),
    ).where(F.col("_passes") == len(PASSES))
    ranged = frames.join(requests, "seq").where(F.col("frame").between(F.col("frame_start"), F.col("frame_end")))
    ready = ranged.groupBy("seq", "frame_start", "frame_end").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == F.col("frame_end") - F.col("frame_start") + 1
    )
    return ranged.join(ready.select("seq"), "seq", "left_semi").select("seq", "frame", *PASSES)


def phase_progress(steps: DataFrame, requests: DataFrame) -> DataFrame:
    """how far each run is, and how many steps came out of order.

    ``steps``: run_id, ord, phase (RENDER or PROCESS), frame; ``requests``: run_id, frame_start, frame_end.
    A step is in order when its frame follows the one before in its phase and no render comes after a process step.
    """
    known = steps.join(requests, "run_id")
    within = Window.partitionBy("run_id", "phase").orderBy("ord")
    whole = Window.partitionBy("run_id").orderBy("ord")
    expected = F.col("frame_start") + F.row_number().over(within) - 1
    rendered_so_far = F.count_if(F.col("phase") == "RENDER").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    n_frames = F.col("frame_end") - F.col("frame_start") + 1
    early = (F.col("phase") == "PROCESS") & (rendered_so_far < n_frames)
    judged = known.withColumn("_bad", (F.col("frame") != expected) | early)
    counts = judged.groupBy("run_id", "frame_start", "frame_end").agg(
        F.count_if(F.col("phase") == "RENDER").alias("rendered"),
        F.count_if(F.col("phase") == "PROCESS").alias("processed"),
        F.count_if("_bad").alias("order_violations"),
    )
    total = (F.col("frame_end") - F.col("frame_start") + 1) * 2
    done = F.col("rendered") + F.col("processed")
    current = F.when(F.col("rendered") * 2 < total, F.least(F.col("frame_start") + F.col("rendered"), F.col("frame_end"))) \
        .otherwise(F.least(F.col("frame_start") + F.col("processed"), F.col("frame_end")))
    return counts.select(
        "run_id", "rendered", "processed", total.cast("bigint").alias("total_work"), (done / total).alias("progress"),
        current.cast("bigint").alias("current_frame"), "order_violations",
    )


def failed_frame(failures: DataFrame) -> DataFrame:
    """the frame a failure belongs to; ``failures``: run_id, frame_start, frame_end, completed_count."""
    return failures.select(
        "run_id", F.least(F.col("frame_start") + F.col("completed_count"), F.col("frame_end")).alias("failed_frame")
    )
