"""Stage timings and benchmark summaries (H1-H5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The timed stages, the report bound and the length the published extrapolation uses.
STAGES = (
    "beauty_read", "vector_read", "matte_read", "core_processing", "processed_write",
    "manifest_commit", "diagnostics_report_commit",
)
INPUT_STAGES = STAGES[:3]
MAX_TIMED_FRAMES = 96
EXTRAPOLATED_FRAMES = 147

COARSE_BITS = 20


def stage_totals(timings: DataFrame) -> DataFrame:
    """H1: time per stage over the newest 96 frames of each run and sequence, largest first.

    ``timings``: run_id, seq, frame, reset, stage, ns; one row per frame and stage.
    """
    keys = ("run_id", "seq")
    frames = timings.select(*keys, "frame").distinct()
    newest = Window.partitionBy(*keys).orderBy(F.col("frame").desc())
    counted = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    kept = frames.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= MAX_TIMED_FRAMES).drop("_n")
    totals = timings.join(kept, [*keys, "frame"]).groupBy(*keys, "stage").agg(F.sum("ns").alias("duration_ns"))
    place = Window.partitionBy(*keys).orderBy(F.col("duration_ns").desc(), "stage")
    return totals.join(counted, list(keys)).select(
        *keys, "stage", "duration_ns", F.row_number().over(place).alias("place"),
        F.greatest(F.col("n_frames") - MAX_TIMED_FRAMES, F.lit(0)).alias("frames_omitted"),
    )


def exact_median(samples: DataFrame, by: tuple[str, ...], value: str = "ns") -> DataFrame:
    """The whole-number median of each group without gathering a group in one task.

    Values are counted per bucket of 2^20, the bucket that holds each middle rank is found from the
    bucket counts, and only that bucket is counted value by value. Every step pre-aggregates, so one
    group may hold most rows.
    """
    keys = list(by)
    bucket = F.shiftright(F.col(value), COARSE_BITS)
    coarse = samples.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = coarse.withColumns(
        {"_upto": F.sum("_n").over(up_to), "_all": F.sum("_n").over(Window.partitionBy(*keys))}
    )
    ranks = F.array(F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2))
    wanted = ranked.select(*keys, "_b", "_n", "_upto", F.posexplode(ranks).alias("_side", "_rank")).where(
        (F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto"))
    ).select(*keys, "_b", "_side", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    fine = samples.withColumn("_b", bucket).join(
        wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi"
    ).groupBy(*keys, "_b", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = fine.withColumn("_upto", F.sum("_n").over(within)).join(wanted, [*keys, "_b"]).where(
        (F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto"))
    )
    return placed.groupBy(*keys).agg(F.floor(F.avg("_v")).cast("bigint").alias("median_ns"))


def sample_summary(samples: DataFrame, by: tuple[str, ...], frames_per_sample: int = 1) -> DataFrame:
    """H2: count, extremes, median and the 147-frame extrapolation of the durations ``ns``."""
    basic = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("measured_count"), F.min("ns").alias("minimum_ns"), F.max("ns").alias("maximum_ns")
    )
    joined = basic.join(exact_median(samples, by), list(by))
    scaled = F.expr(f"median_ns * {EXTRAPOLATED_FRAMES} DIV {frames_per_sample}")
    return joined.select(
        *by, "measured_count", "minimum_ns", "median_ns", "maximum_ns", scaled.alias("extrapolated_147_frames_ns")
    )


def stage_samples(timings: DataFrame) -> DataFrame:
    """The samples behind H3: each stage, the input reads together and the whole frame.

    Only frames that did not reset count, and a frame without one of the inputs has no total read.
    """
    measured = timings.where(~F.col("reset"))
    single = measured.where(F.col("stage").isin(*STAGES)).select("stage", "ns")
    reads = F.col("stage").isin(*INPUT_STAGES)
    frames = measured.groupBy("run_id", "seq", "frame").agg(
        F.count_if(reads).alias("_reads"), F.sum(F.when(reads, F.col("ns"))).alias("_read_ns"),
        F.sum("ns").alias("_all_ns"),
    )
    combined = frames.select(
        F.inline(
            F.array(
                F.struct(F.lit("total_input_read").alias("stage"),
                         F.when(F.col("_reads") == len(INPUT_STAGES), F.col("_read_ns")).alias("ns")),
                F.struct(F.lit("complete_frame").alias("stage"), F.col("_all_ns").alias("ns")),
            )
        )
    ).where(F.col("ns").isNotNull())
    return single.unionByName(combined)


def stage_summary(timings: DataFrame) -> DataFrame:
    """H3: H2 for every stage."""
    return sample_summary(stage_samples(timings), ("stage",))


def throughput(summary: DataFrame, bytes_per_sample: Column) -> DataFrame:
    """H4: bytes per second at the median."""
    return summary.withColumn("bytes_per_sample", bytes_per_sample.cast("bigint")).withColumn(
        "bytes_per_second",
        F.when(F.col("median_ns") > 0,
               F.floor(F.col("bytes_per_sample").cast("double") * F.lit(1e9) / F.col("median_ns")).cast("bigint")),
    )


def before_after(before: DataFrame, after: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """H5: how much the median fell, per name."""
    old = before.select(*by, F.col("median_ns").alias("before_ns"))
    new = after.select(*by, F.col("median_ns").alias("after_ns"))
    fell = (F.col("before_ns") - F.col("after_ns")) * 100 / F.col("before_ns")
    return old.join(new, list(by)).select(
        *by, "before_ns", "after_ns",
        F.when(F.col("before_ns") > 0, F.round(fell, 2)).alias("median_reduction_percent"),
        F.when(F.col("after_ns") > 0, F.round(F.col("before_ns") / F.col("after_ns"), 2)).alias("speedup_multiple"),
    )
