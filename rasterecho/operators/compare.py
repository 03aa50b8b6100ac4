"""Comparing runs (H6, H7, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_digest(px: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("seq", "frame")) -> DataFrame:
    """H6: a content digest per frame over its size and row-major values.

    Values enter as whole millionths. Rows are digested first and frames from their rows, so a task never
    holds more than one raster row of values.
    """
    whole = [F.rint(F.col(c).cast("double") * F.lit(1e6)).cast("bigint").cast("string") for c in columns]
    rows = px.select(*keys, "y", "x", F.concat_ws(",", *whole).alias("_v")).groupBy(*keys, "y").agg(
        F.sort_array(F.collect_list(F.struct("x", "_v"))).alias("_row")
    ).select(*keys, "y", F.size("_row").alias("_w"), F.sha2(F.concat_ws(";", F.col("_row._v")), 256).alias("_d"))
    framed = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("y", "_d"))).alias("_rows"), F.max("_w").alias("_w")
    )
    size = F.concat_ws("x", F.size("_rows").cast("string"), F.col("_w").cast("string"))
    return framed.select(
        *keys, F.sha2(F.concat_ws("\n", F.lit("float32"), size, F.array_join("_rows._d", "\n")), 256).alias("digest")
    )


def run_equality(
    a: DataFrame, b: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("seq", "frame"), *, lines: bool = False,
) -> DataFrame:
    """H7: per frame, whether two runs agree exactly, and by how much they differ if not.

    ``a`` and ``b`` have a row for each pixel, or with ``lines`` one for each raster row with an array per column: then lines meet and
    are unfolded where they met, so no pixel is moved.
    """
    if lines:
        both = _lines_met(a, b, columns, keys)
    else:
        pixel = [*keys, "y", "x"]
        left = a.select(*pixel, F.struct(*columns).alias("_a"))
        right = b.select(*pixel, F.struct(*columns).alias("_b"))
        both = left.join(right, pixel, "full_outer")
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    error = F.greatest(*[F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) for c in columns])
    return both.groupBy(*keys).agg(
        (F.count_if(differs) == 0).alias("bit_equal"),
        F.count_if(differs).alias("differing_pixels"),
        F.max(error).cast("double").alias("maximum_absolute_error"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched_pixels"),
    )


def _lines_met(a: DataFrame, b: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """The pixels of both sides from lines that meet; a place that a side lacks has null there."""
    line = [*keys, "y"]
    left, right = (df.select(*line, F.arrays_zip(*columns).alias(n)) for df, n in ((a, "_a"), (b, "_b")))
    # Merged, as lines are many times larger than their files, by which Spark would send a side whole to the driver.
    met = left.join(right.hint("merge"), line, "full_outer")
    none = F.array().cast(left.schema["_a"].dataType)
    return met.select(*keys, F.inline(F.arrays_zip(F.coalesce("_a", none).alias("_a"), F.coalesce("_b", none).alias("_b"))))


def sweep_compare(totals: DataFrame) -> DataFrame:
    """K3: the runs of each sequence ranked by how much they change and how much history they use."""
    used = F.when(
        F.col("primary_history_attempts") > 0, F.col("historical_blend_pixels") / F.col("primary_history_attempts")
    ).otherwise(F.lit(0.0))
    scored = totals.withColumn("history_use_ratio", used)
    by_change = Window.partitionBy("seq").orderBy(F.col("changed_output_ratio").desc(), "run_id")
    by_use = Window.partitionBy("seq").orderBy(F.col("history_use_ratio").desc(), "run_id")
    return scored.select(
        "seq", "run_id", "changed_output_ratio", "history_use_ratio",
        F.row_number().over(by_change).alias("change_rank"), F.row_number().over(by_use).alias("use_rank"),
    )
