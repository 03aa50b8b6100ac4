"""Checking vector conventions against observed motion, and building sweeps (K1, K2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SETTINGS


def vector_calibration(px: DataFrame) -> DataFrame:
    """K1: per frame, the mean vectors inside the matte against how far the matte centroid moved.

    Tells which channel pair is populated, whether each axis needs a flip and the gain that would fit.
    """
    weight = F.col("m").cast("double")
    sums = px.groupBy("seq", "frame").agg(
        F.sum(weight).alias("_w"),
        F.sum(weight * F.col("x")).alias("_x"), F.sum(weight * F.col("y")).alias("_y"),
        *[F.sum(weight * F.col(c).cast("double")).alias(f"_{c}") for c in ("vr", "vg", "vb", "va")],
        F.count_if((F.col("m") > 0) & ((F.col("vr") != 0) | (F.col("vg") != 0))).alias("rg_pixels"),
        F.count_if((F.col("m") > 0) & ((F.col("vb") != 0) | (F.col("va") != 0))).alias("ba_pixels"),
    )

    def mean(name: str) -> Column:
        return F.when(F.col("_w") > 0, F.col(name) / F.col("_w"))

    order = Window.partitionBy("seq").orderBy("frame")
    means = sums.select(
        "seq", "frame", "rg_pixels", "ba_pixels", mean("_x").alias("cx"), mean("_y").alias("cy"),
        *[mean(f"_{c}").alias(f"mean_{c}") for c in ("vr", "vg", "vb", "va")],
    ).withColumns(
        {"moved_x": F.col("cx") - F.lag("cx").over(order), "moved_y": F.col("cy") - F.lag("cy").over(order)}
    )
    rg = F.col("rg_pixels") >= F.col("ba_pixels")
    chosen = means.withColumns(
        {
            "channels": F.when(rg, F.lit("RG")).otherwise(F.lit("BA")),
            "mean_x": F.when(rg, F.col("mean_vr")).otherwise(F.col("mean_vb")),
            "mean_y": F.when(rg, F.col("mean_vg")).otherwise(F.col("mean_va")),
        }
    )
    length = F.sqrt(F.col("mean_x") ** 2 + F.col("mean_y") ** 2)
    moved = F.sqrt(F.col("moved_x") ** 2 + F.col("moved_y") ** 2)
    return chosen.select(
        "seq", "frame", "channels", "rg_pixels", "ba_pixels",
        *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "moved_x", "moved_y")],
        (F.signum("mean_x") * F.signum("moved_x") < 0).alias("flip_x"),
        (F.signum("mean_y") * F.signum("moved_y") < 0).alias("flip_y"),
        F.round(F.when(length > 0, moved / length), 6).alias("implied_gain"),
    )


def preset_runs(bases: DataFrame, overrides: DataFrame) -> DataFrame:
    """K2: base rows overlaid with override rows that share ``preset``.

    ``overrides`` holds preset, variant and any settings; a null keeps the base value.
    """
    given = [c for c in overrides.columns if c in SETTINGS]
    renamed = overrides.select("preset", "variant", *[F.col(c).alias(f"_{c}") for c in given])
    return bases.join(renamed, "preset").select(
        F.concat_ws("/", "run_id", "variant").alias("run_id"),
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in SETTINGS],
    )


def sweep(bases: DataFrame, **values: list[object]) -> DataFrame:
    """Every combination of the given setting values over each base row."""
    out = bases
    for name, options in values.items():
        kind = SETTINGS[name][0]
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in options]))).withColumn(
            "run_id", F.concat_ws("/", "run_id", F.concat(F.lit(f"{name}="), F.col(name).cast("string")))
        )
    return out
