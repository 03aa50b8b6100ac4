"""Schemas, run settings and presets shared by every module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The setting names, their types and their defaults.
SETTINGS: dict[str, tuple[str, object]] = {
    "mode": ("string", "HARD_LOCALIZED"),
    "history_source": ("string", "TARGET_ONLY"),
    "invalid_history_fallback": ("string", "CURRENT_BEAUTY"),
    "trail_decay": ("double", 0.85),
    "trail_motion_mix": ("double", 1.0),
    "persistence": ("double", 0.85),
    "block_size": ("int", 16),
    "motion_channels": ("string", "RG"),
    "reverse_motion": ("boolean", False),
    "flip_x": ("boolean", False),
    "flip_y": ("boolean", False),
    "motion_gain": ("double", 1.0),
    "motion_clamp": ("double", 64.0),
    "motion_quantization": ("double", 1.0),
    "diffusion": ("double", 0.0),
    "refresh_probability": ("double", 0.0),
    "seed": ("bigint", 0),
    "matte_source": ("string", "OBJECT_INDEX"),
}
SETTING_NAMES = tuple(SETTINGS)

# The allowed words of each enumerated setting.
ENUMS = {
    "mode": ("HARD_LOCALIZED", "TRAIL"),
    "history_source": ("TARGET_ONLY", "FULL_FRAME"),
    "invalid_history_fallback": ("CURRENT_BEAUTY", "SAME_PIXEL_HISTORY"),
    "motion_channels": ("RG", "BA"),
    "matte_source": ("OBJECT_INDEX", "EXTERNAL", "CRYPTOMATTE"),
}

# The preset that lets feedback spread over the whole frame.
EXTREME = {
    "mode": "TRAIL",
    "history_source": "FULL_FRAME",
    "invalid_history_fallback": "SAME_PIXEL_HISTORY",
    "persistence": 1.0,
    "trail_decay": 0.995,
    "trail_motion_mix": 0.1,
    "refresh_probability": 0.0,
    "block_size": 32,
    "motion_quantization": 8.0,
    "diffusion": 6.0,
}

# The per-frame counters, in report order.
COUNTERS = (
    "frame_number", "reset", "pixel_count",
    "target_matte_pixels", "target_matte_coverage",
    "effect_matte_pixels", "effect_matte_coverage",
    "primary_history_attempts", "primary_history_valid_uses",
    "primary_history_invalid_samples",
    "same_pixel_fallback_attempts", "same_pixel_fallback_valid_uses",
    "current_beauty_fallback_pixels",
    "refresh_restored_pixels", "refresh_restored_blocks",
    "historical_blend_pixels", "historical_blend_weight",
    "changed_output_pixels", "changed_output_ratio",
    "changed_output_mean_absolute", "changed_output_max_absolute",
)

# Pass names, the marker of the orientation, the manifest's schema number, the limits of single precision.
PASSES = ("beauty", "vector", "matte")
IMAGE_ORIENTATION = "display_top_left_v1"
MANIFEST_SCHEMA = 5
FLOAT_MAX = 3.4028234663852886e38
FLOAT_TINY = 1.401298464324817e-45

PX_SCHEMA = T.StructType(
    [T.StructField("seq", T.StringType(), False)]
    + [T.StructField(c, T.IntegerType(), False) for c in ("frame", "y", "x")]
    + [T.StructField(c, T.FloatType()) for c in ("r", "g", "b", "a", "vr", "vg", "vb", "va", "m")]
)


def f32(value: float | Column) -> Column:
    """A single-precision literal or cast, so float arithmetic stays in float."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def run_row(run_id: str, **overrides: object) -> dict[str, object]:
    """Default settings overlaid with ``overrides``."""
    unknown = set(overrides) - set(SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return {"run_id": run_id, **{k: d for k, (_, d) in SETTINGS.items()}, **overrides}


def run_struct(row: dict[str, object]) -> Column:
    """One run as a struct literal."""
    return F.struct(
        F.lit(row["run_id"]).alias("run_id"),
        *[F.lit(row[k]).cast(t).alias(k) for k, (t, _) in SETTINGS.items()],
    )


def runs_frame(spark: SparkSession, rows: list[dict[str, object]]) -> DataFrame:
    """Run settings as a table."""
    return spark.range(1).select(F.inline(F.array(*[run_struct(r) for r in rows])))


def typed_runs(runs: DataFrame) -> DataFrame:
    """A table of runs with every setting in its type; settings it lacks take their defaults."""
    return runs.select(
        F.col("run_id").cast("string").alias("run_id"),
        *[(F.col(n) if n in runs.columns else F.lit(d)).cast(t).alias(n) for n, (t, d) in SETTINGS.items()],
    )


def assign_runs(px: DataFrame, runs: list[dict[str, object]] | DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """The jobs table: one row per (run, sequence) with the settings of the run.

    ``assignments`` (run_id, seq, and any other columns, which are kept) names the pairs; without it every run handles every
    sequence of ``px``, and the product of the two is the list of the work to be done.
    """
    if not isinstance(runs, DataFrame):
        runs = runs_frame(px.sparkSession, runs)
    runs = typed_runs(runs)
    seqs = px.select("seq").distinct()
    if assignments is None:
        return seqs.crossJoin(runs).select("seq", *runs.columns)
    return assignments.join(seqs, "seq", "left_semi").join(runs, "run_id")
