"""Counters, totals, advice and the bounded report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import COUNTERS, MANIFEST_SCHEMA

# The published policy of the advice and of the report.
MIN_ELIGIBLE_FRAMES = 2
HISTORY_USE_RATIO_MAX = 0.05
OUTPUT_CHANGE_RATIO_MAX = 0.01
MOSTLY_INVALID_RATIO_MIN = 0.80
MOSTLY_REFRESHED_RATIO_MIN = 0.80
MAX_REPORTED_FRAMES = 96
CHECKPOINT_INTERVAL = 10

# The wording of the advice.
EMPTY_TARGET = "empty target matte"
CAUSES = {
    "target_only": "Target Only history source is selected",
    "invalid": "primary history is mostly out of bounds or invalid",
    "direction": "vector direction or convention may be wrong",
    "fallback": "Same Pixel History fallback is not selected",
    "refresh": "Refresh restores too much clean beauty",
    "unknown": "measured history use and output change are both very low",
}
LIKELY, NOTED = "Likely ineffective feedback: ", "Diagnostics: "

SUMMED = (
    "pixel_count", "target_matte_pixels", "effect_matte_pixels", "primary_history_attempts",
    "primary_history_valid_uses", "primary_history_invalid_samples", "same_pixel_fallback_attempts",
    "same_pixel_fallback_valid_uses", "current_beauty_fallback_pixels", "refresh_restored_pixels",
    "refresh_restored_blocks", "historical_blend_pixels", "changed_output_pixels",
)
FRAME = ("run_id", "seq", "frame_number")


def frame_diag(lines: DataFrame) -> DataFrame:
    """The counters of each frame from the partial counters of its lines."""
    keys = ("run_id", "seq", "frame")
    blocks = (
        lines.where(F.size("hit") > 0)
        .select(*keys, F.inline("hit"))
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("refresh_restored_blocks"))
    )
    sums = lines.groupBy(*keys).agg(
        F.min("reset").alias("reset"),
        *[F.sum(c).alias(c) for c in lines.columns if c.startswith(("n_", "s_"))],
        F.max("x_change").alias("x_change"),
    )
    n = F.col("n_pixels")
    return sums.join(blocks, list(keys), "left").select(
        "run_id", "seq", F.col("frame").alias("frame_number"), "reset",
        n.alias("pixel_count"),
        F.col("n_target").alias("target_matte_pixels"),
        (F.col("s_target") / n).alias("target_matte_coverage"),
        F.col("n_effect").alias("effect_matte_pixels"),
        (F.col("s_effect") / n).alias("effect_matte_coverage"),
        F.col("n_attempt").alias("primary_history_attempts"),
        F.col("n_valid").alias("primary_history_valid_uses"),
        (F.col("n_attempt") - F.col("n_valid")).alias("primary_history_invalid_samples"),
        F.col("n_own_attempt").alias("same_pixel_fallback_attempts"),
        F.col("n_own_valid").alias("same_pixel_fallback_valid_uses"),
        (F.col("n_attempt") - F.col("n_valid") - F.col("n_own_valid")).alias("current_beauty_fallback_pixels"),
        F.col("n_refresh").alias("refresh_restored_pixels"),
        F.coalesce(F.col("refresh_restored_blocks"), F.lit(0).cast("bigint")).alias("refresh_restored_blocks"),
        F.col("n_blend").alias("historical_blend_pixels"),
        F.col("s_blend").alias("historical_blend_weight"),
        F.col("n_changed").alias("changed_output_pixels"),
        (F.col("n_changed") / n).alias("changed_output_ratio"),
        (F.col("s_change") / n).alias("changed_output_mean_absolute"),
        F.col("x_change").alias("changed_output_max_absolute"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _weighted(name: str) -> Column:
    return F.sum(F.when(~F.col("reset"), F.col(name) * F.col("pixel_count")))


def run_totals(diag: DataFrame, keys: tuple[str, ...] = ("run_id", "seq")) -> DataFrame:
    """Sums and pixel-weighted means over the frames that did not reset."""
    kept = ~F.col("reset")
    sums = diag.groupBy(*keys).agg(
        F.count_if(F.col("reset")).alias("reset_frame_count"),
        F.count_if(kept).alias("eligible_frame_count"),
        *[F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0).cast("bigint")).alias(c) for c in SUMMED],
        F.coalesce(F.sum(F.when(kept, F.col("historical_blend_weight"))), F.lit(0.0)).alias("historical_blend_weight"),
        *[
            _weighted(c).alias(f"_{c}")
            for c in ("target_matte_coverage", "effect_matte_coverage", "changed_output_mean_absolute")
        ],
        F.coalesce(
            F.max(F.when(kept, F.col("changed_output_max_absolute"))), F.lit(0.0)
        ).alias("changed_output_max_absolute"),
    )
    pixels = F.col("pixel_count")
    return sums.withColumns(
        {
            "target_matte_coverage": _ratio(F.col("_target_matte_coverage"), pixels),
            "effect_matte_coverage": _ratio(F.col("_effect_matte_coverage"), pixels),
            "changed_output_mean_absolute": _ratio(F.col("_changed_output_mean_absolute"), pixels),
            "changed_output_ratio": _ratio(F.col("changed_output_pixels"), pixels),
        }
    ).drop("_target_matte_coverage", "_effect_matte_coverage", "_changed_output_mean_absolute")


def near_no_op(totals: DataFrame) -> DataFrame:
    """I4: add ``likely_near_no_op, causes, message``.

    ``totals`` carries the settings ``history_source`` and ``invalid_history_fallback``.
    """
    enough = F.col("eligible_frame_count") >= MIN_ELIGIBLE_FRAMES
    empty = F.col("target_matte_pixels") == 0
    attempts = F.col("primary_history_attempts")
    invalid = F.col("primary_history_invalid_samples")
    likely = (
        enough & ~empty
        & (_ratio(F.col("historical_blend_pixels"), attempts) <= HISTORY_USE_RATIO_MAX)
        & (F.col("changed_output_ratio") <= OUTPUT_CHANGE_RATIO_MAX)
    )
    mostly_invalid = _ratio(invalid, attempts) >= MOSTLY_INVALID_RATIO_MIN
    refreshed = _ratio(F.col("refresh_restored_pixels"), F.col("effect_matte_pixels"))
    found = F.filter(
        F.array(
            F.when(F.col("history_source") == "TARGET_ONLY", F.lit(CAUSES["target_only"])),
            F.when(mostly_invalid, F.lit(CAUSES["invalid"])),
            F.when(mostly_invalid, F.lit(CAUSES["direction"])),
            F.when(
                (invalid > 0) & (F.col("invalid_history_fallback") != "SAME_PIXEL_HISTORY"),
                F.lit(CAUSES["fallback"]),
            ),
            F.when(refreshed >= MOSTLY_REFRESHED_RATIO_MIN, F.lit(CAUSES["refresh"])),
        ),
        lambda c: c.isNotNull(),
    )
    none = F.array().cast("array<string>")
    causes = (
        F.when(likely, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(CAUSES["unknown"]))))
        .when(enough & empty, F.array(F.lit(EMPTY_TARGET)))
        .otherwise(none)
    )
    listed = totals.withColumns({"likely_near_no_op": likely, "causes": causes})
    joined = F.array_join("causes", "; ")
    return listed.withColumn(
        "message",
        F.when(F.col("likely_near_no_op"), F.concat(F.lit(LIKELY), joined))
        .when(F.size("causes") > 0, F.concat(F.lit(NOTED), joined)),
    )


def running_totals(diag: DataFrame) -> DataFrame:
    """The totals of I3 after each frame; one small row per frame in each window."""
    so_far = Window.partitionBy("run_id", "seq").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    kept = ~F.col("reset")
    named = ("pixel_count", "target_matte_pixels", "effect_matte_pixels", "primary_history_attempts",
             "primary_history_invalid_samples", "refresh_restored_pixels", "historical_blend_pixels",
             "changed_output_pixels")
    sums = {c: F.coalesce(F.sum(F.when(kept, F.col(c))).over(so_far), F.lit(0).cast("bigint")) for c in named}
    return diag.select(
        *FRAME, *[c for c in ("history_source", "invalid_history_fallback") if c in diag.columns],
        F.count_if(kept).over(so_far).alias("eligible_frame_count"),
        *[c.alias(n) for n, c in sums.items()],
    ).withColumn("changed_output_ratio", _ratio(F.col("changed_output_pixels"), F.col("pixel_count")))


def running_advice(diag: DataFrame) -> DataFrame:
    """The first frame at which the advice is actionable, once per run and sequence."""
    judged = near_no_op(running_totals(diag)).where("likely_near_no_op")
    return judged.groupBy("run_id", "seq").agg(
        F.min("frame_number").alias("frame_number"), F.min_by("message", "frame_number").alias("message")
    )


def checkpoint_rows(diag: DataFrame, interval: int = CHECKPOINT_INTERVAL) -> DataFrame:
    """Where a report is written: at the start, every tenth frame, the first advice, the end."""
    order = Window.partitionBy("run_id", "seq").orderBy("frame_number")
    numbered = diag.select("run_id", "seq", "frame_number").withColumns(
        {
            "completed": F.row_number().over(order),
            "_total": F.count(F.lit(1)).over(Window.partitionBy("run_id", "seq")),
        }
    )
    advised = running_advice(diag).select("run_id", "seq", "frame_number", F.lit(True).alias("_advised"))
    marked = numbered.join(advised, ["run_id", "seq", "frame_number"], "left")
    reason = (
        F.when(F.col("completed") == F.col("_total"), F.lit("terminal"))
        .when(F.col("completed") % interval == 0, F.lit("checkpoint"))
        .when(F.col("_advised"), F.lit("advice"))
    )
    later = marked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "run_id", "seq", "completed", "reason"
    )
    start = diag.select("run_id", "seq").distinct().select(
        "run_id", "seq", F.lit(0).alias("completed"), F.lit("start").alias("reason")
    )
    return start.unionByName(later)


def _prefix(frames: str) -> Column:
    return F.struct(
        F.size(frames).alias("count"),
        F.when(F.size(frames) > 0, F.element_at(frames, 1)).alias("start"),
        F.when(F.size(frames) > 0, F.element_at(frames, -1)).alias("end"),
    )


def report(
    diag: DataFrame, manifest: DataFrame, *, active: bool = False, interval: int = CHECKPOINT_INTERVAL,
) -> DataFrame:
    """One bounded report per run and sequence.

    ``manifest``: run_id, seq, frame_start, frame_end, completed, settings_fingerprint, outcome and the
    settings. Only the newest 96 frames are listed; the rest are counted as omitted.
    """
    newest = Window.partitionBy("run_id", "seq").orderBy(F.col("frame_number").desc())
    bounded = diag.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= MAX_REPORTED_FRAMES)
    listed = bounded.groupBy("run_id", "seq").agg(
        F.sort_array(F.collect_list(F.struct(*COUNTERS))).alias("frames")
    )
    spans = diag.groupBy("run_id", "seq").agg(
        F.count(F.lit(1)).alias("_count"), F.min("frame_number").alias("_start"), F.max("frame_number").alias("_end")
    )
    totals = run_totals(diag)
    base = (
        manifest.join(totals, ["run_id", "seq"], "left")
        .join(spans, ["run_id", "seq"], "left")
        .join(listed, ["run_id", "seq"], "left")
        .withColumn("_count", F.coalesce("_count", F.lit(0)))
    )
    same = (
        (F.size("completed") == F.col("_count"))
        & F.coalesce(F.element_at("completed", 1) == F.col("_start"), F.col("_count") == 0)
        & F.coalesce(F.element_at("completed", -1) == F.col("_end"), F.col("_count") == 0)
    )
    same = F.when(F.size("completed") == 0, F.col("_count") == 0).otherwise(same)
    lag = F.greatest(F.size("completed") - F.col("_count"), F.lit(0))
    ahead = F.lit(max(0, interval - 1) if active else 0)
    return base.select(
        "run_id", "seq",
        F.lit(1).alias("schema_version"),
        F.lit(MANIFEST_SCHEMA).alias("manifest_schema_version"),
        F.col("outcome").alias("terminal_outcome"),
        F.struct(F.col("frame_start").alias("start"), F.col("frame_end").alias("end")).alias("frame_range"),
        _prefix("completed").alias("completed_prefix"),
        F.struct(
            F.col("_count").alias("count"), F.col("_start").alias("start"), F.col("_end").alias("end")
        ).alias("diagnostics_completed_prefix"),
        F.when(same, F.lit("COMPLETE")).when(F.col("_count") == 0, F.lit("UNAVAILABLE"))
        .otherwise(F.lit("PARTIAL")).alias("diagnostics_availability"),
        F.lit(interval).alias("checkpoint_interval_frames"),
        F.lit(active).alias("active_report_may_lag_manifest"),
        F.when(lag > 0, F.lit(LAG_POLICY["gap_active" if active else "gap_terminal"]))
        .otherwise(F.lit(LAG_POLICY["active" if active else "terminal"])).alias("lag_policy"),
        lag.alias("diagnostics_lag"),
        (lag + ahead).alias("maximum_diagnostics_lag_while_active"),
        ahead.alias("maximum_manifest_observation_lag_while_active"),
        "settings_fingerprint", "history_source",
        F.coalesce("reset_frame_count", F.lit(0)).alias("reset_frame_count"),
        F.coalesce("eligible_frame_count", F.lit(0)).alias("eligible_frame_count"),
        F.struct(*[F.col(c) for c in (*SUMMED, "changed_output_ratio", "changed_output_max_absolute")]).alias("totals"),
        F.coalesce("frames", F.array().cast(listed.schema["frames"].dataType)).alias("frames"),
        (F.col("_count") - F.coalesce(F.size("frames"), F.lit(0))).alias("frame_diagnostics_omitted"),
    )


# The names of the lag policies in the report.
LAG_POLICY = {
    "gap_active": "active_report_may_checkpoint_lag_manifest_and_prior_resume_diagnostics_are_unavailable",
    "gap_terminal": (
        "terminal_report_contains_all_in_memory_diagnostics_but_prior_resume_diagnostics_are_unavailable"
    ),
    "active": "active_report_may_lag_by_up_to_checkpoint_interval_minus_one_frames",
    "terminal": "terminal_report_does_not_lag_manifest",
}


def report_agreement(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """I8: whether each report names the fingerprint, source and prefix its manifest holds."""
    theirs = manifest.select(
        "run_id", "seq", F.col("settings_fingerprint").alias("_f"), F.col("history_source").alias("_h"),
        F.size("completed").alias("_n"),
    )
    joined = reports.join(theirs, ["run_id", "seq"])
    return joined.select(
        "run_id", "seq",
        F.col("settings_fingerprint").eqNullSafe(F.col("_f")).alias("fingerprint_agrees"),
        F.col("history_source").eqNullSafe(F.col("_h")).alias("source_agrees"),
        F.col("completed_prefix.count").eqNullSafe(F.col("_n")).alias("prefix_agrees"),
    )


def short_number(value: Column) -> Column:
    """A double with up to six significant digits, no trailing zeros, exponent form at the extremes."""
    value = value.cast("double")
    size = F.abs(value)
    exponent = F.format_string("%.5e", value)
    text = F.regexp_replace(F.regexp_replace(exponent, "0+e", "e"), "\\.e", "e")
    for power in range(-4, 6):
        fixed = F.format_string(f"%.{5 - power}f", value)
        plain = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", "") if power < 5 else fixed
        low, high = float(f"9.999995e{power - 1}"), float(f"9.999995e{power}")
        text = F.when((size >= low) & (size < high), plain).otherwise(text)
    return F.when(size == 0, F.lit("0")).otherwise(text)


def config_summary(runs: DataFrame) -> DataFrame:
    """The one-line description of a run."""
    source = F.when(F.col("history_source") == "FULL_FRAME", "Full Frame").otherwise("Target Only")
    mode = F.when(F.col("mode") == "TRAIL", "Trail").otherwise("Hard Localized")
    return runs.select(
        "run_id",
        F.concat(
            source, F.lit(" / "), mode,
            F.lit(" | Persistence "), short_number(F.col("persistence")),
            F.lit(" | Block "), F.col("block_size").cast("string"),
            F.lit(" | Diffusion "), short_number(F.col("diffusion")),
            F.lit(" | Refresh "), short_number(F.col("refresh_probability")),
        ).alias("summary"),
    )


def terminal_outcome(steps: DataFrame) -> DataFrame:
    """How each run stands, from its step log (run_id, ord, status, failure)."""
    last = steps.groupBy("run_id").agg(
        F.max_by("status", "ord").alias("_status"), F.max_by("failure", "ord").alias("_failure"),
        F.count_if(F.col("status") == "DONE").alias("completed_frames"),
    )
    outcome = (
        F.when(F.col("_status") == "END", F.lit("SUCCESS"))
        .when(F.col("_status") == "CANCEL", F.lit("CANCELLED"))
        .when(F.col("_status") == "ERROR", F.lit("FAILURE"))
        .otherwise(F.lit("RUNNING"))
    )
    return last.select(
        "run_id", outcome.alias("outcome"), "completed_frames",
        F.when(outcome == "FAILURE", F.col("_failure")).alias("failure"),
    )
