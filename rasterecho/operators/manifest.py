"""Provenance: effective settings, fingerprints, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import IMAGE_ORIENTATION, MANIFEST_SCHEMA, SETTINGS


def canonical_value(name: str) -> Column:
    """A setting as text that does not depend on how an engine prints doubles.

    Numbers become whole billionths, so equal settings have equal text.
    """
    kind, column = SETTINGS[name][0], F.col(name)
    if kind == "double":
        return F.rint(column * F.lit(1e9)).cast("bigint").cast("string")
    if kind == "boolean":
        return F.when(column, F.lit("true")).otherwise(F.lit("false"))
    return column.cast("string")


def effective_settings(runs: DataFrame) -> DataFrame:
    """G1: every setting plus resets, size policy and versions, as one map per run."""
    optional = {
        "matte_provider": F.lit("object_index"),
        "reset_frames": F.lit(""),
        "resolution_change": F.lit("ERROR"),
        "extension_version": F.lit("unavailable"),
        "host_version": F.lit("unavailable"),
    }
    pairs = [F.struct(F.lit(n).alias("key"), canonical_value(n).alias("value")) for n in SETTINGS]
    for name, default in optional.items():
        value = F.coalesce(F.nullif(F.col(name), F.lit("")), default) if name in runs.columns else default
        pairs.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return runs.select("run_id", F.map_from_entries(F.array(*pairs)).alias("effective_settings"))


def fingerprint(runs: DataFrame) -> DataFrame:
    """SHA-256 over the sorted ``key=value`` text of the settings that change results."""
    parts = [F.concat(F.lit(f"{n}="), canonical_value(n)) for n in sorted(SETTINGS)]
    return runs.select("run_id", F.sha2(F.concat_ws("\n", *parts), 256).alias("settings_fingerprint"))


def manifest_commit(lines: DataFrame, waves_written: DataFrame) -> DataFrame:
    """The committed frames of each run and sequence.

    ``lines`` are the rows of every written wave; ``waves_written`` (wave) lists the waves whose write
    finished. A frame counts only when its wave did.
    """
    frames = lines.join(waves_written, "wave", "left_semi").groupBy("run_id", "seq", "frame").agg(
        F.count(F.lit(1)).alias("_lines")
    )
    return frames.groupBy("run_id", "seq").agg(
        F.sort_array(F.collect_list("frame")).alias("completed"),
        F.min("frame").alias("frame_start"), F.max("frame").alias("last_frame"),
    )


def new_manifest(
    runs: DataFrame, spans: DataFrame, completed: DataFrame, resets: Column, policy: str = "ERROR"
) -> DataFrame:
    """One manifest row per run and sequence; ``spans``: seq, frame_start, frame_end."""
    settled = effective_settings(runs).join(fingerprint(runs), "run_id").join(
        runs.select("run_id", "history_source"), "run_id"
    )
    return completed.join(settled, "run_id").join(spans, "seq").select(
        "run_id", "seq",
        F.lit(MANIFEST_SCHEMA).alias("schema_version"), F.lit(IMAGE_ORIENTATION).alias("image_orientation"),
        "frame_start", "frame_end", "history_source", "settings_fingerprint", "effective_settings",
        resets.alias("reset_frames"), F.lit(policy).alias("resolution_change"), "completed",
    )


# Manifest fields that must agree before a run may resume, in the order they are checked.
COMPARED = (
    "schema_version", "image_orientation", "frame_start", "frame_end", "history_source",
    "settings_fingerprint", "reset_frames", "resolution_change",
)


def manifest_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("run_id", "seq")) -> DataFrame:
    """Why an old manifest cannot serve a new run: every differing field and setting, and a first reason."""
    renamed = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*COMPARED, "effective_settings", "completed")])
    joined = new.join(renamed, list(keys))
    fields = F.filter(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in COMPARED]), lambda c: c.isNotNull()
    )
    theirs = F.col("_effective_settings")
    differing = F.filter(
        F.array_sort(F.map_keys("effective_settings")),
        lambda k: ~F.try_element_at(theirs, k).eqNullSafe(F.try_element_at("effective_settings", k)),
    )
    # Versions are recorded but any non-empty value is accepted.
    differing = F.filter(differing, lambda k: ~k.isin("extension_version", "host_version"))
    names_changed = ~F.array_sort(F.map_keys(theirs)).eqNullSafe(F.array_sort(F.map_keys("effective_settings")))
    source = F.try_element_at(theirs, F.lit("history_source"))
    reason = (
        F.when(F.col("_schema_version") == 2, F.lit("schema 2 cannot prove the complete effective settings"))
        .when(F.size("fields") > 0, F.concat(F.element_at("fields", 1), F.lit(" changed")))
        .when(theirs.isNull(), F.lit("effective_settings is missing or invalid"))
        .when(~source.eqNullSafe(F.col("_history_source")), F.lit("history_source disagrees with effective_settings"))
        .when(F.col("names_changed"), F.lit("effective_settings fields changed"))
        .when(F.size("settings") > 0, F.concat(F.lit("effective_settings."), F.element_at("settings", 1), F.lit(" changed")))
    )
    listed = joined.withColumns({"fields": fields, "settings": differing, "names_changed": names_changed})
    return listed.withColumn("reason", reason).select(
        *keys, "fields", "settings", "reason", F.col("reason").isNull().alias("compatible")
    )


def manifest_prefix(manifests: DataFrame, keys: tuple[str, ...] = ("run_id", "seq")) -> DataFrame:
    """Whether ``completed`` counts up from the first frame and stays inside the range."""
    n = F.size("completed")
    expected = F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.col("frame_start"), F.col("frame_start") + n - 1)
    )
    continuous = F.col("completed") == expected
    inside = F.when(n == 0, F.lit(True)).otherwise(F.element_at("completed", -1) <= F.col("frame_end"))
    reason = (
        F.when(F.exists("completed", lambda f: f.isNull()), F.lit("invalid completed frames"))
        .when(~continuous, F.lit("discontinuous completed frames"))
        .when(~inside, F.lit("completed frames outside the range"))
    )
    return manifests.select(*keys, n.alias("n_completed"), reason.alias("reason"))


def trusted_output(outputs: DataFrame, manifests: DataFrame, keys: tuple[str, ...] = ("run_id", "seq")) -> DataFrame:
    """Outputs whose frame the manifest lists; older files past the prefix stay pending."""
    listed = manifests.select(*keys, F.explode("completed").alias("frame"))
    return outputs.join(listed, [*keys, "frame"], "left_semi")
