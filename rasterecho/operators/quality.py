"""Input checks (B1-B8). Findings are rows, so one bad sequence never stops the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ENUMS, PASSES


def missing_inputs(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """B1: expected (seq, frame, pass, path) without a file, with the message to show."""
    absent = expected.join(catalog, ["seq", "frame", "pass"], "left_anti")
    return absent.select(
        "seq", "frame", "pass",
        F.format_string("Missing %s input for frame %d: %s", "pass", "frame", "path").alias("message"),
    )


def complete_prefix(catalog: DataFrame, start: int = 1) -> DataFrame:
    """B2: frames from ``start`` on in which all passes exist without a gap; what follows is stray."""
    per_frame = catalog.groupBy("seq", "frame").agg(F.count_distinct("pass").alias("passes"))
    order = Window.partitionBy("seq").orderBy("frame")
    # A frame belongs to the prefix while it is complete, and so is every frame before it.
    fit = (F.col("passes") == len(PASSES)) & (F.col("frame") == F.row_number().over(order) + start - 1)
    marked = per_frame.withColumn("_fit", fit).withColumn(
        "_in", F.min("_fit").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return marked.groupBy("seq").agg(
        F.count_if("_in").alias("prefix_length"), F.min(F.when(~F.col("_in"), F.col("frame"))).alias("stray_frame")
    )


def processed_prefix(outputs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether outputs (seq, frame) form a strictly partial prefix equal to the manifest's.

    ``manifests``: seq, frame_start, frame_end, completed.
    """
    kept = outputs.groupBy("seq").agg(
        F.count_distinct("frame").alias("n"), F.min("frame").alias("low"), F.max("frame").alias("high")
    )
    joined = manifests.join(kept, "seq", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    contiguous = (F.col("low") == F.col("frame_start")) & (F.col("high") - F.col("low") + 1 == F.col("n"))
    partial = F.col("high") < F.col("frame_end")
    matches = (F.size("completed") == F.col("n")) & (F.element_at("completed", -1) == F.col("high"))
    matches = F.when(F.size("completed") == 0, F.col("n") == 0).otherwise(matches)
    flags = {"contiguous": contiguous, "partial": partial, "matches": matches}
    return joined.select(
        "seq", "n", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()],
    )


def _bad(*columns: str) -> Column:
    flags = F.lit(False)
    for c in columns:
        value = F.col(c)
        flags = flags | F.isnan(value) | (F.abs(value) == float("inf"))
    return flags


def _frame_counts() -> dict[str, Column]:
    """What has to be counted over the pixels of a frame to judge it."""
    return {
        "beauty_bad": F.count_if(_bad("r", "g", "b", "a")),
        "motion_bad": F.count_if(_bad("vr", "vg", "vb", "va")),
        "matte_bad": F.count_if(_bad("m")),
        "n_beauty": F.count("r"), "n_motion": F.count("vr"), "n_matte": F.count("m"),
        "matte_out": F.count_if(~F.isnan("m") & ((F.col("m") < 0) | (F.col("m") > 1))),
        "area": (F.max("y") + 1) * (F.max("x") + 1),
    }


def _frame_violations() -> Column:
    return F.filter(
        F.array(
            F.when(F.col("beauty_bad") > 0, F.lit("beauty must contain only finite values")),
            F.when(F.col("motion_bad") > 0, F.lit("motion must contain only finite values")),
            F.when(F.col("matte_bad") > 0, F.lit("matte must contain only finite values")),
            F.when(F.col("n_beauty") < F.col("area"), F.lit("beauty must cover the whole frame")),
            F.when(F.col("n_motion") != F.col("n_beauty"), F.lit("motion must match beauty shape")),
            F.when(F.col("n_matte") != F.col("n_beauty"), F.lit("matte must match beauty shape")),
            F.when(F.col("matte_out") > 0, F.lit("matte coverage must be between 0 and 1")),
        ),
        lambda v: v.isNotNull(),
    )


def frame_quality(px: DataFrame) -> DataFrame:
    """The violations of each frame; a pass without pixels at some place has another shape."""
    stats = px.groupBy("seq", "frame").agg(*[c.alias(n) for n, c in _frame_counts().items()])
    return stats.select("seq", "frame", _frame_violations().alias("violations")).where(F.size("violations") > 0)


def checked_dims(px: DataFrame) -> DataFrame:
    """``frame_dims`` plus ``input_error``: the first violation of the frame, from the same pass over the pixels.

    Pixels are counted per line, as totals of a frame cannot tell a hole beside a repeated pixel: each of ``h`` lines must hold
    ``w`` different places from 0 to ``w - 1``, once each. A bit stands for a place, 64 to a word, so all of it is counted in numbers
    and no line is collected or sorted.
    """
    counts = {n: c for n, c in _frame_counts().items() if n != "area"}
    words = px.groupBy("seq", "frame", "y", F.shiftright("x", 6).alias("_word")).agg(
        F.min("x").alias("_low"), F.max("x").alias("_high"), F.count("*").alias("_n"),
        F.bit_or(F.expr("shiftleft(1L, x & 63)")).alias("_bits"), F.max("m").alias("_m"), *[c.alias(n) for n, c in counts.items()],
    )
    lines = words.groupBy("seq", "frame", "y").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_n").alias("_n"), F.sum(F.bit_count("_bits")).alias("_places"),
        F.max("_m").alias("_m"), *[F.sum(n).alias(n) for n in counts],
    )
    stats = lines.groupBy("seq", "frame").agg(
        (F.max("y") + 1).alias("h"), (F.max("_high") + 1).alias("w"), (F.max("_m") > 0).alias("has_matte"),
        (F.min(F.least("y", "_low")) < 0).alias("outside"), F.count("*").alias("_lines"),
        F.bool_and(F.col("_n") == F.col("_places")).alias("_once"), F.min("_places").alias("_least"),
        ((F.max("y") + 1) * (F.max("_high") + 1)).alias("area"), *[F.sum(n).alias(n) for n in counts],
    )
    whole = F.col("_once") & (F.col("_least") == F.col("w")) & (F.col("_lines") == F.col("h"))
    misplaced = F.when(F.col("outside") | ~F.coalesce(whole, F.lit(False)), F.lit("each pixel must be given once"))
    error = F.coalesce(F.get(_frame_violations(), F.lit(0)), misplaced)
    return stats.select("seq", "frame", "h", "w", F.coalesce("has_matte", F.lit(False)).alias("has_matte"), error.alias("input_error"))


def history_quality(state: DataFrame, keys: tuple[str, ...] = ("run_id", "seq", "frame"), more: tuple[Column, ...] = ()) -> DataFrame:
    """Per frame, whether stored history (r g b a, cov) may seed another frame; ``more`` is aggregated with it."""
    cover = F.col("cov")
    legal = ~F.isnan(cover) & (cover >= 0) & (cover <= 1)
    return state.groupBy(*keys).agg(
        F.bool_and(~_bad("r", "g", "b", "a")).alias("color_ok"), F.bool_and(legal).alias("coverage_ok"), *more
    )


def lines_usable() -> Column:
    """B5 on packed lines (r g b a, k): whether this line may seed another frame."""
    finite = F.lit(True)
    for c in ("r", "g", "b", "a"):
        finite = finite & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    legal = F.forall("k", lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0, 1))
    return F.coalesce(finite & legal & (F.size("k") == F.col("w")), F.lit(False))


# The numeric settings and their allowed ranges (None = unbounded).
RANGES = {
    "trail_decay": (0.0, 1.0), "trail_motion_mix": (0.0, 1.0), "persistence": (0.0, 1.0),
    "block_size": (1, None), "motion_gain": (0.0, None), "motion_clamp": (0.0, None),
    "motion_quantization": (0.0, None), "diffusion": (0.0, None), "refresh_probability": (0.0, 1.0),
}


def _range_reason(name: str, low, high) -> Column:
    value = F.col(name).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    if high is not None:
        text, outside = f"{name} must be between 0 and 1", (value < low) | (value > high)
    elif low == 1:
        text, outside = f"{name} must be at least 1", value < low
    else:
        text, outside = f"{name} must not be negative", value < low
    return F.when(~finite, F.lit(f"{name} must be finite")).when(outside, F.lit(text))


def setting_reasons() -> list[Column]:
    """One column per rule on the settings of a run: the reason where it is broken, else null."""
    reasons = [_range_reason(n, *r) for n, r in RANGES.items()]
    reasons += [
        F.when(~F.coalesce(F.col(n).isin(*words), F.lit(False)), F.lit(f"{n} must be one of {', '.join(words)}"))
        for n, words in ENUMS.items()
    ]
    return reasons


def settings_check(runs: DataFrame) -> DataFrame:
    """The reasons each run row is invalid, empty when it is fine.

    Optional columns ``matte_prefix, matte_extension, matte_padding`` are checked too.
    """
    reasons = setting_reasons()
    for name in ("matte_prefix", "matte_extension"):
        if name in runs.columns:
            value, word = F.col(name), name.removeprefix("matte_")
            unsafe = value.rlike(r"[/\\]") | value.rlike(r"^[A-Za-z]:") | value.isin(".", "..")
            reasons.append(F.when(unsafe, F.lit(f"{word} must be a single filename component")))
    if "matte_extension" in runs.columns:
        reasons.append(F.when(~F.col("matte_extension").startswith("."), F.lit("extension must start with a dot")))
    if "matte_padding" in runs.columns:
        reasons.append(F.when(F.col("matte_padding") < 1, F.lit("padding must be at least one")))
    return runs.select("run_id", F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("violations"))


def range_check(requests: DataFrame, supplied: DataFrame) -> DataFrame:
    """Whether the supplied frames (seq, ord, frame) are exactly the configured range, in order.

    Sorted neighbours are compared, so no frame list is gathered: the range is right when it starts and
    ends as configured and every frame follows its predecessor by one.
    """
    order = Window.partitionBy("seq").orderBy("ord")
    stepped = supplied.withColumn("_step", F.col("frame") - F.lag("frame").over(order))
    spans = stepped.groupBy("seq").agg(
        F.min_by("frame", "ord").alias("first"), F.max_by("frame", "ord").alias("last"),
        F.coalesce(F.bool_and(F.col("_step") == 1), F.lit(True)).alias("_even"),
    )
    joined = requests.join(spans, "seq", "left")
    valid = F.col("frame_start") <= F.col("frame_end")
    exact = valid & (F.col("first") == F.col("frame_start")) & (F.col("last") == F.col("frame_end")) & F.col("_even")
    return joined.select("seq", valid.alias("range_ok"), F.coalesce(exact, F.lit(False)).alias("frames_ok"))
