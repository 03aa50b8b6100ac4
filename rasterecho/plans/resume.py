"""Finding where a run may continue and rebuilding its state.

``resume_job`` is the whole of it: it meets manifests, stored images and stored states, picks the least replay for each pair of
run and sequence, rebuilds their state and continues all pairs in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import assign_runs
from ..operators.quality import history_quality
from ..operators.step import pack_lines, tasks_for
from .scan import ScanResult, feedback_scan, plan_frames
from .workspace import stored

PAIR = ["run_id", "seq"]


def resume_point(manifests: DataFrame, outputs: DataFrame, policy: str = "ERROR") -> DataFrame:
    """per run and sequence the usable prefix and the frame to restart at.

    ``manifests``: run_id, seq, frame_start, frame_end, completed; ``outputs``: run_id, seq, frame of
    the processed images that exist. A recorded frame without its image ends the prefix: under RESET
    the run restarts there with a clean frame, under ERROR it does not continue.
    """
    keys = ["run_id", "seq"]
    listed = manifests.select(*keys, F.explode("completed").alias("frame"))
    lost = listed.join(outputs, [*keys, "frame"], "left_anti").groupBy(*keys).agg(F.min("frame").alias("missing_frame"))
    joined = manifests.join(lost, keys, "left")
    missing = F.col("missing_frame")
    usable = F.when(missing.isNull(), F.size("completed")).otherwise(missing - F.col("frame_start"))
    restart = F.col("frame_start") + usable
    return joined.select(
        *keys, "missing_frame", usable.alias("prefix_length"), restart.alias("restart_frame"),
        F.when(missing.isNotNull(), missing).alias("recovery_reset_frame"),
        F.when(missing.isNotNull() & F.lit(policy == "ERROR"),
               F.format_string("Resume history is missing for frame %d", "missing_frame")).alias("error"),
        (restart > F.col("frame_end")).alias("finished"),
    )


def rollback(completed: DataFrame, invalid: DataFrame) -> DataFrame:
    """drop each run's frames from its first invalid one on; that frame restarts clean.

    ``completed`` and ``invalid``: run_id, seq, frame.
    """
    keys = ["run_id", "seq"]
    cut = invalid.groupBy(*keys).agg(F.min("frame").alias("recovery_reset_frame"))
    joined = completed.join(cut, keys, "left")
    kept = joined.where(F.col("recovery_reset_frame").isNull() | (F.col("frame") < F.col("recovery_reset_frame")))
    return kept.select(*keys, "frame", "recovery_reset_frame")


def resume_hard(processed: DataFrame, px: DataFrame, last: DataFrame) -> DataFrame:
    """stored color with the raw matte as coverage, as lines.

    ``processed``: run_id, seq, frame, y, x, r g b a; ``last``: run_id, seq, frame of the newest kept frame.
    """
    newest = processed.join(last, ["run_id", "seq", "frame"], "left_semi")
    matte = px.join(last.select("seq", "frame").distinct(), ["seq", "frame"], "left_semi").withColumn("_at", F.col("x"))
    return _lines(newest, pack_lines(matte, ("_at", "m"), ("seq", "frame"), tasks=tasks_for(newest.count())).withColumnRenamed("m", "k"))


def resume_trail(
    processed: DataFrame, px: DataFrame, last: DataFrame, runs: DataFrame | list[dict[str, object]],
    resets: DataFrame | None = None, *, states: DataFrame | None = None, policy: str = "ERROR",
) -> DataFrame:
    """F8: stored color with trail coverage replayed over the kept prefix.

    Only coverage is replayed: it does not depend on color, so the replay carries one channel. ``last``: run_id, seq, frame of the
    newest kept frame, and optionally ``replay_from``: the frame at which the replay may start clean, as a segment begins there, or
    from a stored state of ``states`` (lines with coverage k of one frame before it).
    """
    first = F.col("replay_from") if "replay_from" in last.columns else F.lit(-(2**31))
    spans = last.select(*PAIR, first.cast("int").alias("frame_from"), F.col("frame").alias("frame_to"))
    # Colors are not followed, so those of a stored state are not read.
    replay = feedback_scan(px, runs, resets, assignments=spans, state=states, policy=policy, color=False, counters=False)
    newest = processed.join(last, [*PAIR, "frame"], "left_semi")
    cover = replay.lines.select(*PAIR, "frame", "y", "w", "k").withColumn("_at", F.expr("sequence(0, size(k) - 1)"))
    return _lines(newest, cover)


def _lines(colors: DataFrame, cover: DataFrame) -> DataFrame:
    """Pixels of color (run_id, seq, frame, y, x, r g b a) with the coverage of the same places, as lines.

    ``cover`` has lines k and their columns ``_at``. Lines meet, not pixels, and are merged: their files are so much smaller than their
    rows that Spark would take any side for a small one and send it whole to the driver.
    """
    keys = [c for c in (*PAIR, "frame", "y") if c in cover.columns]
    mine = pack_lines(colors.withColumn("_x", F.col("x")), ("_x", "r", "g", "b", "a"), (*PAIR, "frame"), tasks=tasks_for(colors.count()))
    met = mine.join(cover.select(*keys, "_at", "k").hint("merge"), keys)
    # Where a side has holes, the places both have.
    both = F.array_intersect("_x", "_at")
    same = F.col("_x") == F.col("_at")

    def at(values: str, places: str):
        held = F.transform(both, lambda x: F.get(F.col(values), (F.array_position(F.col(places), x) - 1).cast("int")))
        return F.when(same, F.col(values)).otherwise(held).alias(values)

    packed = met.select(*PAIR, "frame", "y", *[at(c, "_x") for c in "rgba"], at("k", "_at"))
    packed = packed.withColumn("w", F.size("k")).where("w > 0").select(*PAIR, "frame", "y", "w", "r", "g", "b", "a", "k")
    heights = packed.groupBy("run_id", "seq", "frame").agg((F.max("y") + 1).alias("h"))
    return packed.join(heights, ["run_id", "seq", "frame"])


def plan_resume(
    px: DataFrame, runs: DataFrame | list[dict[str, object]], manifests: DataFrame, processed: DataFrame,
    resets: DataFrame | None = None, *, states: DataFrame | None = None, policy: str = "ERROR", size_policy: str = "ERROR",
) -> DataFrame:
    """How each pair of run and sequence continues: one row per manifest.

    ``manifests``: run_id, seq, frame_start, frame_end, completed. ``processed``: stored pixels (run_id, seq, frame, y, x, r g b a).
    ``states``: stored lines with coverage k, of any frames.

    A recorded frame without its image, or with a history that cannot be used, ends the prefix: of a run without trail only the
    newest frame is looked at, of a run with one every kept frame is, as its coverage goes back to the start. Under RESET the pair
    restarts there with a clean frame, under ERROR it has an ``error``. What is replayed: nothing for a run without trail, or where a
    stored state is that of the newest frame; else coverage from the newest stored state inside the last segment of the prefix
    (``state_frame``), else from the start of that segment.
    """
    jobs = assign_runs(px, runs, manifests.select(*PAIR, F.col("frame_start").alias("frame_from"), F.col("frame_end").alias("frame_to")))
    frames = plan_frames(px, jobs, resets, size_policy, None).select(*PAIR, "frame", "seg", "state_error")
    # The stored image must be that of its frame: as many pixels as the frame has. They are counted in the same pass.
    area = (F.count("*").alias("_n"), ((F.max("y") + 1) * (F.max("x") + 1)).alias("_area"))
    quality = history_quality(processed.withColumn("cov", F.lit(0.0)), (*PAIR, "frame"), area)
    images = stored(quality.select(*PAIR, "frame", (F.col("color_ok") & (F.col("_n") == F.col("_area"))).alias("usable")), "images")
    found = resume_point(manifests, images.select(*PAIR, "frame"), policy).drop("restart_frame", "finished", "recovery_reset_frame")
    spans = manifests.select(*PAIR, "frame_start", "frame_end").join(jobs.select(*PAIR, (F.col("mode") == "TRAIL").alias("trail")), PAIR)
    point = found.join(spans, PAIR).withColumn("_last", F.col("frame_start") + F.col("prefix_length") - 1)
    # Frames of the prefix whose history cannot be used.
    looked_at = point.select(*PAIR, "trail", "frame_start", "_last")
    kept = images.join(looked_at, PAIR).where(F.col("frame").between(F.col("frame_start"), F.col("_last")))
    bad = kept.where(~F.col("usable") & (F.col("trail") | (F.col("frame") == F.col("_last")))).select(*PAIR, "frame")
    stuck = frames.join(looked_at.where("trail"), PAIR).where(F.col("state_error").isNotNull() & (F.col("frame") <= F.col("_last"))).select(*PAIR, "frame")
    invalid = bad.union(stuck).groupBy(*PAIR).agg(F.min("frame").alias("invalid_frame"))
    met = point.join(invalid, PAIR, "left")
    cut = F.coalesce("invalid_frame", "missing_frame")
    last = F.coalesce(F.col("invalid_frame") - 1, F.col("_last"))
    wrong = F.coalesce(
        "error", F.when(F.col("invalid_frame").isNotNull() & F.lit(policy == "ERROR"), F.format_string("Resume history is invalid for frame %d", "invalid_frame"))
    )
    met = met.select(*PAIR, "trail", "frame_start", "frame_end", cut.alias("recovery_reset_frame"), last.alias("last_frame"), wrong.alias("error"))
    # Where the last segment of the prefix begins, and the stored state that lies in it.
    own = frames.join(met.select(*PAIR, "last_frame"), PAIR)
    segment = own.groupBy(*PAIR, "seg").agg(F.min("frame").alias("segment_start"), F.bool_or(F.col("frame") == F.col("last_frame")).alias("_in"))
    met = met.join(segment.where("_in").select(*PAIR, "segment_start"), PAIR, "left")
    if states is None:
        met = met.withColumn("state_frame", F.lit(None).cast("int"))
    else:
        inside = states.select(*PAIR, "frame").distinct().join(met.select(*PAIR, "segment_start", "last_frame"), PAIR)
        inside = inside.where(F.col("frame").between(F.col("segment_start"), F.col("last_frame")))
        met = met.join(inside.groupBy(*PAIR).agg(F.max("frame").alias("state_frame")), PAIR, "left")
    nothing = F.col("last_frame") < F.col("frame_start")
    # A frame that restarts clean needs no state of the one before.
    clean = nothing | F.col("recovery_reset_frame").isNotNull()
    source = (
        F.when(F.col("error").isNotNull(), F.lit("error")).when(F.col("last_frame") >= F.col("frame_end"), F.lit("finished"))
        .when(clean, F.lit("clean")).when(~F.col("trail"), F.lit("color"))
        .when(F.col("state_frame") == F.col("last_frame"), F.lit("stored")).otherwise(F.lit("replay"))
    )
    return met.select(
        *PAIR, "frame_start", "frame_end", F.when(~nothing, F.col("last_frame")).cast("int").alias("last_frame"),
        "recovery_reset_frame", (F.col("last_frame") + 1).cast("int").alias("restart_frame"), source.alias("source"),
        F.when(source == "replay", F.coalesce("state_frame", "segment_start")).alias("replay_from"),
        F.when(source.isin("replay", "stored"), F.col("state_frame")).alias("state_frame"), "error",
    )


@dataclass(frozen=True)
class Resumed:
    """``plan`` says how each pair continued; ``scan`` has the frames from there on."""

    plan: DataFrame
    scan: ScanResult


def resume_job(
    px: DataFrame, runs: DataFrame | list[dict[str, object]], manifests: DataFrame, processed: DataFrame,
    resets: DataFrame | None = None, *, states: DataFrame | None = None, policy: str = "ERROR", size_policy: str = "ERROR",
    job: str | None = None, counters: bool = True,
) -> Resumed:
    """F6-F10 for any number of runs and sequences: plan, rebuild state, continue. Pairs with an ``error`` and finished ones stand still.

    The frames that follow equal those of a scan that was never stopped; under RESET, of one with a reset at each frame that restarted
    clean.
    """
    plan = stored(plan_resume(px, runs, manifests, processed, resets, states=states, policy=policy, size_policy=size_policy), "resume")
    ends = plan.select(*PAIR, F.col("last_frame").alias("frame"), "source", "replay_from", "state_frame")
    color = resume_hard(processed, px, ends.where("source = 'color'").select(*PAIR, "frame"))
    replayed = ends.where("source = 'replay'")
    seeds = None
    if states is not None:
        wanted = replayed.where("state_frame IS NOT NULL").select(*PAIR, F.col("state_frame").alias("frame"))
        seeds = states.join(wanted, [*PAIR, "frame"])
    trail = resume_trail(processed, px, replayed, runs, resets, states=seeds, policy=size_policy)
    state = color.unionByName(trail)
    if states is not None:
        ready = ends.where("source = 'stored'").select(*PAIR, "frame")
        held = states.join(ready, [*PAIR, "frame"]).select(*PAIR, "frame", "y", "k", "h", "w")
        mine = pack_lines(processed.join(ready, [*PAIR, "frame"], "left_semi"), ("r", "g", "b", "a"), (*PAIR, "frame"))
        state = state.unionByName(mine.drop("w").join(held, [*PAIR, "frame", "y"]))
    state = stored(state, "resume-state")
    open_ = plan.where("source NOT IN ('error', 'finished')")
    clean = open_.where("recovery_reset_frame IS NOT NULL").select(*PAIR, F.col("recovery_reset_frame").cast("int").alias("frame"))
    every = clean
    if resets is not None:
        listed = resets.join(open_.select(*PAIR), [c for c in PAIR if c in resets.columns])
        every = clean.union(listed.select(*PAIR, F.col("frame").cast("int")))
    spans = open_.select(*PAIR, F.col("restart_frame").alias("frame_from"), F.col("frame_end").alias("frame_to"))
    scan = feedback_scan(px, runs, every, assignments=spans, state=state, policy=size_policy, counters=counters, job=job)
    return Resumed(plan, scan)
