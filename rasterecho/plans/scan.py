"""The recursive scan over frames (F3-F5, F9), and the log that lets it go on after a stop.

Frame *t* needs the output of frame *t-1*, but segments are independent: wave *k* advances frame *k* of
every segment of every sequence and run in one job, so the number of jobs is the longest segment, not
the number of frames. Each wave is written under ``spark.checkpoint.dir`` and the next one reads it
from there: lineage stays one step long and a lost executor only repeats its own tasks.

With a job folder the same tables lie at a place that is known beforehand, and a log gets one small row when
a wave's write is complete. A wave counts once it is in the log. Who calls the scan again with the same folder
goes on after the last such wave; a wave that was written in part is written again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SETTING_NAMES, assign_runs
from ..operators.blocks import prepare_blocks_once
from ..operators.chains import MOTION, advance_chains, chain_tasks
from ..operators.diagnostics import frame_diag
from ..operators.manifest import fingerprint, manifest_commit
from ..operators.quality import checked_dims, lines_usable, setting_reasons
from ..operators.segments import segments, with_live
from ..operators.step import KEY, Semantics, advance, clean_start, pack_lines, small_frame, tasks_for, unpack_lines
from .coverage import prefix_rounds, stays_in_place
from .workspace import existing, new_folder

LINE_CHANNELS = ("r", "g", "b", "a", "m")
#: Pixels that one task packs to lines of whole small frames.
PACKED_PIXELS = 200_000
#: Semantics that give an empty scan its schema.
ANY = Semantics("HARD_LOCALIZED", "TARGET_ONLY", "CURRENT_BEAUTY")
#: Rows of the log: the wave that is complete (-1: plan, lines and blocks), and whose work it is.
LOG = "wave int, signature string"


@dataclass(frozen=True)
class ScanResult:
    """``lines`` holds every finished frame; ``failures`` the sequences that stopped early and why."""

    lines: DataFrame
    failures: DataFrame
    waves: int
    root: str

    def pixels(self) -> DataFrame:
        """Output color and next coverage, one row per pixel."""
        arrays = {"r": "r", "g": "g", "b": "b", "a": "a", "k": "cov"}
        return unpack_lines(self.lines, arrays, ("run_id", "seq", "frame"))

    def coverage(self) -> DataFrame:
        return unpack_lines(self.lines, {"k": "cov"}, ("run_id", "seq", "frame"))

    def diagnostics(self) -> DataFrame:
        return frame_diag(self.lines)

    def last_state(self) -> DataFrame:
        """The lines of the newest finished frame of each run and sequence, ready to continue from."""
        newest = self.lines.groupBy("run_id", "seq").agg(F.max("frame").alias("frame"))
        return self.lines.join(newest, ["run_id", "seq", "frame"]).select(
            "run_id", "seq", "frame", "y", "w", "h", "r", "g", "b", "a", "k"
        )


def plan_frames(
    px: DataFrame, jobs: DataFrame, resets: DataFrame | None, policy: str, state: DataFrame | None,
) -> DataFrame:
    """One row per run and frame: which wave it belongs to and whether it can hold effect.

    Where ``jobs`` has ``frame_from`` and ``frame_to``, a pair's other frames are left out.
    """
    dims = checked_dims(px)
    bad_run = F.when(F.col("run_error").isNotNull(), F.concat(F.lit("invalid run: "), "run_error"))
    span = [c for c in ("frame_from", "frame_to") if c in jobs.columns]
    checked = jobs.select("run_id", "seq", *span, F.coalesce(*setting_reasons()).alias("run_error"))
    frames = dims.join(checked, "seq").withColumn("input_error", F.coalesce(bad_run, "input_error")).drop("run_error")
    if span:
        frames = frames.where(F.col("frame").between(F.col("frame_from"), F.col("frame_to"))).drop(*span)
    keys = ("run_id", "seq")
    if state is None:
        return with_live(segments(frames, resets, keys, policy=policy), keys).withColumn("seeded", F.lit(False))
    seeds = state.groupBy(*keys).agg(
        F.max("frame").alias("_last"), F.max("h").alias("_h"), F.max("w").alias("_w"),
        (F.bool_and(lines_usable()) & (F.count_distinct("frame", "y") == F.max("h"))).alias("_usable"),
    )
    known = frames.join(seeds, list(keys), "left")  # a pair without stored state starts clean
    # The stored frame takes part as the frame before the first, so size changes and gaps show.
    stored_frame = seeds.select(
        *keys, F.col("_last").alias("frame"), F.col("_h").alias("h"), F.col("_w").alias("w"),
        F.lit(True).alias("has_matte"), F.lit(True).alias("seeded"),
        F.when(~F.col("_usable"), F.lit("stored history is not usable")).alias("input_error"),
    )
    rest = known.where(F.col("_last").isNull() | (F.col("frame") > F.col("_last"))).select(
        *keys, "frame", "h", "w", "has_matte", F.lit(False).alias("seeded"), "input_error"
    )
    return with_live(segments(stored_frame.unionByName(rest), resets, keys, policy=policy), keys)


def feedback_scan(
    px: DataFrame, runs: DataFrame | list[dict[str, object]], resets: DataFrame | None = None, *,
    assignments: DataFrame | None = None, state: DataFrame | None = None, max_waves: int | None = None,
    policy: str = "ERROR", color: bool = True, counters: bool = True, job: str | None = None,
) -> ScanResult:
    """Process every frame of every sequence under every run.

    ``runs`` is a table of settings (``run_id`` and those that differ from the defaults), of any number of rows: they are
    joined, never written into the plan. ``assignments`` (run_id, seq) limits which run handles which sequence, and with
    ``frame_from, frame_to`` which frames. ``state`` continues from stored lines instead of a clean start. ``max_waves`` stops
    at a frame boundary and keeps what is finished. ``color=False`` follows trail coverage only, and without waves where it needs no
    gather. A frame with an illegal or
    missing pixel stops its sequence there; a run with an illegal setting and a pair whose stored lines are damaged do nothing.
    All of them are rows of ``failures``.

    ``job`` names a folder in shared storage: a scan that was stopped, or whose driver was lost, is continued by the same call.
    """
    spark = px.sparkSession
    root = job or new_folder(spark, "scan")
    jobs = assign_runs(px, runs, assignments)
    signature = _signature(jobs, resets, policy, color, counters) if job else ""
    done = committed_waves(spark, root) if job else set()
    _same_work(spark, root, signature, done)
    plan = _written(spark, lambda: plan_frames(px, jobs, resets, policy, state).join(jobs, ["run_id", "seq"]), f"{root}/plan", -1 in done)
    ready = plan.where(F.col("state_error").isNull())
    still = None
    if not color and not counters and state is None and job is None and max_waves is None:
        still = _still_coverage(px, ready.where(stays_in_place()), root)
        ready = ready.where(~stays_in_place())
    # One row per wave and kind of frame.
    found = ready.groupBy("pos", small_frame().alias("small")).agg(
        F.sum(F.when(~F.col("seeded"), F.col("h").cast("bigint") * F.col("w"))).alias("n")).collect()
    waves = max((r.pos for r in found), default=-1) + 1
    if max_waves is not None:
        waves = min(waves, max_waves)
    sizes = sorted({r.small for r in found}, reverse=True) or [True]
    parts = []
    if job:
        parts.append(_waves(px, ready, state, root, found, waves, sizes, done, signature, color, counters))
    else:
        ready = ready.where(F.col("pos") < waves)
        if True in sizes:
            parts.append(_chains(px, ready.where(small_frame()) if len(sizes) > 1 else ready, state, root, sizes, color, counters))
        if False in sizes:
            large = [r for r in found if not r.small]
            parts.append(_waves(
                px, ready.where(~small_frame()), state, root, large, min(waves, max(r.pos for r in large) + 1), [False], done, signature, color, counters,
            ))
    lines_out = reduce(DataFrame.unionByName, parts)
    if still is not None:
        lines_out = lines_out.unionByName(still)
    failures = plan.where(F.col("state_error").isNotNull()).groupBy("run_id", "seq").agg(
        F.min("frame").alias("frame"), F.min_by("state_error", "frame").alias("reason")
    )
    return ScanResult(lines_out, failures, waves, root)


def _packed(px: DataFrame, ready: DataFrame, channels: tuple[str, ...], sizes: list[bool]) -> DataFrame:
    """The pixels as lines. Small frames are dealt whole, so that lines meet what is known of their frame where they are."""
    area = F.col("h").cast("bigint") * F.col("w")
    drawn = ready.where(~F.col("seeded")).select("seq", "frame", "h", "w").distinct().agg(F.sum(area)).first()[0]
    held = px.select("seq", "frame", "y", "x", *channels)
    if False in sizes:
        return pack_lines(held, channels, tasks=tasks_for(drawn))
    return pack_lines(held.repartition(tasks_for(drawn, PACKED_PIXELS), "seq", "frame"), channels)


def _motion_read(ready: DataFrame) -> tuple[str, ...]:
    """The motion channels that any of the runs reads: the others are not moved."""
    read = ready.agg(F.bool_or(F.col("motion_channels") == "RG"), F.bool_or(F.col("motion_channels") != "RG")).first()
    return tuple(c for pair, wanted in zip((MOTION[:2], MOTION[2:]), read) if wanted for c in pair)


def _spread(frames: DataFrame) -> tuple[int, int, int]:
    """Pixels and number of the chains of ``frames``, and over how many tasks the runs of each are spread to use all cores."""
    area = F.col("h").cast("bigint") * F.col("w")
    chains = frames.groupBy("seq", (F.col("frame") - F.col("pos")).alias("chain"), "frame").agg(F.max(area).alias("n"))
    row = chains.agg(F.sum("n"), F.count_distinct("seq", "chain")).first()
    runs = frames.agg(F.count_distinct("run_id")).first()[0]
    cores = frames.sparkSession.sparkContext.defaultParallelism
    return row[0] or 0, row[1], max(1, min(runs, -(-2 * cores // max(1, row[1]))))


def _chained(lines: DataFrame, frames: DataFrame, seeds: DataFrame | None, color: bool, counters: bool, load: tuple[int, int, int]) -> DataFrame:
    pixels, chains, spread = load
    tasks = chain_tasks(pixels * spread, chains * spread, frames.sparkSession.sparkContext.defaultParallelism)
    return advance_chains(lines, frames, seeds, color=color, counters=counters, tasks=tasks, spread=spread)


def _chains(
    px: DataFrame, ready: DataFrame, state: DataFrame | None, root: str, sizes: list[bool], color: bool, counters: bool,
) -> DataFrame:
    """The segments of small frames, from their first frame to their last in one job."""
    spark = px.sparkSession
    frames = ready.where(~F.col("seeded"))
    channels = (*(LINE_CHANNELS if color else ("m",)), *_motion_read(ready))
    seeds = None if state is None else _seed(state, ready)
    make = lambda: _chained(_packed(px, ready, channels, sizes), frames, seeds, color, counters, _spread(frames))
    return _written(spark, make, f"{root}/chains", False)


def _waves(
    px: DataFrame, ready: DataFrame, state: DataFrame | None, root: str, found: list, waves: int, sizes: list[bool],
    done: set[int], signature: str, color: bool, counters: bool,
) -> DataFrame:
    """Wave after wave, each written and, for a job, logged before the next. Small frames take their step as chains of one frame."""
    spark, job = px.sparkSession, bool(signature)
    # A job that is stopped early is expected back, so its tables hold all waves from the start.
    planned = ready if job else ready.where(F.col("pos") < waves)
    pixels: dict[int, int] = {}
    for r in found:
        pixels[r.pos] = pixels.get(r.pos, 0) + (r.n or 0)
    small, large = (True in sizes), (False in sizes)
    channels = (*LINE_CHANNELS, *(_motion_read(ready) if small else ()))

    def lines_of() -> DataFrame:
        places = planned.where(~F.col("seeded")).select("seq", "frame", "pos").distinct()
        return _packed(px, ready, channels, sizes).join(places, ["seq", "frame"])

    def blocks_of() -> DataFrame:
        moving = planned.where((F.col("pos") > 0) & ~small_frame()).select("run_id", "seq", "frame", "seg", "pos", *SETTING_NAMES)
        return prepare_blocks_once(px.select("seq", "frame", "y", "x", *MOTION, "m"), moving, ("seg", "pos"))

    lines = _written(spark, lines_of, f"{root}/lines", -1 in done, "pos")
    blocks = _written(spark, blocks_of, f"{root}/blocks", -1 in done, "pos") if large else None
    if job and -1 not in done:
        _commit(spark, root, -1, signature)

    combos = (Semantics.present(ready.where(~small_frame())) or [ANY]) if large else []
    load = _spread(ready.where(small_frame() & ~F.col("seeded"))) if small else None
    paths: list[str] = []
    prev = None
    for pos in range(max(1, waves)):  # with nothing ready, an empty wave gives the schema
        wave = f"{root}/wave={pos}"

        def frames_of(pos: int = pos, prev: DataFrame | None = prev) -> DataFrame:
            now = ready.where((F.col("pos") == pos) & ~F.col("seeded"))
            here = lines.where(F.col("pos") == pos)
            parts = []
            if small:
                seeds = None if prev is None else prev.where(small_frame()).withColumn("pos", F.lit(pos - 1))
                _, chains, spread = load
                parts.append(_chained(here, now.where(small_frame()), seeds, color, counters, (pixels.get(pos, 0), chains, spread)))
            if large:
                cur = here.drop("w", *MOTION).join(now.where(~small_frame()).drop("pos", "has_matte"), ["seq", "frame"])
                for semantics in combos:
                    live = F.col("live_trail") if semantics.trail else F.col("live_hard")
                    mine = semantics.rows(cur).withColumn("live", live)
                    if pos == 0:
                        parts.append(clean_start(mine, color=color, counters=counters))
                    else:
                        parts.append(advance(
                            mine, prev.where(~small_frame()), blocks.where(F.col("pos") == pos), semantics,
                            color=color, counters=counters, tasks=tasks_for(pixels.get(pos)),
                        ))
            return reduce(DataFrame.unionByName, parts)

        finished = _written(spark, frames_of, wave, pos in done)
        if job and pos not in done and waves:
            _commit(spark, root, pos, signature)
        paths.append(wave)
        prev = finished
        if pos == 0 and state is not None:
            seeded = _seed(state, ready).drop("pos")
            prev = finished.unionByName(seeded.select(*[c for c in seeded.columns if c in finished.columns]), allowMissingColumns=True)
    return spark.read.schema(finished.schema).parquet(*paths)


def _still_coverage(px: DataFrame, ready: DataFrame, root: str) -> DataFrame:
    """The coverage lines of runs whose coverage stays in place, in as many rounds as the longest segment has binary digits."""
    longest = (ready.agg(F.max("pos")).first()[0] or 0) + 1
    places = ready.select(*KEY, "frame", "pos", "h", "trail_decay")
    packed = pack_lines(px.join(ready.select("seq", "frame").distinct(), ["seq", "frame"], "left_semi").select("seq", "frame", "y", "x", "m"), ("m",))
    mattes = packed.withColumnRenamed("m", "k").join(places, ["seq", "frame"])

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/still/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{root}/still/{name}")

    done = prefix_rounds(write(mattes, "round=0"), longest, write)
    bare = F.array().cast("array<float>")
    return done.select(*KEY, "frame", "y", "w", "h", *[bare.alias(c) for c in "rgba"], "k", (F.col("pos") == 0).alias("reset"))


def committed_waves(spark: SparkSession, job: str) -> set[int]:
    """The waves of a job whose write is complete; -1 stands for its plan. One number per wave."""
    log = existing(spark, f"{job}/log", LOG)
    return set() if log is None else {r.wave for r in log.select("wave").distinct().collect()}


def committed_frames(spark: SparkSession, job: str) -> DataFrame:
    """(run_id, seq, frame, wave): the frames of a job that count, by its log alone."""
    plan = spark.read.parquet(f"{job}/plan").where(F.col("state_error").isNull() & ~F.col("seeded"))
    log = spark.read.schema(LOG).parquet(f"{job}/log").select("wave").distinct()
    return plan.withColumn("wave", F.col("pos")).join(log, "wave", "left_semi").select("run_id", "seq", "frame", "wave")


def committed_lines(spark: SparkSession, job: str) -> DataFrame:
    """The lines of those frames. A wave that is not in the log is not read, whatever lies in its folder."""
    waves = sorted(w for w in committed_waves(spark, job) if w >= 0)
    if not waves:
        raise ValueError(f"no wave of {job} is complete")
    return spark.read.parquet(*[f"{job}/wave={w}" for w in waves])


def job_manifest(spark: SparkSession, job: str) -> DataFrame:
    """Per run and sequence what a stopped job has completed, as ``resume_point`` wants it.

    ``completed`` counts up from the first frame without a gap. Frames of later segments that are finished already stay out of
    it until those before them are finished too.
    """
    plan = spark.read.parquet(f"{job}/plan").where(~F.col("seeded"))
    spans = plan.groupBy("run_id", "seq").agg(F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"))
    frames = committed_frames(spark, job)
    missing = plan.join(frames, ["run_id", "seq", "frame"], "left_anti").groupBy("run_id", "seq").agg(F.min("frame").alias("_open"))
    kept = frames.join(missing, ["run_id", "seq"], "left").where(F.col("_open").isNull() | (F.col("frame") < F.col("_open")))
    done = manifest_commit(kept, frames.select("wave").distinct()).select("run_id", "seq", "completed")
    none = F.array().cast("array<int>")
    settled = fingerprint(plan.select("run_id", *SETTING_NAMES).distinct())
    return spans.join(done, ["run_id", "seq"], "left").join(settled, "run_id").select(
        "run_id", "seq", "frame_start", "frame_end", "settings_fingerprint", F.coalesce("completed", none).alias("completed")
    )


def _signature(jobs: DataFrame, resets: DataFrame | None, policy: str, color: bool, counters: bool) -> str:
    """What a job is for: its pairs with all settings, its resets and how it is run."""
    sums = [jobs.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(jobs.columns)))).first()]
    if resets is not None:
        sums.append(resets.distinct().agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(resets.columns)))).first())
    return "/".join(str(v) for v in (*[v for s in sums for v in s], policy, color, counters))


def _same_work(spark: SparkSession, root: str, signature: str, done: set[int]) -> None:
    if done:
        known = {r.signature for r in spark.read.schema(LOG).parquet(f"{root}/log").select("signature").distinct().collect()}
        if known != {signature}:
            raise ValueError(f"{root} holds another job: its runs, resets or policy differ")


def _commit(spark: SparkSession, root: str, wave: int, signature: str) -> None:
    """One row in one file, so that it is seen whole or not at all; a repeated row says the same."""
    spark.range(1).select(F.lit(wave).alias("wave"), F.lit(signature).alias("signature")).coalesce(1).write.mode("append").parquet(f"{root}/log")


def _seed(state: DataFrame, plan: DataFrame) -> DataFrame:
    """Stored lines with the segment they continue in."""
    place = plan.where("seeded").select("run_id", "seq", "frame", "seg", "pos")
    held = [c for c in ("r", "g", "b", "a", "k") if c in state.columns]
    return state.join(place, ["run_id", "seq", "frame"]).select("run_id", "seq", "seg", "pos", "frame", "y", "w", "h", *held)


def _written(spark: SparkSession, make, path: str, already: bool, *partition: str) -> DataFrame:
    """The table at ``path``: read if it is known to be whole, else made and written, over what an earlier attempt left."""
    if already:
        return spark.read.parquet(path)
    df = make()
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
