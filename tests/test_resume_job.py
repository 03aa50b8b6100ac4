"""A stopped scan goes on to the same rows: by its log, and by the resume job on what it left."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasters import px_frame, px_rows

from rasterecho.model import assign_runs, run_row, runs_frame
from rasterecho.plans.resume import plan_resume, resume_job
from rasterecho.plans.scan import committed_frames, committed_waves, feedback_scan, job_manifest
from rasterecho.plans.workspace import new_folder, stored

PIXEL = ("run_id", "seq", "frame", "y", "x", "r", "g", "b", "a", "cov")
ROWS = [run_row("hard", history_source="FULL_FRAME", block_size=2), run_row("trail", mode="TRAIL", trail_decay=0.5, block_size=2)]
PAIRS = [("hard", "s"), ("trail", "s")]


def clip(seq, frames=5, h=4, w=5, seed=3, first=1):
    rng = np.random.default_rng(seed)
    out = []
    for frame in range(first, first + frames):
        beauty = (rng.integers(0, 256, (h, w, 4)) / 256).astype(np.float32)
        motion = (rng.integers(-4, 5, (h, w, 4)) / 2).astype(np.float32)
        matte = (rng.integers(0, 3, (h, w)) / 2).astype(np.float32)
        out.append(px_rows(seq, frame, beauty, motion, matte))
    return out


def rows(df, where="true"):
    return sorted(map(tuple, df.where(where).select(*PIXEL).collect()))


def manifest(spark, upto):
    done = [(r, s, 1, 5, list(range(1, upto + 1))) for r, s in PAIRS]
    return spark.createDataFrame(done, "run_id string, seq string, frame_start int, frame_end int, completed array<int>")


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def px(spark):
    return stored(px_frame(spark, *clip("s")), "px")


@pytest.fixture(scope="module")
def runs(spark):
    return stored(runs_frame(spark, ROWS), "runs")


@pytest.fixture(scope="module")
def resets(spark):
    return spark.createDataFrame([("s", 4)], "seq string, frame int")


@pytest.fixture(scope="module")
def whole(px, runs, resets):
    return feedback_scan(px, runs, resets)


def test_runs_as_a_table(spark, px, resets, whole):
    """A table of runs gives what a list gives, other settings at their defaults; the plan does not grow with the runs."""
    assert rows(whole.pixels()) == rows(feedback_scan(px, ROWS, resets).pixels())
    many = spark.range(10_000).select(F.concat(F.lit("r"), "id").alias("run_id"), (F.col("id") / 10_000).alias("persistence"))
    sizes = [len(assign_runs(px, table)._jdf.queryExecution().toString()) for table in (many, many.limit(10))]
    assert sizes[0] < 1.2 * sizes[1]


def test_a_scan_for_thousands_of_runs(spark):
    one = px_frame(spark, *clip("s", frames=2, h=1, w=2))
    many = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit(0.0).alias("persistence"))
    result = feedback_scan(one, many, counters=False)
    assert result.lines.count() == 6000 and result.failures.count() == 0


def test_a_stopped_scan_goes_on(spark, px, runs, resets, whole):
    job = new_folder(spark, "job")
    feedback_scan(px, runs, resets, job=job, max_waves=1)
    assert committed_waves(spark, job) == {-1, 0}
    # The first wave has frames 1 and 4; only what has no gap before it is listed.
    assert {(r.run_id, r.frame_start, r.frame_end, *r.completed) for r in job_manifest(spark, job).collect()} == {("hard", 1, 5, 1), ("trail", 1, 5, 1)}
    # What a lost driver leaves of a wave that is not in the log counts for nothing.
    spark.range(3).withColumn("torn", F.lit(1)).write.parquet(f"{job}/wave=1")
    again = feedback_scan(px, runs, resets, job=job)
    assert rows(again.pixels()) == rows(whole.pixels())
    assert committed_frames(spark, job).count() == 10
    assert {(r.run_id, *r.completed) for r in job_manifest(spark, job).collect()} == {(r, 1, 2, 3, 4, 5) for r, _ in PAIRS}
    assert rows(feedback_scan(px, runs, resets, job=job).pixels()) == rows(whole.pixels())  # all is done, and read
    with pytest.raises(ValueError, match="another job"):
        feedback_scan(px, runs, job=job)


@pytest.mark.parametrize("with_states", [False, True])
def test_resume_equals_fresh(spark, px, runs, resets, whole, with_states):
    processed = stored(whole.pixels().where("frame <= 3").drop("cov"), "processed")
    states = whole.lines.where("frame IN (2, 4)").select("run_id", "seq", "frame", "y", "w", "h", "r", "g", "b", "a", "k") if with_states else None
    done = resume_job(px, runs, manifest(spark, 2), processed, resets, states=states)
    assert rows(done.scan.pixels()) == rows(whole.pixels(), "frame > 2")
    kinds = {r.run_id: (r.source, r.replay_from) for r in done.plan.collect()}
    # The state of frame 2 is that of the newest frame; that of frame 4 lies beyond what is kept.
    assert kinds == {"hard": ("color", None), "trail": ("stored", None) if with_states else ("replay", 1)}


def test_plans_of_prefixes(spark, px, runs, resets, whole):
    """The replay begins at the newest state inside the last segment, or where that begins; all frames kept leave nothing to do."""
    processed = stored(whole.pixels().drop("cov"), "processed")
    states = whole.lines.where("frame IN (1, 4)").select("run_id", "seq", "frame")
    plan = lambda upto, held=None: {r.run_id: (r.source, r.replay_from, r.restart_frame, r.last_frame) for r in plan_resume(px, runs, manifest(spark, upto), processed, resets, states=held).collect()}
    assert plan(0) == {r: ("clean", None, 1, None) for r, _ in PAIRS}
    assert plan(5) == {r: ("finished", None, 6, 5) for r, _ in PAIRS}
    assert plan(3, states) == {"hard": ("color", None, 4, 3), "trail": ("replay", 1, 4, 3)}
    assert plan(4) == {"hard": ("color", None, 5, 4), "trail": ("replay", 4, 5, 4)}
    assert plan(4, states) == {"hard": ("color", None, 5, 4), "trail": ("stored", None, 5, 4)}


def test_missing_and_invalid_history(spark, px, runs, resets, whole):
    """Frame 2 of one pair is lost, frame 3 of the other is damaged: an error each, or a clean restart there."""
    bad = (F.col("frame") == 3) & (F.col("run_id") == "hard") & (F.col("y") == 1) & (F.col("x") == 2)
    processed = whole.pixels().drop("cov").where("frame <= 3 AND NOT (run_id = 'trail' AND frame = 2)")
    processed = stored(processed.withColumn("g", F.when(bad, F.lit(float("nan")).cast("float")).otherwise(F.col("g"))), "processed")
    stands = resume_job(px, runs, manifest(spark, 3), processed, resets)
    assert {r.run_id: r.error for r in stands.plan.collect()} == {
        "trail": "Resume history is missing for frame 2", "hard": "Resume history is invalid for frame 3"}
    assert stands.scan.lines.isEmpty()
    again = resume_job(px, runs, manifest(spark, 3), processed, resets, policy="RESET")
    first = {"trail": 2, "hard": 3}
    extra = spark.createDataFrame([(r, "s", f) for r in first for f in (4, first[r])], "run_id string, seq string, frame int")
    fresh = feedback_scan(px, runs, extra)
    assert rows(again.scan.pixels()) == [r for r in rows(fresh.pixels()) if r[2] >= first[r[0]]]
    # A run without trail reads its newest frame alone, one with a trail every kept frame.
    early = stored(whole.pixels().drop("cov").withColumn("r", F.when(F.col("frame") == 1, F.lit(float("inf")).cast("float")).otherwise(F.col("r"))), "processed")
    told = {r.run_id: r.error for r in plan_resume(px, runs, manifest(spark, 3), early, resets).collect()}
    assert told == {"hard": None, "trail": "Resume history is invalid for frame 1"}


def test_sizes_in_the_prefix(spark, runs):
    """A size that changes inside the kept prefix is an error for a trail, or a reset there that shortens the replay."""
    px = stored(px_frame(spark, *clip("s", frames=2), *clip("s", frames=3, h=3, seed=8, first=3)), "px")
    whole = feedback_scan(px, runs, policy="RESET")
    processed = stored(whole.pixels().drop("cov").where("frame <= 4"), "processed")
    done = resume_job(px, runs, manifest(spark, 4), processed, size_policy="RESET")
    assert rows(done.scan.pixels()) == rows(whole.pixels(), "frame > 4")
    assert {r.run_id: r.replay_from for r in done.plan.collect()} == {"hard": None, "trail": 3}
    told = {r.run_id: r.error for r in plan_resume(px, runs, manifest(spark, 4), processed, size_policy="ERROR").collect()}
    assert told == {"hard": None, "trail": "Resume history is invalid for frame 3"}
