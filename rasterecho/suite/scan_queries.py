"""Segments, the recursive scan and its resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.segments import frame_dims, reset_frames, segments
from ..model import runs_frame
from ..operators.calibrate import preset_runs
from ..operators.step import unpack_lines
from ..plans.resume import plan_resume, resume_hard, resume_job, resume_point, resume_trail, rollback
from ..plans.scan import committed_lines, feedback_scan, job_manifest
from ..plans.workspace import new_folder, stored
from . import sqlgen as S
from .fixtures import FRAMES, RASTER_CTE, table
from .raster_queries import W, doubles
from .registry import query
from .shared import once, px, reset_scan, resets, run_scan

OUT = ("r", "g", "b", "a", "cov")
SELECT_SCAN = ("CAST(o_r AS DOUBLE) AS r, CAST(o_g AS DOUBLE) AS g, CAST(o_b AS DOUBLE) AS b, "
               "CAST(o_a AS DOUBLE) AS a, CAST(k AS DOUBLE) AS cov")


def scan_sql(run: str, resets_: tuple[int, ...] = (), where: str = "true", last: int = FRAMES) -> str:
    return (f"{W}, {S.scan_cte(S.RUNS[run], '', resets_, last)} "
            f"SELECT '{run}' AS run_id, seq, frame, y, x, {SELECT_SCAN} FROM sc WHERE {where}")


def of_run(pixels, run):
    return doubles(pixels.where(F.col("run_id") == run), *OUT)


LISTS = """SELECT c_custkey, ' ' || (c_custkey % 7) || ', ' || (c_custkey % 5) || ',,' || (c_custkey % 7) || ' , '
 || (c_nationkey - 3) AS expression FROM customer"""


@query("f1_reset_frames", f"""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_transform(
  list_filter(list_transform(string_split(expression, ','), lambda p: trim(p)), lambda p: p <> ''), lambda p: CAST(p AS INT)))), ',')
  AS frames FROM ({LISTS})""")
def f1(spark, sf):
    cust = table(spark, sf, "customer")
    text = F.concat(
        F.lit(" "), (F.col("c_custkey") % 7).cast("string"), F.lit(", "), (F.col("c_custkey") % 5).cast("string"),
        F.lit(",,"), (F.col("c_custkey") % 7).cast("string"), F.lit(" , "), (F.col("c_nationkey") - 3).cast("string"),
    )
    return cust.select("c_custkey", F.array_join(reset_frames(text).cast("array<string>"), ",").alias("frames"))


# Some sequences lose their lower rows from frame 4 on.
RESIZED = "(SELECT * FROM px WHERE NOT (frame >= 4 AND y >= 24 AND seq[1:2] IN ('AF', 'NF')))"


def resized(spark, sf):
    small = (F.col("frame") >= 4) & (F.col("y") >= 24) & F.substring("seq", 1, 2).isin("AF", "NF")
    return px(spark, sf).where(~small)


DIMS = f"dims AS (SELECT seq, frame, max(y) + 1 AS h, max(x) + 1 AS w FROM {RESIZED} GROUP BY seq, frame)"


@query("b6_resolution_change", f"""{W}, {DIMS}, lg AS (SELECT *, lag(h) OVER o AS old_h, lag(w) OVER o AS old_w
 FROM dims WINDOW o AS (PARTITION BY seq ORDER BY frame))
 SELECT seq, frame, old_h, old_w, h, w, 'RESET' AS outcome FROM lg WHERE old_h <> h OR old_w <> w""")
def b6(spark, sf):
    from ..operators.segments import resolution_change

    return resolution_change(frame_dims(resized(spark, sf)), "RESET")


@query("f2_segments", f"""{W}, {DIMS}, fl AS (SELECT seq, frame,
  frame IN {S.RESETS} OR lag(frame) OVER o IS NULL OR coalesce(lag(h) OVER o <> h, false) AS reset
  FROM dims WINDOW o AS (PARTITION BY seq ORDER BY frame)),
 sg AS (SELECT *, CAST(sum(CAST(reset AS INT)) OVER (PARTITION BY seq ORDER BY frame) AS INT) AS seg FROM fl)
 SELECT seq, frame, reset, seg, CAST(row_number() OVER (PARTITION BY seq, seg ORDER BY frame) - 1 AS INT) AS pos FROM sg""")
def f2(spark, sf):
    planned = segments(frame_dims(resized(spark, sf)), resets(spark, sf), policy="RESET")
    return planned.select("seq", "frame", "reset", "seg", "pos")


@query("f3_coverage_scan", f"{W}, {S.scan_cte(S.RUNS['trail_full'], '', S.RESETS)} "
       "SELECT 'trail_full' AS run_id, seq, frame, y, x, CAST(k AS DOUBLE) AS cov FROM sc")
def f3(spark, sf):
    result = feedback_scan(px(spark, sf), [S.RUNS["trail_full"]], resets(spark, sf), color=False, counters=False)
    return doubles(result.coverage(), "cov")


#: A trail whose coverage stays in its place, so that it is followed without waves.
STILL = S.RUNS["trail_full"] | {"run_id": "still", "trail_motion_mix": 0.0}


@query("f3_coverage_prefix", f"{W}, {S.scan_cte(STILL, '', S.RESETS[:1])} "
       "SELECT 'still' AS run_id, seq, frame, y, x, CAST(k AS DOUBLE) AS cov FROM sc")
def f3_prefix(spark, sf):
    listed = resets(spark, sf).where(F.col("frame") == S.RESETS[0])
    return doubles(feedback_scan(px(spark, sf), [STILL], listed, color=False, counters=False).coverage(), "cov")


for _run in ("hard_target", "trail_target", "hard_full", "trail_full", "refresh"):

    @query(f"f4_feedback_scan_{_run}", scan_sql(_run))
    def f4(spark, sf, _run=_run):
        return of_run(run_scan(spark, sf, _run).pixels(), _run)


@query("f4_feedback_scan_resets", scan_sql("hard_full", S.RESETS))
def f4_resets(spark, sf):
    return of_run(reset_scan(spark, sf, "hard_full").pixels(), "hard_full")


@query("f5_bounded_scan", scan_sql("trail_full", (), "frame <= 3", 3))
def f5(spark, sf):
    result = feedback_scan(px(spark, sf), [S.RUNS["trail_full"]], max_waves=3, counters=False)
    return of_run(result.pixels(), "trail_full")


# --- resume ------------------------------------------------------------------------------------
# Recorded runs of line items: a run per order, its frames the line numbers, a lost image for returned lines.

RECORDED = """lo AS (SELECT DISTINCT 'o' || l_orderkey AS run_id, 's' || (l_orderkey % 3) AS seq, l_linenumber AS frame,
   max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
mf AS (SELECT run_id, seq, 1 AS frame_start, CAST(max(frame) AS INT) AS n FROM lo GROUP BY run_id, seq),
lost AS (SELECT m.run_id, m.seq, min(f.range) AS missing_frame FROM mf m, range(1, 8) f
  WHERE f.range <= n AND NOT EXISTS (SELECT 1 FROM lo WHERE lo.run_id = m.run_id AND lo.frame = f.range AND lo.flag <> 'R')
  GROUP BY m.run_id, m.seq)"""


def recorded(spark, sf):
    """Manifests and existing outputs drawn from line items."""
    lines = table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("s"), (F.col("l_orderkey") % 3).cast("string")).alias("seq"),
        F.col("l_linenumber").cast("int").alias("frame"),
    ).agg(F.max("l_returnflag").alias("flag"))
    manifests = lines.groupBy("run_id", "seq").agg(F.max("frame").alias("n")).select(
        "run_id", "seq", F.lit(1).alias("frame_start"), (F.col("n") + F.length("run_id") % 2).alias("frame_end"),
        F.sequence(F.lit(1), F.col("n")).alias("completed"),
    )
    return manifests, lines.where(F.col("flag") != "R").select("run_id", "seq", "frame")


@query("f6_resume_point", f"""WITH {RECORDED} SELECT mf.run_id, mf.seq, CAST(missing_frame AS INT) AS missing_frame,
 CAST(coalesce(missing_frame - 1, n) AS INT) AS prefix_length, CAST(coalesce(missing_frame, n + 1) AS INT) AS restart_frame,
 CAST(missing_frame AS INT) AS recovery_reset_frame, 'Resume history is missing for frame ' || missing_frame AS error,
 coalesce(missing_frame, n + 1) > n + length(mf.run_id) % 2 AS finished FROM mf LEFT JOIN lost USING (run_id, seq)""")
def f6(spark, sf):
    manifests, outputs = recorded(spark, sf)
    return resume_point(manifests, outputs, "ERROR")


def interrupted(spark, sf, run):
    """The reset scan of a run as it stands after frame 4, as stored pixels."""
    def make():
        pixels = reset_scan(spark, sf, run).pixels().where(F.col("frame") <= 4)
        return stored(pixels, "interrupted")

    return once(spark, sf, f"interrupted {run}", make)


def newest(pixels):
    return pixels.groupBy("run_id", "seq").agg(F.max("frame").alias("frame"))


@query("f7_resume_hard", f"{W}, {S.scan_cte(S.RUNS['hard_full'], '', S.RESETS, 4)} "
       "SELECT 'hard_full' AS run_id, sc.seq, sc.frame, sc.y, sc.x, CAST(o_r AS DOUBLE) AS r, CAST(m AS DOUBLE) AS k "
       "FROM sc JOIN px ON px.seq = sc.seq AND px.frame = sc.frame AND px.y = sc.y AND px.x = sc.x WHERE sc.frame = 4")
def f7(spark, sf):
    from ..operators.step import unpack_lines

    kept = interrupted(spark, sf, "hard_full")
    lines = resume_hard(kept.drop("cov"), px(spark, sf), newest(kept))
    return doubles(unpack_lines(lines, {"r": "r", "k": "k"}, ("run_id", "seq", "frame")), "r", "k")


def trail_state(spark, sf):
    kept = interrupted(spark, sf, "trail_target").drop("cov")
    return once(spark, sf, "trail_state", lambda: stored(
        resume_trail(kept, px(spark, sf), newest(kept), [S.RUNS["trail_target"]], resets(spark, sf)), "state"))


@query("f8_resume_trail", f"{W}, {S.scan_cte(S.RUNS['trail_target'], '', S.RESETS, 4)} "
       "SELECT 'trail_target' AS run_id, seq, frame, y, x, CAST(o_r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS k "
       "FROM sc WHERE frame = 4")
def f8(spark, sf):
    from ..operators.step import unpack_lines

    lines = trail_state(spark, sf)
    return doubles(unpack_lines(lines, {"r": "r", "k": "k"}, ("run_id", "seq", "frame")), "r", "k")


@query("f9_resume_scan", scan_sql("trail_target", S.RESETS, "frame > 4"))
def f9(spark, sf):
    result = feedback_scan(
        px(spark, sf), [S.RUNS["trail_target"]], resets(spark, sf), state=trail_state(spark, sf), counters=False
    )
    return of_run(result.pixels(), "trail_target")


@query("f10_rollback", f"""WITH {RECORDED}, done AS (SELECT run_id, seq, CAST(f.range AS INT) AS frame FROM mf, range(1, 8) f WHERE f.range <= n)
 SELECT done.run_id, done.seq, done.frame, CAST(missing_frame AS INT) AS recovery_reset_frame
 FROM done LEFT JOIN lost USING (run_id, seq) WHERE missing_frame IS NULL OR done.frame < missing_frame""")
def f10(spark, sf):
    manifests, outputs = recorded(spark, sf)
    done = manifests.select("run_id", "seq", F.explode("completed").alias("frame"))
    return rollback(done, done.join(outputs, ["run_id", "seq", "frame"], "left_anti"))


@query("b5_history_quality", f"""{W}, {S.scan_cte(S.RUNS['trail_full'], '', ())} SELECT 'trail_full' AS run_id, seq, frame,
 bool_and(NOT (y = 3 AND o_r > 0.9)) AS color_ok, bool_and(k <= 1 AND NOT (y = 5 AND k > 0.5)) AS coverage_ok
 FROM sc GROUP BY seq, frame""")
def b5(spark, sf):
    from ..operators.quality import history_quality

    state = run_scan(spark, sf, "trail_full").pixels()
    broken = state.withColumns(
        {
            "r": F.when((F.col("y") == 3) & (F.col("r") > 0.9), F.lit(float("inf")).cast("float")).otherwise(F.col("r")),
            "cov": F.when((F.col("y") == 5) & (F.col("cov") > 0.5), F.lit(1.5).cast("float")).otherwise(F.col("cov")),
        }
    )
    return history_quality(broken)


# --- a sweep: runs made as a table are scanned and ranked -------------------------------------------

SWEEP = {name: S.RUNS[base] | {"run_id": name} | overrides for name, base, overrides in (
    ("trail_target/low", "trail_target", {"persistence": 0.5}), ("trail_target/wide", "trail_target", {"block_size": 16}),
    ("hard_full/low", "hard_full", {"persistence": 0.25}),
)}
TAGS = {name: f"w{i}" for i, name in enumerate(SWEEP)}
SWEEP_CTE = ",\n".join(S.scan_cte(run, TAGS[name]) for name, run in SWEEP.items())


def sweep_scan(spark, sf):
    def make():
        bases = runs_frame(spark, [S.RUNS["trail_target"], S.RUNS["hard_full"]])
        given = "preset string, variant string, persistence double, block_size int"
        overrides = spark.createDataFrame([("trail_target", "low", 0.5, None), ("trail_target", "wide", None, 16), ("hard_full", "low", 0.25, None)], given)
        return feedback_scan(px(spark, sf), preset_runs(bases.withColumn("preset", F.col("run_id")), overrides))

    return once(spark, sf, "sweep", make)


@query("k2_sweep_scan", f"{W}, {SWEEP_CTE} " + " UNION ALL ".join(
    f"SELECT '{name}' AS run_id, seq, frame, y, x, CAST(o_r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS cov FROM sc{tag}" for name, tag in TAGS.items()))
def k2_scan(spark, sf):
    return doubles(sweep_scan(spark, sf).pixels().select("run_id", "seq", "frame", "y", "x", "r", "cov"), "r", "cov")


# --- what a stopped job left, and how it goes on ----------------------------------------------------

STOP = 4
JOB_RUNS = ("hard_full", "trail_target")


def stopped_job(spark, sf):
    """A job of two runs that was stopped after four waves."""
    def make():
        job = new_folder(spark, "job")
        feedback_scan(px(spark, sf), runs_frame(spark, [S.RUNS[r] for r in JOB_RUNS]), job=job, max_waves=STOP, counters=False)
        return job

    return once(spark, sf, "job", make)


SEQS = f"rs AS (SELECT unnest({list(JOB_RUNS)}) AS run_id), sq AS (SELECT run_id, seq, seq LIKE 'AF%' AS lost FROM rs, (SELECT DISTINCT seq FROM px))"


@query("g3_stopped_job", f"{W}, {SEQS} SELECT run_id, seq, 1 AS frame_start, {FRAMES} AS frame_end, '{','.join(map(str, range(1, STOP + 1)))}' AS completed FROM sq")
def g3_job(spark, sf):
    done = job_manifest(spark, stopped_job(spark, sf))
    return done.select("run_id", "seq", "frame_start", "frame_end", F.array_join(F.col("completed").cast("array<string>"), ",").alias("completed"))


def left_over(spark, sf):
    """The images of the stopped job; some sequences have lost that of frame 3."""
    def make():
        lines = committed_lines(spark, stopped_job(spark, sf))
        pixels = unpack_lines(lines, {c: c for c in "rgba"}, ("run_id", "seq", "frame"))
        return stored(pixels.where("NOT (seq LIKE 'AF%' AND frame = 3)"), "left-over")

    return once(spark, sf, "left-over", make)


@query("f6_resume_plan", f"""{W}, {SEQS} SELECT run_id, seq, CASE WHEN lost THEN 2 ELSE {STOP} END AS last_frame, CASE WHEN lost THEN 3 ELSE {STOP + 1} END AS restart_frame,
 CASE WHEN lost THEN 3 END AS recovery_reset_frame, CASE WHEN lost THEN 'clean' WHEN run_id = 'hard_full' THEN 'color' ELSE 'replay' END AS source,
 CASE WHEN NOT lost AND run_id = 'trail_target' THEN 1 END AS replay_from FROM sq""")
def f6_plan(spark, sf):
    runs = runs_frame(spark, [S.RUNS[r] for r in JOB_RUNS])
    plan = plan_resume(px(spark, sf), runs, job_manifest(spark, stopped_job(spark, sf)), left_over(spark, sf), policy="RESET")
    return plan.select("run_id", "seq", "last_frame", "restart_frame", F.col("recovery_reset_frame").cast("int").alias("recovery_reset_frame"), "source", "replay_from")


@query("f9_resume_job", f"{W}, " + ", ".join(S.scan_cte(S.RUNS[r], f"{t}{i}", z) for i, r in enumerate(JOB_RUNS) for t, z in (("p", ()), ("q", (3,)))) + " " + " UNION ALL ".join(
    f"SELECT '{r}' AS run_id, seq, frame, y, x, CAST(o_r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS cov FROM sc{t}{i} WHERE {w}"
    for i, r in enumerate(JOB_RUNS) for t, w in (("p", f"seq NOT LIKE 'AF%' AND frame > {STOP}"), ("q", "seq LIKE 'AF%' AND frame >= 3"))))
def f9_job(spark, sf):
    runs = runs_frame(spark, [S.RUNS[r] for r in JOB_RUNS])
    done = resume_job(px(spark, sf), runs, job_manifest(spark, stopped_job(spark, sf)), left_over(spark, sf), policy="RESET", counters=False)
    return doubles(done.scan.pixels().select("run_id", "seq", "frame", "y", "x", "r", "cov"), "r", "cov")
