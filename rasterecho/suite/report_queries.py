"""Counters, reports, timings, comparisons, event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import diagnostics as D
from ..operators import events as V
from ..operators import timing as T
from . import sqlgen as S
from .fixtures import table
from .raster_queries import EMBEDDED, W, embedded, step_facts
from .registry import query
from .shared import pair_scan, px, run_scan

RUN_NAMES = tuple(S.RUNS)

# --- counters of the scans -----------------------------------------------------------------------

_FLOATS = ("target_matte_coverage", "effect_matte_coverage", "historical_blend_weight", "changed_output_ratio",
           "changed_output_mean_absolute", "changed_output_max_absolute")


def rounded(df, columns=_FLOATS):
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


def sql_rounded(columns=_FLOATS):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def diag_sql(run: str) -> str:
    spec = S.RUNS[run]
    return f"{W}, {S.scan_cte(spec, '')}, {S.diag_frames_cte(spec, '')}"


for _run in RUN_NAMES:

    @query(f"i1_frame_diag_{_run}", f"{diag_sql(_run)} SELECT '{_run}' AS run_id, * REPLACE ({sql_rounded()}) FROM dg")
    def i1(spark, sf, _run=_run):
        return rounded(run_scan(spark, sf, _run).diagnostics())


@query("i2_change_metric", S.pair_step_sql(S.RUNS["trail_full"],
       "SELECT seq, frame, y, x, CAST(greatest(abs(o_r - r), abs(o_g - g), abs(o_b - b)) AS DOUBLE) AS change, "
       "greatest(abs(o_r - r), abs(o_g - g), abs(o_b - b)) > CAST(1e-6 AS FLOAT) AS changed FROM st"))
def i2(spark, sf):
    from ..functions.pixel import CHANGE_EPSILON, change

    return step_facts(spark, sf, S.RUNS["trail_full"]).selectExpr(
        "seq", "frame", "y", "x", f"CAST({change()} AS DOUBLE) AS change", f"{change()} > {CHANGE_EPSILON} AS changed")


# --- counters of many long runs, drawn from line items ---------------------------------------------
# A run per supplier, a sequence per return flag, a frame per order; the first two and every 40th frame reset.

COUNTERS = """lx AS (SELECT 's' || l_suppkey AS run_id, l_returnflag AS seq, l_suppkey AS sk, l_orderkey AS ok,
  CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(l_partkey) AS BIGINT) AS pk FROM lineitem GROUP BY 1, 2, 3, 4),
ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, seq ORDER BY ok) AS INT) AS frame_number FROM lx),
dx AS (SELECT run_id, seq, sk, frame_number, frame_number <= 2 OR frame_number % 40 = 0 AS reset, CAST(1000 AS BIGINT) AS pixel_count,
  CASE WHEN sk % 7 = 0 THEN 0 ELSE q END AS target_matte_pixels, CASE WHEN sk % 7 = 0 THEN 0 ELSE q END / CAST(1024 AS DOUBLE) AS target_matte_coverage,
  q * 2 AS effect_matte_pixels, q / CAST(512 AS DOUBLE) AS effect_matte_coverage, q * 2 AS primary_history_attempts,
  q * 2 - (q * 2 * (sk % 11)) // 10 AS primary_history_valid_uses, (q * 2 * (sk % 11)) // 10 AS primary_history_invalid_samples,
  q AS same_pixel_fallback_attempts, q // 2 AS same_pixel_fallback_valid_uses, q // 3 AS current_beauty_fallback_pixels,
  (q * 2 * (sk % 6)) // 5 AS refresh_restored_pixels, pk % 5 AS refresh_restored_blocks,
  CASE WHEN frame_number < 5 THEN q ELSE (q * 2 * (sk % 4)) // 60 END AS historical_blend_pixels, q / CAST(4 AS DOUBLE) AS historical_blend_weight,
  pk % (CASE WHEN frame_number < 4 THEN 40 ELSE 12 END) AS changed_output_pixels,
  (pk % (CASE WHEN frame_number < 4 THEN 40 ELSE 12 END)) / CAST(1000 AS DOUBLE) AS changed_output_ratio,
  (pk % 16) / CAST(64 AS DOUBLE) AS changed_output_mean_absolute, (pk % 32) / CAST(32 AS DOUBLE) AS changed_output_max_absolute FROM ln),
st AS (SELECT DISTINCT run_id, CASE WHEN sk % 2 = 0 THEN 'TARGET_ONLY' ELSE 'FULL_FRAME' END AS history_source,
  CASE WHEN sk % 3 = 0 THEN 'SAME_PIXEL_HISTORY' ELSE 'CURRENT_BEAUTY' END AS invalid_history_fallback FROM dx)"""


def counters(spark, sf, settings=False):
    li = table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("run_id"), F.col("l_returnflag").alias("seq"),
        F.col("l_suppkey").alias("sk"), F.col("l_orderkey").alias("ok"),
    ).agg(F.sum("l_quantity").cast("bigint").alias("q"), F.sum("l_partkey").alias("pk"))
    order = Window.partitionBy("run_id", "seq").orderBy("ok")
    rows = li.withColumn("frame_number", F.row_number().over(order)).selectExpr(
        "run_id", "seq", "sk", "frame_number", "frame_number <= 2 OR frame_number % 40 = 0 AS reset", "1000L AS pixel_count",
        "IF(sk % 7 = 0, 0L, q) AS target_matte_pixels", "IF(sk % 7 = 0, 0L, q) / 1024D AS target_matte_coverage",
        "q * 2 AS effect_matte_pixels", "q / 512D AS effect_matte_coverage", "q * 2 AS primary_history_attempts",
        "q * 2 - (q * 2 * (sk % 11)) DIV 10 AS primary_history_valid_uses",
        "(q * 2 * (sk % 11)) DIV 10 AS primary_history_invalid_samples",
        "q AS same_pixel_fallback_attempts", "q DIV 2 AS same_pixel_fallback_valid_uses",
        "q DIV 3 AS current_beauty_fallback_pixels", "(q * 2 * (sk % 6)) DIV 5 AS refresh_restored_pixels",
        "pk % 5 AS refresh_restored_blocks",
        "IF(frame_number < 5, q, (q * 2 * (sk % 4)) DIV 60) AS historical_blend_pixels", "q / 4D AS historical_blend_weight",
        "pk % IF(frame_number < 4, 40, 12) AS changed_output_pixels",
        "(pk % IF(frame_number < 4, 40, 12)) / 1000D AS changed_output_ratio",
        "(pk % 16) / 64D AS changed_output_mean_absolute", "(pk % 32) / 32D AS changed_output_max_absolute",
    )
    if not settings:
        return rows.drop("sk")
    return rows.selectExpr(
        "*", "IF(sk % 2 = 0, 'TARGET_ONLY', 'FULL_FRAME') AS history_source",
        "IF(sk % 3 = 0, 'SAME_PIXEL_HISTORY', 'CURRENT_BEAUTY') AS invalid_history_fallback").drop("sk")


def run_settings(spark, sf):
    return counters(spark, sf, True).select("run_id", "history_source", "invalid_history_fallback").distinct()


_SUMS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (NOT reset), 0) AS BIGINT) AS {c}" for c in D.SUMMED)
_N = "coalesce(sum(pixel_count) FILTER (NOT reset), 0)"


def _mean(c: str) -> str:
    return f"coalesce(sum({c} * pixel_count) FILTER (NOT reset) / CAST(nullif({_N}, 0) AS DOUBLE), 0)"


TOTALS = f"""tt AS (SELECT run_id, seq, count(*) FILTER (reset) AS reset_frame_count, count(*) FILTER (NOT reset) AS eligible_frame_count, {_SUMS},
 coalesce(sum(historical_blend_weight) FILTER (NOT reset), 0) AS historical_blend_weight,
 coalesce(max(changed_output_max_absolute) FILTER (NOT reset), 0) AS changed_output_max_absolute,
 {_mean('target_matte_coverage')} AS target_matte_coverage, {_mean('effect_matte_coverage')} AS effect_matte_coverage,
 {_mean('changed_output_mean_absolute')} AS changed_output_mean_absolute,
 coalesce(CAST(sum(changed_output_pixels) FILTER (NOT reset) AS DOUBLE) / nullif({_N}, 0), 0) AS changed_output_ratio
 FROM dx GROUP BY run_id, seq)"""


@query("i3_run_totals", f"WITH {COUNTERS}, {TOTALS} SELECT * REPLACE ({sql_rounded()}) FROM tt")
def i3(spark, sf):
    return rounded(D.run_totals(counters(spark, sf)))


def advice_sql(source: str, out: str) -> str:
    """``out``: likely, causes, message per row of ``source``, which carries totals and settings."""
    def ratio(a, b):
        return f"(CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0 END)"

    attempts = "primary_history_attempts"
    invalid = "primary_history_invalid_samples"
    likely = (f"eligible_frame_count >= 2 AND target_matte_pixels > 0 AND {ratio('historical_blend_pixels', attempts)} <= 0.05::DOUBLE "
              f"AND changed_output_ratio <= 0.01::DOUBLE")
    mostly = f"{ratio(invalid, attempts)} >= 0.8::DOUBLE"
    causes = ("concat_ws('; ', CASE WHEN history_source = 'TARGET_ONLY' THEN 'Target Only history source is selected' END, "
              f"CASE WHEN {mostly} THEN 'primary history is mostly out of bounds or invalid' END, "
              f"CASE WHEN {mostly} THEN 'vector direction or convention may be wrong' END, "
              f"CASE WHEN {invalid} > 0 AND invalid_history_fallback <> 'SAME_PIXEL_HISTORY' THEN 'Same Pixel History fallback is not selected' END, "
              f"CASE WHEN {ratio('refresh_restored_pixels', 'effect_matte_pixels')} >= 0.8::DOUBLE THEN 'Refresh restores too much clean beauty' END)")
    return f"""{out}0 AS (SELECT *, {likely} AS likely_near_no_op, {causes} AS found FROM {source}),
{out} AS (SELECT *, CASE WHEN likely_near_no_op THEN 'Likely ineffective feedback: ' ||
   CASE WHEN found = '' THEN 'measured history use and output change are both very low' ELSE found END
  WHEN eligible_frame_count >= 2 AND target_matte_pixels = 0 THEN 'Diagnostics: empty target matte' END AS message FROM {out}0)"""


@query("i4_near_no_op", f"WITH {COUNTERS}, {TOTALS}, j AS (SELECT tt.*, history_source, invalid_history_fallback FROM tt JOIN st USING (run_id)), "
       f"{advice_sql('j', 'ad')} SELECT run_id, seq, likely_near_no_op, message FROM ad")
def i4(spark, sf):
    judged = D.near_no_op(D.run_totals(counters(spark, sf)).join(run_settings(spark, sf), "run_id"))
    return judged.select("run_id", "seq", "likely_near_no_op", "message")


_RUN = ("pixel_count", "target_matte_pixels", "effect_matte_pixels", "primary_history_attempts", "primary_history_invalid_samples",
        "refresh_restored_pixels", "historical_blend_pixels", "changed_output_pixels")
RUNNING = "rt0 AS (SELECT run_id, seq, frame_number, count(*) FILTER (NOT reset) OVER o AS eligible_frame_count, " + ", ".join(
    f"CAST(coalesce(sum({c}) FILTER (NOT reset) OVER o, 0) AS BIGINT) AS {c}" for c in _RUN
) + """ FROM dx WINDOW o AS (PARTITION BY run_id, seq ORDER BY frame_number)),
rt AS (SELECT rt0.*, coalesce(changed_output_pixels / CAST(nullif(pixel_count, 0) AS DOUBLE), 0) AS changed_output_ratio,
 history_source, invalid_history_fallback FROM rt0 JOIN st USING (run_id))"""
FIRST = "fa AS (SELECT run_id, seq, min(frame_number) AS frame_number, arg_min(message, frame_number) AS message FROM ra WHERE likely_near_no_op GROUP BY run_id, seq)"


@query("i5_running_advice", f"WITH {COUNTERS}, {RUNNING}, {advice_sql('rt', 'ra')}, {FIRST} SELECT * FROM fa")
def i5(spark, sf):
    return D.running_advice(counters(spark, sf, True))


@query("i6_checkpoint_rows", f"""WITH {COUNTERS}, {RUNNING}, {advice_sql('rt', 'ra')}, {FIRST},
 nb AS (SELECT dx.run_id, dx.seq, dx.frame_number AS c, max(dx.frame_number) OVER (PARTITION BY dx.run_id, dx.seq) AS total, fa.frame_number = dx.frame_number AS advised
   FROM dx LEFT JOIN fa ON fa.run_id = dx.run_id AND fa.seq = dx.seq)
 SELECT DISTINCT run_id, seq, 0 AS completed, 'start' AS reason FROM dx
 UNION ALL SELECT run_id, seq, c, CASE WHEN c = total THEN 'terminal' WHEN c % 10 = 0 THEN 'checkpoint' ELSE 'advice' END
 FROM nb WHERE c = total OR c % 10 = 0 OR advised""")
def i6(spark, sf):
    return D.checkpoint_rows(counters(spark, sf, True))


def report_manifests(spark, sf):
    """Suppliers divisible by 5 recorded three more frames than they measured."""
    rows = counters(spark, sf, True).groupBy("run_id", "seq", "history_source").agg(F.max("frame_number").alias("n"))
    sk = F.substring("run_id", 2, 20).cast("int")
    more = rows.withColumn("n", F.col("n") + F.when(sk % 5 == 0, 3).otherwise(0))
    return more.select(
        "run_id", "seq", F.lit(1).alias("frame_start"), (F.col("n") + sk % 2).alias("frame_end"),
        F.sequence(F.lit(1), "n").alias("completed"), F.concat(F.lit("f"), "run_id").alias("settings_fingerprint"),
        F.when(sk % 2 == 0, "SUCCESS").otherwise("CANCELLED").alias("outcome"), "history_source",
    )


REPORT = f"""WITH {COUNTERS}, {TOTALS}, mx AS (SELECT run_id, seq, sk, max(frame_number) AS n FROM dx GROUP BY run_id, seq, sk)
 SELECT mx.run_id, mx.seq, CASE WHEN sk % 2 = 0 THEN 'SUCCESS' ELSE 'CANCELLED' END AS terminal_outcome,
  CAST(n + CASE WHEN sk % 5 = 0 THEN 3 ELSE 0 END AS INT) AS completed_count, CAST(n AS BIGINT) AS diagnostics_count,
  CASE WHEN sk % 5 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS availability,
  CASE WHEN sk % 5 = 0 THEN 'terminal_report_contains_all_in_memory_diagnostics_but_prior_resume_diagnostics_are_unavailable'
    ELSE 'terminal_report_does_not_lag_manifest' END AS lag_policy,
  CAST(CASE WHEN sk % 5 = 0 THEN 3 ELSE 0 END AS BIGINT) AS diagnostics_lag, tt.reset_frame_count, tt.eligible_frame_count,
  CAST(least(n, 96) AS INT) AS listed, CAST(greatest(n - 96, 0) AS BIGINT) AS omitted, CAST(greatest(n - 95, 1) AS INT) AS first_listed, tt.pixel_count
 FROM mx JOIN tt ON tt.run_id = mx.run_id AND tt.seq = mx.seq"""


@query("i7_report", REPORT)
def i7(spark, sf):
    rows = D.report(counters(spark, sf), report_manifests(spark, sf))
    return rows.select(
        "run_id", "seq", "terminal_outcome", F.col("completed_prefix.count").alias("completed_count"),
        F.col("diagnostics_completed_prefix.count").alias("diagnostics_count"),
        F.col("diagnostics_availability").alias("availability"), "lag_policy", "diagnostics_lag",
        "reset_frame_count", "eligible_frame_count", F.size("frames").alias("listed"),
        F.col("frame_diagnostics_omitted").alias("omitted"), F.element_at("frames", 1)["frame_number"].alias("first_listed"),
        F.col("totals.pixel_count").alias("pixel_count"),
    )


@query("i8_report_agreement", f"""WITH {COUNTERS} SELECT DISTINCT run_id, seq, sk % 6 <> 0 AS fingerprint_agrees, true AS source_agrees,
 sk % 4 <> 0 AS prefix_agrees FROM dx""")
def i8(spark, sf):
    manifests = report_manifests(spark, sf)
    sk = F.substring("run_id", 2, 20).cast("int")
    later = manifests.withColumns(
        {
            "settings_fingerprint": F.when(sk % 6 == 0, F.lit("other")).otherwise(F.col("settings_fingerprint")),
            "completed": F.when(sk % 4 == 0, F.sequence(F.lit(1), F.size("completed") + 1)).otherwise(F.col("completed")),
        }
    )
    return D.report_agreement(D.report(counters(spark, sf), manifests), later)


@query("i10_terminal_outcome", """WITH s AS (SELECT 'o' || l_orderkey AS run_id, l_linenumber AS ord, max(l_returnflag) AS fl, max(l_linestatus) AS st
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
 z AS (SELECT run_id, arg_max(CASE fl WHEN 'A' THEN 'ERROR' WHEN 'R' THEN CASE st WHEN 'F' THEN 'CANCEL' ELSE 'END' END ELSE 'DONE' END, ord) AS status,
  arg_max('line ' || ord, ord) AS failure, count(*) FILTER (fl = 'N') AS completed_frames FROM s GROUP BY run_id)
 SELECT run_id, CASE status WHEN 'END' THEN 'SUCCESS' WHEN 'CANCEL' THEN 'CANCELLED' WHEN 'ERROR' THEN 'FAILURE' ELSE 'RUNNING' END AS outcome,
  completed_frames, CASE WHEN status = 'ERROR' THEN failure END AS failure FROM z""")
def i10(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("run_id"), F.col("l_linenumber").alias("ord")
    ).agg(F.max("l_returnflag").alias("fl"), F.max("l_linestatus").alias("st"))
    status = F.when(F.col("fl") == "A", "ERROR").when(
        F.col("fl") == "R", F.when(F.col("st") == "F", "CANCEL").otherwise("END")).otherwise("DONE")
    return D.terminal_outcome(lines.select(
        "run_id", "ord", status.alias("status"), F.concat(F.lit("line "), F.col("ord").cast("string")).alias("failure")))


@query("k3_sweep_compare", f"""WITH {COUNTERS}, {TOTALS}, s AS (SELECT seq, run_id, changed_output_ratio,
  CASE WHEN primary_history_attempts > 0 THEN historical_blend_pixels / CAST(primary_history_attempts AS DOUBLE) ELSE 0 END AS u FROM tt)
 SELECT seq, run_id, round(changed_output_ratio, 9) AS changed_output_ratio, round(u, 9) AS history_use_ratio,
  CAST(row_number() OVER (PARTITION BY seq ORDER BY changed_output_ratio DESC, run_id) AS INT) AS change_rank,
  CAST(row_number() OVER (PARTITION BY seq ORDER BY u DESC, run_id) AS INT) AS use_rank FROM s""")
def k3(spark, sf):
    ranked = C.sweep_compare(D.run_totals(counters(spark, sf)))
    return ranked.withColumns({c: F.round(c, 9) for c in ("changed_output_ratio", "history_use_ratio")})


def sweep_sql():
    from .scan_queries import SWEEP, SWEEP_CTE, TAGS

    diag = ", ".join(S.diag_frames_cte(run, TAGS[name]) for name, run in SWEEP.items())
    every = " UNION ALL ".join(f"SELECT '{name}' AS run_id, * FROM dg{tag}" for name, tag in TAGS.items())
    return f"""{W}, {SWEEP_CTE}, {diag}, dx AS ({every}), {TOTALS}, s AS (SELECT seq, run_id, changed_output_ratio,
  CASE WHEN primary_history_attempts > 0 THEN historical_blend_pixels / CAST(primary_history_attempts AS DOUBLE) ELSE 0 END AS u FROM tt)
 SELECT seq, run_id, round(changed_output_ratio, 9) AS changed_output_ratio, round(u, 9) AS history_use_ratio,
  CAST(row_number() OVER (PARTITION BY seq ORDER BY changed_output_ratio DESC, run_id) AS INT) AS change_rank,
  CAST(row_number() OVER (PARTITION BY seq ORDER BY u DESC, run_id) AS INT) AS use_rank FROM s"""


@query("k3_sweep_scan", sweep_sql())
def k3_scan(spark, sf):
    from .scan_queries import sweep_scan

    ranked = C.sweep_compare(D.run_totals(sweep_scan(spark, sf).diagnostics()))
    return ranked.withColumns({c: F.round(c, 9) for c in ("changed_output_ratio", "history_use_ratio")})


# --- timings from events ---------------------------------------------------------------------------

STAGE = """CASE event_type WHEN 'click' THEN 'beauty_read' WHEN 'view' THEN 'vector_read' WHEN 'signup' THEN 'matte_read'
 WHEN 'purchase' THEN 'core_processing' ELSE 'processed_write' END"""
TIMED = f"""tm AS (SELECT 'r' || (user_id % 3) AS run_id, 'u' || (user_id % 5) AS seq,
  CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INT) AS frame, date_diff('hour', TIMESTAMP '2024-01-01', ts) % 10 = 1 AS reset,
  {STAGE} AS stage, CAST(sum(CAST(round(value * 100) AS BIGINT)) * 10000 AS BIGINT) AS ns FROM events GROUP BY 1, 2, 3, 4, 5)"""


def timings(spark, sf):
    """A frame per hour of the event log."""
    ev = table(spark, sf, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("int")
    return ev.select(
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("seq"),
        hour.alias("frame"), (hour % 10 == 1).alias("reset"), F.expr(STAGE).alias("stage"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    ).groupBy("run_id", "seq", "frame", "reset", "stage").agg((F.sum("v") * 10000).alias("ns"))


@query("h1_stage_totals", f"""WITH {TIMED}, fr AS (SELECT run_id, seq, frame, row_number() OVER (PARTITION BY run_id, seq ORDER BY frame DESC) AS n,
   count(*) OVER (PARTITION BY run_id, seq) AS total FROM (SELECT DISTINCT run_id, seq, frame FROM tm)),
 s AS (SELECT tm.run_id, tm.seq, stage, CAST(sum(ns) AS BIGINT) AS duration_ns, max(greatest(total - 96, 0)) AS frames_omitted
  FROM tm JOIN fr USING (run_id, seq, frame) WHERE n <= 96 GROUP BY 1, 2, 3)
 SELECT run_id, seq, stage, duration_ns, CAST(row_number() OVER (PARTITION BY run_id, seq ORDER BY duration_ns DESC, stage) AS INT) AS place,
  frames_omitted FROM s""")
def h1(spark, sf):
    return T.stage_totals(timings(spark, sf))


def summary_sql(source: str, by: str, frames: int = 1) -> str:
    return (f"SELECT {by}, count(*) AS measured_count, min(ns) AS minimum_ns, CAST(floor(median(ns)) AS BIGINT) AS median_ns, "
            f"max(ns) AS maximum_ns, CAST(CAST(floor(median(ns)) AS BIGINT) * 147 // {frames} AS BIGINT) AS extrapolated_147_frames_ns "
            f"FROM {source} GROUP BY {by}")


@query("h2_sample_summary", f"WITH {TIMED} {summary_sql('tm', 'run_id, stage', 3)}")
def h2(spark, sf):
    return T.sample_summary(timings(spark, sf), ("run_id", "stage"), 3)


SAMPLES = """sm AS (SELECT stage, ns FROM tm WHERE NOT reset UNION ALL
  SELECT 'total_input_read', CAST(sum(ns) AS BIGINT) FROM tm WHERE NOT reset AND stage IN ('beauty_read', 'vector_read', 'matte_read')
  GROUP BY run_id, seq, frame HAVING count(*) = 3
  UNION ALL SELECT 'complete_frame', CAST(sum(ns) AS BIGINT) FROM tm WHERE NOT reset GROUP BY run_id, seq, frame)"""


@query("h3_stage_summary", f"WITH {TIMED}, {SAMPLES} {summary_sql('sm', 'stage')}")
def h3(spark, sf):
    return T.stage_summary(timings(spark, sf))


@query("h4_throughput", f"WITH {TIMED}, {SAMPLES}, s AS ({summary_sql('sm', 'stage')}) SELECT stage, median_ns, CAST(99532800 AS BIGINT) AS bytes_per_sample, "
       "CASE WHEN median_ns > 0 THEN CAST(floor(99532800::DOUBLE * 1e9::DOUBLE / median_ns) AS BIGINT) END AS bytes_per_second FROM s")
def h4(spark, sf):
    rates = T.throughput(T.stage_summary(timings(spark, sf)), F.lit(99532800))
    return rates.select("stage", "median_ns", "bytes_per_sample", "bytes_per_second")


@query("h5_before_after", f"""WITH {TIMED}, a AS ({summary_sql("(SELECT * FROM tm WHERE run_id = 'r0')", 'stage')}),
 b AS ({summary_sql("(SELECT * FROM tm WHERE run_id = 'r1')", 'stage')})
 SELECT stage, a.median_ns AS before_ns, b.median_ns AS after_ns,
  CASE WHEN a.median_ns > 0 THEN round((a.median_ns - b.median_ns) * 100 / CAST(a.median_ns AS DOUBLE), 2) END AS median_reduction_percent,
  CASE WHEN b.median_ns > 0 THEN round(a.median_ns / CAST(b.median_ns AS DOUBLE), 2) END AS speedup_multiple FROM a JOIN b USING (stage)""")
def h5(spark, sf):
    rows = timings(spark, sf)
    old, new = (T.sample_summary(rows.where(F.col("run_id") == r), ("stage",)) for r in ("r0", "r1"))
    return T.before_after(old, new, ("stage",))


# --- comparing runs ----------------------------------------------------------------------------------

@query("h6_frame_digest", f"""{EMBEDDED}, rw AS (SELECT seq, frame, y, sha256(string_agg(CAST(CAST(round_even(CAST(r AS DOUBLE) * 1e6::DOUBLE, 0) AS BIGINT) AS VARCHAR), ';' ORDER BY x)) AS d,
  count(*) AS w FROM pix GROUP BY seq, frame, y)
 SELECT seq, frame, sha256('float32' || chr(10) || count(*) || 'x' || max(w) || chr(10) || string_agg(d, chr(10) ORDER BY y)) AS digest FROM rw GROUP BY seq, frame""")
def h6(spark, sf):
    return C.frame_digest(embedded(spark, sf), ("r",))


_A, _B = S.RUNS["trail_full"], S.RUNS["refresh"]


@query("h7_run_equality", f"""{W}, {S.scan_cte(_A, 'a')}, {S.scan_cte(_B, 'b')}
 SELECT seq, frame, count(*) FILTER (d) = 0 AS bit_equal, count(*) FILTER (d) AS differing_pixels, max(e)::DOUBLE AS maximum_absolute_error,
  CAST(0 AS BIGINT) AS unmatched_pixels FROM (SELECT p.seq, p.frame, p.o_r <> q.o_r OR p.o_g <> q.o_g OR p.o_b <> q.o_b OR p.o_a <> q.o_a AS d,
  greatest(abs(p.o_r - q.o_r), abs(p.o_g - q.o_g), abs(p.o_b - q.o_b), abs(p.o_a - q.o_a)) AS e
  FROM {S.keyed('SELECT * FROM sca')} p JOIN {S.keyed('SELECT * FROM scb')} q ON p.pk = q.pk) GROUP BY seq, frame""")
def h7(spark, sf):
    both = pair_scan(spark, sf, "trail_full", "refresh").lines
    a, b = (both.where(F.col("run_id") == run) for run in ("trail_full", "refresh"))
    return C.run_equality(a, b, ("r", "g", "b", "a"), lines=True)


# --- event logs ----------------------------------------------------------------------------------------

def event_log(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


def day(ts):
    return F.datediff(ts.cast("date"), F.lit("2000-01-01").cast("date"))


def intervals(spark, sf):
    kind = F.col("event_type")
    return V.event_intervals(event_log(spark, sf), kind == "signup", kind.isin("purchase", "error"), day(F.col("ts")))


INTERVALS = """iv AS (SELECT s.user_id AS key, s.ts AS start_ts, (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id
  AND e.event_type IN ('purchase', 'error') AND e.ts >= s.ts) AS end_ts FROM events s WHERE s.event_type = 'signup')"""


def micros(*columns):
    return [F.expr(f"unix_micros(CAST({c} AS TIMESTAMP)) AS {c}") for c in columns]


@query("h8_event_intervals", f"""WITH {INTERVALS} SELECT key, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts,
 CASE WHEN end_ts IS NULL THEN 'no terminal event' END AS error FROM iv""")
def h8(spark, sf):
    return intervals(spark, sf).select("key", *micros("start_ts", "end_ts"), "error")


@query("h9_event_in_interval", f"""WITH {INTERVALS} SELECT key, epoch_us(p.ts) AS probe_ts, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts
 FROM iv JOIN events p ON p.user_id = key AND p.event_type = 'view' AND start_ts < p.ts AND p.ts < end_ts""")
def h9(spark, sf):
    probes = event_log(spark, sf).where(F.col("event_type") == "view")
    found = V.event_in_interval(intervals(spark, sf), probes, day, 86400)
    return found.select("key", *micros("probe_ts", "start_ts", "end_ts"))


@query("h10_event_order", """WITH d AS (SELECT user_id * 100 + day(ts) AS key, ts, event_type FROM events),
 c AS (SELECT key, count(*) FILTER (event_type = 'click') AS n_ready, count(*) FILTER (event_type = 'view') AS n_started,
  count(*) FILTER (event_type = 'purchase') AS n_sent, min(ts) FILTER (event_type = 'click') AS a, min(ts) FILTER (event_type = 'view') AS b,
  min(ts) FILTER (event_type = 'purchase') AS c, max(ts) FILTER (event_type = 'error') AS e FROM d GROUP BY key)
 SELECT key, n_ready, n_started, n_sent, n_ready = 1 AND n_started = 1 AND n_sent = 1 AS exactly_one, coalesce(a < b AND b < c, false) AS in_order,
  coalesce(e >= c, false) AS has_evidence FROM c""")
def h10(spark, sf):
    kind = F.col("event_type")
    daily = event_log(spark, sf).withColumn("key", F.col("key") * 100 + F.dayofmonth("ts"))
    return V.event_order(
        daily, {"ready": kind == "click", "started": kind == "view", "sent": kind == "purchase"}, kind == "error")
