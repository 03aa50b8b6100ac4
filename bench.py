"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rasterecho-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    from rasterecho.model import EXTREME, assign_runs, run_row
    from rasterecho.operators.blocks import prepare_blocks
    from rasterecho.plans.scan import feedback_scan
    from rasterecho.plans.workspace import stored
    from rasterecho.suite import load
    from rasterecho.suite.fixtures import FRAMES, raster

    queries = load().QUERIES
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        out = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    px = timed("a11_rasterize", lambda: stored(raster(spark, sf, 60, 68), "px"))
    pixels = px.count()
    extreme = run_row("extreme", **EXTREME)
    hard = run_row("hard", history_source="FULL_FRAME", block_size=32)
    jobs = assign_runs(px, [extreme])
    timed("c8_prepare_blocks", lambda: run(prepare_blocks(px.join(jobs, "seq"))))
    scan = timed("f4_scan_extreme", lambda: feedback_scan(px, [extreme]))
    timed("i1_frame_diag", lambda: run(scan.diagnostics()))
    timed("f4_scan_hard", lambda: feedback_scan(px, [hard], counters=False))
    resets = px.select("seq").distinct().select("seq", F.explode(F.array(F.lit(3), F.lit(5))).alias("frame"))
    timed("f4_scan_resets", lambda: feedback_scan(px, [extreme], resets, counters=False))
    for name in ("d2_bilinear_rgba", "g2_fingerprint", "h3_stage_summary", "h8_event_intervals", "i6_checkpoint_rows",
                 "b7_settings_check", "h6_frame_digest"):
        timed(name, lambda name=name: run(queries[name](spark, sf)))

    total = round(sum(seconds.values()), 3)
    recursive = pixels * (FRAMES - 1) // FRAMES
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "pixels": pixels,
        "scan_pixels_per_second": round(recursive / seconds["f4_scan_extreme"]),
        "seconds_per_wave": round(seconds["f4_scan_extreme"] / scan.waves, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
