"""Event logs (H8-H10). Keys may be hot: windows run inside (key, time bucket), never over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_intervals(events: DataFrame, is_start: Column, is_terminal: Column, bucket: Column) -> DataFrame:
    """H8: each start event with the first terminal event of its key at or after it.

    ``events``: key, ts. ``bucket`` is a whole number that grows with ts, such as the day. The next
    terminal is looked up inside the bucket; only starts without one look at the later buckets, through a
    table of one row per key and bucket.
    """
    marked = events.select("key", "ts", bucket.alias("_b"), is_start.alias("_start"), is_terminal.alias("_end"))
    marked = marked.where(F.col("_start") | F.col("_end"))
    end_ts = F.when(F.col("_end"), F.col("ts"))
    onward = Window.partitionBy("key", "_b").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    inside = marked.withColumn("_here", F.min(end_ts).over(onward)).where("_start")
    firsts = marked.groupBy("key", "_b").agg(F.min(end_ts).alias("_first"))
    later = Window.partitionBy("key").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    next_bucket = firsts.select("key", "_b", F.min("_first").over(later).alias("_later"))
    joined = inside.join(next_bucket, ["key", "_b"])
    end = F.coalesce("_here", "_later")
    return joined.select(
        "key", F.col("ts").alias("start_ts"), end.alias("end_ts"),
        F.when(end.isNull(), F.lit("no terminal event")).alias("error"),
    )


def event_in_interval(intervals: DataFrame, probes: DataFrame, bucket, width: int) -> DataFrame:
    """H9: probe events strictly inside an interval of their key.

    ``bucket(ts)`` is a whole number per ``width`` seconds. An interval is copied to each bucket it
    touches and meets probes of that bucket only.
    """
    spread = intervals.where(F.col("end_ts").isNotNull()).select(
        "key", "start_ts", "end_ts", F.explode(F.sequence(bucket(F.col("start_ts")), bucket(F.col("end_ts")))).alias("_b")
    )
    at = probes.select("key", F.col("ts").alias("probe_ts"), bucket(F.col("ts")).alias("_b"))
    return at.join(spread, ["key", "_b"]).where(
        (F.col("start_ts") < F.col("probe_ts")) & (F.col("probe_ts") < F.col("end_ts"))
    ).select("key", "probe_ts", "start_ts", "end_ts")


def event_order(events: DataFrame, markers: dict[str, Column], evidence: Column) -> DataFrame:
    """Per key, that each marker occurs once, that they occur in the given order, and that evidence follows.

    ``markers`` are named conditions in their required order; ``evidence`` must hold at or after the
    last marker.
    """
    names = list(markers)
    first = events.groupBy("key").agg(
        *[F.count_if(c).alias(f"n_{n}") for n, c in markers.items()],
        *[F.min(F.when(c, F.col("ts"))).alias(f"t_{n}") for n, c in markers.items()],
        F.max(F.when(evidence, F.col("ts"))).alias("_evidence"),
    )
    once, ordered = F.lit(True), F.lit(True)
    for n in names:
        once = once & (F.col(f"n_{n}") == 1)
    for a, b in zip(names, names[1:]):
        ordered = ordered & (F.col(f"t_{a}") < F.col(f"t_{b}"))
    followed = F.col("_evidence") >= F.col(f"t_{names[-1]}")
    return first.select(
        "key", *[f"n_{n}" for n in names], once.alias("exactly_one"),
        F.coalesce(ordered, F.lit(False)).alias("in_order"), F.coalesce(followed, F.lit(False)).alias("has_evidence"),
    )
