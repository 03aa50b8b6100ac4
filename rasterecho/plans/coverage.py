"""Trail coverage by a parallel prefix (F3, F8), for runs whose coverage stays in its place.

Where a whole-frame trail mixes in no motion, a frame turns coverage K into max(M, decay * K). Such maps compose: after n frames a
coverage is the largest of every earlier matte, decayed once for each frame since. Decaying is monotone, also when each product is
rounded to single precision, so the largest may be taken in any grouping and the result is that of the frames one after another, bit for
bit. A round joins each line with the one 2^k frames before it, so a segment of n frames takes log2(n) rounds instead of n waves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.step import KEY


def stays_in_place() -> Column:
    """Runs whose coverage needs no gather."""
    return (F.col("mode") == "TRAIL") & (F.col("history_source") == "FULL_FRAME") & (F.col("trail_motion_mix") == 0)


def decayed(value: str, times: int) -> str:
    """SQL: a coverage decayed so many times, rounded each time."""
    return f"aggregate(sequence(1, {times}), {value}, (v, i) -> CAST(trail_decay AS FLOAT) * v)"


def prefix_rounds(lines: DataFrame, longest: int, write) -> DataFrame:
    """The coverage of all lines after all frames before them in their segment.

    ``lines``: KEY, pos, y, trail_decay, k (the line's own matte), and what else is to be kept. ``longest``: frames of the longest
    segment. ``write(df, name)`` writes a table and reads it back, so that each round starts from files.
    """
    step = 1
    while step < longest:
        before = lines.select(*KEY, "y", (F.col("pos") + step).alias("pos"), F.col("k").alias("_before"))
        mixed = f"zip_with(k, _before, (a, b) -> greatest(a, {decayed('b', step)}))"
        joined = lines.join(before, [*KEY, "y", "pos"], "left")
        lines = write(joined.withColumn("k", F.when(F.col("_before").isNull(), F.col("k")).otherwise(F.expr(mixed))).drop("_before"), f"round={step}")
        step *= 2
    return lines
