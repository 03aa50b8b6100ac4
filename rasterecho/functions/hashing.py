"""Deterministic unit random numbers per (seed, frame, block, stream) from built-in bigint operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The odd multipliers and the increment of the 64-bit mix.
MIX = {
    "frame": 0xD6E8FEB86659FD93,
    "block_y": 0xA5A3564E27F8862F,
    "block_x": 0x9E3779B97F4A7C15,
    "stream": 0x94D049BB133111EB,
    "increment": 0x9E3779B97F4A7C15,
    "first": 0xBF58476D1CE4E5B9,
    "second": 0x94D049BB133111EB,
}


def signed64(value: int) -> int:
    """The two's complement bigint of an unsigned 64-bit number."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >= 1 << 63 else value


@contextmanager
def wrapping_bigint(df: DataFrame) -> Iterator[None]:
    """Let bigint products wrap while a select is analysed, then restore the caller's ANSI mode.

    Spark fixes the overflow mode of an expression when the plan is analysed, so the session
    setting only has to be off while the DataFrame is being built.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        conf.set("spark.sql.ansi.enabled", before)


def _const(name: str) -> Column:
    return F.lit(signed64(MIX[name])).cast("bigint")


def _xorshift(column: Column, bits: int) -> Column:
    return column.bitwiseXOR(F.shiftrightunsigned(column, bits))


def with_unit_random(df: DataFrame, streams: dict[str, int]) -> DataFrame:
    """Add one double in [0, 1) per requested stream.

    Needs columns ``seed, frame, by, bx``. Each mixing round is its own projection, so the
    expression stays linear in size.
    """
    kept = df.columns
    with wrapping_bigint(df):
        base = (
            F.col("seed").cast("bigint")
            .bitwiseXOR(F.col("frame").cast("bigint") * _const("frame"))
            .bitwiseXOR(F.col("by").cast("bigint") * _const("block_y"))
            .bitwiseXOR(F.col("bx").cast("bigint") * _const("block_x"))
        )
        start = {
            name: base.bitwiseXOR(F.lit(signed64(stream * MIX["stream"]))) + _const("increment")
            for name, stream in streams.items()
        }
        out = df.select(*kept, *[c.alias(n) for n, c in start.items()])
        for bits, factor in ((30, "first"), (27, "second")):
            out = out.select(*kept, *[(_xorshift(F.col(n), bits) * _const(factor)).alias(n) for n in streams])
        return out.select(
            *kept,
            *[
                (F.shiftrightunsigned(_xorshift(F.col(n), 31), 11).cast("double") * F.lit(2.0**-53)).alias(n)
                for n in streams
            ],
        )
