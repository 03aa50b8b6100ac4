"""Motion decoding and the coarse block grid.

Nothing here is recursive: all frames of all runs are reduced in one aggregation, with partial sums
before the shuffle, so a frame or sequence that holds most of the pixels spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import with_unit_random
from ..model import FLOAT_MAX, FLOAT_TINY, f32

BLOCK_KEYS = ("run_id", "seq", "frame", "by", "bx")
DIFFUSE_X, DIFFUSE_Y, REFRESH = 0, 1, 2
#: Settings that say how pixels are reduced to blocks, and those that are applied to the blocks.
MOTION_SETTINGS = ("block_size", "motion_channels", "reverse_motion", "flip_x", "flip_y", "motion_gain", "motion_clamp")
BLOCK_SETTINGS = ("motion_quantization", "diffusion", "refresh_probability", "seed")


def clip_float(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(FLOAT_MAX)), F.lit(-FLOAT_MAX)).cast("float")


def motion_decode(px: DataFrame) -> DataFrame:
    """Add ``ux, uy`` (double) from the chosen channel pair, reversed and flipped as set."""
    rg = F.col("motion_channels") == "RG"
    reverse = F.when(F.col("reverse_motion"), F.lit(-1.0)).otherwise(F.lit(1.0))
    flip_x = F.when(F.col("flip_x"), F.lit(-1.0)).otherwise(F.lit(1.0))
    flip_y = F.when(F.col("flip_y"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return px.withColumns(
        {
            "ux": F.when(rg, F.col("vr")).otherwise(F.col("vb")).cast("double") * reverse * flip_x,
            "uy": F.when(rg, F.col("vg")).otherwise(F.col("va")).cast("double") * reverse * flip_y,
        }
    )


def motion_clamp(px: DataFrame) -> DataFrame:
    """Add ``du, dv`` (float): gain applied, length held to the clamp, direction kept."""
    length = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"))
    limit = F.least(F.col("motion_clamp"), F.lit(FLOAT_MAX))
    scale = F.when(length > 0, F.least(F.col("motion_gain"), limit / length)).otherwise(F.col("motion_gain"))
    return px.withColumn("_scale", scale).withColumns(
        {
            "du": (F.col("ux") * F.col("_scale")).cast("float"),
            "dv": (F.col("uy") * F.col("_scale")).cast("float"),
        }
    ).drop("_scale")


def with_block(df: DataFrame) -> DataFrame:
    """Block coordinates. A block larger than the frame needs no special case: its index is 0."""
    size = F.col("block_size")
    return df.withColumns(
        {"by": F.floor(F.col("y") / size).cast("int"), "bx": F.floor(F.col("x") / size).cast("int")}
    )


def block_mean(px: DataFrame, carry: tuple[str, ...] = (), keys: tuple[str, ...] = BLOCK_KEYS) -> DataFrame:
    """Matte-weighted mean ``dx, dy`` per block; ``carry`` names columns constant per run."""
    weight = F.col("m").cast("double")
    sums = with_block(px).groupBy(*keys, *carry).agg(
        F.sum(weight).alias("_w"),
        F.sum(F.col("du").cast("double") * weight).alias("_sx"),
        F.sum(F.col("dv").cast("double") * weight).alias("_sy"),
    )

    def mean(total: str) -> Column:
        return F.when(F.col("_w") > 0, F.col(total) / F.col("_w")).otherwise(F.lit(0.0)).cast("float")

    return sums.select(*keys, *carry, mean("_sx").alias("dx"), mean("_sy").alias("dy"))


def block_quantize(blocks: DataFrame) -> DataFrame:
    """C4: round ``dx, dy`` half-even to a multiple of the step; a step below the smallest float is off."""
    step = F.col("motion_quantization")

    def rounded(name: str) -> Column:
        exact = F.rint(F.col(name).cast("double") / step) * step
        return F.when(step >= FLOAT_TINY, clip_float(exact)).otherwise(F.col(name))

    return blocks.withColumns({"dx": rounded("dx"), "dy": rounded("dy")})


def block_diffuse(blocks: DataFrame) -> DataFrame:
    """Jitter each axis by up to ``diffusion`` either way."""
    drawn = with_unit_random(blocks, {"_ux": DIFFUSE_X, "_uy": DIFFUSE_Y})

    def jittered(name: str, unit: str) -> Column:
        moved = F.col(name).cast("double") + (F.lit(2.0) * F.col(unit) - F.lit(1.0)) * F.col("diffusion")
        return F.when(F.col("diffusion") > 0, clip_float(moved)).otherwise(F.col(name))

    return drawn.withColumns({"dx": jittered("dx", "_ux"), "dy": jittered("dy", "_uy")}).drop("_ux", "_uy")


def block_refresh(blocks: DataFrame) -> DataFrame:
    """Add ``refresh``, true for the blocks that return to clean pixels."""
    drawn = with_unit_random(blocks, {"_u": REFRESH})
    chosen = (F.col("refresh_probability") > 0) & (F.col("_u") < F.col("refresh_probability"))
    return drawn.withColumn("refresh", chosen).drop("_u")


def prepare_blocks(px_jobs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Displacement and refresh per block for every frame.

    ``px_jobs`` is ``px`` joined with the jobs table: pixels, ``run_id`` and the settings.
    """
    moved = motion_clamp(motion_decode(px_jobs))
    blocks = block_refresh(block_diffuse(block_quantize(block_mean(moved, (*BLOCK_SETTINGS, *carry)))))
    return blocks.select(*BLOCK_KEYS, *carry, "dx", "dy", "refresh")


def prepare_blocks_once(px: DataFrame, jobs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """C8 for many runs: pixels are reduced once for each distinct way of reading motion, not once for each run.

    ``jobs``: run_id, seq, frame, the settings and ``carry``. Runs that read motion alike share the block means of a frame; what else
    they set (steps, jitter, refresh) is applied to the blocks.
    """
    ways = jobs.select("seq", "frame", *MOTION_SETTINGS).distinct()
    moved = motion_clamp(motion_decode(px.join(ways, ["seq", "frame"])))
    means = block_mean(moved, MOTION_SETTINGS, ("seq", "frame", "by", "bx"))
    mine = jobs.select(*{*("run_id", "seq", "frame"), *MOTION_SETTINGS, *BLOCK_SETTINGS, *carry})
    blocks = block_refresh(block_diffuse(block_quantize(means.join(mine, ["seq", "frame", *MOTION_SETTINGS]))))
    return blocks.select(*BLOCK_KEYS, *carry, "dx", "dy", "refresh")


def expand_blocks(px_jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block values back on the pixels; needs ``block_size`` on the pixel side."""
    return with_block(px_jobs).join(blocks, list(BLOCK_KEYS))


def sample_position(df: DataFrame) -> DataFrame:
    """Where each pixel reads the previous frame: ``sx, sy`` (float)."""
    return df.withColumns({"sx": f32(F.col("x")) - F.col("dx"), "sy": f32(F.col("y")) - F.col("dy")})
