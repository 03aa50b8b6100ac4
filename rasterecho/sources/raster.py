"""Tables to rasters and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """The frames and the size every sequence is drawn on."""

    first_frame: int
    last_frame: int
    height: int
    width: int


def rasterize(facts: DataFrame, grid: Grid, measures: dict[str, Column], channels: dict[str, Column]) -> DataFrame:
    """Draw fact rows on a dense grid.

    ``facts`` has seq, frame, y, x; ``measures`` aggregates facts per pixel (absent = 0) and
    ``channels`` turns the measures into pixel columns. A cell that many facts fall on is combined before
    the shuffle. The drawn cells then meet the lines of the grid, and each line gets the cells it lacks from its
    own row, so there is no grid join, and the empty grid is neither shuffled nor aggregated pixel by pixel.
    """
    line = ("seq", "frame", "y")
    kept = facts.where(
        F.col("frame").between(grid.first_frame, grid.last_frame)
        & F.col("y").between(0, grid.height - 1) & F.col("x").between(0, grid.width - 1)
    )
    hits = kept.groupBy(*line, "x").agg(*[c.alias(n) for n, c in measures.items()])
    # The types of sums, so that narrow measures do not run over in the channels.
    types = {f.name: f.dataType for f in hits.agg(*[F.sum(n).alias(n) for n in measures]).schema}
    zeros = [F.lit(0).cast(t).alias(n) for n, t in types.items()]
    held = [F.coalesce(F.col(n).cast(t), F.lit(0).cast(t)).alias(n) for n, t in types.items()]
    drawn = hits.select(*line, F.struct(F.col("x").cast("int").alias("x"), *held).alias("_c"))
    # Few names make many lines: a fixed number of tasks, which are not merged as the names are small, makes them.
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = (
        facts.select("seq").distinct()
        .select("seq", F.explode(F.sequence(F.lit(grid.first_frame), F.lit(grid.last_frame))).alias("frame"))
        .repartition(tasks, "seq", "frame")
        .select("seq", "frame", F.explode(F.sequence(F.lit(0), F.lit(grid.height - 1))).alias("y"))
        .withColumn("_c", F.lit(None).cast(drawn.schema["_c"].dataType))
    )
    lines = drawn.unionByName(empty).groupBy(*line).agg(F.collect_list("_c").alias("_c"))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(grid.width - 1)), F.col("_c.x"))
    blank = F.transform(missing, lambda x: F.struct(x.alias("x"), *zeros))
    cells = lines.select(*line, F.inline(F.concat("_c", blank)))
    return cells.select(*line, "x", *[c.alias(n) for n, c in channels.items()])


def off_grid(facts: DataFrame, grid: Grid) -> DataFrame:
    """How many facts ``rasterize`` cannot place, by reason."""
    reason = (
        F.when(~F.coalesce(F.col("frame").between(grid.first_frame, grid.last_frame), F.lit(False)), "frame outside the grid")
        .when(~F.coalesce(F.col("y").between(0, grid.height - 1), F.lit(False)), "row outside the grid")
        .when(~F.coalesce(F.col("x").between(0, grid.width - 1), F.lit(False)), "column outside the grid")
    )
    return facts.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("facts"))


def matte_red(px: DataFrame) -> DataFrame:
    """Matte coverage is the red channel of a raster."""
    return px.select("seq", "frame", "y", "x", F.col("r").alias("m"))


def orient(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Bottom-left rows to top-left rows, or back; ``frames`` has seq, frame, h."""
    return px.join(frames.select("seq", "frame", "h"), ["seq", "frame"]).withColumn(
        "y", F.col("h") - 1 - F.col("y")
    ).drop("h")


def array_to_raster(rows: DataFrame, array: str, width: int) -> DataFrame:
    """One pixel per array element, row-major; other columns are kept."""
    kept = [c for c in rows.columns if c != array]
    flat = rows.select(*kept, F.posexplode(array).alias("_i", "r"))
    return flat.select(
        *kept, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).alias("x"), "r"
    )


def raster_to_array(px: DataFrame, keys: tuple[str, ...], value: str, alias: str) -> DataFrame:
    """A12 back: the values of each raster in row-major order."""
    packed = px.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", value))).alias("_p"))
    return packed.select(*keys, F.col(f"_p.{value}").alias(alias))
