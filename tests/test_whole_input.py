"""No fact and no sequence is lost on the way."""

import os

import pytest
from pyspark.sql import functions as F

from rasterecho.model import PX_SCHEMA, run_row
from rasterecho.plans.scan import feedback_scan
from rasterecho.sources.raster import Grid, off_grid, rasterize
from rasterecho.suite.fixtures import FRAMES, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_line_item_has_a_frame(spark):
    frames = table(spark, SF, "lineitem").select((F.year("l_shipdate") - 1994).alias("frame"))
    assert frames.where(~F.col("frame").between(1, FRAMES)).count() == 0


def test_facts_off_the_grid_are_reported(spark):
    facts = spark.createDataFrame([("s", 1, 0, 0), ("s", 1, 0, 0), ("s", 3, 0, 0), ("s", 1, 9, 0), ("s", 1, 0, -1), ("s", None, 0, 0)], "seq string, frame int, y int, x int")
    grid = Grid(1, 2, 2, 2)
    lost = {r.reason: r.facts for r in off_grid(facts, grid).collect()}
    assert lost == {"frame outside the grid": 2, "row outside the grid": 1, "column outside the grid": 1}
    drawn = rasterize(facts, grid, {"n": F.count(F.lit(1))}, {"n": F.col("n")}).agg(F.sum("n")).first()[0]
    assert drawn + sum(lost.values()) == facts.count()


def test_nothing_to_scan(spark):
    result = feedback_scan(spark.createDataFrame([], PX_SCHEMA), [run_row("a")])
    assert result.waves == 0 and result.lines.count() == 0 and result.failures.count() == 0
