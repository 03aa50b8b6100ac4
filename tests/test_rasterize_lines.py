"""The empty grid is made from lines, not from pixels that one task would hold."""

from pyspark.sql import functions as F

from rasterecho.sources.raster import Grid, rasterize


def test_same_cells_with_gaps_and_null_measures(spark):
    rows = [("a", 1, 0, 0, 5), ("a", 1, 0, 0, 6), ("a", 2, 1, 2, None), ("b", 9, 0, 0, 1), (None, 1, 1, 1, 4), ("a", 1, 0, 7, 3)]
    facts = spark.createDataFrame(rows, "seq string, frame int, y int, x int, q int")
    measures = {"q": F.sum("q"), "n": F.count("*"), "top": F.max("q")}
    out = rasterize(facts, Grid(1, 2, 2, 3), measures, {n: F.col(n) for n in measures})
    assert [out.schema[c].dataType.simpleString() for c in measures] == ["bigint"] * 3
    got = {tuple(r)[:4]: tuple(r)[4:] for r in out.collect()}
    want = {(s, f, y, x): (0, 0, 0) for s in ("a", "b", None) for f in (1, 2) for y in (0, 1) for x in (0, 1, 2)}
    want |= {("a", 1, 0, 0): (11, 2, 6), ("a", 2, 1, 2): (0, 1, 0), (None, 1, 1, 1): (4, 1, 4)}
    assert got == want and out.count() == len(want)


def test_no_pixel_of_the_empty_grid_is_aggregated(spark):
    """Below the last aggregation the grid is made down to its lines; before, every pixel of it went in, in one task."""
    facts = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 0)], "seq string, frame int, y int, x int")
    drawn = rasterize(facts, Grid(1, 10, 20, 500), {"n": F.count("*")}, {"n": F.col("n")})
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):].splitlines()
    assert any("Generate" in row and "[y#" in row for row in below)
    assert not any("Generate" in row and "[x#" in row for row in below)
    assert drawn.count() == 2 * 10 * 20 * 500
