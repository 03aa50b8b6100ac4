"""H7 on lines: raster rows of two runs meet, and their pixels are compared where they met."""

from rasterecho.operators import compare, step


def test_run_equality_of_lines(spark):
    """Lines give what their pixels give, with lines and places that one side lacks; no pixel is moved."""
    schema = "seq string, frame int, y int, r array<float>, g array<float>"
    nan = float("nan")
    a = spark.createDataFrame([("s", 1, 0, [0.5, nan], [1.0, 2.0]), ("s", 1, 1, [0.0], [3.0]), ("s", 2, 0, [1.0, 2.0], [1.0, 2.0])], schema)
    b = spark.createDataFrame([("s", 1, 0, [0.5, nan], [1.0, 2.5]), ("s", 2, 0, [1.0], [1.0]), ("t", 1, 0, [1.0], [None])], schema)
    got = compare.run_equality(a, b, ("r", "g"), lines=True)
    pixels = [step.unpack_lines(df, {"r": "r", "g": "g"}, ("seq", "frame")) for df in (a, b)]
    order = ["seq", "frame"]
    assert str(got.orderBy(order).collect()) == str(compare.run_equality(*pixels, ("r", "g")).orderBy(order).collect())
    assert [(r.bit_equal, r.differing_pixels, r.unmatched_pixels) for r in got.orderBy(order).collect()] == [(False, 2, 1), (False, 1, 1), (False, 1, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
