"""Rasters, runs and catalogs drawn from the given tables, in Spark and in SQL.

Every raster has more sequences the larger the tables are; values are multiples of 1/256 or 1/4, so
weighted block sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raster import Grid, rasterize

# One frame for each of the seven ship years of the line items.
HEIGHT, WIDTH, FRAMES, BLOCK = 30, 34, 7, 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raster(spark: SparkSession, sf: str, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """The main raster: line items placed by key, one sequence per flags and supplier group."""
    li = table(spark, sf, "lineitem")
    seq = F.concat_ws(
        "-", F.concat("l_returnflag", "l_linestatus"), F.floor(F.col("l_suppkey") / 25).cast("string")
    )
    facts = li.select(
        seq.alias("seq"),
        (F.year("l_shipdate") - 1994).cast("int").alias("frame"),
        ((F.col("l_orderkey") + F.col("l_linenumber") * 11) % height).cast("int").alias("y"),
        ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % width).cast("int").alias("x"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_orderkey").cast("bigint").alias("k"),
    )
    q, k, n, x, y = (F.col(c) for c in ("q", "k", "n", "x", "y"))

    def share(value: Column, unit: float) -> Column:
        return (value * F.lit(unit)).cast("float")

    channels = {
        "r": share((q * 7 + x * 3 + y) % 256, 1 / 256),
        "g": share((k + x) % 256, 1 / 256),
        "b": share((n * 37 + y * 5) % 256, 1 / 256),
        "a": F.lit(1.0).cast("float"),
        "vr": share((k + x) % 9 - 4, 0.5),
        "vg": share((k + y) % 7 - 3, 0.5),
        "vb": share((q + x) % 5 - 2, 0.75),
        "va": share((q + y) % 11 - 5, 0.25),
        "m": share(F.least(n % 5, F.lit(4)), 0.25),
    }
    measures = {"q": F.sum("q"), "n": F.count(F.lit(1)), "k": F.sum("k")}
    return rasterize(facts, Grid(1, FRAMES, height, width), measures, channels)


RASTER_CTE = f"""
li AS (SELECT l_returnflag || l_linestatus || '-' || CAST(CAST(floor(l_suppkey / 25) AS BIGINT) AS VARCHAR) AS seq,
              CAST(year(l_shipdate) - 1994 AS INT) AS frame,
              CAST((l_orderkey + l_linenumber * 11) % {HEIGHT} AS INT) AS y,
              CAST((l_partkey * 3 + l_suppkey) % {WIDTH} AS INT) AS x,
              CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey AS BIGINT) AS k FROM lineitem),
ag AS (SELECT seq, frame, y, x, CAST(sum(q) AS BIGINT) AS q, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k
       FROM li WHERE frame BETWEEN 1 AND {FRAMES} GROUP BY seq, frame, y, x),
gr AS (SELECT s.seq, CAST(f.range AS INT) AS frame, CAST(yy.range AS INT) AS y, CAST(xx.range AS INT) AS x
       FROM (SELECT DISTINCT seq FROM li) s, range(1, {FRAMES + 1}) f, range({HEIGHT}) yy, range({WIDTH}) xx),
dn AS (SELECT gr.seq, gr.frame, gr.y, gr.x, coalesce(q, 0) AS q, coalesce(n, 0) AS n, coalesce(k, 0) AS k
       FROM gr LEFT JOIN ag ON gr.seq = ag.seq AND gr.frame = ag.frame AND gr.y = ag.y AND gr.x = ag.x),
px AS MATERIALIZED (SELECT seq, frame, y, x,
  CAST(((q * 7 + x * 3 + y) % 256) / CAST(256 AS DOUBLE) AS FLOAT) AS r,
  CAST(((k + x) % 256) / CAST(256 AS DOUBLE) AS FLOAT) AS g,
  CAST(((n * 37 + y * 5) % 256) / CAST(256 AS DOUBLE) AS FLOAT) AS b,
  CAST(1 AS FLOAT) AS a,
  CAST(((k + x) % 9 - 4) * CAST(0.5 AS DOUBLE) AS FLOAT) AS vr,
  CAST(((k + y) % 7 - 3) * CAST(0.5 AS DOUBLE) AS FLOAT) AS vg,
  CAST(((q + x) % 5 - 2) * CAST(0.75 AS DOUBLE) AS FLOAT) AS vb,
  CAST(((q + y) % 11 - 5) * CAST(0.25 AS DOUBLE) AS FLOAT) AS va,
  CAST(least(n % 5, 4) / CAST(4 AS DOUBLE) AS FLOAT) AS m
FROM dn)"""
