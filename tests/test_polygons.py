"""Polygons are computed once a row, whatever their edges."""
from pyspark.sql import functions as F

from gazeloom.functions import scalar as S


def test_polygons_are_computed_once(spark):
    square = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]
    rows = [(0, 0.5, 0.5, square), (1, 0.2, 0.5, square), (2, 0.81, 0.5, square), (3, 0.9, 0.5, square), (4, 0.5, 0.5, None), (5, None, 0.5, square), (6, 0.5, 0.5, [])]
    df = spark.createDataFrame(rows, "id int, x double, y double, p array<struct<x: double, y: double>>")
    x, y, p = F.col("x"), F.col("y"), F.col("p")
    grown = S.point_in_polygon(x, y, S.scale_polygon(p))
    got = df.select("id", S.point_in_polygon(x, y, p).alias("a"), grown.alias("b"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [
        (0, True, True), (1, True, True), (2, False, True), (3, False, False), (4, False, False), (5, None, None), (6, False, False)]
    plan = df.select(grown.alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 2  # one mean for each axis
