"""Derived views are written where their last step leaves them."""
from pyspark.sql import functions as F

from gazeloom.plans import views as V


def test_a_stored_view_is_not_shuffled_into_ranges(spark, tmp_path, monkeypatch):
    rows = [(k % 90, k % 7, k, k % 3, float(k % 11), (k % 10) / 100) for k in range(900)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))

    def refuse(*args):
        raise AssertionError("all columns shuffled once more")
    monkeypatch.setattr(type(li), "repartitionByRange", refuse)
    f = V.fs(spark, str(tmp_path))
    per = f.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("d"), F.max("frame").alias("top")).collect()
    assert sorted((r.session, r.n, r.d, r.top) for r in per) == [(s, 300, 300, 299) for s in range(3)]
