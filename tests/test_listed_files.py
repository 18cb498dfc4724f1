"""Folders per session: the files are dealt to all tasks, and a long session in slices."""
import re

import pytest
from pyspark.sql import functions as F

from gazeloom.operators.ordered import chunk_by
from gazeloom.sources import readers, writers


def test_many_small_sessions_come_from_many_tasks(spark, tmp_path):
    tasks = lambda folder: {re.match(r"part-(\d+)", f.name)[1] for f in folder.glob("**/part-*.parquet")}
    t = spark.range(400).select((F.col("id") % 40).alias("session"), F.col("id").cast("double").alias("t"))
    long = spark.range(2000).select(F.lit(99).cast("long").alias("session"), (F.col("id") * 10).cast("double").alias("t"))
    writers.write_sessions(t.unionByName(long), f"{tmp_path}/gaze", chunk_by(F.col("t"), 3600.0))
    assert len(tasks(tmp_path / "gaze")) > 1 < len(tasks(tmp_path / "gaze" / "session=99"))
    assert {r.session for r in readers.listed_sessions(spark, str(tmp_path), ["gaze"]).collect()} == {*map(str, range(40)), "99"}
    assert spark.read.parquet(f"{tmp_path}/gaze").count() == 2400


def test_files_are_written_without_hadoop_and_listed_by_few_tasks(spark, tmp_path):
    """Folders, names, schema and rows are Spark's, for odd sessions too; a listing starts as many tasks as a shuffle."""
    odd = [None, "", "a b", "a/b=c%d", "é", "x[1]{^'\"", "tab\there", *map(str, range(40))]
    t = spark.createDataFrame([(s, k, None if k % 3 else f"{s}{k}") for s in odd for k in range(3)], "session string, n int, v string")
    t = t.select("session", "n", F.col("v").alias("v.1"), F.array("n", F.lit(None)).alias("many"), F.struct("n", "v").alias("pair"), F.timestamp_seconds("n").alias("ts"), F.lit(1.5).cast("decimal(9,2)").alias("price"))
    t.write.partitionBy("session").parquet(f"{tmp_path}/want")
    writers.write_sessions(t, f"{tmp_path}/gaze", F.col("n"))
    folders = lambda name: sorted(f.name for f in (tmp_path / name).glob("session=*"))
    got, want = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("gaze", "want"))
    assert folders("gaze") == folders("want") and got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not [f for f in (tmp_path / "gaze").glob("session=*/*") if not re.fullmatch(r"part-\d{5}-\w+\.snappy\.parquet", f.name)]
    with pytest.raises(FileExistsError):
        writers.write_sessions(t, f"{tmp_path}/gaze", F.col("n"))
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    listed = readers.listed_sessions(spark, str(tmp_path), ["gaze"])
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(k) for k in sc.statusTracker().getJobIdsForGroup("listing")]
    assert jobs and all(sc.statusTracker().getStageInfo(k).numTasks <= 4 for j in jobs for k in j.stageIds)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert listed.count() == len(folders("gaze"))


def test_no_rows_give_a_table_without_sessions(spark, tmp_path):
    writers.write_sessions(spark.range(9).select(F.col("id").alias("session"), "id").where("id < 0"), f"{tmp_path}/gaze", F.col("id"))
    assert readers.listed_sessions(spark, str(tmp_path), ["gaze"]).count() == 0


def test_a_long_session_is_one_file_a_task(spark, tmp_path):
    """More rows than a batch holds."""
    t = spark.range(50_000).select(F.lit(7).alias("session"), "id", F.lit(0).alias("hour"))
    writers.write_sessions(t, f"{tmp_path}/gaze", F.col("hour"))
    assert len([*(tmp_path / "gaze" / "session=7").iterdir()]) == 1
    assert spark.read.parquet(f"{tmp_path}/gaze").selectExpr("count(distinct id)", "sum(id)").first() == (50_000, 50_000 * 49_999 // 2)
