"""Streams against the batch job, with input in any order."""
import random

import pytest
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.operators import fixations as X
from gazeloom.operators import segmentation as G
from gazeloom.plans import signals as Z
from gazeloom.sources import readers
from gazeloom.streaming import streams as T
from gazeloom.streaming.fixations import fixation_stream
from gazeloom.streaming.segmentation import segment_stream

SF = "/root/testdata/sf0.001"


def deliver(spark, folder, df, parts, seconds):
    """``df`` in ``parts`` deliveries that each mix all others' times, then a row of session -1 long after; a trigger per file."""
    for k in range(parts):
        df.where(F.pmod(F.xxhash64("session", "ts"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(folder)
    df.limit(1).withColumns({"session": F.lit(-1).cast(df.schema["session"].dataType), "ts": F.timestamp_micros(F.lit(int(seconds * 1e6)))}).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("parts", [1, 5])
def test_fixations_of_shuffled_triggers(spark, tmp_path, parts):
    r = random.Random(parts)
    rows = []
    for s in range(4):
        x = 0.0
        for n in range(150):
            x += r.choice([0.0, 0.0, 0.0, 0.005, 0.3])
            rows.append((s, n, n // 3, x, r.random() * 0.01))
    df = spark.createDataFrame(rows, "session int, n int, frame int, x double, y double").withColumn("ts", F.timestamp_micros((F.col("n") * 20_000 + 1_000_000).cast("bigint")))
    stream = deliver(spark, str(tmp_path / "in"), df, parts, 3600)
    out, query = T.run_to_table(fixation_stream(stream, dispersion=0.05, minimum=4, idle_ms=5_000), "fixations")
    cols = ["session", "start_n", "end_n", "start_frame", "end_frame", "samples"]
    want = X.idt_fixations(df, ["session"], dispersion=0.05, minimum=4).select(cols)
    assert sorted(map(tuple, out.where("session <> -1").select(cols).collect())) == sorted(map(tuple, want.collect()))
    assert sum(p.numInputRows > 0 for p in query.recentProgress) >= parts


def test_trials_of_shuffled_triggers(spark, tmp_path):
    one = [r.session for r in Z.varied(spark, SF).select("session").distinct().limit(3).collect()]
    f = Z.varied(spark, SF).where(F.col("session").isin(one))
    df = f.withColumn("ts", F.timestamp_micros((F.col("frame") * 33_333 + 1_000_000).cast("bigint")))
    stream = deliver(spark, str(tmp_path / "in"), df, 5, 7200)
    out, query = T.run_to_table(segment_stream(stream, C.plan_rows(), delay="1 hour"), "trials")
    cols = ["session", "block", "trial", "name", "status", "init", "end", "touch_live", "hand_exit_live", "n_watched", "max_ft"]
    assert sorted(map(str, out.where("session <> -1").select(cols).collect())) == sorted(map(str, G.segment_trials(f, C.plan_rows()).select(cols).collect()))
    assert sum(p.numInputRows > 0 for p in query.recentProgress) >= 5


def test_bucketed_alignment(spark):
    """Frames longer than a bucket, at its edges, and next to each other; a sample is held against its bucket's frames only."""
    at = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("bigint"))
    starts = [0.0, 1.0, 10.0, 10.5, 20.0, 75.0, 75.25, 300.0]
    frames = spark.createDataFrame([("s", k, a, b) for k, (a, b) in enumerate(zip(starts, [*starts[1:], 305.0]))], "session string, frame int, a double, b double").select("session", "frame", at("a").alias("start"), at("b").alias("next"))
    times = [0.0, 0.5, 9.999, 10.0, 10.5, 19.9, 20.0, 29.9, 30.0, 74.9, 75.0, 299.9, 304.9, 305.0, 400.0]
    gaze = spark.createDataFrame([("s", t) for t in times], "session string, t double").withColumn("ts", at("t"))
    got = T.align(gaze, frames, longest="10 seconds")
    want = [(t, max(k for k, a in enumerate(starts) if a <= t)) for t in times if t < 305.0]
    assert sorted((r.t, r.frame) for r in got.collect()) == want
    pieces = T._in_buckets(frames, "start", "next", "10 seconds").withColumnRenamed("session", "_s")
    slots = gaze.withColumn("_slot", T._bucket(F.unix_micros("ts"), "10 seconds"))
    met = slots.join(pieces, (F.col("session") == F.col("_s")) & (F.col("_slot") == F.col("_bucket")))
    most = pieces.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert met.groupBy("t").count().agg(F.max("count")).first()[0] <= most < len(starts) and met.count() < len(times) * 3


def test_bucketed_cleaning(spark, tmp_path):
    """Blinks over several buckets, of no length, and ending at a bucket's edge."""
    at = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("bigint"))
    blinks = spark.createDataFrame([("s", 5.0, 5.5), ("s", 10.0, 35.0), ("s", 40.0, 40.0), ("s", 44.0, 50.0), ("z", 990.0, 991.0)], "session string, a double, b double").select("session", at("a").alias("start"), at("b").alias("end"))
    times = [4.9, 5.0, 5.5, 5.6, 10.0, 20.0, 29.9, 30.0, 35.0, 35.1, 40.0, 40.1, 50.0, 50.1]
    gaze = spark.createDataFrame([("s", t, 0.9) for t in times] + [("s", 41.0, 0.1), ("z", 1000.0, 0.9)], "session string, t double, confidence double").withColumn("ts", at("t"))
    stream = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))[1]
    out, _ = T.run_to_table(T.clean(stream(gaze, "gaze"), stream(blinks, "blinks"), longest="10 seconds"), "cleaned")
    assert sorted(r.t for r in out.where("session = 's'").collect()) == [4.9, 5.6, 35.1, 40.1, 50.1]


def test_listed_sessions(spark, tmp_path):
    root = str(tmp_path / "rec")
    df = spark.createDataFrame([(s, 1) for s in ("a b", "c", "d", "e")], "session string, v int")
    for table, sessions in (("gaze", ["a b", "c", "d", "e"]), ("blinks", ["a b", "c", "d"]), ("marks", ["a b", "d", "e"])):
        df.where(F.col("session").isin(sessions)).write.partitionBy("session").parquet(f"{root}/{table}")
    names = lambda *t: sorted(r.session for r in readers.listed_sessions(spark, root, list(t)).collect())
    assert names("gaze", "blinks", "marks") == ["a b", "d"]
    (tmp_path / "rec" / "blinks" / "session=d" / "part-9.parquet.part").write_bytes(b"PAR1")  # a copy that is under way
    for f in (tmp_path / "rec" / "marks" / "session=e").glob("*.parquet"):
        f.write_bytes(b"")  # a writer that died
    assert names("gaze", "blinks", "marks") == ["a b"] and names("gaze", "marks") == ["a b", "d"]
    assert names("gaze", "nothing") == []
    plan = readers.listed_sessions(spark, root, ["gaze"])._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content" not in plan.split("ReadSchema")[1][:60]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_state_is_read_by_bucket_not_by_track(spark, tmp_path, kind):
    """Many short tracks, one without a key: a trigger reads a few buckets, and each track still has its own fixations."""
    r = random.Random(5)
    rows = [(None if s == 0 else s, n, n // 3, r.choice([0.0, 0.0, 0.0, 0.3]), 0.0) for s in range(60) for n in range(24)]
    df = spark.createDataFrame(rows, "session int, n int, frame int, x double, y double").withColumn("session", F.col("session").cast(kind))
    df = df.withColumn("ts", F.timestamp_micros((F.col("n") * 20_000 + 1_000_000).cast("bigint")))
    stream = deliver(spark, str(tmp_path / "in"), df, 3, 3600)
    out, query = T.run_to_table(fixation_stream(stream, dispersion=0.05, minimum=4, idle_ms=5_000, buckets=8), "fixations")
    cols = ["session", "start_n", "end_n", "start_frame", "end_frame", "samples"]
    want = X.idt_fixations(df, ["session"], dispersion=0.05, minimum=4).select(cols)
    assert out.schema["session"].dataType == df.schema["session"].dataType
    assert sorted(map(str, out.where("NOT session <=> -1").select(cols).collect())) == sorted(map(str, want.collect()))
    assert 0 < max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) <= 8


def test_trials_of_many_sessions_in_few_buckets(spark, tmp_path):
    f = Z.varied(spark, SF)
    df = f.withColumn("ts", F.timestamp_micros((F.col("frame") * 33_333 + 1_000_000).cast("bigint")))
    twice = df.unionByName(df.where("frame % 7 = 0"))  # a frame that comes again counts once
    out, query = T.run_to_table(segment_stream(deliver(spark, str(tmp_path / "in"), twice, 2, 7200), C.plan_rows(), delay="1 hour", buckets=3), "trials")
    cols = ["session", "block", "trial", "name", "status", "init", "end", "touch_live", "hand_exit_live", "n_watched", "max_ft"]
    assert sorted(map(str, out.where("session <> -1").select(cols).collect())) == sorted(map(str, G.segment_trials(f, C.plan_rows()).select(cols).collect()))
    assert f.select("session").distinct().count() > 3 >= max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
