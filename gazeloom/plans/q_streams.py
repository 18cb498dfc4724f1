"""Streaming queries: each processes what is available and returns the table it wrote."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import carry, chunk_by
from gazeloom.plans import signals as Z
from gazeloom.plans import views as V
from gazeloom.plans.q_trials import IDT, SEG, SPREAD, rec, track
from gazeloom.plans.registry import query
from gazeloom.sources.writers import scratch_dir
from gazeloom.streaming import streams as T
from gazeloom.streaming.fixations import fixation_stream
from gazeloom.streaming.segmentation import segment_stream

lit = S.lit
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


def event_stream(spark, sf):
    """Events as a stream of samples."""
    e = T.read_stream(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return e.select(F.col("user_id").alias("session"), S.as_instant(F.col("ts")).alias("ts"), "event_id",
                    F.col("event_type").alias("kind"), k.alias("k"),
                    F.least(S.lit(1), S.lit(0.5) + k.cast("double") / S.lit(160)).alias("confidence"))


us = lambda c, name: F.unix_micros(F.col(c)).alias(name)
WINDOW_SQL = """
SELECT epoch_us(w) AS start_us, session, count(*) AS samples{extra} FROM ({src}) GROUP BY w, session HAVING w + INTERVAL {width} <= (SELECT max(ts) FROM events)"""


# Unmatched rows leave the join once both sides' watermarks have passed them.
@query("t16_stream_cleaning", """
WITH e AS (SELECT user_id AS session, ts, event_id, event_type AS kind, least(1.0e0, 0.5e0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 160.0e0) AS conf FROM events),
b AS (SELECT session, ts AS t0, ts + INTERVAL 150 SECOND AS t1 FROM e WHERE kind = 'error')
SELECT session, epoch_us(ts) AS ts_us, min(event_id) AS event_id FROM e WHERE kind <> 'error' AND conf > 0.6e0
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.session = e.session AND e.ts BETWEEN b.t0 AND b.t1)
  AND ts < (SELECT least(max(CASE WHEN kind <> 'error' AND conf > 0.6e0 THEN ts END), max(CASE WHEN kind = 'error' THEN ts + INTERVAL 120 SECOND END)) - INTERVAL 10 SECOND FROM e)
GROUP BY session, ts""")
def _(spark, sf):
    """Blinks of 150 s: longer than the join looks back."""
    e = event_stream(spark, sf)
    blinks = event_stream(spark, sf).where("kind = 'error'").select(
        "session", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 150 SECONDS")).alias("end"))
    out, _ = T.run_to_table(T.clean(e.where("kind <> 'error'"), blinks), "clean")
    return out.groupBy("session", us("ts", "ts_us")).agg(F.min("event_id").alias("event_id"))


@query("t17_stream_alignment", """
WITH f AS (SELECT user_id AS session, event_id AS frame, ts AS t0, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts + INTERVAL 12 HOUR) AS t1 FROM events WHERE event_type = 'view')
SELECT g.user_id AS session, g.event_id, f.frame FROM events g JOIN f ON f.session = g.user_id AND g.ts >= f.t0 AND g.ts < f.t1 WHERE g.event_type = 'click'""")
def _(spark, sf):
    """A view is on screen until the session's next one; the last one stays for twelve hours."""
    e = V.table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), S.as_instant(F.col("ts")).alias("start"))
    e = carry(e, ["session"], ["start", "frame"], chunk_by(F.unix_micros("start"), 86_400e6), after={"next": F.col("start")})
    e = e.withColumn("next", F.coalesce("next", F.col("start") + F.expr("INTERVAL 12 HOURS")))
    path = scratch_dir(spark, "frames")
    e.write.parquet(path)
    frames = spark.readStream.schema(e.schema).parquet(path)
    g = event_stream(spark, sf).where("kind = 'click'").select("session", "ts", "event_id")
    out, _ = T.run_to_table(T.align(g, frames, longest="1 DAY"), "align")
    return out.select("session", "event_id", "frame")


@query("t18_stream_tumbling", WINDOW_SQL.format(
    extra=", round(avg(CASE WHEN conf > 0.6e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS valid_ratio", width="1 DAY",
    src="SELECT date_trunc('day', ts) AS w, user_id AS session, least(1.0e0, 0.5e0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 160.0e0) AS conf FROM events"))
def _(spark, sf):
    w = T.tumbling(event_stream(spark, sf), "1 day", valid=S.confident(F.col("confidence")))
    out, _ = T.run_to_table(w, "tumbling")
    return out.select(us("start", "start_us"), "session", "samples", F.round("valid_ratio", 6).alias("valid_ratio"))


@query("t18_stream_sliding", WINDOW_SQL.format(
    extra="", width="2 DAY", src="SELECT date_trunc('day', ts) - to_days(CAST(d AS INTEGER)) AS w, user_id AS session FROM events, range(2) t(d)"))
def _(spark, sf):
    out, _ = T.run_to_table(T.sliding(event_stream(spark, sf), "2 days", "1 day"), "sliding")
    return out.select(us("start", "start_us"), "session", "samples")


@query("t18_stream_bouts", """
SELECT epoch_us(min(ts)) AS start_us, session, count(*) AS samples FROM (
  SELECT *, sum(op) OVER (PARTITION BY session ORDER BY ts, event_id) AS bout FROM (SELECT user_id AS session, ts, event_id,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS op FROM events))
GROUP BY session, bout HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)""")
def _(spark, sf):
    out, _ = T.run_to_table(T.bouts(event_stream(spark, sf), "12 hours"), "bouts")
    return out.select(us("start", "start_us"), "session", "samples")


@query("t19_stream_late_data", """
WITH late AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('day', ts) FROM events WHERE event_id % 5 = 0
  AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)))
SELECT CAST(sum(c) AS BIGINT) AS kept, any_value(n) AS dropped FROM (SELECT date_trunc('day', ts) AS w, count(*) AS c FROM events GROUP BY 1), late
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def _(spark, sf):
    """Two deliveries and two starts on one checkpoint: the second delivery repeats every fifth event, which the watermark has passed."""
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("session"), S.as_instant(F.col("ts")).alias("ts"), "event_id")
    root, out, state = (scratch_dir(spark, x) for x in ("late", "late-out", "late-state"))
    e.drop("event_id").write.parquet(f"{root}/first")
    stream = spark.readStream.schema(e.drop("event_id").schema).option("recursiveFileLookup", True).parquet(root)
    T.run_to_table(T.tumbling(stream, "1 day"), "late", out, state)
    e.where(F.col("event_id") % 5 == 0).drop("event_id").write.parquet(f"{root}/second")
    table, done = T.run_to_table(T.tumbling(stream, "1 day"), "late", out, state)
    return table.agg(F.sum("samples").alias("kept"), F.lit(T.late_rows(done)).alias("dropped"))


DELIVERIES, FILES = 6, 4


def delivered(spark, df, seconds, name):
    """``df`` with an event time as a stream of six deliveries and more, and the delay that covers their disorder.

    A row comes with its sixth of the time or one or two deliveries later, by its hash, so each trigger mixes three sixths in any order. A last delivery
    of one row, of a session -1 long after all others, moves the watermark past them. A delivery has a file for every task that can run at once.
    """
    files = max(FILES, spark.sparkContext.defaultParallelism)
    df = df.withColumn("ts", F.timestamp_micros(((seconds + lit(1)) * lit(1e6)).cast("bigint")))  # the watermark starts at zero
    end = df.agg(F.max(seconds)).first()[0] or 0.0
    width = end / DELIVERIES + 0.001
    late = F.pmod(F.xxhash64("session", "frame", "ts"), F.lit(3))
    df = df.withColumn("_delivery", F.floor(seconds / lit(width)) + late)
    root = scratch_dir(spark, name)
    for k in range(DELIVERIES + 2):
        df.where(F.col("_delivery") == k).drop("_delivery").repartition(files).write.mode("append").parquet(root)
    last = df.drop("_delivery").limit(1).withColumns({"session": F.lit(-1).cast(df.schema["session"].dataType), "ts": F.timestamp_micros(F.lit(int((end + 3600) * 1e6)))})
    last.write.mode("append").parquet(root)
    return spark.readStream.schema(df.drop("_delivery").schema).option("maxFilesPerTrigger", files).parquet(root), f"{int(3 * width) + 1} seconds"


@query("t20_stream_trials", Z.with_(*SEG, body="""
SELECT session, block, trial, name, status, init, fin, touch FROM tr"""))
def _(spark, sf):
    """Trials leave the stream when they close; frames come out of order over many triggers."""
    s, delay = delivered(spark, Z.varied(spark, sf), F.col("frame").cast("double") / lit(30), "frames")
    out, _ = T.run_to_table(segment_stream(s, C.plan_rows(), delay=delay), "trials")
    return out.where("session <> -1").select("session", big("block"), big("trial"), "name", "status", big("init"), big("end", "fin"), big("touch_live", "touch"))


@query("t1_stream_fixations", rec(V.GZ, IDT, body="""
SELECT session, start_n, end_n, start_n // 4 AS start_frame, end_n // 4 AS end_frame, samples FROM fx"""))
def _(spark, sf):
    """The batch query's fixations from samples that come out of order over many triggers."""
    s, delay = delivered(spark, track(spark, sf).select("session", "n", "frame", "t", "x", "y"), F.col("t"), "samples")
    out, _ = T.run_to_table(fixation_stream(s, delay=delay, dispersion=SPREAD), "fixations")
    return out.where("session <> -1")
