"""The same cleaning, alignment and windows on Structured Streaming.

All functions take and return streaming DataFrames with a TIMESTAMP column ``ts``;
sources with TIMESTAMP_NTZ are cast first, since watermarks need an instant.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.sources.writers import scratch_dir


def read_stream(spark: SparkSession, folder: str, table: str, **options) -> DataFrame:
    """Streams one Parquet table of a folder, with the schema of the files already there."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").options(**options)
            .parquet(folder))


def _micros(c: str):
    return F.unix_micros(F.col(c))


def _bucket(micros, width: str):
    """Number of the time bucket of ``width`` that an instant lies in."""
    return F.floor(micros / F.unix_micros(F.expr(f"timestamp_micros(0) + INTERVAL {width}")))


def _in_buckets(intervals: DataFrame, start: str, end: str, width: str) -> DataFrame:
    """Intervals cut where a time bucket ends: a piece (``_from``, ``_to``, ``_bucket``) for every bucket they touch."""
    step = F.unix_micros(F.expr(f"timestamp_micros(0) + INTERVAL {width}"))
    i = intervals.where(F.col(end) >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(_bucket(_micros(start), width), _bucket(_micros(end), width))))
    edge = lambda k: F.timestamp_micros(k * step)
    return i.withColumns({"_from": F.greatest(F.col(start), edge(F.col("_bucket"))), "_to": F.least(F.col(end), edge(F.col("_bucket") + 1))})


def clean(gaze: DataFrame, blinks: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD, delay: str = "10 seconds",
          keys=("session",), longest: str = "60 seconds") -> DataFrame:
    """Confidence filter, one row per (session, ts), and no row inside a blink interval (``start``, ``end``).

    A left outer interval join whose unmatched rows are kept; both sides carry watermarks. Intervals travel in pieces, one per time bucket of
    ``longest``, and meet the samples of the same session and bucket only, so the state is as long as one bucket plus the delay, whatever a blink's length.
    """
    g = (gaze.where(F.col("confidence") > F.lit(float(threshold))).withWatermark("ts", delay)
         .dropDuplicatesWithinWatermark([*keys, "ts"]).withColumn("_slot", _bucket(_micros("ts"), longest)))
    b = _in_buckets(blinks, "start", "end", longest).withWatermark("_from", delay).select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_bucket", "_from", "_to")
    cond = ((F.col("_slot") == F.col("_bucket")) & (F.col("ts") >= F.col("_from")) & (F.col("ts") <= F.col("_to"))
            & (F.col("_from") >= F.col("ts") - F.expr(f"INTERVAL {longest}")))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_b_{k}"))
    return g.join(b, cond, "left_outer").where(F.col("_from").isNull()).drop("_slot", "_bucket", "_from", "_to", *[f"_b_{k}" for k in keys])


def align(gaze: DataFrame, frames: DataFrame, delay: str = "10 seconds", longest: str = "1 minute") -> DataFrame:
    """Frame on screen at each sample: ``frames`` say when a frame begins (``start``) and the next one does (``next``).

    Frames travel in pieces, one per time bucket of ``longest``; the join's keys are session and bucket, so a sample is held against the frames of its own bucket only.
    """
    g = gaze.withWatermark("ts", delay).withColumn("_slot", _bucket(_micros("ts"), longest))
    f = _in_buckets(frames, "start", "next", longest).withWatermark("_from", delay).withColumnRenamed("session", "_s")
    return g.join(f, (F.col("session") == F.col("_s")) & (F.col("_slot") == F.col("_bucket")) & (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))
                  & (F.col("_from") >= F.col("ts") - F.expr(f"INTERVAL {longest}")), "inner").drop("_s", "_slot", "_bucket", "_from", "_to")


def tumbling(df: DataFrame, width: str, delay: str = "0 seconds", keys=("session",), valid=None) -> DataFrame:
    """Samples and share of valid ones per window."""
    ok = F.lit(True) if valid is None else valid
    w = df.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(ok.cast("double")).alias("valid_ratio"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "samples", "valid_ratio")


def sliding(df: DataFrame, width: str, step: str, delay: str = "0 seconds", keys=("session",)) -> DataFrame:
    """Samples per overlapping window."""
    w = df.withWatermark("ts", delay).groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("samples"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "samples")


def bouts(df: DataFrame, gap: str, delay: str = "0 seconds", keys=("session",)) -> DataFrame:
    """Recording bouts: stretches of a session without a pause of ``gap``."""
    w = df.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("samples"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "samples")


def run_to_table(df: DataFrame, name: str, path: str | None = None, state: str | None = None, timeout_s: int | None = None) -> tuple[DataFrame, object]:
    """Processes everything available in append mode into a Parquet table; returns it and the finished query.

    ``path`` and ``state`` (checkpoint) of an earlier start go on where that one ended. No time limit unless one is given.
    """
    spark = df.sparkSession
    path, state = path or scratch_dir(spark, name), state or scratch_dir(spark, f"{name}-state")
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, 1_000_000)  # all progress entries, so that counts over them are whole
    try:
        query = (df.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
    finally:
        spark.conf.set(kept, before)
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s} s")
    return spark.read.schema(df.schema).parquet(path), query


def late_rows(query) -> int:
    """Rows a finished query dropped because they were older than its watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def upsert(path: str, keys: list[str]):
    """``foreachBatch`` writer keeping the newest row per key; a replayed batch rewrites the same folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), "updated").alias("r")).select("r.*")
        newest.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current rows of a table written by :func:`upsert`."""
    df = spark.read.parquet(path)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct("updated", "batch")).alias("r")).select("r.*")
