"""Dispersion fixations as a stateful stream, with the rules of the batch job."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.operators.fixations import Run
from gazeloom.streaming.tracks import BUCKETS, in_order


def _row(done: tuple | None) -> list[tuple]:
    if done is None:
        return []
    (start, start_frame), (end, end_frame), count = done
    return [(start, end, start_frame, end_frame, count)]


def fixation_stream(samples: DataFrame, key: str = "session", ts: str = "ts", delay: str = "10 seconds", dispersion: float = C.FIXATION_DISPERSION,
                    minimum: int = C.FIXATION_MIN, idle_ms: int = 60_000, buckets: int = BUCKETS) -> DataFrame:
    """Fixations as they end, from samples (key, n, frame, x, y and the event time ``ts``) that may come up to ``delay`` late and in any order.

    Samples are taken in order of ``n`` once no earlier one can come. A track that has been silent for ``idle_ms`` has its open run closed and is forgotten. The run
    itself holds a few extremes, and points only while it is shorter than a fixation. Uses the RocksDB state store. Returns key, start_n, end_n, start_frame, end_frame, samples.
    """
    s = samples.select(key, ts, F.col("n").cast("long").alias("n"), F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def feed(run: Run, n, frame, x, y):
        out = []
        for tag, a, b in zip(zip(n, frame), x, y):
            done = run.add(a, b, tag)
            if done is not None:
                out += _row(done)
        return out

    return in_order(s, key, ts, delay, ["n", "frame", "x", "y"], ["n", "frame", "_at", "x", "y"], lambda: Run(dispersion, minimum), feed, lambda run: _row(run.closing()),
                    False, "start_n long, end_n long, start_frame long, end_frame long, samples long", idle_ms, buckets)
