"""Runs, streaks, inertia, hysteresis and running averages over frame series.

Input series have one row per (session, frame) with frames numbered without gaps
unless said otherwise. All of it goes through :func:`carry`, so a session is never
sorted in one task.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.operators.ordered import BLOCK, carry, chunk_by, in_blocks

FRAME_CHUNK = 65536


_FC = "_fc"


def _sliced(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df if _FC in df.columns else df.withColumn(_FC, chunk_by(F.col(order), chunk))


def _carry(df, order="frame", keys=("session",), **kw):
    return carry(df, list(keys), [order], _FC, **kw)


def runs(df: DataFrame, cond: Column, keys=("session",), order: str = "frame",
         chunk: int = FRAME_CHUNK) -> DataFrame:
    """Adds ``run_start`` (first frame of the current run of true ``cond``; NULL when false)
    and ``run_len`` (its length so far)."""
    df = _sliced(df, order, chunk).withColumn("_c", F.coalesce(cond, F.lit(False)))
    df = _carry(df, order, keys, last={"_false": F.when(~F.col("_c"), F.col(order))},
                running_max={"_first": -F.col(order)})
    start = F.coalesce(F.col("_false") + 1, -F.col("_first"))
    return (df.withColumn("run_start", F.when(F.col("_c"), start))
            .withColumn("run_len", F.when(F.col("_c"), F.col(order) - start + 1).otherwise(F.lit(0)))
            .drop("_c", "_false", "_first", _FC))


def first_streak(df: DataFrame, cond: Column, n: int, keys=("session",), order: str = "frame",
                 chunk: int = FRAME_CHUNK) -> DataFrame:
    """Per key: start of the first run of at least ``n`` true rows, and the row that confirmed it."""
    r = runs(df, cond, keys, order, chunk).where(F.col("run_len") == n)
    return r.groupBy(*keys).agg(F.min("run_start").alias("start"), F.min(order).alias("confirmed"))


def streak_with_tolerance(df: DataFrame, cond: Column, n: int, misses: int, keys=("session",),
                          order: str = "frame", chunk: int = FRAME_CHUNK) -> DataFrame:
    """Like :func:`first_streak`, counting only true rows; up to ``misses`` false rows in a row are forgiven."""
    t = _sliced(df.where(F.coalesce(cond, F.lit(False))).select(*keys, order), order, chunk)
    t = _carry(t, order, keys, prev={"_last": F.col(order)})
    opens = F.col("_last").isNull() | (F.col(order) - F.col("_last") > misses + 1)
    t = t.withColumn("_open", F.when(opens, F.col(order)))
    t = _carry(t, order, keys, last={"run_start": F.col("_open")}, running_sum={"_k": F.lit(1)})
    t = t.withColumn("_base", F.when(opens, F.col("_k") - 1))
    t = _carry(t, order, keys, last={"_from": F.col("_base")})
    hit = t.where(F.col("_k") - F.col("_from") == n)
    return hit.groupBy(*keys).agg(F.min("run_start").alias("start"), F.min(order).alias("confirmed"))


def panel_confirmed(df: DataFrame, panel: Column, n: int = 4, keys=("session",), order: str = "frame",
                    chunk: int = FRAME_CHUNK) -> DataFrame:
    """Adds ``confirmed``: the panel once seen on ``n`` consecutive frames. A different panel restarts."""
    df = _sliced(df, order, chunk).withColumn("_p", panel)
    df = _carry(df, order, keys, prev={"_was": F.coalesce("_p", F.lit(""))})
    fresh = ~F.coalesce(F.col("_p"), F.lit("")).eqNullSafe(F.col("_was"))
    df = df.withColumn("_new", F.when(fresh, F.col(order)))
    df = _carry(df, order, keys, last={"_since": F.col("_new")})
    seen = F.col(order) - F.col("_since") + 1
    return (df.withColumn("panel_run", F.when(F.col("_p").isNotNull(), seen).otherwise(F.lit(0)))
            .withColumn("confirmed", F.when(F.col("panel_run") >= n, F.col("_p")))
            .withColumn("panel_since", F.when(F.col("_p").isNotNull(), F.col("_since")))
            .drop("_p", "_was", "_new", "_since", _FC))


def hold_last(df: DataFrame, raw: Column, n: int = 2, keys=("session",), order: str = "frame",
              chunk: int = FRAME_CHUNK) -> DataFrame:
    """Adds ``held``: true on true rows and on the ``n`` rows after one; and ``last_seen``, the last true row."""
    df = _sliced(df, order, chunk).withColumn("_raw", F.coalesce(raw, F.lit(False)))
    df = _carry(df, order, keys, last={"last_seen": F.when(F.col("_raw"), F.col(order))})
    return df.withColumn("held", F.coalesce(F.col(order) - F.col("last_seen") <= n, F.lit(False))).drop("_raw", _FC)


def sustained_loss(df: DataFrame, raw: Column, k: int = 4, inertia: int = 2, keys=("session",),
                   order: str = "frame", chunk: int = FRAME_CHUNK) -> DataFrame:
    """Frames where a seen contour has been missing for more than ``k`` rows after its inertia ran out."""
    h = hold_last(df, raw, inertia, keys, order, chunk)
    return (h.where(F.col("last_seen").isNotNull() & (F.col(order) - F.col("last_seen") == k + 1 + inertia))
            .select(*keys, F.col(order).alias("lost_at"), F.col("last_seen").alias("end")))


def hysteresis_return(df: DataFrame, value: Column, enter: float, leave: float, n: int,
                      keys=("session",), order: str = "frame", chunk: int = FRAME_CHUNK) -> DataFrame:
    """Per key: start of the first run of ``n`` rows at or below ``leave`` after a peak of at least ``enter``."""
    df = _sliced(df, order, chunk).withColumn("_v", value)
    df = _carry(df, order, keys, running_max={"_peak": F.col("_v")})
    low = (F.col("_peak") >= F.lit(float(enter))) & (F.col("_v") <= F.lit(float(leave)))
    return first_streak(df, low, n, keys, order, chunk)


def ema(df: DataFrame, value: str, keep: float, out: str, idx: str, keys=("session",)) -> DataFrame:
    """Exponential average ``keep * previous + (1 - keep) * value``, starting at the first value.

    Inside a block of rows it is a scaled running sum; a block reaches later ones through
    ``keep ** rows``, so the blocks before the last few no longer matter in double precision.
    """
    if keep <= 0:
        return df.withColumn(out, F.col(value).cast("double"))
    if keep > 0.9999:
        raise ValueError("keep must be at most 0.9999")
    # Rows until a weight is below 1e-18: a block has a quarter of that at least, so it is handed on to few others,
    # and weights inside a block stay within double precision's range.
    fade = math.ceil(18 * math.log(10) / -math.log(keep))
    size = min(max(8, fade if fade < 128 else max(128, fade // 4)), 65536)
    reach = -(-fade // size)
    gain = F.when(F.col(idx) == 0, F.lit(1.0)).otherwise(F.lit(1.0 - keep))
    pos = (F.col(idx) % size).cast("double")
    b = in_blocks(df, idx, size=size).withColumn(
        "_term", gain * F.col(value) * F.pow(F.lit(1.0 / keep), pos))
    w = Window.partitionBy(*keys, BLOCK).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_own", F.sum("_term").over(w) * F.pow(F.lit(keep), pos))
    # Block totals are handed to the next blocks directly; only blocks, never rows, are repeated.
    ends = b.groupBy(*keys, BLOCK).agg(F.max_by("_own", idx).alias("_end"))
    handed = (ends.select(*keys, "_end", BLOCK, F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d"))
              .select(*keys, (F.col(BLOCK) + F.col("_d")).alias(BLOCK),
                      (F.col("_end") * F.pow(F.lit(keep), ((F.col("_d") - 1) * size).cast("double"))).alias("_part"))
              .groupBy(*keys, BLOCK).agg(F.sum("_part").alias("_in")))
    joined = b.join(handed, [*keys, BLOCK], "left")
    return (joined.withColumn(out, F.col("_own") + F.coalesce("_in", F.lit(0.0)) * F.pow(F.lit(keep), pos + 1))
            .drop("_term", "_own", "_in", "_home", BLOCK))


def vote_state(df: DataFrame, vote: Column, idx: str, n: int = 3, keys=("session",)) -> DataFrame:
    """Hysteresis on a boolean vote: ``state`` flips once ``n`` votes in a row agree; starts false."""
    b = in_blocks(df.withColumn("_vote", vote), idx, halo=n)
    w = Window.partitionBy(*keys, BLOCK).orderBy(idx)
    agreed = F.lit(True)
    for i in range(1, n):
        agreed = agreed & F.coalesce(F.lag("_vote", i).over(w) == F.col("_vote"), F.lit(False))
    b = b.withColumn("_agreed", F.when(agreed, F.col("_vote"))).where("_home").drop(BLOCK, "_home")
    b = carry(b, list(keys), [idx], chunk_by(F.col(idx), FRAME_CHUNK), last={"state": F.col("_agreed")})
    return b.withColumn("state", F.coalesce("state", F.lit(False))).drop("_vote", "_agreed")


def merge_segments(df: DataFrame, active: Column, ts: str = "t", gap: float = 6.0, min_len: float = 4.0,
                   keys=("session",), idx: str = "n", chunk_s: float = 60.0) -> DataFrame:
    """Stretches of active rows: pieces less than ``gap`` apart join, those of at least ``min_len`` stay.

    Rows without an active neighbour end a piece; the gap runs from the last active row of one
    piece to the first of the next, whichever rows lie between.
    """
    a = df.where(active).select(*keys, ts, idx)
    a = a.withColumn(_FC, chunk_by(F.col(ts), chunk_s))
    a = carry(a, list(keys), [ts, idx], _FC, prev={"_pt": F.col(ts), "_pn": F.col(idx)})
    joined = F.col("_pn").isNotNull() & (
        (F.col(idx) - F.col("_pn") == 1) | (F.col(ts) - F.col("_pt") < F.lit(float(gap))))
    a = a.withColumn("_open", F.when(~joined, F.col(idx)))
    a = carry(a, list(keys), [ts, idx], _FC, last={"_seg": F.col("_open")})
    return (a.groupBy(*keys, "_seg").agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
            .where(F.col("t1") - F.col("t0") >= F.lit(float(min_len))).drop("_seg"))


def sticky_flips(df: DataFrame, cond: Column, keys=("session",), order: str = "frame",
                 chunk: int = FRAME_CHUNK) -> DataFrame:
    """Number of changes of a boolean along each key."""
    d = _sliced(df, order, chunk).withColumn("_c", cond.cast("int"))
    d = _carry(d, order, keys, prev={"_p": F.col("_c")})
    return d.groupBy(*keys).agg(
        F.sum(F.coalesce((F.col("_c") != F.col("_p")).cast("bigint"), F.lit(0))).alias("flips"))
