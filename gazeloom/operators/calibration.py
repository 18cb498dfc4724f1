"""Drift calibration of a recording from its dot panels: residuals, gate, noise model.

A recording shows tens of panels of nine dots, so per-panel and per-recording groups
of *dots* are small; groups of *samples* are only ever aggregated.
"""
from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.functions.md5 import first_bits
from gazeloom.operators.ordered import carry, chunk_by, exact_percentile, spread, with_row_index
from gazeloom.sources.writers import materialise

DOT = ["session", "panel", "dot"]
#: Dots of a recording up to which one task draws all its repetitions; also the draws held at once.
GROUP_DOTS = 1 << 16
#: Dots that a recording needs for statistics.
MIN_DOTS = 6


def residuals(points: DataFrame) -> DataFrame:
    """Median residual (gaze - dot) per panel and dot. ``points``: keys, t, dot_x, dot_y, rx, ry."""
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    return points.groupBy(*DOT).agg(F.min("t").alias("t"), med("dot_x"), med("dot_y"), med("rx"), med("ry"))


def panel_offsets(dots: DataFrame) -> DataFrame:
    """Mean residual of every panel, normalised, with its segment and number of dots."""
    return dots.groupBy("session", "panel", "seg").agg(
        F.min("t").alias("t"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"), F.count(F.lit(1)).alias("n_dots")
    ).withColumns({"off_x": F.col("mx") / S.lit(C.WORLD_W), "off_y": F.col("my") / S.lit(C.WORLD_H)})


def leave_one_out(dots: DataFrame, chunk_s: float = 60.0) -> DataFrame:
    """Error of each dot before and after the offset its panel would get from the other panels of its segment.

    Only the panels next to it in time matter. Panels with a single dot are not held out.
    """
    p = panel_offsets(dots)
    value = F.struct("t", "mx", "my")
    near = carry(p, ["session", "seg"], ["t"], chunk_by(F.col("t"), chunk_s), prev={"_a": value}, after={"_b": value})

    def at(k):
        a, b = F.col(f"_a.{k}"), F.col(f"_b.{k}")
        share = (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
        return (F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), a + (b - a) * share)
                .otherwise(F.coalesce(a, b, F.lit(0.0))))

    held = near.where(F.col("n_dots") >= 2).select("session", "panel", at("mx").alias("ox"), at("my").alias("oy"))
    d = dots.join(held, ["session", "panel"])
    d = d.withColumns({"cx": F.col("rx") - F.col("ox"), "cy": F.col("ry") - F.col("oy")})
    return d.withColumns({"base": S.hyp(F.col("rx"), F.col("ry")), "corr": S.hyp(F.col("cx"), F.col("cy"))})


def draw(session, rep, i, n):
    """The dot drawn at place ``i`` of a repetition: 32 bits of an MD5, which every engine has, modulo the number of dots."""
    bits = F.substring(F.md5(F.concat_ws(",", session.cast("string"), rep.cast("string"), i.cast("string"))), 1, 8)
    return (F.conv(bits, 16, 10).cast("bigint") % n).cast("int")


def resamples(errors: DataFrame, reps: int = C.BOOTSTRAP_REPS, chunk: int = 64) -> DataFrame:
    """(session, rep, base, corr, times, n): how often each repetition of the bootstrap draws a dot; dots it does not draw have no row.

    Dots are numbered by panel and dot, in slices of ``chunk`` panels. Every dot is a place that all repetitions draw for, so the draws of one recording come from as many tasks as its
    dots are in, and are counted before they are shuffled. A recording with fewer than six dots is not drawn from.
    """
    e = errors.select("session", "panel", "dot", "base", "corr")
    e = with_row_index(e, ["session"], ["panel", "dot", "base", "corr"], chunk_by(F.col("panel"), chunk), "_i", start=0)
    e = materialise(e.join(e.groupBy("session").agg(F.count(F.lit(1)).alias("_n")), "session").where("_n >= 6"), "dots")
    drawn = e.select("session", "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = drawn.select("session", "rep", draw(F.col("session"), F.col("rep"), F.col("_i"), F.col("_n")).cast("bigint").alias("_i"))
    counts = drawn.groupBy("session", "rep", "_i").agg(F.count(F.lit(1)).alias("times"))
    return counts.join(e.select("session", "_i", "base", "corr", F.col("_n").alias("n")), ["session", "_i"]).drop("_i")


def _percentile(ordered: np.ndarray, p: float) -> float | None:
    """Interpolated percentile of sorted values, as Spark and SQL define it; None of nothing."""
    if not len(ordered):
        return None
    at = (len(ordered) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    low, high = float(ordered[lo]), float(ordered[hi])
    return low if low == high else (hi - at) * low + (at - lo) * high


def _drawn_medians(values: list, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the values that each row of ``draws`` picks, and whether there is one: null values do not count, NaN is the largest."""
    known = np.array([k for k, x in enumerate(values) if x is not None], np.int64)
    v = np.array([values[k] for k in known], float)
    order = np.argsort(v, kind="stable")
    rank = np.full(len(values), len(values), np.int32)
    rank[known[order]] = np.arange(len(known))
    picked = np.sort(rank[draws], 1)
    n = (picked < len(values)).sum(1)
    at = lambda k: np.append(v[order], np.nan)[np.minimum(picked[np.arange(len(draws)), k], len(known))]
    low, high = at(np.maximum(n - 1, 0) // 2), at(np.minimum(n // 2, len(values) - 1))
    return np.where(low == high, low, 0.5 * low + 0.5 * high), n > 0


def _bootstrapped(session: str, base: list, corr: list, reps: int) -> tuple:
    """(median of base, of corr, 5th and 95th percentile of the gain) of one recording, given in order."""
    known = lambda values: np.sort([x for x in values if x is not None and x == x])
    own = _percentile(known(base), 0.5), _percentile(known(corr), 0.5)
    if len(base) < MIN_DOTS:
        return *own, None, None
    gains, some = [], max(1, GROUP_DOTS // len(base))
    for first in range(0, reps, some):
        draws = first_bits(f"{session},".encode(), np.arange(first, min(reps, first + some)), len(base)) % len(base)
        (b, has_b), (c, has_c) = _drawn_medians(base, draws), _drawn_medians(corr, draws)
        with np.errstate(divide="ignore", invalid="ignore"):
            rises = has_b & ~(b <= 0)  # NaN is above 0
            gains.append(np.where(rises, 1.0 - c / b, 0.0)[~rises | has_c])
    ordered = np.sort(np.concatenate(gains))
    return *own, _percentile(ordered, 0.05), _percentile(ordered, 0.95)


def _gains(reps: int):
    """Statistics per recording from a stream of dots sorted by recording; one recording of at most GROUP_DOTS dots is held."""
    def run(batches):
        kind = None

        def dots():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("session").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("session", "_text", "base", "corr")))

        rows = []
        for session, group in groupby(dots(), itemgetter(0)):
            _, text, base, corr = zip(*group)
            found = (None,) * 4 if session is None else _bootstrapped(text[0], base, corr, reps)
            rows.append((session, len(base), *found))
            if len(rows) >= 1024:
                yield _stats(kind, rows)
                rows = []
        if rows:
            yield _stats(kind, rows)
    return run


STATS = ["base_px", "corr_px", "gain_lo", "gain_hi"]


def _stats(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = [kind, pa.int64(), *[pa.float64()] * len(STATS)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["session", "n_points", *STATS])


def _large_gains(errors: DataFrame, sizes: DataFrame, reps: int) -> DataFrame:
    """The same of recordings with more dots than one task holds: draws and medians spread over many tasks."""
    own = exact_percentile(errors, ["session"], "base", {"base_px": 0.5}).join(exact_percentile(errors, ["session"], "corr", {"corr_px": 0.5}), "session", "full")
    times, each = materialise(resamples(errors, reps), "resamples"), ["session", "rep"]
    medians = exact_percentile(times, each, "base", {"b": 0.5}, weight="times").join(exact_percentile(times, each, "corr", {"c": 0.5}, weight="times"), each, "full")
    relative = F.when(F.col("b") > 0, S.lit(1) - F.col("c") / F.col("b")).otherwise(S.lit(0))
    gains = medians.groupBy("session").agg(F.percentile(relative, F.array(F.lit(0.05), F.lit(0.95))).alias("_g"))  # ``reps`` values
    return sizes.join(own, "session", "left").join(gains, "session", "left").select(
        "session", "n_points", "base_px", "corr_px", F.get("_g", F.lit(0)).alias("gain_lo"), F.get("_g", F.lit(1)).alias("gain_hi"))


def gate(errors: DataFrame, reps: int = C.BOOTSTRAP_REPS, min_base: float = C.GATE_MIN_BASE_PX) -> DataFrame:
    """Adopts the correction when its bootstrapped gain is reliably positive and worth having.

    A recording of at most GROUP_DOTS dots is drawn from in one place: only its dots are shuffled, never its draws. Of larger ones draws are counted per repetition and dot,
    and medians are percentiles weighted by these counts. One with fewer than six points gets no statistics.
    """
    e = materialise(errors.select("session", "panel", "dot", "base", "corr"), "errors")
    sizes = e.groupBy("session").agg(F.count(F.lit(1)).alias("n_points"), F.count("panel").alias("_placed"))
    large = materialise(sizes.where((F.col("n_points") > GROUP_DOTS) | (F.col("_placed") < F.col("n_points"))).drop("_placed"), "large")
    any_large, small = not large.isEmpty(), e
    same = F.col("session").eqNullSafe(F.col("_large"))
    if any_large:
        small = e.join(large.select(F.col("session").alias("_large")), same, "left_anti")
    text = small.withColumn("_text", F.col("session").cast("string")).select("session", "_text", "panel", "dot", "base", "corr")
    kind = e.schema["session"].dataType.simpleString()
    s = spread(text, "session").sortWithinPartitions("session", "panel", "dot", "base", "corr").mapInArrow(
        _gains(reps), f"session {kind}, n_points bigint, " + ", ".join(f"{c} double" for c in STATS))
    if any_large:
        members = e.join(large.select(F.col("session").alias("_large")), same, "left_semi")
        s = s.unionByName(_large_gains(materialise(members, "members"), large, reps))
    enough = F.col("n_points") >= MIN_DOTS
    g = materialise(s, "gains").select("session", "n_points", *[F.when(enough, F.col(c)).alias(c) for c in STATS])
    gain = F.when(F.col("base_px") > 0, S.lit(1) - F.col("corr_px") / F.col("base_px")).otherwise(S.lit(0))
    return g.withColumns({
        "gain": F.when(enough, gain),
        "apply": F.coalesce(enough & (F.col("gain_lo") > 0) & (F.col("base_px") >= S.lit(min_base)), F.lit(False))})


def jitter(points: DataFrame) -> DataFrame:
    """Samples with the mean of their dot taken out: jx, jy, and the dot's distance to the centre."""
    mean = points.groupBy(*DOT).agg(F.avg("rx").alias("_mx"), F.avg("ry").alias("_my"))
    ecc = S.hyp(F.col("dot_x") - S.lit(C.WORLD_W / 2), F.col("dot_y") - S.lit(C.WORLD_H / 2))
    return points.join(mean, DOT).withColumns(
        {"jx": F.col("rx") - F.col("_mx"), "jy": F.col("ry") - F.col("_my"), "ecc": ecc}).drop("_mx", "_my")



def jitter_cov(jit: DataFrame) -> DataFrame:
    """Axes of the jitter ellipse (px, degrees), pooled variance and number of samples."""
    g = jit.groupBy("session").agg(
        F.covar_samp("jx", "jx").alias("xx"), F.covar_samp("jx", "jy").alias("xy"), F.covar_samp("jy", "jy").alias("yy"),
        F.avg(F.col("jx") * F.col("jx") + F.col("jy") * F.col("jy")).alias("pool_var"), F.count(F.lit(1)).alias("n_samples"))
    a, b, ang = S.ellipse(F.col("xx"), F.col("xy"), F.col("yy"))
    return g.select("session", a.alias("sigma_major"), b.alias("sigma_minor"), ang.alias("angle_deg"), "pool_var", "n_samples",
                    F.sqrt("pool_var").alias("jitter_rms_px"))


def conf_var_factor(jit: DataFrame, pool: DataFrame, min_samples: int = C.BIN_MIN_SAMPLES) -> DataFrame:
    """Variance by confidence bin relative to the pool; never rises with confidence."""
    c = F.col("conf")
    which = F.coalesce(*[F.when((c >= S.lit(lo)) & (c < S.lit(hi)), F.lit(i)) for i, (lo, hi) in enumerate(C.CONF_BINS)])
    middle = F.get(F.array(*[S.lit(round((lo + hi) / 2.0, 3)) for lo, hi in C.CONF_BINS]), F.col("bin"))
    b = jit.withColumn("bin", which).where(F.col("bin").isNotNull()).groupBy("session", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("jx") * F.col("jx") + F.col("jy") * F.col("jy")).alias("_v"))
    b = b.where(F.col("n") >= min_samples).join(pool.where(F.col("pool_var") > 0).select("session", "pool_var"), "session")
    low = Window.partitionBy("session").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # five rows
    return b.select("session", "bin", middle.alias("conf"), F.round(F.min(F.col("_v") / F.col("pool_var")).over(low), 3).alias("factor"))


def spatial_var_factor(jit: DataFrame, pool: DataFrame, min_samples: int = C.BIN_MIN_SAMPLES) -> DataFrame:
    """Variance in three eccentricity bands, closed on both ends: a sample on a boundary counts in both."""
    q = exact_percentile(jit, ["session"], "ecc", {"q0": 0.0, "q1": 0.33, "q2": 0.66, "q3": 1.0})
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"q{i}").alias("lo"), F.col(f"q{i + 1}").alias("hi")) for i in range(3)])
    # Dots sit at a few distances: samples collapse to one row per distance before they meet the bands.
    per = jit.groupBy("session", "ecc").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("jx") * F.col("jx") + F.col("jy") * F.col("jy")).alias("_s"))
    b = per.join(q, "session").select("session", "ecc", "_n", "_s", F.explode(bands).alias("b"))
    b = b.where((F.col("ecc") >= F.col("b.lo")) & (F.col("ecc") <= F.col("b.hi"))).groupBy("session", "b.band", "b.lo", "b.hi").agg(
        F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("_v"))
    b = b.where(F.col("n") >= min_samples).join(pool.where(F.col("pool_var") > 0).select("session", "pool_var"), "session")
    return b.select("session", "band", F.round((F.col("lo") + F.col("hi")) / 2, 1).alias("ecc"),
                    F.round(F.col("_v") / F.col("pool_var"), 3).alias("factor"))


def bias_cov(errors: DataFrame, gates: DataFrame) -> DataFrame:
    """Second moment of the residual vectors: corrected where the gate adopted the correction."""
    e = errors.join(gates.select("session", "apply"), "session")
    x = F.when(F.col("apply"), F.col("cx")).otherwise(F.col("rx"))
    y = F.when(F.col("apply"), F.col("cy")).otherwise(F.col("ry"))
    return e.groupBy("session").agg(F.avg(x * x).alias("bxx"), F.avg(x * y).alias("bxy"), F.avg(y * y).alias("byy"))


def artifacts(points: DataFrame, dots: DataFrame, min_samples: int = C.BIN_MIN_SAMPLES) -> DataFrame:
    """Calibration artifact per recording. Fewer than three panels: no correction, with the reason."""
    panels = dots.groupBy("session").agg(F.count_distinct("panel").alias("panels"))
    enough = panels.where(F.col("panels") >= 3).select("session")
    used = dots.join(enough, "session", "left_semi")
    errors = materialise(leave_one_out(used), "residuals")
    gates = materialise(gate(errors), "gates")
    jit = materialise(jitter(points.join(enough, "session", "left_semi")), "jitter")
    pool = materialise(jitter_cov(jit), "pool")
    pairs = lambda df, key, order: df.groupBy("session").agg(  # at most five entries
        F.array_sort(F.collect_list(F.struct(order, key, "factor"))).alias("_l")).select(
        "session", F.col("_l").getField(key).alias(key), F.col("_l").getField("factor").alias("factor"))
    conf = pairs(conf_var_factor(jit, pool, min_samples), "conf", "bin").select("session", F.struct("conf", "factor").alias("conf_var_factor"))
    ecc = pairs(spatial_var_factor(jit, pool, min_samples), "ecc", "band").select(
        "session", F.struct(F.lit("radial_ecc_px").alias("model"), "ecc", "factor").alias("spatial_var_factor"))
    offs = panel_offsets(used).groupBy("session").agg(F.array_sort(F.collect_list(F.struct(  # one entry per panel
        F.round("t", 3).alias("t"), F.round("off_x", 6).alias("off_x"), F.round("off_y", 6).alias("off_y"),
        "seg", F.col("n_dots").cast("int").alias("n_dots")))).alias("panel_offsets"))
    bias = bias_cov(errors, gates)
    a = panels
    for part in (gates, offs, pool, conf, ecc, bias):
        a = a.join(part, "session", "left")
    stats = F.struct(F.round("base_px", 2).alias("base_px"), F.round("corr_px", 2).alias("corr_px"), F.round("gain", 3).alias("gain"),
                     F.round("gain_lo", 3).alias("gain_lo"), F.round("gain_hi", 3).alias("gain_hi"),
                     F.col("n_points").cast("int").alias("n_points"),
                     F.when(F.col("panels") < 3, "insufficient_panels").alias("reason"))
    known = F.col("n_samples").isNotNull() & (F.col("pool_var") > 0)
    unc = F.struct(
        F.struct(F.round("sigma_major", 2).alias("sigma_major"), F.round("sigma_minor", 2).alias("sigma_minor"),
                 F.round("angle_deg", 1).alias("angle_deg")).alias("jitter_cov_px"), "conf_var_factor", "spatial_var_factor",
        F.round("jitter_rms_px", 2).alias("jitter_rms_px"), F.col("n_samples").cast("int").alias("n_samples"),
        F.array(F.array("bxx", "bxy"), F.array("bxy", "byy")).alias("bias_cov_px"))
    return a.select(F.col("session").alias("participant"), F.coalesce("apply", F.lit(False)).alias("apply"), "panel_offsets",
                    stats.alias("stats"), F.when(known, unc).alias("uncertainty"))
