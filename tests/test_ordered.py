"""Slicing a session must not change any result."""
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gazeloom.operators import gaze as G
from gazeloom.operators import timejoins as J
from gazeloom.operators import windows as W
from gazeloom.operators.ordered import carry, chunk_by, exact_percentile, with_row_index

rnd = random.Random(7)
ROWS = [(s, i, rnd.choice([None, rnd.randint(0, 99)])) for s in (1, 2) for i in range(150 if s == 1 else 7)]


@pytest.fixture(scope="module")
def rows(spark):
    shuffled = ROWS[:]
    rnd.shuffle(shuffled)
    return spark.createDataFrame(shuffled, "session int, t int, v int").cache()


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
def test_carry_equals_plain_windows(rows, width):
    w = Window.partitionBy("session").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select("session", "t", F.last("v", True).over(upto).alias("a"),
                        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
                        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("c"),
                        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("d"),
                        F.max("v").over(upto).alias("e"), F.sum("v").over(upto).alias("f"))
    v = F.col("v")
    sliced = carry(rows, ["session"], ["t"], chunk_by(F.col("t"), width), last={"a": v}, prev={"b": v},
                   following={"c": v}, after={"d": v}, running_max={"e": v}, running_sum={"f": v})
    assert sorted(plain.collect(), key=str) == sorted(sliced.select(plain.columns).collect(), key=str)


def test_row_index_and_percentile(rows):
    got = with_row_index(rows, ["session"], ["t"], chunk_by(F.col("t"), 5)).collect()
    assert all(r.n == r.t for r in got)
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95}
    want = rows.groupBy("session").agg(*[F.percentile("v", F.lit(p)).alias(k) for k, p in probs.items()]).collect()
    have = exact_percentile(rows, ["session"], "v", probs, 3).collect()
    for a, b in zip(sorted(want), sorted(have)):
        assert all(math.isclose(a[k], b[k]) for k in probs)


def test_smoothing_is_the_same_in_small_blocks(spark):
    data = [(s, n, n * 0.01, rnd.random(), rnd.random() * 0.02 + (n // 9) % 3 * 0.3, rnd.random() * 0.02)
            for s, k in ((1, 200), (2, 9), (3, 8)) for n in range(k)]
    g = spark.createDataFrame(data, "session int, n int, ts double, confidence double, x double, y double")
    g = g.withColumns({"factor": F.lit(1.0) + F.col("confidence"), "base_xx": F.lit(1e-5), "base_xy": F.lit(2e-6),
                       "base_yy": F.lit(2e-5), "bias_xx": F.lit(1e-6), "bias_xy": F.lit(0.0), "bias_yy": F.lit(1e-6)})
    whole = {(r.session, r.n): r for r in G.smooth(g, model=True).collect()}
    small = G.smooth(g, model=True, block=16).collect()
    assert len(small) == len(data) == len(whole)
    for r in small:
        o = whole[r.session, r.n]
        for k in ("ts", "sx", "sy", "cov_xx", "cov_xy", "cov_yy"):
            assert (r[k] is None) == (o[k] is None)
            assert r[k] is None or math.isclose(r[k], o[k], rel_tol=1e-9, abs_tol=1e-15)
        if r.session == 3:
            assert r.sx == r.x and r.cov_xx is None


def test_smoothed_covariance_dominates_scatter_and_formal(spark):
    """Raised covariance minus formal and minus observed one is positive semidefinite."""
    data = [(1, n, 0.9, 0.5 + rnd.gauss(0, 0.004), 0.5 + rnd.gauss(0, 0.0005)) for n in range(40)]
    g = spark.createDataFrame(data, "session int, n int, confidence double, x double, y double").withColumns(
        {"factor": F.lit(1.0), "base_xx": F.lit(1e-6), "base_xy": F.lit(0.0), "base_yy": F.lit(1e-6),
         "bias_xx": F.lit(0.0), "bias_xy": F.lit(0.0), "bias_yy": F.lit(0.0)})
    for r in G.smooth(g, jump_px=1e9, model=True).collect():
        near = [d for d in data if abs(d[1] - r.n) <= 4]
        k = len(near)
        e = [sum((d[3] - r.sx) ** 2 for d in near) / k / k, sum((d[3] - r.sx) * (d[4] - r.sy) for d in near) / k / k,
             sum((d[4] - r.sy) ** 2 for d in near) / k / k]
        for other in (e, [1e-6 / k, 0.0, 1e-6 / k]):
            a, b, c = r.cov_xx - other[0], r.cov_xy - other[1], r.cov_yy - other[2]
            assert a > -1e-12 and c > -1e-12 and a * c - b * b > -1e-15


def test_ema_and_runs_across_blocks(spark):
    vals = [rnd.random() for _ in range(700)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "session int, frame int, v double")
    for keep in (0.85, 0.95):
        want, acc = [], None
        for v in vals:
            acc = v if acc is None else keep * acc + (1 - keep) * v
            want.append(acc)
        got = {r.frame: r.e for r in W.ema(df, "v", keep, "e", "frame").collect()}
        assert all(math.isclose(got[i], w, rel_tol=1e-12) for i, w in enumerate(want))
    flag = [v > 0.4 for v in vals]
    length, want = 0, []
    for f in flag:
        length = length + 1 if f else 0
        want.append(length)
    got = {r.frame: r.run_len for r in W.runs(df, F.col("v") > 0.4, chunk=11).collect()}
    assert [got[i] for i in range(len(vals))] == want


def test_asof_clamps_and_intervals_cover(spark):
    gaze = spark.createDataFrame([("a", t / 10) for t in range(100)], "session string, ts double")
    frames = spark.createDataFrame([("a", i, 2.0 + i * 0.55) for i in range(8)], "session string, frame int, ts double")
    times = [2.0 + i * 0.55 for i in range(8)]
    for width in (0.3, 60.0):
        for r in J.align_to_frames(gaze, frames, width).collect():
            assert r.frame == max(0, sum(t <= r.ts for t in times) - 1)
    spans = [(1.0, 2.0), (1.5, 1.7), (4.0, 9.05), (5.0, 5.5)]
    iv = spark.createDataFrame([("a", *s) for s in spans], "session string, start double, end double")
    kept = {r.ts for r in J.exclude_blinks(gaze, iv, chunk_s=0.7).collect()}
    assert kept == {t / 10 for t in range(100) if not any(a <= t / 10 <= b for a, b in spans)}


def test_streak_forgives_short_misses(spark):
    flags = [1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 1, 1]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "session int, frame int, f boolean")
    got = W.streak_with_tolerance(df, F.col("f"), 3, 2, chunk=2).collect()
    assert [(r.start, r.confirmed) for r in got] == [(7, 10)]


def test_unknown_keys_and_times_stay_and_count_for_nobody(spark):
    nan, inf = float("nan"), float("inf")
    data = [(None, 1.0, 10), (None, 2.0, None), (None, 70.0, 5), (1, None, 90), (1, nan, 91), (1, inf, 92), (1, 3.0, 7), (1, 200.0, None)]
    df = spark.createDataFrame(data, "session int, t double, v int")
    v = F.col("v")
    got = {(r.session, str(r.t)): r for r in carry(df, ["session"], ["t"], chunk_by(F.col("t"), 60.0), last={"a": v}, prev={"b": v}, following={"c": v},
                                                    after={"d": v}, running_max={"e": v}, running_sum={"f": v}).collect()}
    assert len(got) == len(data)
    assert [got[None, "70.0"][k] for k in "abcdef"] == [5, 10, 5, None, 10, 15]
    assert [got[None, "2.0"][k] for k in "abcdef"] == [10, 10, 5, 5, 10, 10]
    assert [got[1, "200.0"][k] for k in "abcdef"] == [7, 7, None, None, 7, 7]
    assert all(got[1, t][k] is None for t in ("None", "nan", "inf") for k in "abcdef")
    n = {(r.session, str(r.t)): r.n for r in with_row_index(df, ["session"], ["t"], chunk_by(F.col("t"), 60.0)).collect()}
    assert n == {(None, "1.0"): 0, (None, "2.0"): 1, (None, "70.0"): 2, (1, "3.0"): 0, (1, "200.0"): 1, (1, "None"): None, (1, "nan"): None, (1, "inf"): None}


def test_joins_keep_samples_without_time_or_session(spark):
    g = spark.createDataFrame([(1, 0.5), (1, None), (None, 0.5), (1, 5.0)], "session int, ts double")
    frames = spark.createDataFrame([(1, 0.0, 0), (1, 1.0, 1), (None, 0.4, 7)], "session int, ts double, frame int")
    got = sorted(((r.session, r.ts, r.frame) for r in J.align_to_frames(g, frames).collect()), key=str)
    assert got == sorted([(1, 0.5, 0), (1, None, None), (None, 0.5, 7), (1, 5.0, 1)], key=str)
    blinks = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.1, None), (None, None, 2.0)], "session int, start double, end double")
    kept = sorted(((r.session, r.ts) for r in J.exclude_blinks(g, blinks).collect()), key=str)
    assert kept == sorted([(1, None), (None, 0.5), (1, 5.0)], key=str)


def test_percentiles_of_odd_values_and_concentrated_ones(spark):
    data = [(None, float(k % 3)) for k in range(30)] + [(1, 1.0)] * 50 + [(1, 1.0 + k * 1e-9) for k in range(500)] + [(1, None), (1, float("nan"))]
    df = spark.createDataFrame(data, "session int, v double")
    got = {r.session: (r.q, r.m) for r in exact_percentile(df, ["session"], "v", {"q": 0.25, "m": 0.5}, 4).collect()}
    import numpy as np
    for s in (None, 1):
        vals = [x for k, x in data if k == s and x is not None and x == x]
        assert np.allclose(got[s], np.percentile(vals, [25, 50]), rtol=0, atol=1e-15)


@pytest.mark.parametrize("keep", [0.0, 0.001, 0.5, 0.9, 0.99, 0.9995])
def test_running_average_for_any_factor(spark, keep):
    data = [(s, n, rnd.random()) for s in (1, 2) for n in range(700 if s == 1 else 3)]
    got = {(r.session, r.n): r.e for r in W.ema(spark.createDataFrame(data, "session int, n int, v double"), "v", keep, "e", "n").collect()}
    assert len(got) == len(data)
    state = {}
    for s, n, v in data:
        state[s] = v if n == 0 else keep * state[s] + (1 - keep) * v
        assert math.isclose(got[s, n], state[s], rel_tol=1e-9, abs_tol=1e-15)
