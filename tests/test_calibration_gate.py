"""The bootstrap gate against a seeded generator."""
import numpy as np
from pyspark.sql import functions as F

from gazeloom.operators import calibration as K


def test_draws_are_uniform(spark):
    d = spark.range(500).select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"), F.col("id").alias("rep"))
    n = d.select("rep", K.draw(F.lit(7), F.col("rep"), F.col("i"), F.lit(40)).alias("k"))
    per = [r.c for r in n.groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(per) == 40 and max(per) < 650 and min(per) > 370  # 500 expected
    share = n.groupBy("rep").agg((F.count_distinct("k") / 40).alias("s")).agg(F.avg("s"), F.stddev("s")).first()
    assert abs(share[0] - (1 - (1 - 1 / 40) ** 40)) < 0.01 and share[1] < 0.08


def test_decisions_agree_with_a_seeded_generator(spark):
    r = np.random.default_rng(3)
    sets = []
    for s in range(60):
        n = int(r.integers(4, 45))
        base = r.gamma(4, 5, n)
        sets.append((base, base * r.normal(0.75 + 0.4 * (s % 3), 0.25, n).clip(0.05)))
    rows = [(s, i // 9, i % 9, float(b), float(c)) for s, (base, corr) in enumerate(sets) for i, (b, c) in enumerate(zip(base, corr))]
    got = {g.session: g for g in K.gate(spark.createDataFrame(rows, "session int, panel int, dot int, base double, corr double")).collect()}
    agree, off = 0, []  # two runs of a generator differ, most where dots are few
    for s, (base, corr) in enumerate(sets):
        g = got[s]
        if len(base) < 6:
            assert not g["apply"] and g.gain is None and g.gain_lo is None and g.base_px is None
            agree += 1
            continue
        rng = np.random.default_rng(s)
        gains = []
        for _ in range(500):
            k = rng.integers(0, len(base), len(base))
            gains.append(1 - np.median(corr[k]) / np.median(base[k]))
        lo, hi = np.percentile(gains, [5, 95])
        off += [abs(g.gain_lo - lo), abs(g.gain_hi - hi)]
        assert abs(g.base_px - np.median(base)) < 1e-9
        agree += g["apply"] == (lo > 0 and np.median(base) >= 12)
    assert agree >= 58 and np.mean(off) < 0.03 and np.quantile(off, 0.9) < 0.08


def test_large_recordings_take_buckets_with_the_same_result(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(s, i // 9, i % 9, float(b), float(b * c)) for s, n in ((1, 40), (2, 300), (3, 5)) for i, (b, c) in enumerate(zip(r.gamma(4, 5, n).round(1), r.normal(0.8, 0.2, n).clip(0.05)))]
    errors = spark.createDataFrame(rows, "session int, panel int, dot int, base double, corr double")
    one = {g.session: g for g in K.gate(errors, reps=40).collect()}
    monkeypatch.setattr(K, "GROUP_DOTS", 100)
    two = {g.session: g for g in K.gate(errors, reps=40).collect()}
    assert set(one) == set(two) == {1, 2, 3} and one[3] == two[3] and one[3].gain_lo is None
    for s in (1, 2):
        assert one[s]["apply"] == two[s]["apply"] and all(abs(one[s][c] - two[s][c]) < 1e-9 for c in ("base_px", "corr_px", "gain", "gain_lo", "gain_hi"))


def test_draws_by_counts_are_the_draws_one_by_one(spark):
    errors = spark.createDataFrame([(7, i // 9, i % 9, float(i), float(2 * i)) for i in range(20)], "session int, panel int, dot int, base double, corr double")
    got = {(x.rep, int(x.base)): x.times for x in K.resamples(errors, reps=5).collect()}
    import hashlib
    from collections import Counter
    want = Counter((rep, int(hashlib.md5(f"7,{rep},{i}".encode()).hexdigest()[:8], 16) % 20) for rep in range(5) for i in range(20))
    assert got == dict(want)
