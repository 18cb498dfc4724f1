"""The gate of ordinary recordings shuffles dots, never draws."""
import hashlib

import numpy as np

from gazeloom.functions.md5 import first_bits
from gazeloom.operators import calibration as K

ERRORS = "session string, panel int, dot int, base double, corr double"


def test_first_bits_of_md5():
    for start, places in ((b"7,", 7), (b"235000000,", 101), (b"s" * 60 + b",", 12)):
        lead = np.array([0, 9, 10, 123])
        want = [[int(hashlib.md5(b"%s%d,%d" % (start, r, i)).hexdigest()[:8], 16) for i in range(places)] for r in lead]
        assert first_bits(start, lead, places).tolist() == want


def test_draws_are_not_stored_and_odd_values_count_as_before(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(s, i // 9, i % 9, float(b), float(b * r.uniform(0.2, 0.9))) for s, n in (("a", 40), ("b", 12), ("c", 5), (None, 9)) for i, b in enumerate(r.gamma(4, 8, n))]
    rows += [("d", 0, k, None if k % 3 else 20.0, None if k < 7 else 5.0) for k in range(9)] + [("e", 0, k, float("nan") if k == 4 else 0.0, 3.0 + k) for k in range(9)]
    rows += [("f", None if k == 0 else 0, k, 15.0 + k, 2.0 + k) for k in range(9)]
    errors = spark.createDataFrame(rows, ERRORS)
    rounded = lambda g: tuple(round(v, 9) if isinstance(v, float) else v for v in g[1:])
    monkeypatch.setattr(K, "GROUP_DOTS", 1)
    spread = {g.session: rounded(g) for g in K.gate(errors, reps=30).collect()}
    monkeypatch.undo()
    calls, real = [], K.resamples
    monkeypatch.setattr(K, "resamples", lambda e, reps: calls.append({x.session for x in e.select("session").distinct().collect()}) or real(e, reps))
    got = {g.session: rounded(g) for g in K.gate(errors, reps=30).collect()}
    assert calls == [{"f"}]  # a dot without a place in the order
    assert set(got) == {"a", "b", "c", "d", "e", "f", None} and got["c"][1] is None and got["a"][5] is not None
    assert {k: str(v) for k, v in got.items() if k != "e"} == {k: str(v) for k, v in spread.items() if k != "e"}
    assert got["e"][1] == spread["e"][1] == 0.0 and got["e"][-1] is False
