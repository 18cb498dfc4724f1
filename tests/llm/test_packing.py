import zlib

import numpy as np
import pytest

from gazeloom.llm import packing as P, tokens


def check_plan(counts, capacity):
    plan = P.complete_bins(counts, capacity)
    packed = np.zeros_like(counts)
    for content, times in plan:
        assert sum(content) <= capacity and times > 0
        for s in content:
            packed[s] += times
    assert (packed == counts).all()
    return sum(n for _, n in plan)


def optimum(sizes, capacity):
    """Fewest bins by dynamic programming over subsets."""
    n = len(sizes)
    best = [(0, 0)] + [None] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        options = []
        for k in range(n):
            if mask >> k & 1:
                bins, used = best[mask ^ 1 << k]
                options.append((bins, used + sizes[k]) if bins and used + sizes[k] <= capacity else (bins + 1, sizes[k]))
        best[mask] = min(options)
    return best[-1][0]


@pytest.mark.parametrize("seed", range(25))
def test_small_cases_are_optimal(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 21, 9).tolist()
    assert check_plan(np.bincount(sizes, minlength=21), 20) == optimum(sizes, 20)


def test_bin_completion_beats_the_first_incumbent():
    sizes = [6, 6, 5, 5, 4, 4]  # best fit decreasing opens four bins of 10 at most; three suffice
    assert check_plan(np.bincount(sizes, minlength=11), 10) == 3
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    counts = np.bincount(sizes, minlength=61)
    assert check_plan(counts, 60) == optimum(sizes, 60) <= sum(n for _, n in P.best_fit_decreasing(counts, 60))


@pytest.mark.parametrize("copies", [1, 3, 50, 1000])
def test_fillings_are_mixed(copies):
    counts = np.zeros(1025, np.int64)
    for size, n in {612: 2, 561: 3, 306: 1, 255: 3, 204: 4, 153: 2}.items():
        counts[size] = n * copies
    assert P.lower_bound(counts, 1024) <= 5 * copies == check_plan(counts, 1024) < sum(n for _, n in P.best_fit_decreasing(counts, 1024))


def test_bounds_and_dominance():
    assert P.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3
    assert P.fillings(np.bincount([4, 3, 1], minlength=11), 4) == [(4,)]
    assert P._fits_into((2, 1), (3,)) and not P._fits_into((3,), (2, 2))
    assert check_plan(np.zeros(11, np.int64), 10) == 0


def test_many_pieces_come_close_to_the_volume():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1025, 200_000), minlength=1025)
    assert check_plan(counts, 1024) <= 1.002 * -(-int((counts * np.arange(1025)).sum()) // 1024)


def verify(df, rows, capacity=1024):
    got = df.toPandas()
    want = []
    for i, t in rows:
        ids = np.array(tokens.library().encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    have = [(None if i != i else int(i), *x) for i, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(str, have)) == sorted(map(str, want))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= capacity and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    return got


def test_operator(make, odd):
    rows = odd + [(60 + k, "one two three") for k in range(700)]
    got = verify(P.pack(make(rows)), rows)
    assert got.sequence_id.nunique() == -(-got.length.sum() // 1024)
    assert P.pack(make([(1, "a")]).where("false")).count() == 0


def test_other_capacity(make):
    rows = [(k, "pine " * k) for k in range(40)]
    verify(P.pack(make(rows), 16), rows, 16)
