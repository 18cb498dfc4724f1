import hashlib
import random

import numpy as np
import pytest

from gazeloom.llm import suffix_dedup as X
from tests.llm.conftest import prose


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p: p + length]] = seen.get(t[p: p + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p: p + length]] > 1:
                gone[p: p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **k):
    return sorted((tuple(r) for r in X.remove_repeats(df, **k).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def sharing(n=14):
    r = random.Random(4)
    shared = [prose(700 + k, 130) for k in range(3)]
    rows = []
    for k in range(n):
        parts = [prose(800 + 10 * k + j, 60) for j in range(3)]
        for s in shared:
            if r.random() < 0.6:
                a = r.randrange(0, 200)
                parts.insert(r.randrange(4), s[a: a + r.randrange(300, 900)])
        rows.append((300 + k, " ".join(parts)))
    return rows


@pytest.mark.parametrize("large", [1_024, 3])
def test_against_brute_force(make, odd, monkeypatch, large):
    monkeypatch.setattr(X, "LARGE_GROUP", large)
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in odd] + sharing()
    rows += [(400, "ab" * 600), (401, "ba" * 500), (402, "é" * 500), (403, "x" * 399), (404, "x" * 400), (405, "y" * 401), (406, prose(1, 100) * 2), (407, prose(9, 300)[:400]), (408, prose(9, 300)[:399])]
    assert run(make(rows)) == brute(rows, 400)


@pytest.mark.parametrize("seed", range(8))
def test_collections_against_brute_force(seed):
    """Small strings over few letters around equal cores."""
    r = random.Random(seed)
    core = "".join(r.choice("ab") for _ in range(6)).encode()
    other = core[::-1] + b"c"
    strings, places = [], []
    for _ in range(60):
        c = core if r.random() < 0.7 else other[:6]
        p = r.randrange(0, 5)
        n = r.randrange(max(12 - 6 - p, 0), 7)
        s = bytes(r.choice(b"ab") for _ in range(p)) + c + bytes(r.choice(b"ab") for _ in range(n))
        if (s, p) not in list(zip(strings, places)) and len(s) - 12 <= p:
            strings.append(s)
            places.append(p)
    got = X.repeated_windows(strings, places, 12, 6)
    for k, (s, p) in enumerate(zip(strings, places)):
        for x in range(len(s) - 11):
            # Windows are equal if they have the same bytes with the core at the same place.
            want = any(x - p + q >= 0 and t[x - p + q: x - p + q + 12] == s[x: x + 12] for j, (t, q) in enumerate(zip(strings, places)) if j != k and x - p + q < len(t) - 11)
            assert not want or got[k][x], (s, x)
            assert not got[k][x] or want or any(t[y: y + 12] == s[x: x + 12] for j, t in enumerate(strings) for y in range(len(t) - 11) if (j, y) != (k, x))


def test_runs_tile_the_windows_alike_everywhere(monkeypatch):
    data = prose(31, 4000).encode()
    first, count, place, core, _ = X.runs(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(data) - 399
    assert (place - count + 1 >= 0).all() and (place <= 200).all()
    shifted = X.runs(b"other text in front " + data)
    assert len(set(core.tolist()) - set(shifted[3].tolist())) == 0
    monkeypatch.setattr(X, "CHUNK", 1000)
    parts = X.runs(data)
    assert np.repeat(parts[0] + parts[2], parts[1]).tolist() == np.repeat(first + place, count).tolist()


def test_empty_table_and_short_texts(make):
    assert X.remove_repeats(make([(1, "a")]).where("false")).count() == 0
    assert run(make([(1, "a" * 399), (2, "a" * 399)])) == brute([(1, "a" * 399), (2, "a" * 399)], 400)


def test_null_and_shared_ids(make):
    """Texts under one id, or under none, are told apart by all of their bytes."""
    passage = prose(50, 100)
    rows = [(i, f"{prose(60 + k, 80)} {passage if k % 3 == 0 else ''} {prose(90 + k, 30)}") for k, i in enumerate([None] * 12 + [7] * 12)]
    rows += [rows[1], rows[13], (-(1 << 63), prose(99, 90)), (None, prose(98, 90))]
    got = run(make(rows))
    assert got == brute(rows, 400) and sum(r[2] == 0 for r in got) == 16


def test_minima():
    r = np.random.default_rng(1)
    v = r.integers(0, 500, 2000).astype(np.uint16)
    first = r.integers(0, 2000, 300)
    last = np.minimum(first + r.integers(0, 400, 300), 1999)
    assert X.range_minima(v, first, last).tolist() == [v[a: b + 1].min() for a, b in zip(first, last)]
    assert X.range_minima(v, first[:0], last[:0]).tolist() == []


def test_rounds_write_two_short_transforms(monkeypatch):
    """What stands behind a core does not pass through the rounds of what stands in front."""
    written, real = [], X.Sequential.write
    monkeypatch.setattr(X.Sequential, "write", lambda self, suffixes: written.append(len(suffixes)) or real(self, suffixes))
    r = random.Random(5)
    core = bytes(r.choice(b"abc") for _ in range(200))
    front, rest = (bytes(r.choice(b"abc") for _ in range(200)) for _ in range(2))
    strings = [front + core + rest[:199] + b"x", b"y" + front[1:] + core + rest, front[100:] + core + rest[:150], front + core + b"z" * 200]
    places = [200, 200, 100, 200]
    got = X.repeated_windows(strings, places)
    assert [X._ranges(x) for x in got] == [[0, 200], [1, 200], [0, 51], [0, 1]]
    # One transform of all 401 symbols would write about 401 * 402 / 2 suffixes a string.
    assert sum(written) < 0.55 * len(strings) * 401 * 402 / 2
