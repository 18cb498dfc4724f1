import re

import numpy as np
import pytest
import xxhash

from gazeloom.llm import common, simhash as S
from tests.llm.conftest import prose


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k: k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    members = {}
    for k, (i, _) in enumerate(rows):
        members.setdefault(find(k), []).append(i)
    return sorted(((i, f"{prints[k]:016x}", min((x for x in members[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)


def run(df):
    return sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)


def copies():
    base = prose(77, 900).split(" ")
    out = []
    for k in range(25):
        w = list(base)
        w[20 + k * 30] = "changed"
        out.append((100 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("large", [20_000, 3])
def test_against_brute_force(make, odd, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE_TRIE", large)
    rows = odd + copies() + [(200 + k, prose(500 + k, 30)) for k in range(40)]
    got = run(make(rows))
    assert got == brute(rows)
    assert len({g[2] for g in got if g[0] and 100 <= g[0] < 125}) < 25


@pytest.mark.parametrize("seed", range(6))
def test_walk_finds_every_link(seed):
    r = np.random.default_rng(seed)
    centre = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.concatenate([centre, *[centre ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for _ in range(12)],
                          *[centre ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for _ in range(12)]])
    fps = np.unique(fps)
    groups = np.sort(r.integers(0, 2, len(fps)))
    order = np.lexsort((fps, groups))
    fps = fps[order]
    a, b = S.walk(groups, fps)
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for x, y in zip(a, b):
        parent[find(x)] = find(y)
    want = list(range(len(fps)))

    def top(k):
        while want[k] != k:
            k = want[k]
        return k
    for x in range(len(fps)):
        for y in range(x):
            if groups[x] == groups[y] and int(fps[x] ^ fps[y]).bit_count() <= 3:
                want[top(x)] = top(y)
    assert len({(find(k), top(k)) for k in range(len(fps))}) == len({find(k) for k in range(len(fps))}) == len({top(k) for k in range(len(fps))})


def test_a_large_front_is_walked_in_parts(monkeypatch):
    fps = np.unique(np.random.default_rng(0).integers(0, 256, 200).astype(np.uint64))
    whole = S.walk(np.zeros(len(fps)), fps)
    monkeypatch.setattr(S, "FRONT", 16)
    parts = S.walk(np.zeros(len(fps)), fps)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000 + (k * 7 + 3) % 50) for k in range(50)] + [(5, 5)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(301)) and all(got[k] >= 1000 for k in got if k >= 1000)


def test_empty_table(make):
    assert S.near_duplicates(make([(1, "a")]).where("false")).count() == 0
