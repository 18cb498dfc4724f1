"""Exact five-word similarity by brute force."""
from collections import Counter


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_pairs(texts, least=0.8):
    """All pairs of positions with a Jaccard index of ``least`` or more, by shared shingles."""
    sets, where, out = [shingles(t) for t in texts], {}, []
    for b, s in enumerate(sets):
        shared = Counter(a for x in s for a in where.get(x, ()))
        out += [(a, b) for a, n in shared.items() if 5 * n >= 5 * least * (len(sets[a]) + len(s) - n) - 1e-9]
        for x in s:
            where.setdefault(x, []).append(b)
    return out


def groups(n, pairs):
    up = list(range(n))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(k) for k in range(n)]
