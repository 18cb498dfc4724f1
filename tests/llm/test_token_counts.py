import random
from collections import Counter

import numpy as np

from gazeloom.llm import token_counts, tokens


def test_counts_are_the_librarys(make, odd):
    rows = odd + [(50, "a<|endoftext|>b  <|endoftext|><|endoftext|>"), (51, "it's we'll \n\n  x   y\u0085z"), (52, "a" * 5000)]
    got = sorted((tuple(r) for r in token_counts.count_tokens(make(rows), limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    n = lambda t: len(tokens.library().encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 100) for i, t in rows), key=str)


def test_ids_of_random_texts():
    r, table = random.Random(2), tokens.WordIds()
    alphabet = list("ab éÉ'sß \n\n  \t0123²$%!?,.|") + ["<|endoftext|>", "'ll", "漢", " ", "\u0085", " ", "🙂", " a", "\x1c"]
    for _ in range(5000):
        t = "".join(r.choices(alphabet, k=r.randrange(14)))
        want = tokens.library().encode(t, add_special_tokens=False).ids
        assert np.frombuffer(tokens.text_ids(t, table), "<u4").tolist() == want, repr(t)
        assert token_counts.Lengths({}).count(t) == len(want), repr(t)


def test_a_small_table_only_costs_time(make):
    df = make([(k, f"word{k} is here") for k in range(50)])
    assert len(token_counts.frequent_lengths(df, entries=4)) <= 4
    assert [r["n_tokens"] for r in token_counts.count_tokens(df, entries=1).orderBy("doc_id").collect()] == [
        len(tokens.library().encode(f"word{k} is here", add_special_tokens=False).ids) for k in range(50)]


def test_summaries_stay_bounded_and_keep_heavy_entries():
    c = Counter({f"w{k}": 1 for k in range(1000)})
    c["heavy"] = 500
    assert token_counts.prune(c, 10).most_common(1)[0][0] == "heavy" and len(token_counts.prune(c, 10)) <= 10


def test_summary_tree(make, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN_IN", 2)
    assert token_counts.frequent_lengths(make([(k, "the same words") for k in range(40)], 9))[" same"] == 1


def test_empty_table(make):
    assert token_counts.count_tokens(make([(1, "a")]).where("false")).count() == 0
