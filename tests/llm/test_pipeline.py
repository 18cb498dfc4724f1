"""The stages against brute force on the smallest scale."""
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from gazeloom.llm import tokens
from tests.llm import test_line_dedup
from tests.llm.conftest import prose
from tests.llm.similarity import brute_pairs, groups

SF = "/root/testdata/sf0.001"


def brute(rows, items):
    """doc_id -> text before packing. The language stage keeps what has letters: the given texts are of one language each."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    rows = [(i, t) for i, t, _, n, _ in test_line_dedup.brute(rows) if n == 0 or t.strip(" ")]
    top = groups(len(rows), brute_pairs([t for _, t in rows]))
    rows = [rows[k] for k in range(len(rows)) if rows[k][0] == min(i for n, (i, _) in enumerate(rows) if top[n] == top[k])]
    grams = {tuple(w[k: k + 10]) for w in (t.lower().split() for t in items) for k in range(len(w) - 9)}
    return {i: t for i, t in rows if not any(tuple(w[k: k + 10]) in grams for w in [t.lower().split()] for k in range(len(w) - 9))}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items)
    pieces = []
    for i, t in want.items():
        ids = np.array(tokens.library().encode(t, add_special_tokens=False).ids + [2], "<u4")
        at, size, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            pieces.append((i, k, at, size, zlib.crc32(ids[at: at + size].tobytes())))
            at, size, k = at + size, 1024, k + 1
    got = C.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(b)[:k]) for b in bins.values() for k, (o, _) in enumerate(sorted(b)))
    volume = -(-sum(r["length"] for r in got) // 1024)
    assert max(sum(n for _, n in b) for b in bins.values()) <= 1024 and len(bins) <= volume + 3


def test_stages_keep_the_columns_and_odd_rows(spark, make, odd):
    docs = make(odd + [(60, prose(60, 50))]).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert 60 in ids or name == "language_id", name
    assert C.STAGES[-1][1](spark, docs, SF).count() > 0


def test_stages_on_an_empty_table(spark, make):
    docs = make([(1, "a")]).where("false").withColumn("n_chars", F.lit(1))
    assert all(stage(spark, docs, SF).count() == 0 for _, stage in C.STAGES)


def test_registered_queries():
    import __spark_entry__ as e
    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_duplicates", "benchmark", "packing"]
