import zlib

import numpy as np

from gazeloom.llm import quality as Q
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=240):
    rows, labels = [], []
    for k in range(n):
        good = k % 4 != 0
        rows.append((k, prose(k, 80) if good else " ".join(f"{w.upper()}!!" for w in prose(k, 80).split())))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, make, odd):
    rows, labels = corpus()
    labels += [(0, None), (None, 1), (999, 1), (3, 1), (3, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = make(rows)
    model = Q.fit(docs, lab)
    got = Q.score(docs, model).collect()
    want = dict(labels[:240])
    assert all(r["predicted"] == want[r["doc_id"]] for r in got if r["held_out"])
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert "text" not in got[0] and got[0]["h"] == "x"
    more = Q.score(make(odd), model).collect()
    assert len(more) == len(odd) and len({r["score"] for r in more if r["doc_id"] == 3}) == 1
    assert Q.score(docs.where("false"), model).count() == 0


def test_nothing_is_learned_from_held_out_rows(spark, make):
    rows, labels = corpus(60)
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (Q.fit(make(rows), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert (a == b).all() and a.any()


def test_without_labels(spark, make):
    model = Q.fit(make([(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score(make([(1, "a")]), model).first()["score"] == 0.5


def test_updates_and_features():
    table = Q.Tokens()
    at, x = Q.features("", table)
    assert at.tolist() == [Q.BIAS] and x.tolist() == [1.0]
    at, x = Q.features("Some words, some more words", table)
    assert (np.diff(np.sort(x[x > 0])) >= 0).all() and at.max() < 1 << Q.BITS
    w = Q.ftrl([(1, np.array([0, 1]), np.array([1.0, 1.0])), (0, np.array([0, 2]), np.array([1.0, 1.0]))] * 20)
    assert w[1] > 0 > w[2] and (w[3:] == 0).all()


def test_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
