import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import language_id as L

SF = "/root/testdata/sf0.01"
VOCABULARY = {"aa": "tala mora sila nara kalo", "bb": "ütz weng schil ückt ptaß", "cc": "слово время город рука"}


def corpus():
    r = np.random.default_rng(0)
    return [(k, " ".join(r.choice(VOCABULARY[lang].split(), 30)), lang) for k, lang in enumerate(list(VOCABULARY) * 8)]


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.createDataFrame(corpus() + [(90, None, "aa"), (91, "tala", None)], "doc_id long, text string, lang string"))


def test_learned_languages(model):
    langs, scores, candidates = model
    assert langs == ["aa", "bb", "cc"] and candidates[L.SCRIPT_NAMES.index("cyrillic")].tolist() == [False, False, True]
    assert candidates[L.SCRIPT_NAMES.index("han")].all()


def test_mixed_text_and_odd_rows(make, odd, model):
    mixed = "tala mora sila nara. ütz weng schil ückt ptaß weng! слово время город"
    rows = odd + [(30, mixed), (31, "TALA MORA"), (32, "12 ½ --")]
    got = {r["doc_id"]: r for r in L.identify(make(rows), model, keep_spans=True).collect()}
    assert [s["lang"] for s in got[30]["spans"]] == ["aa", "bb", "cc"] and mixed[got[30]["spans"][1]["start"]:][:3] == "ütz"
    assert got[30]["lang_pred"] == "bb" and 0.3 < got[30]["score"] < 0.6
    assert got[31]["lang_pred"] == "aa" and got[31]["score"] == 1.0
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 5, 8, 32))
    assert got[7]["lang_pred"] in model[0] and got[6]["lang_pred"] in model[0] and got[9]["text"] == "One"
    assert L.identify(make([(1, "a")]).where("false"), model).count() == 0


def test_nothing_learned(spark, make):
    model = L.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    assert L.identify(make([(1, "word")]), model).first()["lang_pred"] == "und"


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_path(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 7, 9)
    scores = r.normal(size=(int(lengths.sum()), 3)).astype(np.float32) * 3
    got = L.viterbi(scores, lengths, 2.0)
    value = lambda s, path: sum(s[k, p] for k, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    at = 0
    for n in lengths:
        s, path = scores[at: at + n], got[at: at + n]
        assert n == 0 or value(s, path) == pytest.approx(max(value(s, p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)
        at += n


def test_cache_starts_afresh(model, monkeypatch):
    table = L.WordScores(*model[1:])
    a = table.rows_of(["tala", "ütz"])
    monkeypatch.setattr(L, "WORD_CACHE", 1)
    assert (table.rows_of(["ütz", "tala"]) == a[::-1]).all()


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.is_held_out(F.col("doc_id"), 4, 2)
    got = L.identify(docs, L.fit(docs.where(~out))).where(out).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.98
