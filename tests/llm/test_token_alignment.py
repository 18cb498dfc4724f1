import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gazeloom.llm import token_alignment as T
from gazeloom.llm.queries import QUERIES

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def tokens_of(text, a, b, of):
    """[(id, bytes)] of both for one whole text, from the entries alone; None without tokens."""
    if not text:
        return None
    ta = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    tb = [(i, piece(i)) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb) else None


def brute(texts):
    """Rows by two byte cursors over whole texts, without words, spans or caches."""
    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    of = {a.id_to_token(i): v for i, v in ((a.token_to_id(c), v) for c, v in T.byte_level().items())}
    per, counts = [], Counter()
    for text in texts:
        both = tokens_of(text, a, b, of)
        if both is None:
            per.append(None)
            continue
        place = []
        for side in both:
            at, spans = 0, []
            for i, x in side:
                spans.append((at, at + len(x), i))
                at += len(x)
            place.append(spans)
        links = []
        j = 0
        for s, e, i in place[0]:
            while place[1][j][1] <= s:
                j += 1
            k = j
            while k < len(place[1]) and place[1][k][0] < e:
                links.append((i, place[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in place[0]} & {e for _, e, _ in place[1]})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in place) if len(cuts) < 400 else None)
        if groups and groups[0] is None:  # long texts: the same with moving cursors
            groups, at = [], [0, 0]
            for hi in cuts:
                parts = []
                for n, side in enumerate(place):
                    begin = at[n]
                    while at[n] < len(side) and side[at[n]][1] <= hi:
                        at[n] += 1
                    parts.append(",".join(str(x[2]) for x in side[begin: at[n]]))
                groups.append("|".join(parts))
        counts.update(links)
        per.append((len(both[0]), len(both[1]), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else
            (*p[:3], len(p[3]), sum(counts[x] == top[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), hashlib.sha256(p[4].encode()).hexdigest()) for p in per]


def rows(df):
    return sorted(((r["doc_id"], *(r[c] for c in T.RESULTS)) for r in df.collect()), key=str)


ODD = ["<s> a</s> <0x0A> <|endoftext|>  b", "x▁y is not given back", "  leading and trailing  ", "tabs\tand\n\nlines \n of　wide spaces", "naïve Ärger — “quoted” façade",
       "漢字かな交じり文 Ελλάδα 🙂🙂 é ‍", " x    ", "\x00 \x01\x1c a\x1cb", "it's we'll 123456 don't", " ", "\n", "a" * 3000, "字" * 500 + " end"]


@pytest.mark.parametrize("table", [T.TABLE, 40, 0])
def test_against_whole_texts(make, odd, table, monkeypatch):
    monkeypatch.setattr(T, "CALL_CHARS", 300)
    data = [r for r in odd if r[0] != 6] + list(enumerate(ODD, 100)) + [(100, ODD[0])]
    got = T.align(make(data), A_FILE, B_FILE, table)
    assert got.columns == ["doc_id", "lang", "h", "_rest", "score", "n_lines", *T.RESULTS] and {r["h"] for r in got.collect()} == {"x"}
    assert rows(got) == sorted(((i, *w) for (i, _), w in zip(data, brute([t for _, t in data]))), key=str)


def test_random_texts(make):
    r = random.Random(5)
    alphabet = list("abcé ßñ  \n\t.,!?0189'-") + ["漢", "🙂", "▁", " the", " and", "<0x41>", " ", "</s>", "ﬁ", "é", " 　"]
    data = [(k, "".join(r.choices(alphabet, k=r.randrange(1, 30)))) for k in range(800)]
    assert rows(T.align(make(data), A_FILE, B_FILE, 500)) == sorted(((i, *w) for (i, _), w in zip(data, brute([t for _, t in data]))), key=str)


def test_small_caches_change_nothing(make, monkeypatch):
    data = [(k, f"word{k % 7} meets word{k % 5} in town{k} again") for k in range(60)]
    want = rows(T.align(make(data), A_FILE, B_FILE))
    monkeypatch.setattr(T, "CACHE_WORDS", 3)
    monkeypatch.setattr(T, "HELD_PAIRS", 2)
    assert rows(T.align(make(data, 1), A_FILE, B_FILE)) == want


def test_query_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows(QUERIES["op13_token_alignment"](spark, SF)) == sorted(((d["doc_id"], *w) for d, w in zip(docs, brute([d["text"] for d in docs]))), key=str)


def test_empty_table(make):
    assert T.align(make([(1, "a")]).where("false"), A_FILE, B_FILE).count() == 0
