"""Language identification of mixed-language texts.

A word's script narrows the languages that can have written it. Hashed character trigrams give every word a score
per language, and the Viterbi path over a text's words, with a penalty for switching, labels its spans. The text's
language is the one whose spans hold most letters.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import packed, rows, slices, strings, unpacked

#: Labelled documents per language that the model is fitted on (expected number; whole texts, chosen by a hash of doc_id).
SAMPLE = 2_000
GRAM = 3
GRAM_BUCKETS = 1 << 15
SMOOTHING = 0.3
#: What a language can gain over the others with one word, and what a switch costs, in nats.
WORD_SPAN = 6.0
SWITCH = 7.0
#: Share of a language's words that a script needs to count as the language's.
SCRIPT_SHARE = 0.001
MOST_LANGUAGES = 256
WORD_CACHE = 150_000
#: Text labelled at once.
TOGETHER = 2 << 20
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges (Unicode blocks) and the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_OF = [SCRIPT_NAMES.index(s) for _, s in SCRIPTS]


def script_of(word: str) -> int:
    return _SCRIPT_OF[bisect_right(_STARTS, ord(word[0])) - 1]


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-case."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


class Grams(dict):
    def __missing__(self, gram: str) -> int:
        k = zlib.crc32(gram.encode()) % GRAM_BUCKETS
        if len(self) < WORD_CACHE:
            self[gram] = k
        return k

    def of(self, word: str) -> list[int]:
        w = f"^{word}$"
        return [self[w[i: i + GRAM]] for i in range(max(1, len(w) - GRAM + 1))]


def is_held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``part``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log scores [bucket, language], candidates [script, language] from (doc_id, text, lang).

    The driver gets one count per language and bucket, whatever the corpus holds.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((GRAM_BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))]), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), strings(part)):
                    found.setdefault(lang, Counter()).update(words_of(text))
        grams = Grams()
        for lang, words in found.items():
            n: Counter = Counter()
            for word, times in words.items():
                n[-1 - script_of(word)] += times
                for k in grams.of(word):
                    n[k] += times
            yield rows(schema, [lang] * len(n), list(n), list(n.values()))

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = np.array([langs.index(x) for x in counted.column("lang").to_pylist()], np.int64)
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    grams, scripts = np.zeros((GRAM_BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    is_gram = bucket >= 0
    grams[bucket[is_gram], at[is_gram]] = n[is_gram]
    scripts[-1 - bucket[~is_gram], at[~is_gram]] = n[~is_gram]
    scores = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * GRAM_BUCKETS))
    candidates = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0))
    candidates[~candidates.any(1)] = True  # a script that no language has says nothing
    return langs, scores.astype(np.float32), candidates


class WordScores(dict):
    """Word -> row of ``table``: its score per language, the best one at 0 and none below -WORD_SPAN; non-candidates well below."""

    def __init__(self, scores: np.ndarray, candidates: np.ndarray):
        super().__init__()
        self.scores, self.candidates, self.grams = scores, candidates, Grams()
        self.table, self.new = np.empty((0, scores.shape[1]), np.float32), []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Scores of the words; new ones are computed together."""
        if len(self) > WORD_CACHE:
            self.clear()
            self.table = self.table[:0]
        k = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            grams = [self.grams.of(w) for w in self.new]
            starts = np.r_[0, np.cumsum([len(g) for g in grams])[:-1]]
            s = np.add.reduceat(self.scores[np.concatenate(grams)], starts, axis=0)
            able = self.candidates[[script_of(w) for w in self.new]]
            top = np.where(able, s, -np.inf).max(1, keepdims=True)
            s = np.where(able, np.maximum(s - top, -WORD_SPAN), -2 * WORD_SPAN)
            self.table = np.concatenate([self.table, s.astype(np.float32)])
            self.new = []
        return self.table[k]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word of all texts, whose scores [word, language] stand one after another."""
    order = np.argsort(-lengths, kind="stable")
    start = np.r_[0, np.cumsum(lengths)[:-1]][order]
    alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")  # texts with a word at each step
    came = np.empty(scores.shape, np.uint8)
    own = np.arange(scores.shape[1], dtype=np.uint8)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t, n in enumerate(alive):  # texts by falling length, so the living ones are in front
        v = value[:n]
        best = v.argmax(1)
        top = v[np.arange(n), best][:, None] - np.float32(switch)
        stays = v >= top
        came[start[:n] + t] = np.where(stays, own, best.astype(np.uint8)[:, None])
        value[:n] = np.where(stays, v, top) + scores[start[:n] + t]
    label = np.empty(len(scores), np.uint8)
    last = value.argmax(1).astype(np.uint8)
    for t in range(len(alive) - 1, -1, -1):
        at = start[: alive[t]] + t
        label[at] = last[: alive[t]]
        last[: alive[t]] = came[at, last[: alive[t]]]
    return label


def spans(text: str, labels: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    """(first code point, end, language) of the runs of equal labels."""
    out: list[list] = []
    found = [m for m in WORD.finditer(text) if any(c.isalpha() for c in m.group())]
    for m, k in zip(found, labels):
        if out and out[-1][2] == langs[k]:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end(), langs[k]])
    return [tuple(x) for x in out]


def identify(docs: DataFrame, model: tuple, keep_text: bool = True, keep_spans: bool = False) -> DataFrame:
    """The documents with lang_pred and score, the share of letters in spans of that language; with ``spans`` if asked for.

    Null text or a text without a letter: ``und`` with score 0; so are all texts if no language was learned. Ties go
    to the language first by name. Other columns stay; those named like a result are replaced.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    own = packed(docs, "doc_id", "text")
    kept = ["doc_id", *["text"] * keep_text, "_rest"]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches):
        langs, scores, candidates = spread.value
        table = WordScores(scores, candidates)
        for batch in batches:
            for part in slices(batch, size=TOGETHER):
                texts = strings(part)
                words = [words_of(x) if langs else [] for x in texts]
                lengths = np.array([len(w) for w in words], np.int64)
                flat = [w for ws in words for w in ws]
                labels = viterbi(table.rows_of(flat), lengths) if flat else np.empty(0, np.uint8)
                letters = np.fromiter(map(len, flat), np.int64, len(flat))
                doc = np.repeat(np.arange(len(texts)), lengths)
                held = np.bincount(doc * max(1, len(langs)) + labels, letters, len(texts) * max(1, len(langs))).reshape(len(texts), -1)
                best, total = held.argmax(1), held.sum(1)
                cols = {c: part.column(c) for c in kept}
                cols["lang_pred"] = [langs[b] if n else UNDETERMINED for b, n in zip(best, total)]
                cols["score"] = held.max(1) / np.maximum(1, total)
                if keep_spans:
                    ends = np.cumsum(lengths)
                    cols["spans"] = pa.array([[dict(zip(("start", "end", "lang"), s)) for s in spans(x, labels[e - n: e], langs)]
                                              for x, e, n in zip(texts, ends, lengths)], span_type)
                yield pa.RecordBatch.from_pydict(cols)

    out = own.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    results = ["lang_pred", "score"]
    if keep_spans:
        out = out.select("*", F.lit(None).cast("array<struct<start:int,end:int,lang:string>>").alias("spans"))
        results.append("spans")
    return unpacked(own.mapInArrow(label, out.schema), docs if keep_text else docs.drop("text"), *results)
