"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question with other numbers or names keeps its template. Windows
of eight tokens meet the benchmark's windows by hash; where they do, the values in the slots must map from item to document
consistently. Besides, windows of the case-folded tokens as they are meet by hash, whatever they consist of, and whole items
where they are shorter than a window. What a document covers of an item by consistent and exact windows decides.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import materialise, slices, strings

WINDOW = 8
#: Literal tokens that a template window needs, and tokens that an item needs to be searched for by templates. Exact windows need neither.
LITERALS, ITEM_WORDS = 3, 5
#: A document holds an item if it covers so many tokens of it in a row, or this share of it.
RUN = 13
SHARE = 0.8
#: Window hashes of the benchmark that are broadcast as a filter (8 MB); with more, all windows are shuffled to the join.
BROADCAST_HASHES = 1 << 20
WORD_CACHE = 150_000
LITERAL, NUMBER, NAME, UNIT = range(4)

#: Scripts without spaces, where each character is a token: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = "\u0e00-\u0e4e\u0e80-\u0ece\u1000-\u103f\u1780-\u17d3\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W\d_{UNSPACED}]+(?:['’][^\W\d_{UNSPACED}]+)?|\d+(?:[.,:]\d+)*|[%$€£¥°]|[{UNSPACED}]")
# Fixed values.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
                         "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen twice".split())
UNITS = frozenset("% $ € £ ¥ ° mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg gram grams kilogram "
                  "kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours "
                  "day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts joule joules".split())


def kind_of(token: str) -> int:
    if token[0].isdigit():
        return NUMBER
    low = token.lower()
    if low in NUMBER_WORDS:
        return NUMBER
    if low in UNITS:
        return UNIT
    return NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else LITERAL


class Tokens(dict):
    """Token -> hash of its case-folded form with the kind in the two lowest bits."""

    def __missing__(self, token: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        kind = kind_of(token)
        v = self[token] = xxhash.xxh64_intdigest(token.casefold().encode()) & ~3 | kind
        return v


def _hashes(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(ids) - size + 1
    h = np.full(n, seed, np.uint64)
    for k in range(size):
        h = (h ^ ids[k: k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def windows(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes (signed) of the template windows, those with enough literal tokens."""
    if len(ids) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = ids & np.uint64(3)
    literal = np.r_[0, np.cumsum(kinds == LITERAL)]
    at = np.flatnonzero(literal[size:] - literal[:-size] >= LITERALS)
    return at, _hashes(np.where(kinds == LITERAL, ids, kinds), size, size)[at]


def exact_windows(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes (signed) of all windows of case-folded tokens."""
    if len(ids) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = _hashes(ids & ~np.uint64(3), size, size + 1000)
    return np.arange(len(h)), h


class Known:
    """Sorted hashes, with a table of their top bits that sorts out most others at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(16, len(hashes).bit_length() + 4))
        self.table = np.zeros(1 << int(64 - self.shift), np.bool_)
        self.table[hashes.view(np.uint64) >> self.shift] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of known hashes."""
        maybe = np.flatnonzero(self.table[h.view(np.uint64) >> self.shift])
        k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[k] == h[maybe]]


def _slots(tokens: list[str], ids: np.ndarray, at: int, size: int) -> tuple[str, list[str]]:
    """The window's template, and the values in its slots in lower case."""
    kinds = ids[at: at + size] & np.uint64(3)
    template = " ".join(t.casefold() if k == LITERAL else f"<{k}>" for t, k in zip(tokens[at: at + size], kinds))
    return template, [t.casefold() for t, k in zip(tokens[at: at + size], kinds) if k != LITERAL]


_ROWS = "h long, id long, pos int, size int, n_words int, n_templates int, templated boolean, template string, slots array<string>"
_SCHEMA = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("n_words", pa.int32()), ("n_templates", pa.int32()),
                     ("templated", pa.bool_()), ("template", pa.string()), ("slots", pa.list_(pa.string()))])


def _window_rows(known, sizes):
    """Arrow map from (id, text) to window rows. ``sizes``: window sizes, or None for an item's own; ``known``: broadcast hashes to keep, or None for all.

    n_templates: tokens that template windows can cover; templated: whether the window at this position can be one."""
    def cut(batches):
        table = Tokens()
        wanted = Known(known.value) if known is not None else None
        for batch in batches:
            for part in slices(batch):
                out = {f.name: [] for f in _SCHEMA}
                for doc, text in zip(part.column("id").to_pylist(), strings(part)):
                    tokens = TOKEN.findall(text)
                    ids = np.fromiter(map(table.__getitem__, tokens), np.uint64, len(tokens))
                    for size in sizes or [min(WINDOW, len(tokens))] * (len(tokens) > 0):
                        at, h = windows(ids, size) if size >= ITEM_WORDS else windows(ids[:0], size)
                        templated = set(at.tolist()) if sizes is None else ()
                        n_templates = len({p for a in templated for p in range(a, a + size)})
                        every, x = exact_windows(ids, size)
                        if wanted is not None:
                            hit = wanted.find(h)
                            at, h = at[hit], h[hit]
                            hit = wanted.find(x)
                            every, x = every[hit], x[hit]
                        for a, v in zip(at.tolist(), h.tolist()):
                            template, values = _slots(tokens, ids, a, size)
                            for name, y in zip(out, (v, doc, a, size, len(tokens), n_templates, True, template, values)):
                                out[name].append(y)
                        for a, v in zip(every.tolist(), x.tolist()):
                            same = "=" + " ".join(tokens[a: a + size]).casefold()  # no template begins so
                            for name, y in zip(out, (v, doc, a, size, len(tokens), n_templates, a in templated, same, [])):
                                out[name].append(y)
                yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
    return cut


def consistent(windows_of: list[tuple[int, int, list[str], list[str]]]) -> list[bool]:
    """Which windows (item position, size, item slots, document slots) along one alignment agree. An item value stands for the document
    value it meets most often (first by name among equals); windows with another one do not count."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for _, _, mine, theirs in windows_of:
        for a, b in zip(mine, theirs):
            votes[a][b] += 1
    stands = {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
    return [all(stands[a] == b for a, b in zip(mine, theirs)) for _, _, mine, theirs in windows_of]


def covered(windows_of: list[tuple[int, int, list[str], list[str]]]) -> tuple[set[int], int]:
    """Item positions covered by consistent windows, and the number of different slot values."""
    at: set[int] = set()
    changed: set[str] = set()
    for (pos, size, mine, theirs), good in zip(windows_of, consistent(windows_of)):
        if good:
            at.update(range(pos, pos + size))
            changed.update(a for a, b in zip(mine, theirs) if a != b)
    return at, len(changed)


def longest_run(at: set[int]) -> int:
    best = 0
    for p in at:
        if p - 1 not in at:
            q = p
            while q in at:
                q += 1
            best = max(best, q - p)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, longest_run, n_changed) for documents that hold a benchmark item.

    A document holds an item if it covers ``run`` tokens of it in a row, ``share`` of its tokens, or ``share`` of the tokens that template windows
    can cover (those with few literals meet by exact windows only). An item shorter than a window is found word for word whatever its
    length, an item of one word wherever the word stands.
    n_changed: slot values that differ from the item's. Null or empty texts hold nothing and are never held; rows with a null id are not
    searched. Repeated rows count once. Other columns are not carried.
    """
    spark = docs.sparkSession
    items = materialise(benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), "text").distinct()
                        .mapInArrow(_window_rows(None, None), _ROWS).distinct(), "templates")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most eight
    hashes = items.select("h").distinct()
    n = hashes.count()
    known = None
    if n <= BROADCAST_HASHES:
        known = spark.sparkContext.broadcast(np.sort(hashes.toArrow().column("h").to_numpy()))
    if not n:
        sizes = [WINDOW]
        known = spark.sparkContext.broadcast(np.array([0], np.int64))
    found = (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
             .mapInArrow(_window_rows(known, sizes), _ROWS).select("h", F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), F.col("template").alias("t"), F.col("slots").alias("theirs")))
    met = (found.join(items, "h").where(F.col("t") == F.col("template"))
           .select("doc_id", F.col("id").alias("item_id"), (F.col("doc_pos") - F.col("pos")).alias("shift"), "pos", "size", "n_words", "n_templates", "templated", F.col("slots").alias("mine"), "theirs"))
    result = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("n_covered", pa.int32()), ("longest_run", pa.int32()), ("n_changed", pa.int32())])

    def judge(batches):
        key, shift, n_words, n_templates = None, None, 0, 0
        along: list = []
        flags: list = []
        at: set[int] = set()
        of_templates: set[int] = set()
        changed = 0

        def end_alignment():
            nonlocal changed
            more, c = covered(along)
            at.update(more)
            changed = max(changed, c)
            for (p, size, *_), good, flag in zip(along, consistent(along), flags):
                if good and flag:
                    of_templates.update(range(p, p + size))
            along.clear()
            flags.clear()

        def end_pair(out):
            end_alignment()
            r = longest_run(at)
            if r >= run or at and len(at) >= share * n_words or of_templates and len(of_templates) >= share * n_templates:
                out.append((*key, n_words, len(at), r, changed))

        for batch in batches:
            out: list = []
            for d, i, s, p, size, n_w, n_t, flag, mine, theirs in zip(*(batch.column(k).to_pylist() for k in range(10))):
                if (d, i) != key:
                    if key is not None:
                        end_pair(out)
                    key, shift, n_words, n_templates, changed = (d, i), s, n_w, n_t, 0
                    at.clear()
                    of_templates.clear()
                elif s != shift:
                    end_alignment()
                    shift = s
                along.append((p, size, mine, theirs))
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, result)], schema=result)
        out = []
        if key is not None:
            end_pair(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), result)], schema=result)

    return (met.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "shift", "pos")
            .mapInArrow(judge, "doc_id long, item_id long, n_words int, n_covered int, longest_run int, n_changed int"))
