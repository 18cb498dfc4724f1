"""Two tokenizers side by side: token groups between common cuts, overlap links, and how often linked ids meet in the corpus.

Texts are cut in front of single spaces between two characters that are no white space. There both vocabularies cut as well (no entry of
either holds such a space, which ``Pair`` checks), so each distinct word is aligned once per cache. The
tokens of many new words come from one call: the character offsets of ``tokenizers`` and the byte spans of the SentencePiece
proto are coarse cuts; characters of several bytes that tokens share and byte-fallback tokens, whose spans say nothing, are refined by
the bytes their ids decode to.

Texts are read once. Each document is written with its links, packed; id pairs are counted from words times their frequency, per task, before
the shuffle. The stored links then meet the counts: frequent pairs are broadcast (at most ``TABLE`` of them), links whose pair is
rarer leave as rows (document, pair, links), meet their count in a join and are added up again.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gazeloom.llm.common import materialise, packed, slices, strings, unpacked

#: Pairs in the broadcast table: 17 bytes each, 18 MB at most.
TABLE = 1 << 20
#: Words and characters in a worker's cache: beyond either, it keeps what was met again, half of it at most.
CACHE_WORDS = 400_000
CACHE_CHARS = 8 << 20
#: Characters encoded in one call.
CALL_CHARS = 1 << 16
#: Distinct pairs a task holds before it hands them on.
HELD_PAIRS = 1 << 20

CUT = re.compile(r"(?<=\S) (?=\S)")
#: A text with a space beside other white space, or at an end, needs the slower cut; this finds all of these and some more.
LOOSE = re.compile(r"\s\s")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULTS = (*COUNTS, "n_best", "count_sum", "groups_sha256")
PAIR_COUNTS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))


def byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        of, vocabulary = byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if any(CUT.search(x.decode(errors="replace")) for x in (*self.a_bytes, *self.b_bytes)):
            raise ValueError("an entry that holds a space between two other characters: words cannot be aligned apart")

    def spans(self, text: str):
        """Ids of A and B over space + text, with the byte where each token ends. None where the bytes of either differ from it."""
        whole = (" " + text).encode()
        encoded = self.a.encode(" " + text, add_special_tokens=False)
        a = np.array(encoded.ids, np.int64)
        b, begins, ends = flat([(p.id, p.begin, p.end) for p in self.b.encode(text, return_type="proto").pieces]).reshape(-1, 3).T
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return None
        # A: a token ends at a character's end unless the next one begins inside that character.
        offsets = flat(encoded.offsets).reshape(-1, 2)
        at = np.concatenate([[0], np.cumsum(utf8_lengths(" " + text))])
        coarse = np.append(offsets[:-1, 1] <= offsets[1:, 0], True)
        a_ends = refined(at[offsets[:, 1]], coarse, self.a_len[a])
        # B: spans are bytes of the text without the added space; byte tokens but the last of a character have none.
        b_ends = refined(ends + 1, ends > begins, self.b_len[b])
        return a, b, a_ends, b_ends


def flat(tuples: list[tuple[int, ...]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(tuples), np.int64)


def utf8_lengths(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def refined(cuts: np.ndarray, coarse: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens: where ``coarse``, the cut; in between, the last cut and the decoded bytes since."""
    total = np.cumsum(lengths)
    known = np.flatnonzero(coarse)
    before = np.searchsorted(known, np.arange(len(cuts)), "right") - 1
    anchor = known[np.maximum(before, 0)]
    since = np.where(before < 0, total, cuts[anchor] + total - total[anchor])
    if not np.array_equal(since, total):
        raise ValueError("spans and decoded bytes disagree")
    return since


@cache
def loaded(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def cut(text: str) -> list[str]:
    """The words of a text; each stands behind a space."""
    return CUT.split(text) if text[0].isspace() or text[-1].isspace() or LOOSE.search(text) else text.split(" ")


class Words:
    """Aligned words by number. Per word: counts, its groups as text, and where its links stand in ``pairs``."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []
        self.parts = {k: [] for k in ("ok", "n_a", "n_b", "n_groups", "n_links", "pairs")}
        self.table: dict[str, np.ndarray] = {}
        self.hits = np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS

    def prune(self):
        """Keeps the words that were met most often, more than once, up to half of the cache; numbers change."""
        least = 2
        words = list(self.index)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        while (kept := np.flatnonzero(self.hits >= least)).size > CACHE_WORDS // 2 or sizes[kept].sum() > CACHE_CHARS // 2:
            least *= 2
        index, text, hits, table = {words[k]: n for n, k in enumerate(kept.tolist())}, [self.text[k] for k in kept.tolist()], self.hits[kept], self.table
        links = links_of(self, kept)
        self.clear()
        self.index, self.text, self.hits, self.chars = index, text, hits // 2, int(sizes[kept].sum())
        self.parts = {k: [links if k == "pairs" else table[k][kept]] for k in self.parts}
        self.tabulate()

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and where each text starts."""
        lists = [cut(t) if t else [] for t in texts]
        starts = np.cumsum([0, *map(len, lists)])
        every = list(chain.from_iterable(lists))
        self.learn(list(set(every).difference(self.index)))
        numbers = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        self.hits = summed(self.hits, np.bincount(numbers, minlength=len(self.index)))
        return numbers, starts

    def learn(self, words: list[str]):
        call, size = [], 0
        for w in words:
            if w[0].isspace() or w[-1].isspace() or len(w) > CALL_CHARS:
                self.add([w])
                continue
            call.append(w)
            size += len(w) + 1
            if size > CALL_CHARS:
                self.add(call)
                call, size = [], 0
        if call:
            self.add(call)
        if words:
            self.tabulate()

    def tabulate(self):
        self.table = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in self.parts.items()}
        self.parts = {k: [v] for k, v in self.table.items()}
        self.table["first"] = np.concatenate([[0], np.cumsum(self.table["n_links"])])

    def add(self, words: list[str]):
        found = self.pair.spans(" ".join(words))
        if found is None and len(words) > 1:
            for w in words:
                self.add([w])
            return
        n, known = len(words), len(self.index)
        self.index.update(zip(words, range(known, known + n)))
        self.chars += sum(map(len, words))
        if found is None:
            for k in ("ok", "n_a", "n_b", "n_groups", "n_links"):
                self.parts[k].append(np.zeros(n, np.int64))
            self.text += [""] * n
            return
        a, b, a_ends, b_ends = found
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        ends = np.union1d(a_ends, b_ends)  # each stretch between two ends lies in one token of A and one of B
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        links = (a[np.searchsorted(a_ends, ends)] << 32) | b[np.searchsorted(b_ends, ends)]
        per_word = lambda x: np.diff(np.searchsorted(x, word_ends, "right"), prepend=0)
        if not np.isin(word_ends, common).all():
            raise ValueError("a word ends inside a token")
        for k, v in zip(("ok", "n_a", "n_b", "n_groups", "n_links", "pairs"), (np.ones(n, np.int64), per_word(a_ends), per_word(b_ends), per_word(common), per_word(ends), links)):
            self.parts[k].append(v)
        sa, sb = (list(map(self.pair.names.__getitem__, x.tolist())) for x in (a, b))
        to_a, to_b = np.searchsorted(a_ends, common, "right").tolist(), np.searchsorted(b_ends, common, "right").tolist()
        text = [f"{sa[i]}|{sb[j]}" if i2 - i == 1 and j2 - j == 1 else f"{','.join(sa[i:i2])}|{','.join(sb[j:j2])}"
                for i, i2, j, j2 in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        to = np.searchsorted(common, word_ends, "right").tolist()
        self.text += [";".join(text[g:g2]) for g, g2 in zip([0, *to], to)]


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two arrays, ``b`` as long as ``a`` or longer."""
    b[: len(a)] += a
    return b


def by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def whole(words: Words, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts of which every word has its own bytes in both tokenizers."""
    n = np.diff(starts)
    return (n > 0) & (by_text(words.table["ok"][numbers], starts) == n) if len(numbers) else np.zeros(len(n), bool)


#: Aligned words of a worker between its tasks.
_kept: dict[tuple[str, str], Words] = {}


def links_of(words: Words, numbers: np.ndarray) -> np.ndarray:
    """The links of words in a row."""
    first, n = words.table["first"][numbers], words.table["n_links"][numbers]
    return words.table["pairs"][np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def pack(links: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([links >> 32, links & 0xFFFFFFFF]).astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    both = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)
    return (both[:n] << 32) | both[n:]


class PairCounts:
    """Links of a task by pair; hands them on where there are too many to hold."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, words: Words, seen: np.ndarray) -> None:
        used = np.flatnonzero(seen)
        self.held.append((links_of(words, used), np.repeat(seen[used], words.table["n_links"][used])))
        pairs, place = np.unique(np.concatenate([p for p, _ in self.held]), return_inverse=True)
        self.held = [(pairs, np.bincount(place, np.concatenate([n for _, n in self.held]), len(pairs)).astype(np.int64))]

    def take(self, least: int) -> Iterator[pa.Array]:
        """All that is held in lists of bounded length, if it is ``least`` pairs or more."""
        if self.held and len(self.held[0][0]) >= max(1, least):
            pairs, n = self.held.pop()
            for at in range(0, len(pairs), 1 << 16):
                part = pa.StructArray.from_arrays([pa.array(pairs[at: at + (1 << 16)]), pa.array(n[at: at + (1 << 16)])], ["pair", "n"])
                yield pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)


def scan(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """A row per document with its counts, digest and packed links, and rows with ``pairs``, which only hold counts of id pairs."""

    def read(batches):
        words = _kept.pop((a_file, b_file), None) or Words(loaded(a_file, b_file))  # from the last task that this worker finished
        counts, seen = PairCounts(), np.zeros(0, np.int64)
        task, row, like = TaskContext.get().partitionId(), 0, None

        def counted(least):
            for lists in counts.take(least):
                empty = {f.name: pa.nulls(1, f.type) for f in like}
                yield pa.RecordBatch.from_pydict(empty | {"pairs": lists})

        for batch in batches:
            for part in slices(batch):
                numbers, starts = words.numbers(strings(part))
                n_docs = part.num_rows
                valid = whole(words, numbers, starts)
                if len(numbers):
                    seen = summed(seen, np.bincount(numbers[np.repeat(valid, np.diff(starts))], minlength=len(words.index)))
                of = {k: np.where(valid, by_text(words.table[k][numbers], starts), 0) if len(numbers) else np.zeros(n_docs, np.int64) for k in COUNTS}
                digests, links, text = [""] * n_docs, [None] * n_docs, words.text
                for d in np.flatnonzero(valid).tolist():
                    mine = numbers[starts[d]: starts[d + 1]]
                    digests[d] = hashlib.sha256(";".join(map(text.__getitem__, mine.tolist())).encode()).hexdigest()
                    links[d] = pack(links_of(words, mine))
                out = pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "_rest": part.column("_rest"), **{k: pa.array(v, pa.int64()) for k, v in of.items()}, "groups_sha256": pa.array(digests, pa.string()),
                    "_row": pa.array(np.arange(row, row + n_docs) + (task << 40), pa.int64()), "_links": pa.array(links, pa.binary()), "pairs": pa.nulls(n_docs, PAIR_COUNTS)})
                like = out.schema
                yield out
                row += n_docs
                if words.full():
                    counts.add(words, seen)
                    words.prune()
                    seen = np.zeros(0, np.int64)
                    yield from counted(HELD_PAIRS)
        if seen.any():
            counts.add(words, seen)
        yield from counted(1)
        _kept[a_file, b_file] = words

    none = F.lit(None).cast("long")
    shape = docs.select("doc_id", "_rest", *[none.alias(c) for c in COUNTS], F.lit(None).cast("string").alias("groups_sha256"), none.alias("_row"), F.lit(None).cast("binary").alias("_links"),
                        F.lit(None).cast("array<struct<pair: bigint, n: bigint>>").alias("pairs")).schema
    shape = StructType([StructField(f.name, f.dataType, True) for f in shape])  # rows that only count have no document
    return materialise(docs.mapInArrow(read, shape), "links")  # fixes the row numbers


def pair_counts(scanned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair over all texts, and whether no pair of its B id has more. ``pair`` is A's id * 2^32 + B's."""
    counted = scanned.where(F.col("pairs").isNotNull()).select(F.explode("pairs").alias("p")).select("p.*").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counted.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))  # one row per id of B's vocabulary
    return materialise(counted.join(most, b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "pairs")


def frequent(pairs: DataFrame, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The pairs from the least power of two on of which there are at most ``table``, ordered, and whether these are all."""
    power = F.length(F.bin("n"))
    sizes = {r["p"]: r["c"] for r in pairs.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 63 rows
    least, total = 64, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= table:
        least -= 1
        total += sizes.get(least, 0)
    got = pairs.where(power >= least).toArrow()
    key, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(key)
    return key[order], n[order], best[order], total == sum(sizes.values())


def align(docs: DataFrame, a_file: str, b_file: str, table: int = TABLE) -> DataFrame:
    """The documents without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A (``tokenizers`` file) reads space + text, B (SentencePiece file) the text, to which it adds the space; special strings in texts are plain text. Texts that
    are null or empty, or that either tokenizer's bytes do not give back, have no tokens: zeros, an empty digest, and no part in the counts.
    ``n_best`` counts links whose pair is as frequent as any of its B id; ``count_sum`` adds up the counts over the links. Rows are judged each for itself, whatever
    their id, null, shared or repeated; repeated rows count as often as they stand there. Other columns stay; those named like a result are replaced.
    """
    scanned = scan(packed(docs, "doc_id", "text"), a_file, b_file)
    pairs = pair_counts(scanned)
    *known, complete = frequent(pairs, table)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def weigh(batches):
        keys, counts, best = shared.value
        for batch in batches:
            total, top, rare = [], [], []
            for blob, n in zip(batch.column("_links").to_pylist(), batch.column("n_links").to_pylist()):
                links = unpack(blob, n) if blob is not None else np.zeros(0, np.int64)
                place = np.searchsorted(keys, links)
                place[place == len(keys)] = 0
                found = keys[place] == links if len(keys) else np.zeros(n, bool)
                at = place[found]
                total.append(int(counts[at].sum()))
                top.append(int(best[at].sum()))
                left, times = np.unique(links[~found], return_counts=True)
                rare.append([{"pair": p, "links": k} for p, k in zip(left.tolist(), times.tolist())] or None)
            kept = {c: batch.column(c) for c in batch.schema.names if c != "_links"}
            yield pa.RecordBatch.from_pydict(kept | {"n_best": pa.array(top, pa.int64()), "count_sum": pa.array(total, pa.int64()),
                                                     "_rare": pa.array(rare, pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())])))})

    own = scanned.where(F.col("_row").isNotNull()).drop("pairs")
    shape = own.drop("_links").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long"), "_rare": F.lit(None).cast("array<struct<pair: bigint, links: bigint>>")}).schema
    judged = own.mapInArrow(weigh, shape)
    if not complete:
        judged = materialise(judged, "weighed")
        met = (judged.select("_row", F.explode("_rare").alias("r")).select("_row", "r.*").join(pairs, "pair")
               .groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum")))
        judged = judged.join(met, "_row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return unpacked(judged, docs.drop("text"), *RESULTS)
