"""Cheapest edits that give a conversation its structure: an optional system turn, then user and assistant by turns.

Turns are put in order by range partitions, so a conversation of any length is a row of pieces, one per partition it
touches, each a string of one letter per turn. A piece is a 4x4 matrix of least costs between the states at its ends; these are folded
per conversation (at most one per partition) into the cost of going on behind each piece. With it, every piece finds its optimal arcs by itself.

Among equally cheap audits the least is wanted. Each optimal arc is a node of a ranking: its rank among audits of
length 1 is its letter, and its rank among audits of length 2m is the rank of (its rank at m, the rank at m of the arc its pointer leads to). Pointers double along.
From one state a letter leads to one state only, so the arc a pointer takes never waits for a later rank.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import materialise

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: State behind a kept turn of each initial, by the state before; -1 where it must not stand. The last row is for any other role.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: State behind an inserted or renamed turn.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What ends a conversation: cost and inserted turns by state.
TAIL = ["", "II", "I", ""]
DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their letters
LETTERS = "DIKR"
COST = {"delete": 3, "insert": 2, "rerole": 2, "truncated": 1}
NEVER = 1 << 40
#: Turns whose pieces are worked on at once.
BATCH = 1 << 15
WHITE = r"\x20\x09-\x0D"
LEGAL = {"su", "ua", "au"}


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by CRC-32 of ``conv_id:turn``; nulls in role, text and that key count as one space.

    Of 20 remainders 0 drops the row, 1 empties the text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                                                  F.when(fault == 3, 2).otherwise(1).alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).drop("_copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` (blank, duplicate, truncated or null) to rows with an ``_id``."""
    first = rows.groupBy("_conv", "role", "_md5").agg(F.min(F.struct("turn", "_id")).alias("_f")).select(F.col("_f._id").alias("_id"), F.lit(True).alias("_first"))
    rows = rows.join(first, "_id", "left")  # ids are unique: no key is hot
    return rows.withColumn("fault", F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_open"), "truncated"))


def _letter() -> Column:
    """Initial and fault of a turn in one letter."""
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    kind = F.when(F.length("role") == 0, 3).when(initial > 0, initial - 1).otherwise(3)
    fault = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    return F.chr(F.lit(65) + 3 * kind + fault)


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_conv, letter) -> (_conv, part, letters), one per conversation of the partition."""
    part, current, letters, out = TaskContext.get().partitionId(), None, [], []
    kind = None

    def made():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([part] * len(out), pa.int64()), pa.array([s for _, s in out], pa.string())], ["_conv", "part", "letters"])

    for batch in batches:
        kind = batch.schema.field("_conv").type
        for conv, letter in zip(batch.column("_conv").to_pylist(), batch.column("letter").to_pylist()):
            if conv != current:
                if letters:
                    out.append((current, "".join(letters)))
                current, letters = conv, []
            letters.append(letter)
        if len(out) > 4096:
            yield made()
            out = []
    if letters:
        out.append((current, "".join(letters)))
    if out:
        yield made()


def codes_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(pieces).encode(), np.uint8).astype(np.int64) - 65, np.cumsum([0, *map(len, pieces)])


def costs(codes: np.ndarray, starts: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from (piece, state) and from (turn, state) on, given that behind each piece: ``right`` (pieces, states, cases).

    Turns may be inserted in front of every turn; what is inserted behind the last one belongs to the next piece.
    """
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    now, at = right[order].copy(), np.zeros((len(codes), *right.shape[1:]), np.int64)
    sizes = n[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -step, "left"))  # pieces longer than step
        rows = starts[order[:m] + 1] - 1 - step
        now[:m] = at[rows] = before_turn(codes[rows], now[:m])
    left = np.empty_like(now)
    left[order] = now
    return left, at


def options(code: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost of deleting, keeping or renaming a turn, by state before it; ``behind``: (turns, states, cases)."""
    kind, fault = code // 3, code % 3
    open_ = (fault == 2)[:, None, None] * COST["truncated"]
    to = KEPT[kind][:, :, None]
    free = (fault != 1)[:, None, None]
    keep = np.where(free & (to >= 0), np.take_along_axis(behind, np.broadcast_to(np.maximum(to, 0), behind.shape), axis=1) + open_, NEVER)
    rerole = np.where(free, behind[:, NEXT] + COST["rerole"] + open_, NEVER)
    return behind + COST["delete"], keep, rerole


def before_turn(code: np.ndarray, behind: np.ndarray) -> np.ndarray:
    best = np.minimum.reduce(options(code, behind))
    user, assistant = best[:, USER], best[:, ASSISTANT]
    best[:, USER], best[:, ASSISTANT] = np.minimum(user, assistant + COST["insert"]), np.minimum(assistant, user + COST["insert"])
    for state in (EMPTY, SYSTEM):
        best[:, state] = np.minimum(best[:, state], best[:, USER] + COST["insert"])
    return np.minimum(best, NEVER)


def end_costs() -> np.ndarray:
    return np.array([len(t) * COST["insert"] for t in TAIL], np.int64)


def audits(codes: np.ndarray, starts: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """For each piece and state in front of it: the state behind it, and the least of the cheapest audits. ``right``: (pieces, states)."""
    n_rows, n_pieces = len(codes), len(starts) - 1
    _, at = costs(codes, starts, right[:, :, None])
    at = at[:, :, 0]
    last = np.zeros(n_rows, bool)
    last[starts[1:][np.diff(starts) > 0] - 1] = True
    piece = np.repeat(np.arange(n_pieces), np.diff(starts))
    behind = np.where(last[:, None], right[piece], np.roll(at, -1, axis=0))
    # Nodes: 4 x turn + state, then 4 x piece + state behind it.
    state = np.arange(4)
    onward = np.where(last, n_rows + piece, np.arange(n_rows) + 1)[:, None] * 4
    delete, keep, rerole = (x[:, :, 0] for x in options(codes, behind[:, :, None]))
    here = np.arange(n_rows)[:, None] * 4
    ways = {DELETE: (delete, onward + state), INSERT: (at[:, NEXT] + COST["insert"], here + NEXT), KEEP: (keep, onward + KEPT[codes // 3]), REROLE: (rerole, onward + NEXT)}
    label, source, head = [], [], []
    for letter, (cost, to) in ways.items():
        hit = cost == at
        source.append(np.broadcast_to(here + state, hit.shape)[hit])
        head.append(np.broadcast_to(to, hit.shape)[hit])
        label.append(np.full(len(head[-1]), letter + 1))
    ends = 4 * n_rows + np.arange(4 * n_pieces)  # behind a piece: an arc to itself, with the least rank
    label, source, head = (np.concatenate(x) for x in ([*label, np.zeros(len(ends), np.int64)], [*source, ends], [*head, ends]))
    order = np.lexsort((label, source))
    label, source, head = label[order], source[order], head[order]

    rank = label
    jump = np.searchsorted(source, head)  # of the arcs that leave the head, the one with the least letter
    length, levels = (label > 0).astype(np.int64), []
    while label[jump].any():
        levels.append(jump)
        length = length + length[jump]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    final = jump
    by_rank = np.lexsort((rank, source))
    entry_nodes = np.where((np.diff(starts) > 0)[:, None], 4 * starts[:-1, None] + state, 4 * (n_rows + np.arange(n_pieces))[:, None] + state)
    entry = by_rank[np.searchsorted(source[by_rank], entry_nodes.ravel())]
    n = length[entry]
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    path = np.repeat(entry, n)
    for k, pointers in enumerate(levels):  # the arcs 2^k to 2^(k+1) - 1 steps away, from those 2^k before them
        far = np.flatnonzero((place >= 1 << k) & (place < 2 << k))
        path[far] = pointers[path[far - (1 << k)]]
    text = np.frombuffer(("$" + LETTERS).encode(), np.uint8)[label[path]].tobytes().decode()
    out = [text[a: a + size] for a, size in zip(first.tolist(), n.tolist())]
    to = np.where(n == 0, entry_nodes.ravel(), head[final[entry]])
    return (to % 4).reshape(n_pieces, 4), [out[k: k + 4] for k in range(0, len(out), 4)]


def parts(batch: pa.RecordBatch, column: str = "letters") -> Iterator[pa.RecordBatch]:
    """Row ranges with about BATCH turns each (one row at least)."""
    at, size = 0, 0
    for k, s in enumerate(batch.column(column).to_pylist()):
        if size and size + len(s) > BATCH:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += len(s)
    if batch.num_rows > at:
        yield batch.slice(at)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least costs between the states at both ends, the initials there, and the illegal neighbours inside."""
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    initials = INITIALS + "-"
    for batch in batches:
        for part in parts(batch):
            pieces = part.column("letters").to_pylist()
            codes, starts = codes_of(pieces)
            left, _ = costs(codes, starts, np.broadcast_to(unit, (len(pieces), 4, 4)))
            roles = ["".join(initials[c // 3] for c in codes[a:b].tolist()) for a, b in zip(starts, starts[1:])]
            wrong = [sum(x + y not in LEGAL for x, y in zip(r, r[1:])) for r in roles]
            yield pa.RecordBatch.from_pydict({
                "_conv": part.column("_conv"), "part": part.column("part"), "matrix": pa.array(left.reshape(len(pieces), 16).tolist(), pa.list_(pa.int64())),
                "ends": pa.array([r[0] + r[-1] for r in roles], pa.string()), "illegal": pa.array(wrong, pa.int64())})


def fold_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all pieces of a conversation in order: the cost of going on behind each; cost and illegal neighbours of the conversation with its first piece."""
    for batch in batches:
        out = {k: [] for k in ("_conv", "part", "right", "first", "last", "cost", "illegal")}
        for conv, pieces in zip(batch.column("_conv").to_pylist(), batch.column("pieces").to_pylist()):
            behind, rights = end_costs(), []
            for p in reversed(pieces):
                rights.append(behind.tolist())
                behind = (np.array(p["matrix"]).reshape(4, 4) + behind).min(axis=1)
            ends = "".join(p["ends"] for p in pieces)
            illegal = sum(p["illegal"] for p in pieces) + sum(ends[k: k + 2] not in LEGAL for k in range(1, len(ends) - 1, 2))
            for k, (p, right) in enumerate(zip(pieces, reversed(rights))):
                for name, v in zip(out, (conv, p["part"], right, k == 0, k == len(pieces) - 1, None if k else int(behind[EMPTY]), None if k else illegal)):
                    out[name].append(v)
        kinds = (batch.schema.field("_conv").type, pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, for each state in front of a piece, the state behind it and the audit, at the end with the closing inserts."""
    for batch in batches:
        for part in parts(batch):
            codes, starts = codes_of(part.column("letters").to_pylist())
            exits, texts = audits(codes, starts, np.array(part.column("right").to_pylist(), np.int64).reshape(-1, 4))
            texts = [[t + TAIL[e] for t, e in zip(four, ends)] if last else four for four, ends, last in zip(texts, exits.tolist(), part.column("last").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                **{c: part.column(c) for c in ("_conv", "part", "first", "last")},
                "exits": pa.array(exits.tolist(), pa.list_(pa.int64())), "audits": pa.array(texts, pa.list_(pa.string()))})


def fold_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of each piece of a conversation."""
    for batch in batches:
        conv, part, entry = [], [], []
        for c, pieces in zip(batch.column("_conv").to_pylist(), batch.column("pieces").to_pylist()):
            state = EMPTY
            for p in pieces:
                conv.append(c)
                part.append(p["part"])
                entry.append(state)
                state = p["exits"][state]
        yield pa.RecordBatch.from_arrays([pa.array(conv, batch.schema.field("_conv").type), pa.array(part, pa.int64()), pa.array(entry, pa.int64())], ["_conv", "part", "entry"])


class Repaired:
    """Turns of one conversation in order, after its audit."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, EMPTY

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = int(NEXT[self.state])
            yield ROLE[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = int(NEXT[self.state])
            yield ROLE[self.state], text
        elif edit == "K":
            self.state = int(KEPT[INITIALS.index(role[0])][self.state])
            yield role, text


def edited(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    """Per conversation its audits, then its turns in order -> (_conv, audit, repaired_sha256), or (_conv, position, role, text).

    One turn at a time: besides the audit, nothing of a conversation is held.
    """
    current, open_, lines, digest, n, kind = None, Repaired(), [], hashlib.sha256(), 0, None
    started = False

    def put(turns):
        nonlocal n
        for role, text in turns:
            if digests:
                digest.update((("\n" if n else "") + f"{role}:{text}").encode())
            else:
                lines.append((current, n, role, text))
            n += 1

    def close():
        put(open_.inserted())
        if digests:
            lines.append((current, open_.audit, digest.hexdigest()))

    def made():
        names, kinds = (("_conv", "audit", "repaired_sha256"), (kind, pa.string(), pa.string())) if digests else (("_conv", "position", "role", "text"), (kind, pa.int64(), pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*lines), kinds)], list(names))

    for batch in batches:
        kind = batch.schema.field("_conv").type
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("_conv", "audit", "role", "text"))):
            if not started or conv != current:
                if started:
                    close()
                started, current, open_, digest, n = True, conv, Repaired(), hashlib.sha256(), 0
            if audit is not None:
                open_.audit += audit
            else:
                put(open_.turn(role, text))
            if len(lines) >= 4096:
                yield made()
                lines.clear()
    if started:
        close()
    if lines:
        yield made()


def _solved(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with faults, (conversation, cost, illegal), and (conversation, part, audit)."""
    white_end = f"[.!?][{WHITE}]*\\z"
    rows = conversations.select(
        F.struct("conv_id").alias("_conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_id"))
    rows = rows.withColumns({"_md5": F.md5("text"), "_blank": ~F.col("text").rlike(f"[^{WHITE}]"), "_open": ~F.col("text").rlike(white_end)})
    rows = materialise(rows, "turns")  # fixes the ids
    slim = materialise(_faults(rows.drop("text")).drop("_first", "_blank", "_open"), "faults")
    order = ["_conv", "turn", "role", "_md5", "_id"]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slim.withColumn("letter", _letter()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("_conv", "letter")
    conv = placed.schema["_conv"].dataType.simpleString()
    pieces = materialise(placed.mapInArrow(cut_pieces, f"_conv {conv}, part long, letters string"), "pieces")
    sums = pieces.mapInArrow(matrices, f"_conv {conv}, part long, matrix array<long>, ends string, illegal long")
    folded = materialise(sums.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("part", "matrix", "ends", "illegal"))).alias("pieces"))
                         .mapInArrow(fold_costs, f"_conv {conv}, part long, right array<long>, first boolean, last boolean, cost long, illegal long"), "costs")
    chosen = materialise(pieces.join(folded.select("_conv", "part", "right", "first", "last"), ["_conv", "part"])
                         .mapInArrow(choose, f"_conv {conv}, part long, first boolean, last boolean, exits array<long>, audits array<string>"), "audits")
    several = chosen.where(~(F.col("first") & F.col("last")))
    entries = (several.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("pieces"))
               .mapInArrow(fold_states, f"_conv {conv}, part long, entry long"))
    audit = chosen.join(entries, ["_conv", "part"], "left").select("_conv", "part", F.expr("audits[coalesce(entry, 0)]").alias("audit"))
    return rows.join(slim.select("_id", "fault"), "_id"), folded.where("first").select("_conv", "cost", "illegal"), audit


def _edited(rows: DataFrame, audit: DataFrame, digests: bool) -> DataFrame:
    """A conversation's turns meet its audit in one sorted stream: its digest is one by definition."""
    none = lambda t: F.lit(None).cast(t)
    stream = (audit.select("_conv", F.lit(0).alias("_kind"), F.col("part").alias("turn"), F.lit("").alias("role"), F.lit("").alias("_md5"), F.lit(0).cast("long").alias("_id"), none("string").alias("text"), "audit")
              .unionByName(rows.select("_conv", F.lit(1).alias("_kind"), "turn", "role", "_md5", "_id", "text", none("string").alias("audit"))))
    order = ["_conv", "_kind", "turn", "role", "_md5", "_id"]
    stream = stream.repartition("_conv").sortWithinPartitions(*order).select("_conv", "audit", "role", "text")
    conv = stream.schema["_conv"].dataType.simpleString()
    shape = f"_conv {conv}, audit string, repaired_sha256 string" if digests else f"_conv {conv}, position long, role string, text string"
    return stream.mapInArrow(lambda batches: edited(batches, digests), shape)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    rows, _, audit = _solved(conversations)
    return _edited(rows, audit, False).select("_conv.conv_id", "position", "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns go by ``turn``, nulls first, ties by role and then by the text's MD5; a null role or text counts as one space, a null conv_id is a conversation like any
    other. A row's first fault counts: blank, duplicate (role and text seen before), truncated (last character but white space not ``.!?``). Edits: keep (0),
    rename to user or assistant (2), delete (3, forced for blank and duplicate), insert an empty turn (2); a truncated turn that stays adds 1. The audit has
    their initials in order, the least among the cheapest. Repeated rows are duplicates. Other columns do not matter. An empty table has no rows.
    """
    rows, solved, audit = _solved(conversations)
    of = lambda k: F.count_if(F.col("fault") == k).alias(k)
    distinct = rows.select("_conv", "turn").distinct().groupBy("_conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = rows.groupBy("_conv").agg(of("blank"), of("duplicate"), of("truncated"))
    out = _edited(rows, audit, True).join(solved, "_conv").join(counts, "_conv").join(distinct, "_conv")
    return out.select("_conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damages the rows, repairs what is left, and returns every conversation of the original; one without rows has zeros and empty results."""
    found = repair(damage(conversations)).withColumn("_conv", F.struct("conv_id")).drop("conv_id")
    every = conversations.select(F.struct("conv_id").alias("_conv")).distinct().join(found, "_conv", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("_conv.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
