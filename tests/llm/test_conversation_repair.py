import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from gazeloom.llm import conversation_repair as R
from gazeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        role, text = s(role), s(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def best_edits(turns):
    """Least (cost, audit, result) over all edits by best-first search; turns: (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit, lines
        nxt = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*lines, ("assistant" if nxt == "a" else "user", ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                r = role[:1]
                if (state == "" and r == "s") or (r == nxt and r != "") or (state == "" and r == "u"):
                    heapq.heappush(heap, (more, audit + "K", i + 1, r, (*lines, (role, text))))
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, nxt, (*lines, ("assistant" if nxt == "a" else "user", text))))


def brute(rows, original):
    out = []
    for conv in {c for c, *_ in original}:
        mine = sorted(((t, role, text) for c, t, role, text in rows if c == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, turns = set(), []
        for _, role, text in mine:
            solid = text.strip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        known = [t for t, *_ in mine if t is not None]
        cost, audit, lines = best_edits(turns)
        count = lambda k: sum(f == k for *_, f in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 7, "y", "z") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, _id int, fault string, audit string")


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def chats(seed, n, longest=9):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "user", "admin", "tool", "", None]
    texts = ["Yes.", "No!", "open end", " \t", "", None, "What?\n", "Yes.", " ", "ok.  \r", "a. b"]
    out = []
    for c in range(n):
        for t in range(r.randrange(longest)):
            out.append((c if c % 17 else None, r.choice([t, t, t, t + 3, None]), r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"Turn {r.randrange(50)}."))
    return out


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_against_search(spark, partitions):
    """With 40 range partitions most conversations are cut into pieces."""
    rows = chats(1, 120)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert got(R.repair(table(spark, rows))) == brute([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], rows)
        assert got(R.repair_damaged(table(spark, rows))) == brute(damaged(rows), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pieces_of_every_size():
    """Audits of pieces, put together, are those of the whole, wherever it is cut."""
    r = random.Random(3)
    fold = lambda pieces: next(R.fold_costs(iter([_batch(pieces)])))

    def _batch(pieces):
        import pyarrow as pa
        codes, starts = R.codes_of(pieces)
        left, _ = R.costs(codes, starts, np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, R.NEVER), (len(pieces), 4, 4)))
        return pa.RecordBatch.from_pylist([{"_conv": {"conv_id": 1}, "pieces": [{"part": k, "matrix": m.ravel().tolist(), "ends": "uu", "illegal": 0} for k, m in enumerate(left)]}])

    def solve(pieces):
        right = np.array(fold(pieces).column("right").to_pylist())
        exits, texts = R.audits(*R.codes_of(pieces), right)
        state, out = R.EMPTY, ""
        for e, t in zip(exits.tolist(), texts):
            out, state = out + t[state], e[state]
        return fold(pieces).column("cost").to_pylist()[0], out + R.TAIL[state]

    for _ in range(150):
        whole = "".join(r.choices("ADGCFIBEHJKL", [2, 6, 6, 1, 2, 2, 1, 1, 1, 1, 1, 1], k=r.randrange(1, 14)))
        turns = [("suax"[(ord(c) - 65) // 3] * 2, str(k), (None, "blank", "truncated")[(ord(c) - 65) % 3]) for k, c in enumerate(whole)]
        want = best_edits(turns)[:2]
        assert solve([whole]) == want
        cuts = sorted(r.sample(range(1, len(whole)), min(len(whole) - 1, r.randrange(4))))
        assert solve([whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]) == want


def test_one_long_conversation(spark):
    rows = [(5, k, ("user", "assistant")[k % 2 if k % 11 else 0], f"Turn {k % 700}." if k % 5 else "open") for k in range(3000)] + [(6, 1, "user", "x")]
    want = brute(rows, rows)
    assert got(R.repair(table(spark, rows))) == want
    turns = R.repaired_turns(table(spark, rows)).where("conv_id = 5").orderBy("position").collect()
    assert [r["position"] for r in turns] == list(range(len(turns)))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() in {w[-1] for w in want}


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, SF)) == brute(damaged(rows), rows)


def test_empty_table(spark):
    assert got(R.repair_damaged(table(spark, [(1, 1, "user", "a")]).where("false"))) == []
