import hashlib
from collections import defaultdict

from gazeloom.llm.line_dedup import dedup_lines

BLANK = " \t\n\x0b\x0c\r"
LONG = "This line is long enough to be a key of forty points or more"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders[key(x)]) >= 5 and max(holders[key(x)], key=lambda d: (d is not None, d or 0)) != i)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_against_brute_force(make, odd):
    rows = odd + [(20 + k, f"  {LONG.upper() if k % 2 else LONG}\t\nown {k}\n{LONG}") for k in range(6)]
    rows += [(40 + k, "é" * 39 + "\n" + "É" * 40 + f"\n{'x' * 39}\n") for k in range(5)] + [(40, "É" * 40)]
    rows += [(None, LONG + "\nnull")]
    assert run(make(rows)) == brute(rows)


def test_four_documents_are_not_enough_and_repeats_in_one_count_once(make):
    rows = [(k, LONG + "\n" + LONG) for k in range(4)]
    assert all(r[3] == 0 for r in run(make(rows)))


def test_columns_and_empty_table(make):
    df = dedup_lines(make([(1, "a")]))
    assert df.columns == ["doc_id", "text", "lang", "h", "_rest", "score", "n_lines", "n_dropped", "kept_sha256"]
    assert df.first()["h"] == "x" and df.first()["_rest"] == 7 and df.first()["n_lines"] == 1
    assert dedup_lines(make([(1, "a")]).where("false")).count() == 0
