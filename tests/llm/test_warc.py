import gzip
import hashlib
import json
import zlib

import duckdb
import pytest

from gazeloom.llm import warc as W
from gazeloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "<p>" + "the same words " * 20 + "</p>"
PAGES = [(4, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/3", LONG), (2, "http://a/2", LONG), (None, "u", LONG), (1, None, None), (3, "", ""), (5, "x y\r\nWARC-Type: fake", "short"),
         (6, "é", "short"), (7, "http://b", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (8, "v", "漢字🙂\x00" * 30), (10, "w", "x" * 3_000_000), (None, "n", "n" * 200), (None, "m", "n" * 200),
         (11, "e", "é" * 49 + "ab"), (12, "e", "é" * 49 + "ab"), (13, "e", "é" * 49 + "a"), (14, "e", "é" * 49 + "a")]
SCHEMA = "page_id long, url string, html string, digest string, payload string, n int"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "z", "z", 1) for p in PAGES], SCHEMA).repartition(3)


def want(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        x = (html or "").encode()
        to = first.get(html) if first.get(html) != i else None
        out.append((i, len(x), hashlib.sha256(x).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def facts(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def test_round_trip(pages):
    assert facts(W.round_trip(pages)) == want(PAGES)


def test_urls_cannot_forge_headers(pages):
    got = {r["page_id"]: r["url"] for r in W.round_trip(pages).where("page_id in (1, 3, 5, 6)").collect()}
    assert got == {1: None, 3: None, 5: "x%20y%0D%0AWARC-Type:%20fake", 6: "é"}


def test_archives_are_single_streams_and_members_stand_alone(pages):
    monolith = W.write_archives(pages.coalesce(1), 5000).collect()
    assert len(monolith) > 3
    for row in monolith:
        stream = zlib.decompressobj(W.GZIP)
        whole = stream.decompress(row["content"])
        assert stream.eof and not stream.unused_data
        new, sidecar = W.normalised(bytes(row["content"]))
        assert gzip.decompress(new) == whole
        lines = [json.loads(x) for x in sidecar.decode().split("\n")]
        assert [x["offset"] for x in lines] == [sum(y["length"] for y in lines[:k]) for k in range(len(lines))] and lines[-1]["offset"] + lines[-1]["length"] == len(new)
        assert b"".join(zlib.decompress(new[x["offset"]: x["offset"] + x["length"]], W.GZIP) for x in lines) == whole
        assert W.normalised(new) == (new, sidecar)  # members stay what they are


def test_small_steps_and_two_streams(monkeypatch):
    a, b = (W.record(k, "u", b"x" * 300 * k, "d", None) for k in (1, 2))
    content = gzip.compress(a) + gzip.compress(b + a)
    whole = [r for _, r in W.records(content)]
    monkeypatch.setattr(W, "STEP", 7)
    assert [r for _, r in W.records(content)] == whole == [a, b, a]


@pytest.mark.parametrize("content", [b"no gzip", gzip.compress(b"hello\r\n\r\n"), gzip.compress(W.record(1, "u", b"abc", "d", None))[:-9],
                                     gzip.compress(W.record(1, "u", b"abc", "d", None)[:-2]), gzip.compress(b"WARC/1.1\r\nX: y\r\n\r\n")])
def test_damaged_archives_are_refused(content):
    with pytest.raises(W.Damaged):
        W.normalised(content)


def test_empty(spark, pages):
    assert W.round_trip(pages.where("false")).count() == 0
    assert W.read_records(W.normalise(spark.createDataFrame([("a", b""), ("b", None)], "archive string, content binary"))).count() == 0


def test_query_and_its_sql(spark):
    got = QUERIES["op11_warc"](spark, SF)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    expected = db.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({ORACLES['op11_warc']})").fetchall()
    assert facts(got) == sorted(expected, key=str)


def test_sql_on_repeated_pages(spark):
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar, html varchar)")
    rows = [p for p in PAGES if "\x00" not in (p[2] or "")]
    db.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(db.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({W.ORACLE})").fetchall(), key=str) == want(rows)
