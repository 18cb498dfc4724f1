import hashlib
import zlib

import pytest

from gazeloom.llm import media_ts as M
from tests.llm.conftest import prose


def plain_read(ts: bytes) -> bytes:
    """Another reader: packet by packet, for the known stream only."""
    out, unit = b"", b""
    for k in range(0, len(ts), 188):
        p = ts[k: k + 188]
        assert p[0] == 0x47
        if (p[1] & 0x1F) << 8 | p[2] != M.DATA_PID:
            continue
        at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if p[1] & 0x40:
            out, unit = out + unit[14:], b""
        unit += p[at:]
    return out + unit[14:]


@pytest.mark.parametrize("n", [64, 128, 192, 16_320, 16_384, 16_448, 100_032])
def test_round_trip(n):
    payload = bytes(k * 7 % 251 for k in range(n))
    ts = M.mux(payload)
    s = M.demux(ts)
    assert s.payload == payload == plain_read(ts)
    assert len(ts) % 188 == 0 and s.discontinuities == s.damaged == 0 and s.programs == 1
    assert s.stamps == [k * M.UNIT_TICKS for k in range(-(-n // M.UNIT_BYTES))] and len(s.random_access) == len(s.stamps)
    for at in s.random_access:  # a random-access point starts a unit with a clock
        p = ts[188 * at: 188 * at + 188]
        assert p[1] & 0x40 and p[5] & 0x50 == 0x50


def test_damage_is_seen():
    ts = bytearray(M.mux(bytes(40_000)))
    lost = bytes(ts[: 188 * 5] + ts[188 * 6:])
    assert M.demux(lost).discontinuities == 1 and M.demux(lost).damaged == 1
    ts[6] ^= 1  # in the program table
    assert M.demux(bytes(ts)).damaged >= 1
    with pytest.raises(ValueError):
        M.demux(bytes(ts[1:]))


def test_stamps_and_checksum():
    for t in (0, 1, 90_000, (1 << 33) - 1, 0x155555555):
        assert M._read_stamp(M._stamp(t)) == t
    assert M.crc32_mpeg(b"123456789") == 0x0376E6E7  # the published check value


def test_operator(make, odd):
    got = M.to_transport_stream(make(odd)).collect()
    assert len(got) == len(odd)
    texts = {i: (t or "").encode() for i, t in odd if i is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        payload = texts[r["doc_id"]] + bytes(-len(texts[r["doc_id"]]) % 64 if texts[r["doc_id"]] else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(r["media"]) and plain_read(bytes(r["media"])) == payload
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and len(r["pts"]) == len(r["random_access"])
    assert len({r["feature"] for r in got if r["doc_id"] == 3}) == 1


def test_empty_table_and_columns(make):
    df = M.to_transport_stream(make([(1, prose(1, 5))]), keep_media=False)
    assert {"h", "_rest", "score"} <= set(df.columns) and "media" not in df.columns and df.count() == 1
    assert M.to_transport_stream(make([(1, "a")]).where("false")).count() == 0
