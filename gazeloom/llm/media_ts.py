"""Media columns as MPEG transport streams.

A payload becomes one program with one private-data stream: program tables (PAT, PMT) in front of every
access unit, access units of 16 KiB as elementary packets with time stamps, random-access points in
adaptation fields. The reader needs none of that knowledge: it follows the tables, checks continuity counters,
reassembles the elementary packets, and lists time stamps with the stream offsets of random-access points.
"""
from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import packed, slices, unpacked, utf8

# Fixed values of the format.
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_STREAM_TYPE, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK_HZ = 90_000
# Own choices.
UNIT_BYTES = 16_384
UNIT_TICKS = CLOCK_HZ // 25
PAD = 64


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = c << 8 & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, bytes([STUFFING]))


_PAT = _table_packet(PAT_PID, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(ticks: int) -> bytes:
    """33 bits of a presentation time, with the format's marker bits."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    out, counter = [], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        unit = payload[at: at + UNIT_BYTES]
        ticks = k * UNIT_TICKS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + unit
        for pid_packet in (_PAT, _PMT):
            p = bytearray(pid_packet)
            p[3] |= k & 15
            out.append(bytes(p))
        clock = (ticks & (1 << 33) - 1) << 15 | 0x7E00  # 33 bits of base, 6 reserved, 9 of extension
        field_bytes = bytes([0x50]) + clock.to_bytes(6, "big")
        room = PACKET - 4 - 1 - len(field_bytes)
        if len(pes) < room:
            field_bytes += bytes([STUFFING]) * (room - len(pes))
        first = pes[:room]
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, len(field_bytes)]) + field_bytes + first)
        counter = counter + 1 & 15
        rest = pes[len(first):]
        whole = len(rest) // 184
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, :3] = (SYNC, DATA_PID >> 8, DATA_PID & 255)
            block[:, 3] = 0x10 | np.arange(counter, counter + whole) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(block.tobytes())
            counter = counter + whole & 15
        tail = rest[whole * 184:]
        if tail:
            gap = 183 - len(tail)
            stuffed = bytes([gap]) + (b"\x00" + bytes([STUFFING]) * (gap - 1) if gap else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter]) + stuffed + tail)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers
    discontinuities: int = 0
    programs: int = 0
    packets: int = 0
    damaged: int = 0  # tables with a wrong checksum, units with a wrong start


def _sections(packets: np.ndarray, start: np.ndarray, stream: Stream) -> list[bytes]:
    """Distinct sections of one packet each whose checksum holds."""
    found = {}
    for row, at in zip(packets, start):
        at = int(at) + 1 + int(row[at])
        length = (int(row[at + 1]) & 0x0F) << 8 | int(row[at + 2])
        section = row[at: at + 3 + length].tobytes()
        if section not in found:
            found[section] = crc32_mpeg(section) == 0
        stream.damaged += not found[section]
    return [s for s, good in found.items() if good]


def demux(data: bytes) -> Stream:
    """Reads the first program's first elementary stream."""
    stream = Stream()
    if len(data) % PACKET or not data:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    stream.packets = len(p)
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    has_field, has_payload = (p[:, 3] & 0x20) != 0, (p[:, 3] & 0x10) != 0
    offset = np.where(has_field, p[:, 4].astype(np.int32) + 5, 4)

    tables = (pid == PAT_PID) & starts & has_payload
    pmts = []
    for s in _sections(p[tables], offset[tables], stream):
        for k in range(8, len(s) - 4, 4):
            if s[k] << 8 | s[k + 1]:
                pmts.append((s[k + 2] & 0x1F) << 8 | s[k + 3])
    stream.programs = len(set(pmts))
    if not pmts:
        return stream
    tables = (pid == pmts[0]) & starts & has_payload
    streams = []
    for s in _sections(p[tables], offset[tables], stream):
        k = 12 + ((s[10] & 0x0F) << 8 | s[11])
        while k < len(s) - 4:
            streams.append((s[k + 1] & 0x1F) << 8 | s[k + 2])
            k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    if not streams:
        return stream

    own = np.flatnonzero((pid == streams[0]) & has_payload)
    counters = p[own, 3] & 15
    stream.discontinuities = int(((counters[1:].astype(np.int32) - counters[:-1]) % 16 != 1).sum())
    jumps = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x40) != 0) & (pid == streams[0])
    stream.random_access = np.flatnonzero(jumps).tolist()

    bounds = [*np.flatnonzero(starts[own]).tolist(), len(own)]
    units = []
    for a, b in zip(bounds, bounds[1:]):
        mine = own[a:b]
        plain = offset[mine] == 4
        pieces, k = [], 0
        while k < len(mine):  # runs of packets without an adaptation field are one copy
            if plain[k]:
                end = k + int(np.argmin(plain[k:])) if not plain[k:].all() else len(mine)
                run = p[mine[k]: mine[end - 1] + 1] if mine[end - 1] - mine[k] == end - 1 - k else p[mine[k:end]]
                pieces.append(run[:, 4:].tobytes())
                k = end
            else:
                pieces.append(p[mine[k], offset[mine[k]]:].tobytes())
                k += 1
        pes = b"".join(pieces)
        length = pes[4] << 8 | pes[5]
        if pes[:3] != b"\x00\x00\x01" or length and length + 6 != len(pes):
            stream.damaged += 1
            continue
        if pes[7] & 0x80:
            stream.stamps.append(_read_stamp(pes[9:14]))
        units.append(pes[9 + pes[8]:])
    stream.payload = b"".join(units)
    return stream


def feature(s: Stream) -> str:
    span = f"{s.stamps[0]}-{s.stamps[-1]}" if s.stamps else "none"
    points = zlib.crc32(np.array(s.random_access, "<u4").tobytes())
    return f"programs={s.programs};packets={s.packets};units={len(s.stamps)};pts={span};rap={len(s.random_access)};rap_crc={points:08x};cc_errors={s.discontinuities};damaged={s.damaged}"


def pad(data: bytes) -> bytes:
    return data + bytes(PAD - len(data) % PAD if len(data) % PAD or not data else 0)


MEDIA = "media binary, pts array<long>, random_access array<long>"


def to_transport_stream(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """The documents without text, with ``media`` (the stored stream), ``pts``, ``random_access`` (packet numbers), if asked
    for, and n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is the text's UTF-8 padded with zeros to a positive multiple of 64; all values but n_bytes are taken from
    the stream as read back. Null or empty text: 64 zeros. Other columns stay; those named like a result are replaced.
    """
    own = packed(docs, "doc_id", "text")
    names = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
             "media_sha256": pa.string(), "feature": pa.string()}
    if keep_media:
        names |= {"media": pa.binary(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())}

    def convert(batches):
        for batch in batches:
            for part in slices(batch):
                cols = {n: [] for n in names}
                for text in utf8(part):
                    media = mux(pad(text))
                    s = demux(media)
                    if s.discontinuities or s.damaged:
                        raise ValueError("the stored stream cannot be read back")
                    values = {"n_bytes": len(text), "payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest(),
                              "tail_crc32": zlib.crc32(s.payload[-PAD:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                              "feature": feature(s), "media": media, "pts": s.stamps, "random_access": s.random_access}
                    for n, into in cols.items():
                        into.append(values[n])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "_rest": part.column("_rest"), **{n: pa.array(v, names[n]) for n, v in cols.items()}})

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    out = own.select("doc_id", "_rest", *[F.lit(None).cast(sql[t]).alias(n) for n, t in names.items()]).schema
    return unpacked(own.mapInArrow(convert, out), docs.drop("text"), *names)
