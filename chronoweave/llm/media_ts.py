"""Media columns as MPEG transport streams (operator 7).

Each text becomes the payload of one program: its UTF-8 bytes, padded with 255
to a positive multiple of 576, are taken as 8-bit samples at 8 kHz (one access
unit is 576 samples = 72 ms). Access units travel in PES packets with
presentation times; every PES packet opens on a transport packet flagged as
random-access point with a clock reference. Program tables lead the stream and
are repeated. The reader parses the tables, checks continuity counters, puts
elementary packets together again and lists times and random-access points.

Null texts count as empty. Equal texts give equal bytes. Each row is handled
alone, so repeated rows, any id (null too) and extra columns make no difference.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_arrow

PACKET, UNIT, UNITS_PER_PES, TICKS = 188, 576, 8, 6480
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
TABLES_EVERY = 64  # PES packets between repeated program tables


def crc_mpeg(data: bytes) -> int:
    """CRC-32 of program-table sections: polynomial 0x04C11DB7, not reflected, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


def _section(table_id: int, key: int, body: bytes) -> bytes:
    inner = struct.pack(">HBBB", key, 0xC1, 0, 0) + body
    head = struct.pack(">BH", table_id, 0xB000 | (len(inner) + 4))
    whole = head + inner
    return whole + struct.pack(">I", crc_mpeg(whole))


_PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(0x02, PROGRAM, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter) + (b"\0" + section).ljust(PACKET - 4, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """Transport stream that holds ``payload`` (a multiple of 576 bytes) losslessly."""
    out, tables, counter = [], 0, 0
    step = UNIT * UNITS_PER_PES
    for n, at in enumerate(range(0, len(payload), step)):
        if n % TABLES_EVERY == 0:
            out += [_table_packet(0, _PAT, tables & 15), _table_packet(PMT_PID, _PMT, tables & 15)]
            tables += 1
        block = payload[at : at + step]
        pts = (at // UNIT * TICKS) & 0x1FFFFFFFF
        pes = b"\0\0\1\xbd" + struct.pack(">H", len(block) + 8) + b"\x80\x80\x05" + _stamp(pts) + block
        clock = bytes([pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, (pts & 1) << 7 | 0x7E, 0])
        # the opening packet: random access and clock reference, then 176 bytes of the elementary packet
        first = pes[: PACKET - 12]
        stuffing = b"\xff" * (PACKET - 12 - len(first))
        out.append(struct.pack(">BHBBB", 0x47, 0x4000 | ES_PID, 0x30 | counter, 7 + len(stuffing), 0x50) + clock + stuffing + first)
        counter = counter + 1 & 15
        for p in range(PACKET - 12, len(pes), PACKET - 4):
            part = pes[p : p + PACKET - 4]
            if len(part) == PACKET - 4:
                out.append(struct.pack(">BHB", 0x47, ES_PID, 0x10 | counter) + part)
            else:
                gap = PACKET - 5 - len(part)  # bytes of the adaptation field after its length
                out.append(struct.pack(">BHBB", 0x47, ES_PID, 0x30 | counter, gap) + (b"\0" + b"\xff" * (gap - 1) if gap else b"") + part)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass(frozen=True)
class Stream:
    """What the reader finds in a transport stream."""

    program: int
    pmt_pid: int
    es_pid: int
    stream_type: int
    packets: int
    continuity_errors: int
    payload: bytes
    pts: list[int | None]
    random_access: list[int]  # packet numbers


def _read_section(payload: bytes) -> bytes:
    start = 1 + payload[0]
    size = 3 + ((payload[start + 1] & 0x0F) << 8 | payload[start + 2])
    section = payload[start : start + size]
    if len(section) < size or crc_mpeg(section):
        raise ValueError("damaged program table")
    return section


_SECTIONS: dict[bytes, bytes] = {}


def _section_of(payload: bytes) -> bytes:
    if payload not in _SECTIONS:
        if len(_SECTIONS) > 64:
            _SECTIONS.clear()
        _SECTIONS[payload] = _read_section(payload)
    return _SECTIONS[payload]


def demux(stream: bytes) -> Stream:
    """Parse a transport stream: the first program's first elementary stream.

    Packets without payload don't count on; a packet that comes twice counts once;
    a jump of the counter is an error unless the packet announces it. An elementary
    packet without a length goes on to the next one, one without a time has none (null).
    """
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole transport packets")
    grid = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    extra, filled = (grid[:, 3] & 0x20) != 0, (grid[:, 3] & 0x10) != 0
    begins = np.where(extra, 5 + grid[:, 4].astype(np.int32), 4)
    flags = np.where(extra & (grid[:, 4] > 0), grid[:, 5], 0)

    def section(pid: int, what: str) -> bytes:
        rows = np.flatnonzero((pids == pid) & filled & ((grid[:, 1] & 0x40) != 0))
        if not len(rows):
            raise ValueError(f"no {what}")
        return _section_of(grid[rows[0], begins[rows[0]] :].tobytes())

    pat = section(0, "program association table")
    programs = [struct.unpack(">HH", pat[i : i + 4]) for i in range(8, len(pat) - 4, 4)]
    program, pmt_pid = next(((n, pid & 0x1FFF) for n, pid in programs if n), (0, 0))  # program 0 is the network's table
    if not program:
        raise ValueError("no program")
    pmt = section(pmt_pid, "program map table")
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    stream_type, es_pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]

    errors, rows = 0, np.zeros(0, np.int64)
    for pid in (0, pmt_pid, es_pid):
        rows = np.flatnonzero((pids == pid) & filled)
        step = (grid[rows[1:], 3] - grid[rows[:-1], 3]) & 0x0F
        twice = np.zeros(len(step), bool)
        for i in np.flatnonzero(step == 0).tolist():
            twice[i] = np.array_equal(grid[rows[i], begins[rows[i]] :], grid[rows[i + 1], begins[rows[i + 1]] :])
        errors += int(((step != 1) & ~twice & ((flags[rows[1:]] & 0x80) == 0)).sum())
        rows = rows[np.concatenate([[True], ~twice])] if len(rows) else rows

    es, begin = grid[rows], begins[rows]
    opens = (es[:, 1] & 0x40) != 0
    access = rows[(flags[rows] & 0x40) != 0]
    joined = es[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    heads = np.concatenate([[0], ends[:-1]])[opens].tolist() if len(rows) else []
    parts, times = [], []
    for h, after in zip(heads, [*heads[1:], len(joined)], strict=True):
        if joined[h : h + 3] != b"\0\0\1":
            raise ValueError("no elementary packet where one should start")
        size = struct.unpack(">H", joined[h + 4 : h + 6])[0]
        if joined[h + 7] & 0x80:
            a, b, c, d, e = joined[h + 9 : h + 14]
            times.append((a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1)
        else:
            times.append(None)
        parts.append(joined[h + 9 + joined[h + 8] : h + 6 + size if size else after])
    return Stream(program, pmt_pid, es_pid, stream_type, len(grid), errors, b"".join(parts), times, access.tolist())


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, program int, es_pid int, packets long, continuity_errors long, pts array<long>, random_access array<long>"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at, held = 0, 0
        rows: list[tuple] = []
        for i in range(len(ids)):
            text = (texts[i].as_py() or "").encode()
            stored = mux(pad(text))
            got = demux(stored)
            rows.append((len(text), stored, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-32:]), got.program, got.es_pid, got.packets, got.continuity_errors, got.pts, got.random_access))
            held += len(stored)
            if held > 8 << 20 or i == len(ids) - 1:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([ids[at : i + 1].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])
                at, held, rows = i + 1, 0, []


def transport_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored transport stream per row, with what reading it back gives (see SCHEMA)."""
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _encode, SCHEMA)


def op7_media(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, from the stored streams."""
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("program="), F.col("program")),
        F.concat(F.lit("pid="), F.col("es_pid")),
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("cc_errors="), F.col("continuity_errors")),
        F.concat(F.lit("pes="), F.size("pts")),
        F.concat(F.lit("last_pts="), F.element_at("pts", -1)),
        F.concat(F.lit("access="), F.size("random_access")),
        F.concat(F.lit("index_crc="), F.crc32(F.concat_ws(",", F.col("pts").cast("array<string>"), F.col("random_access").cast("array<string>")).cast("binary"))),
    )
    return transport_streams(docs).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "continuity_errors",
    )
