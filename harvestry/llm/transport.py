"""MPEG transport streams as media columns: writing payloads as elementary packets, and parsing them back.

The parser follows program tables (association and map sections with their CRC, over as many packets as they take), checks
continuity counters (a packet that is sent twice counts once, an announced discontinuity is none), reassembles elementary
packets, and gives each unit's presentation time, place in the stream, and whether it is a random-access point.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, keep, read_table, texts_of

#: Fixed by ISO/IEC 13818-1: packet size, sync byte, PIDs of the program association and of null packets, stream id of private data.
PACKET, SYNC, PAT_PID, NULL_PID, PRIVATE_1 = 188, 0x47, 0, 0x1FFF, 0xBD
PMT_PID, DATA_PID, PROGRAM, PRIVATE_TYPE = 0x100, 0x101, 1, 0x06
#: Bytes of payload a unit has, and units from one random-access point (and program table) to the next; 90 kHz ticks a unit.
UNIT, RANDOM_EVERY, TICKS, PAD, TAIL = 192 * 32, 8, 3600, 192, 16


@lru_cache(1)
def crc_table() -> tuple[int, ...]:
    """Of the CRC-32 of sections: polynomial 0x04C11DB7, most significant bit first."""
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return tuple(table)


def section_crc(data: bytes) -> int:
    c, table = 0xFFFFFFFF, crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + struct.pack(">H", 0xB000 | len(body) + 9) + struct.pack(">HBBB", number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


@lru_cache(1)
def tables() -> tuple[bytes, bytes]:
    """The payloads of the packets with the association and the map."""
    pat = section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))
    return tuple((b"\x00" + s).ljust(PACKET - 4, b"\xff") for s in (pat, pmt))


def clock(ticks: int, mark: int) -> bytes:
    """A 33-bit time in five bytes with marker bits."""
    return bytes([mark << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def read_clock(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def write_stream(payload: bytes, points: list[tuple[int, int]] | None = None) -> bytes:
    """The payload as one private stream: a unit of UNIT bytes per elementary packet, tables before each random-access point.

    `points` gets the time and the byte offset of each random-access point.
    """
    out: list[bytes] = []
    counters = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def packet(pid: int, first: bool, adaptation: bytes, data: bytes) -> None:
        n = counters[pid]
        counters[pid] = n + 1 & 15
        out.append(struct.pack(">BHB", SYNC, first << 14 | pid, (0x30 if adaptation else 0x10) | n) + adaptation + data)

    for k, start in enumerate(range(0, len(payload), UNIT)):
        random = k % RANDOM_EVERY == 0
        if random:
            for pid, data in zip((PAT_PID, PMT_PID), tables(), strict=True):
                packet(pid, True, b"", data)
        part = payload[start : start + UNIT]
        ticks = k * TICKS & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_1, len(part) + 8, 0x84, 0x80, 5) + clock(ticks, 2) + part
        flags = b"\x01\x40" if random else b""  # an adaptation field with the random-access indicator
        if random and points is not None:
            points.append((ticks, len(out) * PACKET))
        at = PACKET - 4 - len(flags)
        packet(DATA_PID, True, *fitted(flags, pes[:at]))
        while at < len(pes):
            packet(DATA_PID, False, *fitted(b"", pes[at : at + PACKET - 4]))
            at += PACKET - 4
    return b"".join(out)


def fitted(adaptation: bytes, data: bytes) -> tuple[bytes, bytes]:
    """An adaptation field that fills the packet up to the data."""
    room = PACKET - 4 - len(data)
    if room == len(adaptation):
        return adaptation, data
    if room == 1:
        return b"\x00", data
    flags = adaptation[1:2] or b"\x00"
    return bytes([room - 1]) + flags + b"\xff" * (room - 2), data


@dataclass
class Stream:
    """What parse_stream() finds: units of (pid, time, random access, data, offset), packets, and errors by kind."""

    units: list[tuple[int, int | None, bool, bytes, int]] = field(default_factory=list)
    types: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    repeats: int = 0
    breaks: int = 0
    bad_sections: int = 0
    lost_sync: int = 0

    @property
    def points(self) -> list[tuple[int | None, int]]:
        return [(time, offset) for _, time, random, _, offset in self.units if random]


def sections_of(held: dict[int, bytearray], pid: int, first: bool, data: bytes) -> list[bytes]:
    """The sections that a packet's payload completes; `held` has what has come so far of the next one, by PID."""
    out = []
    if first:
        jump = data[0] + 1 if data else 0
        if pid in held:
            out += complete(held[pid], data[1:jump])
        held[pid] = bytearray()
        data = data[jump:]
    if pid in held:
        out += complete(held[pid], data)
    return out


def complete(held: bytearray, data: bytes) -> list[bytes]:
    """Whole sections off the front of what is held and `data`; a byte 255 where a table id belongs begins stuffing."""
    held += data
    out = []
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < size:
            return out
        out.append(bytes(held[:size]))
        del held[:size]
    if held and held[0] == 0xFF:
        held.clear()
    return out


def parse_stream(data: bytes) -> Stream:
    """Parse a transport stream; broken sections, lost sync bytes and continuity breaks are counted, not raised.

    A packet that is sent twice in a row is read once; what follows an announced discontinuity is no break.
    """
    s = Stream()
    maps: set[int] = set()
    last: dict[int, tuple[int, bytes, bool]] = {}
    held: dict[int, bytearray] = {}
    open_: dict[int, tuple[bool, int, list[bytes]]] = {}

    def close(pid: int) -> None:
        if pid not in open_:
            return
        random, offset, parts = open_.pop(pid)
        pes = b"".join(parts)
        if len(pes) >= 9 and pes[:3] == b"\x00\x00\x01":
            length = struct.unpack_from(">H", pes, 4)[0]
            time = read_clock(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 and len(pes) >= 14 else None
            s.units.append((pid, time, random, pes[9 + pes[8] : 6 + length if length else None], offset))

    def take(pid: int, table: bytes) -> None:
        if len(table) < 12 or section_crc_of(table):
            s.bad_sections += 1
        elif pid == PAT_PID:
            maps.update(struct.unpack_from(">H", table, i + 2)[0] & 0x1FFF for i in range(8, len(table) - 4, 4) if table[i : i + 2] != b"\x00\x00")
        else:
            i = 12 + (struct.unpack_from(">H", table, 10)[0] & 0xFFF)
            while i < len(table) - 8:
                kind, stream, more = struct.unpack_from(">BHH", table, i)
                s.types[stream & 0x1FFF] = kind
                i += 5 + (more & 0xFFF)

    for at in range(0, len(data) - PACKET + 1, PACKET):
        if data[at] != SYNC:
            s.lost_sync += 1
            continue
        s.packets += 1
        head, b = struct.unpack_from(">HB", data, at + 1)
        pid, first, body = head & 0x1FFF, head >> 14 & 1, at + 4
        flags = 0
        if b & 0x20:
            flags = data[body + 1] if data[body] else 0
            body += 1 + data[body]
        if not b & 0x10 or pid == NULL_PID:
            continue
        payload = data[body : at + PACKET]
        if pid in last and not flags & 0x80:
            count, before, again = last[pid]
            if count == b & 15 and before == payload and not again:
                s.repeats += 1
                last[pid] = count, before, True
                continue
            s.breaks += count + 1 & 15 != b & 15
        last[pid] = b & 15, payload, False
        if pid == PAT_PID or pid in maps:
            for table in sections_of(held, pid, bool(first), payload):
                take(pid, table)
        elif pid in s.types:
            if first:
                close(pid)
                open_[pid] = bool(flags & 0x40), at, []
            if pid in open_:
                open_[pid][2].append(payload)
    for pid in list(open_):
        close(pid)
    return s


@lru_cache(256)
def section_crc_of(table: bytes) -> int:
    """Zero for a section with a right CRC; tables repeat, so results are kept."""
    return section_crc(table)


def padded(text: bytes) -> bytes:
    """The text and bytes 32 up to a positive multiple of PAD."""
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b" ")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the text as a transport stream in the column `media`, and `points`, the time and byte offset of each
    random-access point in it; null text counts as empty. Rows that repeat are stored alike. Other columns are not read."""
    bounded_batches(docs.sparkSession)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media, points = [], [], []
        for text in texts_of(batch.column(1)):
            sizes.append(len(text))
            points.append([])
            media.append(write_stream(padded(text), points[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), point_array(points)], ["doc_id", "n_bytes", "media", "points"])

    return each_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, f"doc_id long, n_bytes long, media binary, points {POINTS}")


POINTS = "array<struct<time: long, offset: long>>"
DIGEST = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points {POINTS}"
NAMES = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points")


def point_array(points: list[list[tuple[int | None, int]]]) -> pa.Array:
    flat = [p for row in points for p in row]
    values = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.int64()), pa.array([o for _, o in flat], pa.int64())], ["time", "offset"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, points)]), pa.int32()), values)


def read_back(media: DataFrame) -> DataFrame:
    """Digests of the payload in each stored stream (doc_id, n_bytes, media), from its parsed units, and its random-access points.

    feature: packets, units, random-access points, first and last time, mean byte of the payload, and errors.
    """
    bounded_batches(media.sparkSession)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for stored in texts_of(batch.column(2)):
            s = parse_stream(stored)
            payload = b"".join(u[3] for u in s.units)
            times = [u[1] for u in s.units if u[1] is not None] or [0]
            mean = np.frombuffer(payload, np.uint8).sum(dtype=np.int64) * 1000 // max(len(payload), 1)
            feature = f"packets={s.packets};units={len(s.units)};random={sum(u[2] for u in s.units)};pts={times[0]}-{times[-1]};mean={mean / 1000:.3f};errors={s.breaks + s.bad_sections + s.lost_sync}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, s.points))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, point_array([r[-1] for r in rows])], NAMES)

    return each_batch(media.select("doc_id", "n_bytes", "media"), of, DIGEST)


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(keep(store(read_table(spark, sf_dir, "documents")), "media"))
