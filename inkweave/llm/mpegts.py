"""MPEG transport streams: a payload is stored as one, and any such stream is taken apart again.

A stream (ISO/IEC 13818-1) is 188-byte packets. Reading finds the programs in the association
and map tables, checks every stream's continuity counters, reassembles elementary packets and
keeps their timestamps with the random-access points. Both ways work on whole arrays of packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import whole_text
from inkweave.session import read_table

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
#: What a unit of payload holds, in bytes, and the filler behind the last one.
UNIT, FILLER = 576, 255
PROGRAM, MAP_PID, DATA_PID = 1, 0x100, 0x101
#: Private data in elementary packets, and the id of such a stream in them.
DATA_TYPE, DATA_STREAM = 0x06, 0xBD
#: Ticks of 90 kHz between units, and units between random-access points.
TICKS, ACCESS_EVERY = 3600, 8
#: Stream ids whose elementary packets have no optional header.
BARE_STREAMS = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))) + _table_packet(
    MAP_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([DATA_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def padded(payload: bytes) -> bytes:
    """payload with filler up to a positive multiple of UNIT bytes."""
    return payload.ljust(max(1, -(-len(payload) // UNIT)) * UNIT, bytes([FILLER]))


def store(payload: bytes) -> bytes:
    """A transport stream of one program that holds payload, a multiple of UNIT bytes long.

    A unit is an elementary packet of its own with a presentation time, in four packets: the
    first with a clock reference, the last stuffed to size.
    """
    data = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(data)
    k = np.arange(n, dtype=np.int64)
    pts = k * TICKS
    out = np.full((n, 4, PACKET), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = (k[:, None] * 4 + np.arange(4)) & 15 | 0x10
    out[:, (0, 3), 3] |= 0x20
    # an adaptation field with the random-access flag and the clock reference
    out[:, 0, 4] = 7
    out[:, 0, 5] = 0x10 | np.where(k % ACCESS_EVERY == 0, 0x40, 0)
    for i, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + i] = pts >> shift & 255
    out[:, 0, 10], out[:, 0, 11] = (pts & 1) << 7 | 0x7E, 0
    size = UNIT + 8
    head = np.frombuffer(bytes([0, 0, 1, DATA_STREAM, size >> 8, size & 255, 0x80, 0x80, 5]), np.uint8)
    out[:, 0, 12:21] = head
    out[:, 0, 21] = 0x21 | (pts >> 30 & 7) << 1
    out[:, 0, 22], out[:, 0, 23] = pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1
    out[:, 0, 24], out[:, 0, 25] = pts >> 7 & 255, (pts & 127) << 1 | 1
    out[:, 0, 26:] = data[:, :162]
    out[:, 1, 4:], out[:, 2, 4:] = data[:, 162:346], data[:, 346:530]
    stuffing = PACKET - 4 - (UNIT - 530)
    out[:, 3, 4], out[:, 3, 5] = stuffing - 1, 0
    out[:, 3, 4 + stuffing :] = data[:, 530:]
    return TABLES + out.tobytes()


@dataclass
class Stream:
    """One elementary stream of a program."""

    pid: int
    kind: int
    program: int
    continuity_errors: int = 0
    packets: int = 0
    data: bytes = b""
    sizes: list[int] = field(default_factory=list)  # of the data of each elementary packet
    pts: list[int | None] = field(default_factory=list)
    access: list[bool] = field(default_factory=list)
    broken: int = 0  # elementary packets without a start code or cut short


def _timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _sections(rows: np.ndarray, start: np.ndarray, unit_start: np.ndarray) -> Iterator[bytes]:
    """Whole sections with a right CRC from the packets of one table."""
    held = b""
    for row, at, first in zip(rows, start, unit_start, strict=True):
        body = row[at:].tobytes()
        if first and body:
            pointer = body[0]
            ready, held = [held + body[1 : 1 + pointer]], body[1 + pointer :]
        elif held:
            held += body
            ready = []
        else:
            continue
        for piece in ready:
            yield from _whole(piece)
        done = b""
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
            done, held = held[:n], held[n:]
            yield from _whole(done)


def _whole(section: bytes) -> Iterator[bytes]:
    if len(section) >= 12 and crc32_mpeg(section) == 0:
        yield section


def parse(media: bytes) -> list[Stream]:
    """The elementary streams of all programs in media, by program and pid.

    Bytes before the first packet and a cut last one are left out, as are packets without sync
    or with the error flag. A repeated packet counts once; a gap in a stream's continuity
    counters is counted unless the packet says that it may be there.
    """
    first = next((i for i in range(min(PACKET, len(media))) if all(media[j] == SYNC for j in range(i, min(len(media), i + 3 * PACKET), PACKET))), None)
    if first is None:
        return []
    n = (len(media) - first) // PACKET
    packets = np.frombuffer(media, np.uint8, n * PACKET, first).reshape(n, PACKET)
    packets = packets[(packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)]
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    adapted, loaded = control & 2 > 0, control & 1 > 0
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    start = np.minimum(np.where(adapted, 5 + packets[:, 4].astype(np.int64), 4), PACKET)
    unit_start, counter = packets[:, 1] & 0x40 > 0, packets[:, 3] & 15

    def of(p: int) -> np.ndarray:
        return np.flatnonzero((pid == p) & loaded)

    def table(p: int, kind: int) -> list[bytes]:
        own = of(p)
        return [s for s in _sections(packets[own], start[own], unit_start[own]) if s[0] == kind]

    maps: dict[int, int] = {}
    for s in table(0, 0):
        for k in range(8, len(s) - 4, 4):
            if program := s[k] << 8 | s[k + 1]:
                maps[program] = (s[k + 2] & 31) << 8 | s[k + 3]
    found: dict[tuple[int, int], Stream] = {}
    for program, map_pid in sorted(maps.items()):
        for s in table(map_pid, 2):
            if s[3] << 8 | s[4] != program:
                continue
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                p = (s[k + 1] & 31) << 8 | s[k + 2]
                found[program, p] = Stream(p, s[k], program)
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for (_, p), stream in sorted(found.items()):
        own = of(p)
        stream.packets = len(own)
        if len(own):
            _read(stream, packets[own], start[own], unit_start[own], counter[own].astype(np.int64), flags[own])
    return [s for _, s in sorted(found.items())]


def _read(stream: Stream, rows: np.ndarray, start: np.ndarray, unit_start: np.ndarray, counter: np.ndarray, flags: np.ndarray) -> None:
    step = (counter[1:] - counter[:-1]) % 16
    again = np.concatenate([[False], (step == 0) & (rows[1:, 4:] == rows[:-1, 4:]).all(axis=1)])
    step = np.concatenate([[1], step])
    stream.continuity_errors = int(((step != 1) & ~again & (flags & 0x80 == 0)).sum())
    rows, start, unit_start, flags = rows[~again], start[~again], unit_start[~again], flags[~again]
    data = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    firsts = np.flatnonzero(unit_start)
    if not len(firsts):
        return
    begin = (ends - (PACKET - start))[firsts].tolist()
    stop = [*begin[1:], len(data)]
    access = (flags[firsts] & 0x40 > 0).tolist()
    parts: list[bytes] = []
    for a, b, random in zip(begin, stop, access, strict=True):
        if data[a : a + 3] != b"\0\0\1" or b - a < 6:
            stream.broken += 1
            continue
        length = data[a + 4] << 8 | data[a + 5]
        end = a + 6 + length if length else b
        if end > b:
            stream.broken += 1
            end = b
        pts, body = None, a + 6
        if data[a + 3] not in BARE_STREAMS and end - a >= 9:
            body = a + 9 + data[a + 8]
            if data[a + 7] & 0x80 and data[a + 8] >= 5:
                pts = _timestamp(data[a + 9 : a + 14])
        part = data[body:end]
        parts.append(part)
        stream.sizes.append(len(part))
        stream.pts.append(pts)
        stream.access.append(random)
    stream.data = b"".join(parts)


def features(streams: list[Stream]) -> str:
    """What a stream's tables, counters and timestamps say, in one line."""
    out = [f"programs={len({s.program for s in streams})}", f"streams={len(streams)}"]
    for s in streams:
        known = [p for p in s.pts if p is not None]
        points = [p for p, a in zip(s.pts, s.access, strict=True) if a and p is not None]
        digest = zlib.crc32(",".join(map(str, points)).encode())
        out.append(
            f"pid={s.pid}:type={s.kind}:packets={s.packets}:gaps={s.continuity_errors}:units={len(s.sizes)}:broken={s.broken}:pts={min(known, default='')}-{max(known, default='')}:"
            f"access={len(points)}:access_crc={digest:08x}"
        )
    return ";".join(out)


def access_times(streams: list[Stream]) -> str:
    """pid:time of every random-access point with a time, by program and pid, comma-joined."""
    return ",".join(f"{s.pid}:{p}" for s in streams for p, a in zip(s.pts, s.access, strict=True) if a and p is not None)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) for each row of docs: the whole text, filled up to whole units, as a transport stream.

    Null counts as empty, which is one unit of filler. Rows without an id and repeated rows are
    stored as they stand; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for at in range(0, len(texts), 256):  # the stored form is larger than the text
                part = texts.slice(at, 256).to_pylist()
                media = pa.array([store(padded(t)) for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, 256), pa.array(map(len, part), pa.int64()), media], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """stored(id, n_bytes, media) with payload, feature, access_points, payload_bytes and tail_crc32 of what is read back.

    payload is the data of all streams, by program and pid. Null and unreadable media have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = [parse(m.as_py() or b"") for m in b.column("media")]
            data = [b"".join(s.data for s in x) for x in streams]
            columns = [
                b.column("id"), b.column("n_bytes"), pa.array([len(m.as_py() or b"") for m in b.column("media")], pa.int64()),
                pa.array([hashlib.sha256(m.as_py() or b"").hexdigest() for m in b.column("media")], pa.string()), pa.array(data, pa.binary()),
                pa.array([zlib.crc32(d[-32:]) for d in data], pa.int64()), pa.array(map(features, streams), pa.string()),
                pa.array(map(access_times, streams), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media_bytes", "media_sha256", "payload", "tail_crc32", "feature", "access_points"])

    kind = stored.schema["id"].dataType.simpleString()
    return stored.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, media_bytes long, media_sha256 string, payload binary, tail_crc32 long, feature string, access_points string")


def access_points(stored: DataFrame) -> DataFrame:
    """(id, program, pid, unit, pts) for each random-access point of stored(id, media).

    unit is the number of the elementary packet that begins there, pts its time in ticks of 90
    kHz, null if it has none. Null and unreadable media have no rows, as has an empty table;
    repeated rows have theirs repeated.
    """
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, media in enumerate(b.column("media")):
                points = [(s.program, s.pid, k, s.pts[k]) for s in parse(media.as_py() or b"") for k, a in enumerate(s.access) if a]
                ids = b.column("id").slice(at, 1).take(pa.array(np.zeros(len(points), np.int64)))
                columns = [pa.array([x[c] for x in points], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "program", "pid", "unit", "pts"])

    return stored.select("id", "media").mapInArrow(run, f"id {kind}, program int, pid int, unit long, pts long")


def op2_media_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_media(store_texts(read_table(spark, sf_dir, "documents")))
    return back.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points",
    )


QUERIES = {"op2_media_mpegts": op2_media_mpegts}
ORACLES: dict[str, str] = {}
