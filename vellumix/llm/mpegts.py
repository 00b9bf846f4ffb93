"""Media columns: MPEG transport streams in binary columns.

Writing. A payload becomes one private-data elementary stream (stream type 6) of one program: access units of up to
``UNIT`` bytes, each a PES packet with a presentation time stamp 3,600 ticks (1/25 s) after the last, each marked as a
random-access point and led by a program clock reference. The program tables (PAT and PMT) come first and again before
every ``TABLES_EVERY`` access units. All packets are 188 bytes; the last of an access unit is stuffed.

Reading takes any transport stream: it finds the packet grid, resynchronises after damage, drops packets flagged as in
error, parses PAT and PMT sections (which may span packets) under their CRC, checks continuity counters per PID (a
single repeated packet is dropped, as the standard allows; any other jump counts as an error unless it is announced as
a discontinuity), reassembles PES packets by PID, and keeps their time stamps with the random-access points. An
elementary stream's bytes are those of its PES packets in order.

Defined cases: a null text is empty; a payload is padded with zero bytes to a positive multiple of ``ALIGN``, so it is
never empty; null media parse as an empty stream; damaged media never raise, what is lost is counted; repeated rows
and null ids give a row each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, read, stored, text_or_empty, texts

ALIGN = 64
UNIT = 32_768
TICKS = 3600
TABLES_EVERY = 16
PACKET = 188
PMT_PID, ES_PID = 0x1000, 0x0100
PRIVATE_STREAM_1, PRIVATE_DATA = 0xBD, 0x06


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = c << 1 ^ (0x04C11DB7 if c & 1 << 31 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, not reflected, all ones first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")


def _stamp(prefix: int, pts: int) -> bytes:
    return bytes([prefix << 4 | pts >> 29 & 0x0E | 1, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pes(data: bytes, pts: int) -> bytes:
    return b"\0\0\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + data


_HEADS = [bytes([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10 | cc]) for cc in range(16)]


def _table_packet(pid: int, cc: int, body: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10 | cc]) + b"\0" + body).ljust(PACKET, b"\xff")


def mux(payload: bytes) -> bytes:
    """A transport stream of the payload."""
    out: list[bytes] = []
    cc = tables = 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        if n % TABLES_EVERY == 0:
            out += [_table_packet(0, tables & 15, PAT), _table_packet(PMT_PID, tables & 15, PMT)]
            tables += 1
        pts = (n + 1) * TICKS & (1 << 33) - 1
        unit = pes(payload[at : at + UNIT], pts)
        base = n * TICKS & (1 << 33) - 1
        pcr = (base << 15 | 0x3F << 9).to_bytes(6, "big")
        first = min(len(unit), PACKET - 12)
        room = PACKET - 12 - first
        out.append(bytes([0x47, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc, 7 + room, 0x50]) + pcr + b"\xff" * room + unit[:first])
        cc = cc + 1 & 15
        end = first + (len(unit) - first) // 184 * 184
        for i in range(first, end, 184):
            out += (_HEADS[cc], unit[i : i + 184])
            cc = cc + 1 & 15
        if rest := unit[end:]:
            room = 183 - len(rest)
            field_ = bytes([room]) + (b"\0" + b"\xff" * (room - 1) if room else b"")
            out.append(bytes([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc]) + field_ + rest)
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. access: per PES packet (pid, pts or None, offset of its packet, random access,
    damaged: a packet of it was lost on the way)."""

    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    access: list[tuple[int, int | None, int, bool, bool]] = field(default_factory=list)
    data: dict[int, list[bytes]] = field(default_factory=dict)
    packets: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    table_errors: int = 0
    lost_bytes: int = 0
    flagged: int = 0
    pcrs: int = 0

    def payload(self, pid: int | None = None) -> bytes:
        """The bytes of an elementary stream; by default of the first that the tables name."""
        pid = pid if pid is not None else next(iter(self.types), None)
        return b"".join(self.data.get(pid, ()))


def _sections(held: bytearray) -> Iterator[bytes]:
    """Whole sections at the front of a table's bytes, which they leave."""
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < size:
            return
        yield bytes(held[:size])
        del held[:size]


def _table(out: Stream, pid: int, body: bytes) -> None:
    if len(body) < 12 or crc32_mpeg(body):
        out.table_errors += 1
    elif pid == 0 and body[0] == 0:
        for i in range(8, len(body) - 4, 4):
            if number := int.from_bytes(body[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF
    elif body[0] == 2:
        i = 12 + (int.from_bytes(body[10:12], "big") & 0x0FFF)
        while i + 5 <= len(body) - 4:
            out.types[int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF] = body[i]
            i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0x0FFF)


def _finish(out: Stream, pid: int, parts: list[bytes], where: tuple[int, bool], damaged: bool = False) -> None:
    """A PES packet whose parts are there."""
    raw = b"".join(parts)
    if len(raw) < 9 or raw[:3] != b"\0\0\x01":
        out.lost_bytes += len(raw)
        return
    size, flags, head = int.from_bytes(raw[4:6], "big"), raw[7], 9 + raw[8]
    pts = None
    if flags & 0x80 and len(raw) >= 14:
        a = raw[9:14]
        pts = (a[0] >> 1 & 7) << 30 | a[1] << 22 | a[2] >> 1 << 15 | a[3] << 7 | a[4] >> 1
    end = 6 + size if size else len(raw)
    out.lost_bytes += max(0, end - len(raw))
    out.access.append((pid, pts, *where, damaged or end > len(raw)))
    out.data.setdefault(pid, []).append(raw[head:end])


def parse(media: bytes) -> Stream:
    """Reads a transport stream."""
    out = Stream()
    counters: dict[int, int] = {}
    last: dict[int, bytes] = {}
    tables: dict[int, bytearray] = {}
    open_: dict[int, tuple[list[bytes], tuple[int, bool]]] = {}
    damaged: set[int] = set()
    at, n = 0, len(media)
    while at + PACKET <= n:
        if media[at] != 0x47:
            nxt = media.find(b"\x47", at + 1)  # resynchronise where a second sync byte follows, or the stream ends
            while nxt >= 0 and nxt + PACKET < n and media[nxt + PACKET] != 0x47:
                nxt = media.find(b"\x47", nxt + 1)
            nxt = nxt if nxt >= 0 else n
            out.lost_bytes += nxt - at
            at = nxt
            continue
        b1, b3, p = media[at + 1], media[at + 3], at
        at += PACKET
        out.packets += 1
        pid = (b1 & 0x1F) << 8 | media[p + 2]
        if b1 & 0x80:
            out.flagged += 1
            continue
        if pid == 0x1FFF:
            continue
        body, random, jump = p + 4, False, False
        if b3 & 0x20:
            size = media[p + 4]
            body = p + 5 + size
            if size and size < 184:
                flags = media[p + 5]
                random, jump = bool(flags & 0x40), bool(flags & 0x80)
                out.pcrs += bool(flags & 0x10)
        if not b3 & 0x10 or body >= at:
            continue
        cc, before = b3 & 15, counters.get(pid)
        if before is not None and not jump and cc != before + 1 & 15:
            if cc == before and last.get(pid) == media[p:at]:
                out.repeated += 1
                continue
            out.continuity_errors += 1
            damaged.add(pid)  # what is open, which goes on behind the gap, or has lost its end
        counters[pid] = cc
        last[pid] = media[p:at]
        known = open_.get(pid)
        if pid == 0 or pid in out.programs.values():
            held = tables.setdefault(pid, bytearray())
            if b1 & 0x40:
                skip = media[body]
                if held:
                    held += media[body + 1 : body + 1 + skip]
                    for s in _sections(held):
                        _table(out, pid, s)
                held[:] = media[body + 1 + skip : at]
            else:
                held += media[body:at]
            for s in _sections(held):
                _table(out, pid, s)
        elif b1 & 0x40:
            if known:
                _finish(out, pid, *known, pid in damaged)
            damaged.discard(pid)
            open_[pid] = ([media[body:at]], (p, random))
        elif known:
            known[0].append(media[body:at])
        else:
            out.lost_bytes += at - body
    out.lost_bytes += n - at if at < n else 0
    for pid, known in open_.items():
        _finish(out, pid, *known, pid in damaged)
    return out


def describe(s: Stream) -> str:
    """The stream's features in one line."""
    stamps = [a[1] for a in s.access if a[1] is not None]
    random = [a for a in s.access if a[3]]
    return (
        f"programs={len(s.programs)};streams={','.join(f'{p}:{t}' for p, t in sorted(s.types.items()))};packets={s.packets};pes={len(s.access)};pcr={s.pcrs};"
        f"cc_errors={s.continuity_errors};repeated={s.repeated};table_errors={s.table_errors};lost={s.lost_bytes};flagged={s.flagged};"
        f"pts={f'{min(stamps)}-{max(stamps)}' if stamps else ''};random_access={len(random)};last_random_access={random[-1][2] if random else ''}"
    )


def payload_of(text: bytes, align: int = ALIGN) -> bytes:
    return text.ljust(max(1, -(-len(text) // align)) * align, b"\0")


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (binary): each text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch, "text")
            for at in range(0, len(rows), 100):
                part = rows[at : at + 100]
                columns = [batch.column(0).slice(at, 100), pa.array([len(x) for x in part], pa.int64()), pa.array([mux(payload_of(x)) for x in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored stream holds: digests, features, time stamps and random-access points.

    access: array of (pid, pts, offset, random_access, damaged), one for each PES packet.
    """
    kind = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_()), ("damaged", pa.bool_())]))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in texts(batch, "media"):
                s = parse(raw)
                data = s.payload()
                access = [dict(zip(("pid", "pts", "offset", "random_access", "damaged"), a, strict=True)) for a in s.access]
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ALIGN:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(s), access))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access array<struct<pid:int,pts:long,offset:long,random_access:boolean,damaged:boolean>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op1_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are written to the shared folder and read back from there."""
    return read_media(stored(to_media(read(prepare(spark), sf_dir, "documents")), "media"))
