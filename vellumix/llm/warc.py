"""WARC archives in binary columns, and a reader that salvages damaged ones.

Writing. One gzip member per record, archives of about ``ARCHIVE`` bytes, which the query writes to the shared folder. Of
records with equal payloads the one with the largest page_id is a response, the others are revisits that refer to it.
The equal payloads are found by their SHA-256 in an aggregate over narrow rows, of which those of several pages
are written. They are few as a rule, and then looked up without moving any payload; if not, only those that over ``HOT``
pages share are, and the others are joined by digest. So no payload's pages meet in one task, however many share it.

Reading goes member by member, and in a member record by record, inflating no more than the record at hand needs. A
record whose block digest can be computed is judged by it alone: if it holds, the record is good, whatever of the bytes
behind it or of the member's CRC is missing or wrong. A digest in an algorithm or spelling that can't be read says
nothing. A record whose version line, header, length, digest or (without a digest) end fails is quarantined, and reading
goes on at the next version line of the member's content. Records without such a digest are not taken from members that
fail to inflate or whose CRC fails, nor where one ends at the place at which a member is cut off. Header lines may be
folded. The reader then searches for the next byte position at which a gzip member that inflates to a version line
begins, or a plain version line. Each damage is logged as a gap with its reason: the bytes up to that position, or all
bytes of the member if the damage lies in its content. Archives may mix gzip members and plain records. Inflating takes
time in proportion to the archive, twice over.

Defined cases: a null page text is an empty payload, a null url an empty one; empty payloads are equal like others; of
rows that share the largest page_id that with the greatest url is the response, and rows alike in all three are one
record written several times, all responses or all revisits; a null page_id is below all others, is written without
one and reads back as null; payloads that pages without a page_id alone share are all responses, as nothing could refer
to one; an empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, prepare, read, stored

#: Compressed bytes after which an archive is closed.
ARCHIVE = 4 << 20
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/(?:1\.[01]|0\.1[78])\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/(?:1\.[01]|0\.1[78])\r\n")
#: Bytes after which a damaged member's inflating can be taken up again, and those of a member's content that are inflated at once.
PIECE, STRETCH = 1 << 14, 1 << 20
#: Pages of one payload from which they are looked up rather than joined, where too many payloads repeat to look up all.
HOT = 1 << 14


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None, n: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{n}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, n: int = 0) -> bytes:
    """One record, not compressed: a response, or with refers_to a revisit without its payload's bytes."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    url = re.sub(r"[\r\n]+", " ", url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_id(page_id, n)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_id(refers_to, 0)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


CUT = "gzip: the member is cut off"
END = b"\r\n\r\n"
#: Digests that can be computed, and their lengths.
DIGESTS = {"sha1": 20, "sha256": 32, "sha512": 64, "md5": 16}


class Damage(Exception):
    pass


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block behind its HTTP header, or whole if it has none."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        head, mark, body = self.block.partition(END)
        return body if mark else b""

    def http_length(self) -> int | None:
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.block.partition(END)[0])
        return int(m[1]) if m else None


def named_digest(value: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest header ("sha1:BASE32", "SHA-256:hex"); null for one that can't be computed or read."""
    name, mark, text = (value or "").partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip()
    if not mark or name not in DIGESTS:
        return None
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * DIGESTS[name] else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, raw) if len(raw) == DIGESTS[name] else None


class _Member:
    """The content of the gzip member at a position, inflated step by step."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.start, self.at = data, at, at
        self.z, self.step, self.given = zlib.decompressobj(31), PIECE // 4, 0
        self.wrong: str | None = None
        self.ended = False

    def more(self) -> bytes:
        """The next stretch of the content; empty once there is none."""
        while not self.ended:
            piece = self.data[self.at : self.at + self.step]  # what lies behind the member is copied once a piece, not once a member
            if not piece:
                self.ended, self.wrong = True, CUT
                return b""
            try:
                out = self.z.decompress(piece, STRETCH)
            except zlib.error as e:
                self.ended, self.wrong = True, f"gzip: {e}"[:60]
                return self._rest()
            self.at += len(piece) - len(self.z.unused_data) - len(self.z.unconsumed_tail)
            self.step = min(self.step * 2, STRETCH)
            self.ended = self.z.eof
            self.given += len(out)
            if out:
                return out
        return b""

    def _rest(self) -> bytes:
        """What inflates before the bytes that fail: by pieces again, and the piece that fails by bytes."""
        z, at, skip, out = zlib.decompressobj(31), self.start, self.given, []

        def keep(x: bytes) -> None:
            nonlocal skip
            out.append(x[skip:])
            skip = max(0, skip - len(x))

        before = z
        while at < len(self.data):
            before = z.copy()
            try:
                keep(z.decompress(self.data[at : at + PIECE]))
                at += PIECE
            except zlib.error:
                break
        try:
            while at < len(self.data):
                keep(before.decompress(self.data[at : at + 1]))
                at += 1
        except zlib.error:
            pass
        self.at = at
        return b"".join(out)


def _never() -> bool:
    return False


def _one(data: bytes | bytearray, at: int, grow: Callable[[], bool] = _never) -> tuple[dict[str, str], bytes, int, bool]:
    """The record at a position: headers, block, end, and whether a digest proves it. grow: gets more of data, false at its end."""
    while len(data) < at + 12 and grow():
        pass
    if not (m := VERSION.match(data, at)):
        raise Damage("no version line")
    while (end := data.find(END, m.end() - 2)) < 0:
        if VERSION.search(data, at + 1) or not grow():
            raise Damage("the header does not end")
    headers: dict[str, str] = {}
    last = None
    for line in bytes(data[m.end() : end]).decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line
            headers[last] = f"{headers[last]} {line.strip()}".strip()
            continue
        name, mark, value = line.partition(":")
        if not mark:
            raise Damage("a header line has no colon")
        last = name.strip().lower()
        headers[last] = value.strip()
    if not headers.get("content-length", "").isdecimal():
        raise Damage("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    while len(data) < stop + 4 and grow():
        pass
    known = named_digest(headers.get("warc-block-digest"))
    whole = data[stop : stop + 4] == END
    if not whole and (known is None or len(data) < stop):
        raise Damage("the block does not end where its length says")
    block = bytes(data[start:stop])
    if known and hashlib.new(known[0], block).digest() != known[1]:
        raise Damage("block digest")
    rest = next(k for k in range(4, -1, -1) if data[stop : stop + k] == END[:k])
    return headers, block, stop + rest, known is not None


def _records(member: _Member, at: int, wrong: str | None) -> Iterator[Record | str]:
    """The records of a member's content, and the reason for each stretch that holds none. No more of the content is held than
    one record, or what lies before the next version line."""
    held, i = bytearray(), 0

    def grow() -> bool:
        x = member.more()
        held.extend(x)
        return bool(x)

    while True:
        del held[:i]
        i = 0
        if not held and not grow():
            return
        try:
            headers, block, i, sure = _one(held, 0, grow)
            if wrong == CUT and not sure and i == len(held) and not grow():
                yield "the record ends at the cut"
            elif wrong not in (None, CUT) and not sure:
                yield "no digest in a damaged member"
            else:
                yield Record(at, headers, block)
        except Damage as e:
            yield str(e)
            i = 1
            while not (m := VERSION.search(held, i)):
                i = max(1, len(held) - 11)  # a version line may have begun
                if not grow():
                    return
                del held[: i - 1]
                i = 1
            i = m.start()


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive, and gaps (start, end, reason) for the damage between them."""
    at = 0
    while at < len(data):
        if data.startswith(b"\x1f\x8b\x08", at):
            probe, size = _Member(data, at), 0  # what is wrong must be known before records without a digest are given
            while x := probe.more():
                size += len(x)
            end, wrong = probe.at, probe.wrong
            reasons, found = [], False
            for x in _records(_Member(data, at), at, wrong):
                if isinstance(x, Record):
                    found = True
                    yield x
                else:
                    reasons.append(x)
            if wrong:  # its length is not known; plain lines in what gave records are part of it
                end, reasons = _next(data, at + 1, end if found else at + 1), [wrong]
            elif not size:
                reasons = ["an empty member"]
            yield from ((at, end, r) for r in reasons)
            at = end
            continue
        try:
            headers, block, end, _ = _one(data, at)
            yield Record(at, headers, block)
            at = end
        except Damage as e:
            start, at = at, _next(data, at + 1)
            yield start, at, str(e)


def _next(data: bytes, at: int, plain: int = 0) -> int:
    """The next position where a record begins, one without gzip not before plain, or the end."""
    for m in START.finditer(data, at):
        if data[m.start()] != 0x1F:
            if m.start() >= plain:
                return m.start()
            continue
        try:  # a chance magic number mostly fails in its first bytes
            if VERSION.match(zlib.decompressobj(31).decompress(data[m.start() : m.start() + 4096], 16)):
                return m.start()
        except zlib.error:
            pass
    return len(data)


def assign(pages: DataFrame, least: int = 0, small: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """page_id, url, payload (binary), refers_to: null for responses. Payloads below least bytes are all responses."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    key = F.sha2("payload", 256)
    groups = rows.where(F.length("payload") >= least).groupBy(key.alias("k")).agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    firsts = groups.where("n > 1 and top.page_id is not null").checkpoint()
    keyed = rows.withColumn("k", key)
    if firsts.limit(small + 1).count() <= small:
        found = keyed.join(F.broadcast(firsts), "k", "left")
    else:
        many = firsts.where(F.col("n") > hot).select("k", F.col("top").alias("hot"))  # at most a hot-th of all pages
        few = firsts.where(F.col("n") <= hot).select(F.col("k").alias("j"), "top")
        one = keyed.join(F.broadcast(many), "k", "left")
        j = F.when(F.col("hot").isNull(), F.col("k")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))  # the rest goes anywhere
        found = one.withColumn("j", j).join(few, "j", "left").withColumn("top", F.coalesce("hot", "top"))
    other = ~F.struct("page_id", "url").eqNullSafe(F.col("top"))
    return found.select("page_id", "url", "payload", F.when(F.col("top").isNotNull() & other, F.col("top.page_id")).alias("refers_to"))


def write_archives(rows: DataFrame, size: int = ARCHIVE) -> DataFrame:
    """n_records, data (binary): archives of rows as assign gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["n_records", "data"])
            held.clear()
            return out

        total = 0
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(record(page, url, payload, refers)))
                total += len(held[-1])
                if total >= size:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "n_records int, data binary")


FIELDS = {
    "kind": ("string", pa.string()),
    "start": ("long", pa.int64()),
    "stop": ("long", pa.int64()),
    "reason": ("string", pa.string()),
    "record_type": ("string", pa.string()),
    "record_id": ("string", pa.string()),
    "refers_to": ("string", pa.string()),
    "url": ("string", pa.string()),
    "payload_digest": ("string", pa.string()),
    "payload_bytes": ("long", pa.int64()),
    "payload": ("binary", pa.binary()),
}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record (kind "record") and per quarantined gap (kind "gap": start, stop, reason) of the data column.

    A response's digest and length are those of the payload that was read, a gap if they differ from its header; a
    revisit's are its header's (the length that of its HTTP header). payload is null for revisits, or if not asked for.
    """

    def row(x: Record | tuple[int, int, str]) -> tuple:
        if not isinstance(x, Record):
            return ("gap", *x, None, None, None, None, None, None, None)
        h, kind = x.headers, x.headers.get("warc-type")
        named = named_digest(h.get("warc-payload-digest"))
        common = (kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"))
        if kind == "revisit":
            told = base64.b32encode(named[1]).decode() if named and named[0] == "sha1" else h.get("warc-payload-digest")
            return ("record", x.offset, None, None, *common, told, x.http_length(), None)
        body = x.payload
        own = digest32(body)
        if named and hashlib.new(named[0], body).digest() != named[1]:
            return ("gap", x.offset, x.offset, "payload digest", *[None] * 7)
        return ("record", x.offset, None, None, *common, own, len(body), body if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                part: list[tuple] = []
                for x in salvage(data.as_py() or b""):
                    part.append(row(x))
                    if len(part) >= 200:
                        yield _batch(part)
                        part = []
                if part:
                    yield _batch(part)

    return archives.select("data").mapInArrow(run, ", ".join(f"{k} {t}" for k, (t, _) in FIELDS.items()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS.values())], list(FIELDS))


def page_number(record_id: str) -> Column:
    """The page_id in a record id."""
    return F.nullif(F.regexp_extract(record_id, r"<urn:page:(-?\d*):", 1), F.lit("")).cast("long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    archives = stored(write_archives(assign(read(spark, sf_dir, "pages"))), "warc")
    rows = read_archives(archives, payloads=False).where("kind = 'record'")
    return rows.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


#: SHA-1's hex digits in groups of 5 bits; DuckDB has no base 32.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
t AS (SELECT x, n, max(page_id) AS top FROM h GROUP BY x, n),
bits AS (SELECT page_id, h.n, top, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', x[i]) - 1), 4, '0')), 'string_agg', '') AS s FROM h JOIN t USING (x, n))
SELECT page_id, n::BIGINT AS payload_bytes,
list_aggregate(list_transform(range(0, 32), lambda i: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[((s[5*i+1]::INT * 16 + s[5*i+2]::INT * 8 + s[5*i+3]::INT * 4 + s[5*i+4]::INT * 2 + s[5*i+5]::INT) + 1)::BIGINT]), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> top THEN top END AS refers_to FROM bits
"""
