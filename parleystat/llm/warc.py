"""WARC archives: a writer on Spark's text sink and a reader that survives damage.

Writing. Each row becomes one WARC 1.1 record. Spark's text sink writes the bytes of its string column as they
are and a chosen separator after each, through whatever file system the path names. Plain archives use the
record's own closing blank lines as that separator; compressed ones write each record as a gzip member of its own
and an empty member as the separator, which readers of concatenated gzip skip.

Reading. One task reads one file (the writer keeps files small; size foreign archives the same way) and walks it
member by member. A record counts only if everything checks: version line, lengths and digests. Where a check fails
the reader opens a gap, searches for the next gzip magic or version line that starts a valid record, and goes on
there; the skipped bytes come out as a row with their offsets and the reason. Inside a member the same search goes
over its inflated bytes, as far as they can be had: a member that is cut or broken gives the records before the
damage (where compression or its checksum failed, only those with a digest of their block), whichever way an archive is
compressed. As in plain archives, no digest covers a record's header lines, so records of a member that is not whole
are marked as not verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleystat.llm.common import batches

VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
END = b"\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
_NAME = re.compile(rb"[A-Za-z0-9_-]+")
_CONTROL = re.compile(rb"[\x00-\x08\x0a-\x1f\x7f]")
CUT, BROKEN = "truncated member", "broken compression"
WRITTEN = "2000-01-01T00:00:00Z"

EVENTS = pa.schema(
    [
        ("kind", pa.string()),  # record or gap
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("reason", pa.string()),  # of a gap
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("payload_digest", pa.string()),
        ("inner_offset", pa.int64()),  # in the inflated bytes of the member at `offset`
        ("inner_length", pa.int64()),
        ("verified", pa.bool_()),  # of a record: false where its member's own checksum is not met
    ]
)
EVENTS_DDL = (
    "kind string, path string, offset long, length long, reason string, record_type string, record_id string, "
    "target_uri string, headers map<string,string>, payload binary, payload_digest string, "
    "inner_offset long, inner_length long, verified boolean"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing


def _record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, refers: bool) -> bytes:
    """One record without its closing blank lines."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", WRITTEN),
        *([("WARC-Target-URI", uri)] if uri else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{keeper}>")] if refers else []),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Page rows as `page_id, url, payload, keeper, refers`.

    Of pages with equal payloads of at least `least_bytes` bytes, the one with the largest page_id is kept and the
    others refer to it. Rows that repeat the kept page_id and its payload are kept too. A null html is an empty
    payload; a page without an id refers to one with an id, or is kept where there is none. The digests are
    grouped map-side, and a digest that many pages share is split by Spark where it joins back.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("_digest", F.sha1("payload"))
    kept = rows.groupBy("_digest").agg(F.max("page_id").alias("keeper"))
    refers = (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(kept, "_digest").select("page_id", "url", "payload", "keeper", refers.alias("refers"))


def write_warc(rows: DataFrame, path: str, compress: bool = True) -> None:
    """Write the rows of `with_revisits` as archives below `path`, one file per partition."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for part in parts:
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    data = _record(*row)
                    if compress:
                        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                        data = packer.compress(data + END) + packer.flush()
                    yield (data,)

        yield from batches(records(), pa.schema([("value", pa.binary())]), weigh=lambda r: len(r[0]))

    separator = EMPTY_MEMBER if compress else END
    written = rows.select("page_id", "url", "payload", "keeper", "refers").mapInArrow(encode, "value binary")
    (
        written.select(F.col("value").cast("string"))
        .write.option("lineSep", separator.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(path)
    )


# Reading


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes
    inner: tuple[int, int] | None = None  # where it is in the inflated bytes of its member
    verified: bool = True  # False in a member that is not whole: no checksum covers the header lines


class Gap(NamedTuple):
    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


class Damaged(Exception):
    """Why there is no valid record. None starts before `past` either, as the same header would fail again. `frame`
    is where the record ends by its length, if that is met and only a digest differs."""

    def __init__(self, reason: str, past: int = 0, frame: int = 0):
        super().__init__(reason)
        self.past, self.frame = past, frame


def _inflate(data: bytes, start: int, until: int | None = None, step: int = 1 << 15) -> tuple[bytes, int, str | None, bool]:
    """The gzip member at `start`, where it ends, and why it is not whole: then it is what comes before the damage, or
    before `until`. Last, whether the decoder lost its place, and did not come to a checksum that differs. It is fed in
    steps, so what follows it is never copied; a step that fails is fed again byte by byte."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    until = len(data) if until is None else until
    while not unpacker.eof:
        if at >= until:
            return b"".join(out), until, CUT, False
        before = unpacker.copy() if out else None
        part = data[at : min(at + step, until)]
        try:
            out.append(unpacker.decompress(part))
        except zlib.error:
            before = before or zlib.decompressobj(31)
            try:
                while True:
                    out.append(before.decompress(data[at : at + 1]))
                    at += 1
            except zlib.error as failed:
                return b"".join(out), at, BROKEN, "incorrect" not in str(failed)
        at += len(part)
    return b"".join(out), at - len(unpacker.unused_data), None, False


def _broken_member(data: bytes, start: int, plain: bytes, end: int, why: str) -> tuple[bytes, int, str]:
    """What a member that failed at `end` holds for sure, where that is at an end, and why no more comes.

    A decoder that has lost its place, or whose member was cut off, reads on through what follows and writes old bytes
    once more. So the member ends where a whole one starts inside the bytes it took in, if one does, and nothing that was
    decoded from behind that place counts.
    """
    next_one = data.find(MAGIC, start + 1, end)
    while next_one >= 0:
        if data[next_one : next_one + len(EMPTY_MEMBER)] == EMPTY_MEMBER or _VERSION_LINE.match(_inflate(data, next_one)[0]):
            if _inflate(data, next_one)[2] is None:
                plain, _, cut, _ = _inflate(data, start, next_one)
                return plain, next_one, why if cut == CUT and why == BROKEN else cut or why
        next_one = data.find(MAGIC, next_one + 1, end)
    return plain, end, why


def _reached(data: bytes, start: int, length: int, step: int = 1 << 15) -> int:
    """Where the first `length` inflated bytes of the member at `start` have been read."""
    unpacker, at = zlib.decompressobj(31), start
    while length:
        part, before = data[at : at + step], unpacker.copy()
        try:
            length -= len(unpacker.decompress(part, length))
        except zlib.error:  # what follows them in the same step is broken
            unpacker, step = before, 1
            continue
        at += len(part) - len(unpacker.unconsumed_tail)
    return at


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The header lines from `at` to the empty line, however long, and where the block begins. The walk ends at the
    first line that is none, so damage does not make it read on through what follows."""
    headers: dict[str, str] = {}
    while (stop := data.find(CRLF, at)) != at:
        if stop < 0:
            raise Damaged("unclosed header", at)
        name, colon, value = data[at:stop].partition(b":")
        try:
            said = value.decode("utf-8").strip()
        except UnicodeDecodeError:
            raise Damaged("broken header line", at) from None
        if not colon or not _NAME.fullmatch(name) or _CONTROL.search(value):
            raise Damaged("broken header line", at)
        headers[name.decode().lower()] = said
        at = stop + len(CRLF)
    return headers, at + len(CRLF)


def _parse(data: bytes, start: int, by_digest: bool = False) -> Record:
    """The plain record at `start`, checked against its lengths and digests; `by_digest` asks for the block's."""
    if not _VERSION_LINE.match(data, start):
        raise Damaged("no version line")
    headers, begin = _headers(data, start + len(b"WARC/1.1\r\n"))
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length", begin)
    end = begin + int(length)
    if data[end : end + len(END)] != END:
        raise Damaged("content length does not meet the record's end", begin)
    block = data[begin:end]
    digests = {"block": headers.get("warc-block-digest", "")}
    if headers.get("warc-type") == "response":
        digests["payload"] = headers.get("warc-payload-digest", "")
    known = {of: named[5:] for of, named in digests.items() if named.startswith("sha1:")}
    for of, named in known.items():
        if named != sha1_base32(block if of == "block" else payload_of(headers, block)):
            raise Damaged(f"{of} digest differs", frame=end + len(END))
    if by_digest and "block" not in known:
        raise Damaged("no block digest to tell by")
    return Record(start, end + len(END), headers, block)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The entity body of a record that holds an HTTP message, else the whole block."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    split = block.find(END)
    return block[split + len(END) :] if split >= 0 else b""


Unit = tuple[list[Record | Gap], int, Damaged | None]


def _plain(data: bytes, start: int, by_digest: bool = False) -> Unit:
    record = _parse(data, start, by_digest)
    return [record], record.end, None


def _once(found: list[Record | Gap]) -> list[Record | Gap]:
    """The finds of a member whose decoder lost its place. Such a one copies what it wrote before, so a record that
    equals an earlier one of the member is a gap."""
    seen, out = set(), []
    for x in found:
        if isinstance(x, Record):
            what = sha1_base32(x.block), *x.headers.items()
            x = Gap(x.start, x.end, "written again") if what in seen else x
            seen.add(what)
        out.append(x)
    return out


def _unit(data: bytes, start: int) -> Unit:
    """The records and inner gaps of the member or plain record at `start`, where it ends, and what is wrong with the
    rest. A member that is not whole ends behind its last valid record."""
    if not data.startswith(MAGIC, start):
        return _plain(data, start)
    plain, end, broken, lost = _inflate(data, start)
    if broken:
        plain, end, broken = _broken_member(data, start, plain, end, broken)
    found = list(_walk(plain, partial(_plain, by_digest=broken == BROKEN), (VERSION,)))
    if broken:
        found = [x._replace(verified=False) if isinstance(x, Record) else x for x in (_once(found) if lost else found)]
        while found and isinstance(found[-1], Gap):
            found.pop()
        if not found:
            raise Damaged(broken)
        end = min(_reached(data, start, found[-1].end), end)
    placed = [x._replace(start=start, end=end, inner=(x.start, x.end)) for x in found]
    return placed, end, Damaged(broken) if broken else None


def _meets(data: bytes, unit: Callable[..., Unit], at: int, frame: int) -> bool:
    """Whether whole units follow each other from `at` up to `frame`."""
    try:
        while at < frame:
            _, at, rest = unit(data, at)
            if rest:
                return False
    except Damaged:
        return False
    return at == frame


def _walk(data: bytes, unit: Callable[..., Unit], marks: tuple[bytes, ...]) -> Iterator[Record | Gap]:
    """Units from the start on; after damage, from the next of `marks` that starts one with a valid record.

    In a record of which only a digest differs, records count only if they fill it to its end (a wrong length had
    taken them in); else its payload quotes them.
    """
    at, search, damage, places = 0, 0, None, dict.fromkeys(marks, 0)
    while at < len(data):
        place = at
        if damage:
            for mark in marks:
                if 0 <= places[mark] < search:
                    places[mark] = data.find(mark, search)
            place = min((p for p in places.values() if p >= 0), default=len(data))
            if place == len(data):
                yield Gap(at, place, str(damage))
                return
        try:
            found, end, rest = unit(data, place)
            if damage and found and not any(isinstance(x, Record) for x in found):
                raise Damaged("no valid record")
            if damage and place < damage.frame and not _meets(data, unit, end, damage.frame):
                raise Damaged("quoted")
        except Damaged as failed:
            damage = damage or failed
            search = max(place + 1, failed.past)
            continue
        if at < place:
            yield Gap(at, place, str(damage))
        yield from found
        at, search, damage = end, end, rest


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every valid record of an archive, and every gap between them, in order. An empty archive has neither.

    Records and gaps inside a gzip member have its offsets and their own in its inflated bytes (`inner`).
    """
    return _walk(data, _unit, (MAGIC, VERSION))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below `path`, one row each (`EVENTS_DDL`).

    `payload` is null where the record does not carry it (revisits). Lost executors only repeat their files.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events():
            for part in parts:
                for name, data in zip(part.column(0).to_pylist(), part.column(1)):
                    for x in salvage(data.as_py()):
                        inner = (x.inner[0], x.inner[1] - x.inner[0]) if x.inner else (None, None)
                        if isinstance(x, Gap):
                            yield ("gap", name, x.start, x.end - x.start, x.reason, *[None] * 6, *inner, None)
                            continue
                        h = x.headers
                        kind = h.get("warc-type")
                        payload = None if kind == "revisit" else payload_of(h, x.block)
                        named = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        digest = named or (None if payload is None else sha1_base32(payload))
                        yield (
                            "record", name, x.start, x.end - x.start, None, kind, h.get("warc-record-id"),
                            h.get("warc-target-uri"), list(h.items()), payload, digest, *inner, x.verified,
                        )

        yield from batches(events(), EVENTS, weigh=lambda r: len(r[9] or b"") + 2 * len(r[7] or ""))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, EVENTS_DDL)


def page_results(events: DataFrame) -> DataFrame:
    """Per page record: its id, full payload's length and digest, type, and the page it refers to."""

    def page(name: Column | str) -> Column:
        return F.nullif(F.regexp_extract(name, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")

    revisit = F.col("record_type") == "revisit"
    named = F.col("headers")["x-payload-length"].cast("long")
    return events.where("kind = 'record'").select(
        page("record_id").alias("page_id"),
        F.when(revisit, named).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(revisit, page(F.col("headers")["warc-refers-to"])).alias("refers_to"),
    )
