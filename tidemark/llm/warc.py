"""WARC archives: a writer with payload de-duplication and a salvage reader that survives damaged bytes.

An archive is a table of chunks ``(archive long, chunk long, data binary)``: each chunk holds whole records, so any store
that Spark can write keeps it. ``read_warc`` also takes real ``.warc`` or ``.warc.gz`` files through ``binary_files``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import tidy

#: Fixed values of the format: a gzip member's first bytes, the revisit profile, the form of a date.
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are never turned into revisits.
MIN_REVISIT_BYTES = 100
#: Bytes of a chunk, of whole records (one at least).
CHUNK_BYTES = 4 << 20
#: Bytes in which the headers of a record have to end, and a name or comment in the head of a gzip member.
HEADER_BYTES, NAME_BYTES = 1 << 20, 1 << 14
#: Records of which nothing says when they were captured bear this date.
NO_DATE = "1970-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_SCHEMA = "archive long, chunk long, offset long, length long, kind string, reason string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
_ARROW = pa.schema(
    [("archive", pa.int64()), ("chunk", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
    + [(n, pa.string()) for n in ("kind", "reason", "record_type", "page_id", "url")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
)


def _header_value(x: str) -> str:
    """Header values lie on one line; control characters and the escape itself are percent-encoded."""
    return re.sub(r"[%\x00-\x1f\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), x)


def _plain_value(x: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), x)


def build_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, date: str = NO_DATE) -> bytes:
    """One record in its own gzip member. A revisit carries no payload, but the length and digest of the full one. ``date`` is
    the time of capture in UTC, as the format writes it."""
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else _header_value(str(page_id))}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{digest if refers_to is None else hashlib.sha256(b'').hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{_header_value(str(refers_to))}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES, date: str = NO_DATE) -> DataFrame:
    """Archive chunks with one record for each row of ``pages``, captured at ``date``.

    Of rows with equal payloads of ``min_revisit`` bytes or more, the one with the smallest id is a response and the
    others are revisits of it. Nulls: a null payload is empty; a null id sorts after all others (without any id in its
    group it is a response) and reads back as null; a null url is left out. Rows that repeat the smallest id together with
    its payload are responses all of them. An empty table gives no chunks. Other columns are ignored.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    # Sizes and ids alone are gathered by digest, with map-side sums; payloads move once, and a large group of copies can be split.
    groups = rows.filter(F.length("body") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    lead = F.col("first").isNotNull() & F.col("id").eqNullSafe(F.col("first"))
    joined = rows.join(groups.filter("n > 1"), "digest", "left").withColumn("lead", lead)

    def build(batches):
        k = 0
        part = None
        for batch in batches:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            data: list[bytes] = []
            size = 0
            ids, urls, bodies, digests, firsts, leads = (batch.column(n).to_pylist() for n in ("id", "url", "body", "digest", "first", "lead"))
            out: list[bytes] = []
            for i, u, b, d, f, lead in zip(ids, urls, bodies, digests, firsts, leads):
                data.append(build_record(i, u, b, d, None if f is None or lead else f, date))
                size += len(data[-1])
                if size >= CHUNK_BYTES:
                    out.append(b"".join(data))
                    data, size = [], 0
            if data:
                out.append(b"".join(data))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int64()), pa.array(range(k, k + len(out)), pa.int64()), pa.array(out, pa.binary())], ["archive", "chunk", "data"])
            k += len(out)

    return joined.mapInArrow(tidy(build), "archive long, chunk long, data binary")


@dataclass
class Found:
    offset: int
    length: int
    reason: str | None  # of a gap; None for a record
    headers: dict[str, str] | None = None
    block: bytes = b""


def _headers(data: bytes, at: int) -> tuple[int, int, dict[str, str]] | str:
    """The headers at ``at``: where their block begins and ends, and their fields under lower-case names; or why they are
    none. White space around a value is not part of it, and a line that begins with some continues the one before."""
    if not _VERSION.match(data, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if stop < 0:
        return "headers not ended"
    headers: dict[str, str] = {}
    name = None
    try:
        for line in data[at:stop].decode().split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and name:
                headers[name] = f"{headers[name]} {line.strip(' \t')}"
                continue
            name, colon, value = line.partition(":")
            name = name.strip(" \t").lower()
            if not colon or not name:
                return "headers not readable"
            headers[name] = value.strip(" \t")
    except ValueError:
        return "headers not readable"
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no content length"
    return stop + 4, stop + 4 + int(length), headers


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at ``at`` of uncompressed bytes: its end, headers and block; or why it is none."""
    got = _headers(data, at)
    if isinstance(got, str):
        return got
    begin, end, headers = got
    if data[end : end + 4] != b"\r\n\r\n":
        return "content length does not fit"
    block = data[begin:end]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        return "block digest differs"
    return end + 4, headers, block


def _gzip_head(data: bytes, at: int) -> int | None:
    """Where the deflated bytes of a gzip member begin, if its head is sound."""
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return None
    flags, to = data[at + 3], at + 10
    if flags & 4:
        to += 2 + int.from_bytes(data[to : to + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            to = data.find(b"\0", to, to + NAME_BYTES) + 1
            if not to:
                return None
    return to + 2 * bool(flags & 2)


def _member(data: bytes, at: int) -> tuple[int, bytes] | str:
    """The gzip member at ``at``: its end and content; or why it is none. zlib checks length and CRC.

    No more is inflated than the headers and then the block that they announce. Input is fed in steps that grow, so that a
    false beginning costs little.
    """
    head = _gzip_head(data, at)
    if head is None or head >= len(data):
        return "member not readable (head)"
    d = zlib.decompressobj(31)
    view, out, to, step, most = memoryview(data), bytearray(), at, head - at + 512, None
    try:
        while not d.eof and to < len(data):
            feed = view[to : to + step]
            to, step = to + len(feed), min(2 * step, 1 << 20)
            while True:
                room = (most if most is not None else HEADER_BYTES) + 1 - len(out)
                out += d.decompress(feed, max(1, min(room, 1 << 20)))
                if most is None and (b"\r\n\r\n" in out or len(out) > HEADER_BYTES or d.eof):
                    got = _headers(bytes(out[: HEADER_BYTES + 4]), 0)
                    if isinstance(got, str):
                        return got
                    most = got[1] + 4
                if most is not None and len(out) > most:
                    return "trailing bytes in member"
                if d.eof or not d.unconsumed_tail:
                    break
                feed = d.unconsumed_tail
    except zlib.error as e:
        return f"member not readable ({str(e).split(':')[0]})"
    return (to - len(d.unused_data), bytes(out)) if d.eof else "member not ended"


def salvage(data: bytes) -> Iterator[Found]:
    """Records of an archive and the byte gaps between them, in order, covering every byte.

    A failed check opens a gap, which lasts until the next gzip member that decompresses to a record, or the next version
    line (of uncompressed archives) with a valid record behind it. Digests that differ, lengths that do not fit, bad
    members and headers all count as failed checks.
    """
    at, gap, why = 0, None, ""
    n = len(data)
    # Where the next member and the next version line may begin; each is looked for once it has been passed.
    member, version = -1, -1

    def after(i: int) -> int:
        nonlocal member, version
        if member < i:
            k = data.find(GZIP_MAGIC, i)
            member = k if k >= 0 else n
        if version < i:
            m = _VERSION.search(data, i)
            version = m.start() if m else n
        return min(member, version)

    while at < n:
        got: object
        if data.startswith(GZIP_MAGIC, at):
            got = _member(data, at)
            if not isinstance(got, str):
                end, plain = got
                inner = _parse(plain, 0)
                got = inner if isinstance(inner, str) else (end, inner[1], inner[2])
        else:
            got = _parse(data, at)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            at = after(at + 1)
            continue
        if gap is not None:
            yield Found(gap, at - gap, why)
            gap = None
        yield Found(at, got[0] - at, None, got[1], got[2])
        at = got[0]
    if gap is not None:
        yield Found(gap, n - gap, why)


def _urn(x: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:(.*)>", x or "")
    return _plain_value(m[1]) or None if m else x


def read_warc(archives: DataFrame) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined byte gaps (``kind = 'gap'``, with offset, length and reason) of chunks.

    Nulls: a chunk of null bytes has no records and no gaps. Empty chunks and tables give no rows. Payload length and
    digest of a revisit are those of the full payload, from its headers.
    """

    def read(batches):
        for batch in batches:
            for a, c, data in zip(*(batch.column(n).to_pylist() for n in ("archive", "chunk", "data"))):
                rows = []
                for f in salvage(data or b""):
                    row = {"archive": a, "chunk": c, "offset": f.offset, "length": f.length, "kind": "gap" if f.headers is None else "record", "reason": f.reason}
                    if f.headers is not None:
                        h = f.headers
                        kind = h.get("warc-type")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                        row |= {
                            "record_type": kind, "page_id": _urn(h.get("warc-record-id")), "refers_to": _urn(h.get("warc-refers-to")), "payload": f.block,
                            "url": _plain_value(h["warc-target-uri"]) if "warc-target-uri" in h else None,
                            "payload_bytes": int(h.get("x-payload-length", len(f.block))) if kind == "revisit" else len(f.block),
                            "payload_digest": digest if kind == "revisit" else hashlib.sha256(f.block).hexdigest(),
                        }
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return archives.select("archive", "chunk", "data").mapInArrow(tidy(read), RECORD_SCHEMA)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Real WARC files as archive chunks. A file is a chunk and is read as one value, so files have to be of bounded size (a
    usual crawl's are about 1 GB; above 2 GB Spark refuses them)."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("archive"), F.lit(0).cast("long").alias("chunk"), F.col("content").alias("data"))


def page_catalogue(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` in the shared folder, read it back, and list its records by page. Nulls, repeated rows and
    empty tables as ``write_warc``; columns beyond ``page_id``, ``url`` and ``html`` are ignored."""
    from tidemark.llm._common import materialize

    back = read_warc(materialize(write_warc(pages), "warc"))
    kind = pages.schema["page_id"].dataType
    return back.filter("kind = 'record'").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
