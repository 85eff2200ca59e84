"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import NULL_ID, as_bytes, id_column, prepare, stash, tidy

MAGIC = b"\x1f\x8b\x08"
#: A complete gzip member of nothing. Every member ends with a zero byte when it is under 16 MiB, as this one does.
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def encode_record(kind: str, record_id: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record; a revisit has no payload of its own but says how long it is and where it is."""
    http = HTTP + b"Content-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    safe = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {size}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """The record as a gzip member that ends with a zero byte."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + NOTHING


def _agrees(said: str, data: bytes) -> bool | None:
    """Whether a digest header, its value in hexadecimal or base 32, is that of the data; None of an algorithm not computed here."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if not value or name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    own = hashlib.new(name, data, usedforsecurity=False).digest()
    value = value.strip().lower().rstrip("=")
    return value in (own.hex(), base64.b32encode(own).decode().lower().rstrip("="))


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and the offset after the record that begins at `at`. Raises Damaged where a check fails."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    heads: dict[str, str] = {}
    last = None
    for line in data[at:end].split(b"\r\n")[1:]:
        if last is not None and line[:1] in (b" ", b"\t"):  # a folded line goes on with the value before it
            heads[last] = f"{heads[last]} {line.strip().decode('latin-1')}"
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        last = name.strip().lower().decode("latin-1")
        heads[last] = value.strip().decode("latin-1")
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date") if h not in heads]:
        raise Damaged(f"no {missing[0]}")
    if not heads.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start, size = end + 4, int(heads["content-length"])
    block = data[start : start + size]
    if len(block) < size:
        raise Damaged("block is cut short")
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    if _agrees(heads.get("warc-block-digest", ""), block) is False:
        raise Damaged("block digest differs")
    return heads, block, start + size + 4


def _unzip(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int | None, str]:
    """The contents of the member at an offset and the offset behind it; of a damaged one what comes before the damage, None, and the reason."""
    z, view, out, k = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not z.eof and k < len(data):
            part = view[k : k + step]
            out.append(z.decompress(part))
            k += len(part)
    except zlib.error as e:
        return b"".join(out) + _until_error(data, at, k), None, f"member: {e}"
    if not z.eof:
        return b"".join(out), None, "member is cut short"
    return b"".join(out), k - len(z.unused_data), ""


def _until_error(data: bytes, at: int, k: int) -> bytes:
    """What a damaged member holds between an offset up to which it reads well and the byte that fails."""
    z, out = zlib.decompressobj(31), []
    view = memoryview(data)
    for j in range(at, k, 1 << 16):
        z.decompress(view[j : min(j + (1 << 16), k)])
    try:
        for j in range(k, len(data)):
            out.append(z.decompress(view[j : j + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _plain(data: bytes, at: int = 0) -> Iterator[tuple[str, int, int, object]]:
    """('record', offset, length, (headers, block)) and ('gap', offset, length, reason) of uncompressed records, in order, covering all bytes."""
    gap, why = None, ""
    while at < len(data):
        try:
            heads, block, end = parse_record(data, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            m = VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why
            gap = None
        yield "record", at, end - at, (heads, block)
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, int | None]]:
    """('record', offset, length, (headers, block), inner) and ('gap', offset, length, reason, inner), in order.

    After a failed check the search goes on byte by byte for the next member or version line that reads without a
    failure; what lies between is one quarantined gap. A member's records are read on in the same way from its
    contents: a damaged one of them is a gap of its own, and `inner` says where in the contents each begins. Offset and
    length are the member's then. Records before the damage of a member that breaks off are recovered; their length is
    0, since the member's end is not known, and they follow the gap. All else covers all bytes of the archive.
    """
    at, gap, why = 0, None, ""
    rescued: list[tuple] = []
    marks = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")
    while at < len(data):
        got: list[tuple] = []
        if data.startswith(MAGIC, at):
            plain, end, reason = _unzip(data, at)
            inside = list(_plain(plain))
            if end is None:
                rescued += [("record", at, 0, x, k) for kind, k, _, x in inside if kind == "record"]
            elif inside and all(kind == "gap" for kind, *_ in inside):
                end, reason = None, str(inside[0][3])
            elif len(inside) == 1:
                got = [("record", at, end - at, inside[0][3], None)]
            else:
                got = [(kind, at, end - at, x, k) for kind, k, _, x in inside]
        else:
            try:
                heads, block, end = parse_record(data, at)
                got = [("record", at, end - at, (heads, block), None)]
            except Damaged as e:
                end, reason = None, str(e)
        if end is None:
            if gap is None:
                gap, why = at, reason
            m = marks.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why, None
            yield from rescued
            gap, rescued = None, []
        yield from got
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, None
        yield from rescued


def _is_http(heads: dict, block: bytes) -> bool:
    kind = heads.get("content-type")
    return block.startswith(b"HTTP/") if kind is None else kind.lower().startswith("application/http")


def _body(heads: dict, block: bytes) -> bytes:
    """The block, without the HTTP headers if it is an HTTP message."""
    if not _is_http(heads, block):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


def _unchunk(body: bytes) -> bytes:
    out, k = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, k):
        n = int(m[1], 16)
        out.append(body[m.end() : m.end() + n])
        k = m.end() + n + 2
    return b"".join(out)


def _differs(heads: dict, block: bytes, body: bytes) -> bool:
    """Whether the payload digest is not that of the payload. Of a chunked message it may be that of the joined chunks; a segment's is that of the whole."""
    said = heads.get("warc-payload-digest", "")
    if heads.get("warc-type") in ("revisit", "continuation") or "warc-segment-number" in heads or _agrees(said, body) is not False:
        return False
    chunked = _is_http(heads, block) and re.search(rb"\r\ntransfer-encoding:[^\r\n]*chunked", block[: len(block) - len(body)], re.IGNORECASE)
    return not (chunked and _agrees(said, _unchunk(body)))


def _payload(heads: dict, body: bytes) -> tuple[int | None, str | None]:
    """Size and SHA-256 of the full payload; a revisit's are what its headers say of it, null if they do not."""
    if heads.get("warc-type") == "revisit":
        size = heads.get("x-payload-length", "")
        return int(size) if size.isdigit() else None, heads.get("warc-payload-digest", "").partition(":")[2] or None
    return len(body), hashlib.sha256(body).hexdigest()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, file_bytes: int = 64 << 20) -> None:
    """Write one record per row to gzipped archives below `path`, one member per record.

    Of rows with equal payloads of at least `least` bytes that with the smallest id is a response and the others
    revisit it; smaller payloads are all responses. Null payloads are empty, null URLs too; a null id orders first.
    Rows that repeat the response's id and payload are responses too. An empty table writes no record.

    Payload digests are made in a first scan; only ids and digests are shuffled. In the second scan the revisits' ids
    come by a join on the id. Files are bounded by `file_bytes` as far as mean and largest payload let it be known.
    """
    spark = pages.sparkSession
    prepare(spark)

    def digests(batches):
        for b in batches:
            raw = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], ["page", "digest", "size"])

    rows = pages.select(id_column(id_col).alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(payload_col).cast("string").alias("payload"))
    ids = stash(rows.select("page", "payload").mapInArrow(tidy(digests), "page long, digest binary, size long"), "payloads")
    first = ids.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = stash(ids.join(first, "digest").filter("page <> first").select("page", "digest", "first").distinct(), "revisits")
    mean, most = ids.agg(F.avg("size"), F.max("size")).first()
    per_file = max(1, min(int(file_bytes / ((mean or 0) + 1024)), int(16 * file_bytes / ((most or 0) + 1024))))

    def records(batches):
        for b in batches:
            out = []
            for page, url, raw, digest, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                own = hashlib.sha256(raw).digest()
                revisit = to is not None and own in digest
                to = to[digest.index(own)] if revisit else None
                name = lambda p: "null" if p == NULL_ID else str(p)
                out.append(member(encode_record("revisit" if revisit else "response", name(page), url, raw, own.hex(), len(raw), name(to) if revisit else None))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    known = revisits.groupBy("page").agg(F.collect_list(F.struct("digest", "first")).alias("r")).select("page", F.col("r.digest").alias("digest"), F.col("r.first").alias("first"))
    made = rows.join(known, "page", "left").select("page", "url", "payload", "digest", "first").mapInArrow(tidy(records), "record binary")
    # the writer ends each row with the separator, which is the last byte of each member
    made.select(F.col("record").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


RECORDS = "path string, offset long, length long, inner long, kind string, reason string, record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records and quarantined gaps of the archives below `path`, gzipped or plain.

    kind is 'record' or 'gap'; a gap has the reason of the first check that failed. A record whose payload is not the
    one its digest says (MD5, SHA-1, SHA-256 or SHA-512) is quarantined too. Only HTTP messages lose their headers. `inner` is
    where in a member of several records one begins. `payloads` adds the bytes of responses. An empty folder has no
    rows. An archive is read by one task as one value, so it must be under 2 GB; write_warc bounds its own.
    """
    prepare(spark)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for kind, at, n, x, inner in salvage(data):
                    if kind == "record":
                        heads, block = x
                        body = _body(heads, block)
                        size, digest = _payload(heads, body)
                        if _differs(heads, block, body):
                            kind, x = "gap", "payload digest differs"
                    if kind == "gap":
                        rows.append((name, at, n, inner, "gap", x, None, None, None, None, None, None, None))
                    else:
                        bare = lambda k: None if (v := heads.get(k)) is None else re.sub(r"^<urn:page:|>$", "", v)  # noqa: E731, B023
                        rows.append((name, at, n, inner, "record", None, bare("warc-record-id"), heads.get("warc-type"), heads.get("warc-target-uri"), size, digest, bare("warc-refers-to"), body if payloads and heads.get("warc-type") == "response" else None))
                    if len(rows) >= 1000:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(tidy(run), RECORDS + ", payload binary")
    return out if payloads else out.drop("payload")


def _records(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    import uuid

    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path)
