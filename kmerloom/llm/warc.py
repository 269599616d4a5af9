"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

Archives are gzip files with one member per record, written by Spark's text writer to any file
system Spark knows. The writer ends every row with a separator; this is one zero byte here, which
is the last byte of every gzip member of less than 16 MiB, so it is taken off the member first. A
longer member keeps its last byte, and the separator is the zero padding that gzip readers skip.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tables import whole
from kmerloom.plans.runtime import scratch_folder

VERSION, MAGIC = b"WARC/1.1", b"\x1f\x8b\x08"
_NUMBER = re.compile(rb"[0-9]+\Z")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Uncompressed bytes an archive holds on average.
ARCHIVE_BYTES = 32 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as WARC text: a response, or a revisit without payload where ``refers_to`` is given."""
    body = b"" if refers_to is not None else payload
    named = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(body)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        named += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    named.append(("Content-Length", str(len(body))))
    head = "".join(f"{k}: {v}\r\n" for k, v in named).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packed = gzip.compress(record, compresslevel=4, mtime=0)
    return packed[:-1] if packed[-1] == 0 else packed


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = zip(pages["page_id"], pages["url"], pages["html"], pages["refers_to"], strict=True)
        number = lambda x: None if pd.isna(x) else int(x)
        yield pd.DataFrame({"value": [_member(encode(number(p), u, h.encode("utf-8", "surrogatepass"), number(r))) for p, u, h, r in rows]})


def first_copies(pages: DataFrame) -> DataFrame:
    """``(page_id, k, refers_to)`` of every distinct page: of equal payloads the largest page_id is the response.

    k is the payload's SHA-256 name. Payloads do not move: only names and ids do, and each name's
    largest id is found by partial aggregation, so a payload that a third of all pages share is no hot task.
    """
    named = pages.select("page_id", F.sha2(whole("html").cast("binary"), 256).alias("k")).distinct()
    top = named.groupBy("k").agg(F.max("page_id").alias("top"))
    return named.join(top, "k").select("page_id", "k", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages(page_id, url, html)``; null html is an empty payload.

    Repeated rows are written as often as they come, all of the same type. Pages without page_id are
    responses unless another page has their payload and an id; they then stay responses, too.
    """
    size = pages.agg(F.avg(F.octet_length(whole("html")))).first()[0] or 0.0
    plan = first_copies(pages).withColumnRenamed("page_id", "id")
    held = pages.select("page_id", "url", whole("html").alias("html")).withColumn("h", F.sha2(F.col("html").cast("binary"), 256))
    joined = held.join(plan, held.page_id.eqNullSafe(plan.id) & (held.h == plan.k)).select("page_id", "url", "html", "refers_to")
    records = joined.mapInPandas(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    per_file = max(1, int(archive_bytes / (size + 600)))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)


#: Digest algorithms that WARC files name, and the functions behind them.
_ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}


def _agrees(stated: bytes, body: bytes) -> bool | None:
    """Whether the body has the stated digest; None if there is none, or one of an unknown algorithm or spelling."""
    name, _, value = stated.decode("latin-1").partition(":")
    algorithm = _ALGORITHMS.get(name.strip().lower())
    if algorithm is None:
        return None
    own, value = hashlib.new(algorithm, body).digest(), value.strip()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    if len(value.rstrip("=")) == -(-8 * len(own) // 5):
        return value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")
    return None


def _record(data: bytes, at: int, sure: bool = False) -> tuple[dict, int] | None:
    """The record whose version line starts at ``at`` and its end, or None if anything about it fails.

    With ``sure`` only a record whose block digest agrees will do, else also one whose digest cannot be checked.
    """
    if not _LINE.match(data, at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip()
    length = head.get(b"content-length", b"")
    end = stop + 4 + int(length) if _NUMBER.match(length) else -1
    if end < 0 or data[end : end + 4] != b"\r\n\r\n":
        return None
    body = data[stop + 4 : end]
    agrees = _agrees(head.get(b"warc-block-digest", b""), body)
    if agrees is False or sure and not agrees:
        return None
    return {"head": head, "body": body}, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member that starts at ``at`` inflates to, where it ends, and whether its own checks hold.

    Of a damaged or cut member it is what was inflated before the fault.
    """
    unpack, view, parts = zlib.decompressobj(31), memoryview(data), []
    while not unpack.eof and at < len(data):
        piece, before = view[at : at + 16384], unpack.copy()
        at += len(piece)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            parts.append(_up_to_fault(before, piece))
            return b"".join(parts), at, False
    return b"".join(parts), at - len(unpack.unused_data), unpack.eof


def _up_to_fault(unpack, piece: memoryview) -> bytes:
    """What a piece that fails inflates to, byte by byte, before it fails."""
    out = []
    try:
        for i in range(len(piece)):
            out.append(unpack.decompress(piece[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _inside(inner: bytes, sure: bool) -> tuple[list[dict], list[tuple[int, int]]]:
    """The valid records in what a member inflates to, and the (place, length) of what lies between them."""
    found, gaps, place, gap = [], [], 0, None
    while place < len(inner):
        one = _record(inner, place, sure)
        if one:
            if gap is not None:
                gaps.append((gap, place - gap))
                gap = None
            found.append(one[0])
            place = one[1]
        else:
            gap = place if gap is None else gap
            place = inner.find(b"WARC/1.", place + 1)
            place = len(inner) if place < 0 else place
    if gap is not None:
        gaps.append((gap, len(inner) - gap))
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None]]:
    """Read an archive, plain or of gzip members: ``(kind, offset, length, record)``, kind record or gap.

    After a failed check the bytes are searched for the next place where a valid member or
    record starts; the bytes before it are one gap. Inside a member the search goes on at the next version line, so
    its other records are kept; what lies between them is a gap of the member's bytes, whose last entry tells place
    and length in the inflated bytes. Of a damaged or cut member the records before the fault are kept if their block
    digests agree and more follows them, and its bytes are part of a gap, too. Zero padding between members is no gap.
    """
    at, gap, size = 0, None, len(data)
    held: list[tuple[int, dict]] = []  # records of damaged members in the open gap
    while at < size:
        found, holes, end = [], [], at
        if data.startswith(MAGIC, at):
            inner, end, sound = _inflate(data, at)
            found, holes = _inside(inner, not sound)
            if not sound:
                # nothing vouches for a record that runs up to the fault
                ends_there = not holes or sum(holes[-1]) < len(inner)
                held += [(at, record) for record in (found[:-1] if ends_there else found)]
                found, holes = [], []
        elif one := _record(data, at):
            found, end = [one[0]], one[1]
        elif gap is None and data[at] == 0:
            at += 1
            continue
        if found:
            if gap is not None:
                yield from (("record", start, at - start, record) for start, record in held)
                yield "gap", gap, at - gap, None
                gap, held = None, []
            for record in found:
                yield "record", at, end - at, record
            for place, length in holes:
                yield "gap", at, end - at, {"place": place, "length": length}
            at = end
        else:
            gap = at if gap is None else gap
            nexts = [p for p in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if p >= 0]
            at = min(nexts, default=size)
    if gap is not None:
        yield from (("record", start, size - start, record) for start, record in held)
        yield "gap", gap, size - gap, None


def _id(value: bytes | None) -> int | None:
    got = re.match(rb"<urn:page:(-?[0-9]+)>\Z", value or b"")
    return int(got[1]) if got else None


READ = (
    "archive string, kind string, offset long, length long, page_id long, url string, record_type string,"
    " payload_bytes long, payload_digest string, refers_to long, payload binary, inner long, inner_length long"
)


def _read(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    for files in batches:
        for path, content in zip(files["path"], files["content"], strict=True):
            rows, held = [], 0
            for kind, offset, length, told in salvage(content):
                record, hole = (told, {}) if kind == "record" else (None, told or {})
                head = record["head"] if record else {}
                stated = head.get(b"x-payload-length", b"")
                rows.append((
                    path, kind, offset, length, _id(head.get(b"warc-record-id")), head.get(b"warc-target-uri", b"").decode("utf-8", "replace") if record else None,
                    head[b"warc-type"].decode("latin-1") if b"warc-type" in head else None, int(stated) if _NUMBER.match(stated) else None,
                    head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:") or None, _id(head.get(b"warc-refers-to")), record["body"] if record and payloads else None,
                    hole.get("place"), hole.get("length"),
                ))
                held += len(record["body"]) if record and payloads else 0
                if len(rows) >= 4096 or held > 16 << 20:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[part.split()[0] for part in READ.split(",")])
    for name in ("page_id", "payload_bytes", "refers_to", "inner", "inner_length"):
        out[name] = pd.array([None if pd.isna(x) else x for x in out[name].astype(object)], dtype="Int64")
    return out


def read_archives(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives in a folder; one row each, gaps with offset and length, those inside a
    gzip member also with place and length in its inflated bytes (inner, inner_length)."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(lambda it: _read(it, payloads), READ)


def query(pages: DataFrame) -> DataFrame:
    """Write all pages as archives to the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = f"{scratch_folder(spark).rstrip('/')}/kmerloom-warc/{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = read_archives(spark, folder, payloads=False).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 of a SHA-1: five hexadecimal digits are 20 bits, four letters.
SQL = """
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, n, max(page_id) AS top FROM h GROUP BY x, n),
j AS (SELECT page_id, h.n, h.x, top FROM h JOIN m ON m.x = h.x AND m.n = h.n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM j
"""
