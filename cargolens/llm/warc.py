"""WARC archives: records written with segments and chunked framing, read back and reassembled.

Writing: a page becomes a response or, when a page with a larger id has an
equal payload, a revisit that refers to it. A response block is an HTTP message
whose body is the payload in chunked framing. A block beyond SEGMENT bytes is
cut: the first segment keeps the record's type, continuation records follow,
each naming the first one's id and its own segment number, the last one the
total length. Records, as bytes, are dealt over files by Spark's text writer.

Reading: Spark lists the files, each task parses whole records by their
Content-Length. Segments are grouped by origin id, a bounded aggregate of one
record, put in order of their numbers, their lengths checked against the total,
and the body is freed of its framing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from cargolens.llm.common import fresh_path, narrow_batches, written

#: Bytes of a block's segment, of a chunk in the framing, and records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 16 * 1024, 4096, 2000
CRLF = b"\r\n"
VERSION = b"WARC/1.1"
#: Ends every record; the text writer puts it between and after its lines.
RECORD_END = "\r\n\r\n"
EPOCH = b"1970-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError when the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size without end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message: the body, freed of chunked framing where its header names it."""
    head, found, body = block.partition(CRLF + CRLF)
    if not found:
        raise ValueError("HTTP message without end of its header")
    fields = _fields(head.split(CRLF)[1:])
    return unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> bytes:
    """The same id for the same key, so that a task run again writes the same record."""
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, key)).encode()


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without the two line ends behind its block, which the writer adds."""
    head = [VERSION, *(a + b": " + b for a, b in fields), b"Content-Length: %d" % len(block)]
    return CRLF.join(head) + CRLF + CRLF + block


def _clean(value: str | None) -> bytes:
    return b"" if value is None else value.replace("\r", " ").replace("\n", " ").encode("utf-8", "surrogatepass")


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit alone, or a response in one segment or more."""
    sha = digest(payload)
    key = f"page:{page_id}:{sha}" if page_id is not None else f"page::{sha}:{url}"
    own = record_id(key)
    fields = [(b"WARC-Record-ID", own), (b"WARC-Date", EPOCH), (b"WARC-Target-URI", _clean(url)), (b"WARC-Payload-Digest", b"sha1:" + sha.encode()), (b"WARC-Payload-Length", b"%d" % len(payload)), (b"Content-Type", b"application/http;msgtype=response")]
    if page_id is not None:
        fields.append((b"WARC-Page-ID", b"%d" % page_id))
    if refers_to is not None:
        more = [(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To", record_id(f"page:{refers_to}:{sha}")), (b"WARC-Refers-To-Page-ID", b"%d" % refers_to)]
        return [_record([(b"WARC-Type", b"revisit"), *fields, *more], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    number = [(b"WARC-Segment-Number", b"1")] if len(parts) > 1 else []
    out = [_record([(b"WARC-Type", b"response"), *fields, *number], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [(b"WARC-Segment-Origin-ID", own), (b"WARC-Segment-Number", b"%d" % n)]
        if n == len(parts):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", record_id(f"{key}:{n}")), (b"WARC-Date", EPOCH), *more], part))
    return out


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest page_id of an equal payload of at least `least` bytes, null on that page itself.

    A null html is the empty payload; a row without page_id refers to nothing
    and nothing refers to it. Equal means equal in SHA-1 and length.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.where("page_id is not null").select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("size"))
    again = slim.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
    again = written(again.where("last <> first").select("sha", "size", "last"), "payloads")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    joined = rows.join(again, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """(page_id, url, payload, refers_to) as archive files below path, FILE_RECORDS records each at most."""

    def lines(batches):
        for batch in batches:
            page, url, payload, refers = (batch.column(i).to_pylist() for i in range(4))
            for i in range(0, len(page), 64):
                found = [r for k in range(i, min(i + 64, len(page))) for r in records(page[k], url[k], payload[k], refers[k], segment)]
                yield pa.record_batch({"record": pa.array(found, pa.binary())})

    rows = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(lines, "record binary")
    # the cast keeps the bytes as they are, and the text writer puts them out unchanged
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one file, gzip or plain, by Content-Length; ValueError when a record is cut short."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            one = zlib.decompressobj(31)
            plain += [one.decompress(data), one.flush()]
            data = one.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record header at byte {at}")
        fields = _fields(data[at:end].split(CRLF)[1:])
        start, size = end + 4, int(fields["content-length"])
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[start : start + size]
        at = start + size + 4


SEGMENTS = "origin string, number int, cut boolean, type string, page_id long, refers_to long, digest string, payload_length long, total long, block binary"
_KINDS = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
#: Bytes of blocks that a task hands on together.
HELD = 8 << 20


def _segment(f: dict[str, str], block: bytes) -> tuple:
    whole = lambda name: int(f[name]) if name in f else None
    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
    claimed = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (origin, whole("warc-segment-number") or 1, "warc-segment-number" in f, f["warc-type"], whole("warc-page-id"), whole("warc-refers-to-page-id"), claimed, whole("warc-payload-length"), whole("warc-segment-total-length"), block)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below path; origin names the record that a segment belongs to."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for fields, block in parsed(content.as_py()):
                    held.append(_segment(fields, block))
                    size += len(block)
                    if size > HELD:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(rows, SEGMENTS)


OPENED = StructType([StructField("payload", BinaryType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("fault", StringType())])


def _payload(kind: str | None, parts: list[tuple[int, bytes]], cut: bool, total: int | None, length: int | None, claimed: str | None) -> tuple:
    """payload, its length, its digest and what is wrong."""
    if kind is None:
        return None, None, None, "first segment missing"
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        return None, None, None, "segment missing or repeated"
    block = b"".join(b for _, b in parts)
    if cut and total != len(block):
        return None, None, None, "segments differ from the total length"
    if kind != "response":
        return None, length, claimed, None
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, None, str(e)
    found = digest(payload)
    if (claimed, length) not in ((found, len(payload)), (None, None)):
        return None, None, None, "payload differs from its digest or length"
    return payload, len(payload), found, None


@F.pandas_udf(OPENED)
def opened(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for kind, parts, cut, total, length, claimed in rows.itertuples(index=False):
        ordered = [(p["number"], p["block"]) for p in parts]
        out.append(_payload(kind, ordered, bool(cut), None if pd.isna(total) else int(total), None if pd.isna(length) else int(length), claimed))
    found = pd.DataFrame(out, columns=OPENED.names, index=rows.index)
    return found.astype({"payload_bytes": "Int64"})


def reassembled(segments: DataFrame) -> DataFrame:
    """(origin, type, page_id, refers_to, payload, payload_bytes, payload_digest, fault) of every record.

    Records in several segments are grouped by origin, whatever files the
    segments lie in, and count once if they were written twice; only they are
    shuffled. fault says what is wrong: a segment that is missing or repeated
    with other bytes, a total length that the segments don't have, broken
    framing, a payload that differs from its digest; the payload is then null.
    A revisit has no payload, its length and digest are those it names. An
    empty folder gives an empty result.
    """
    part = F.struct("number", "block")
    first = F.col("number") == 1
    alone = segments.where("not cut").withColumn("parts", F.array(part)).select("origin", "type", "page_id", "refers_to", "digest", "payload_length", "total", "cut", "parts")
    joined = (
        segments.where("cut")
        .groupBy("origin")
        .agg(
            *(F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest", "payload_length")),
            F.max("total").alias("total"),
            F.lit(True).alias("cut"),
            F.array_sort(F.collect_set(part)).alias("parts"),
        )
    )
    both = alone.unionByName(joined)
    found = both.withColumn("r", opened(F.struct("type", "parts", "cut", "total", F.col("payload_length").alias("length"), F.col("digest").alias("claimed"))))
    return found.select("origin", "type", "page_id", "refers_to", "r.*")


#: Rows that one value makes at a time where a row is given back as often as it came.
BACK_AT_ONCE = 100_000


@F.pandas_udf(StringType())
def _digest_of(sha: pd.Series) -> pd.Series:
    return sha.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode("ascii"))


def repeated(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, times) of the pages that come several times with one payload; page_id may be null."""
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    found = pages.select("page_id", sha.alias("sha")).groupBy("page_id", "sha").agg(F.count("*").alias("times")).where("times > 1")
    return found.select(F.col("page_id").alias("again_id"), _digest_of("sha").alias("again"), "times")


def archived(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, fault) of every page, as read back from the archives written below path.

    Without a path the archives go to a fresh folder among the shared ones.
    Pages that repeat an id and a payload, whatever their url, are read back as
    one record and give a row each; a page without id is a response without id.
    Only page_id, url and html are looked at. An empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    narrow_batches(spark)
    path = path or fresh_path(spark, "warc")
    write(revisits(pages, least), path)
    found = reassembled(read_segments(spark, path))
    found = found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "fault").distinct()
    again = written(repeated(pages), "repeated-pages")
    same = found["page_id"].eqNullSafe(again["again_id"]) & (found["payload_digest"] == again["again"])
    back = found.join(again, same, "left").withColumn("times", F.coalesce("times", F.lit(1)))
    back = back.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / BACK_AT_ONCE))))
    most = F.least(F.lit(BACK_AT_ONCE).cast("long"), F.col("times") - F.col("turn") * BACK_AT_ONCE)
    return back.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), most))).select(*found.columns)
