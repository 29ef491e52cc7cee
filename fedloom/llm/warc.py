"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

The reader checks each record (member inflates, version line, header lines, Content-Length, end of record,
payload digest). After a failed check it searches for the next valid gzip member or version line, goes on
from there, and logs the bytes between as a quarantined gap.

Archives are rows of a table (archive, content) in the shared folder: whole files of a few MB, so that any
executor can write and read them and a lost one costs only its own archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import work_table

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
END = b"\r\n\r\n"
ARCHIVE_BYTES = 4 << 20
SALTS = 32
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(raw: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _clean(value: str) -> str:
    """A header value can't hold line ends."""
    return re.sub(r"[\r\n]+", " ", value)


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit without payload that names the response's page and the payload's size."""
    headers = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return record("response", headers, payload)
    return record("revisit", [*headers, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))], b"")


def _inflate(raw: bytes, at: int) -> tuple[bytes, int] | None:
    """A whole gzip member's bytes and the offset behind it; None if it is damaged or breaks off.

    It is fed pieces that double in length, so the work goes with the member's size, whatever follows it.
    """
    z, view, parts, size = zlib.decompressobj(31), memoryview(raw), [], 1 << 12
    try:
        while not z.eof and at < len(raw):
            parts.append(z.decompress(view[at : at + size]))
            at, size = min(at + size, len(raw)), min(2 * size, 1 << 20)
    except zlib.error:
        return None
    return (b"".join(parts), at - len(z.unused_data)) if z.eof else None


def parse(raw: bytes, at: int = 0, end: int | None = None) -> tuple[dict[str, str], bytes, int] | str:
    """Headers (lower-case names), block and the offset behind the record at this offset, or what is wrong. end: where its headers end, if that is known, -1 if nowhere."""
    m = VERSION.match(raw, at)
    if not m:
        return "no version line"
    end = raw.find(END, m.end() - 2) if end is None else end
    if end < 0:
        return "headers break off"
    headers: dict[str, str] = {}
    place = m.end()
    # line by line: a version line within the headers of another ends them at once
    while place < end:
        stop = raw.find(b"\r\n", place, end)
        stop = end if stop < 0 else stop
        line, place = raw[place:stop], stop + 2
        if not line:
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header has no colon"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no Content-Length"
    start = end + 4
    stop = start + int(size)
    if stop > len(raw):
        return "block breaks off"
    if raw[stop : stop + 4] != END:
        return "no end of record behind the block"
    block = raw[start:stop]
    claimed = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and claimed.startswith("sha1:") and claimed[5:] != digest32(block):
        return "payload digest differs"
    return headers, block, stop + 4


def salvage(raw: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, b"") in order; together they cover all bytes.

    Headers may have any length. What was looked for (a member, a version line, an end of headers) is remembered until
    it is passed, so the work goes with the number of bytes.
    """
    at, gap, why, n = 0, -1, "", len(raw)
    # the next member and the next version line; looked for again only once they are passed
    member = line = ending = -1
    while at < n:
        found: tuple[dict[str, str], bytes, int] | str
        if raw.startswith(MAGIC, at):
            inflated = _inflate(raw, at)
            if inflated is None:
                found = "damaged gzip member"
            else:
                found = parse(inflated[0])
                if not isinstance(found, str):
                    found = (found[0], found[1], inflated[1]) if found[2] == len(inflated[0]) else "bytes behind the record in its member"
        else:
            if ending < at and ending < n:
                ending = raw.find(END, at)
                ending = n if ending < 0 else ending
            m = VERSION.match(raw, at)
            # a version line's own line end may begin the end of empty headers
            found = parse(raw, at, (ending if ending < n else -1) if m and ending >= m.end() - 2 else None) if m else "no version line"
        if isinstance(found, str):
            if gap < 0:
                gap, why = at, found
            if member <= at:
                member = raw.find(MAGIC, at + 1)
                member = n if member < 0 else member
            if line <= at:
                m = VERSION.search(raw, at + 1)
                line = m.start() if m else n
            at = min(member, line)
            continue
        if gap >= 0:
            yield "gap", gap, at - gap, why, b""
            gap = -1
        headers, block, stop = found
        yield "record", at, stop - at, headers, block
        at = stop
    if gap >= 0:
        yield "gap", gap, n - gap, why, b""


def write_archives(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all rows as a table (archive, content) in the shared folder.

    Of rows whose payloads (null: empty) of at least min_bytes are equal, those with the largest id are
    responses, all others revisit it; a null id is smaller than any; if all ids are null, all are responses.
    Repeated rows make repeated records. The largest id of each digest is pre-aggregated before the shuffle
    and joined back where it stands for several rows, in SALTS copies: a payload that a third of all rows share is
    dealt to many tasks by id and address.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url}`").alias("url") if url in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    newest = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    newest = newest.select(F.col("digest").alias("of"), "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(newest, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    refers = F.when(F.col("newest").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("newest"))), F.col("newest"))
    records = joined.select("id", "url", "payload", "digest", refers.alias("refers"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = number = 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            ids, urls, digests, refer = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for k, i in enumerate(ids):
                body = batch.column(2)[k].as_py().encode()
                held.append(member(page_record(i, urls[k], body, base64.b32encode(digests[k]).decode(), refer[k])))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held.clear()
                    size, number = 0, number + 1
        if held:
            yield archive()

    return work_table(spark, records.mapInArrow(run, "archive string, content binary"), "warc", codec="none")


RECORDS = "archive string, offset bigint, length bigint, gap string, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap (gap: the reason, else null) of a table (archive, content).

    Content may be plain or of gzip members, whole or damaged; null content has no rows. payload_bytes is
    the full payload's size, of revisits as their record states it.
    """
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def rows(name, raw):
        for kind, at, size, headers, block in salvage(raw):
            if kind == "gap":
                yield (name, at, size, headers, *[None] * 7)
                continue
            what = headers.get("warc-type")
            length = int(headers.get("x-payload-length", len(block))) if what == "revisit" else len(block)
            yield (name, at, size, None, what, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, length, headers.get("warc-refers-to"), block if with_payload else None)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                held: list[tuple] = []
                for r in rows(batch.column(0)[k].as_py(), raw or b""):
                    held.append(r)
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def page_records(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to. A gap in them is an error."""
    read = read_archives(write_archives(spark, pages, min_bytes=min_bytes), with_payload=False)
    gap = F.raise_error(F.concat(F.lit("a gap in "), "archive", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "gap")).cast("boolean")
    read = read.where(F.when(F.col("gap").isNull(), F.lit(True)).otherwise(gap))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
