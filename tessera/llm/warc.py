"""WARC archives of pages: a writer with revisit records and a salvage reader.

The writer is a projection: header fields and payload are concatenated and
Spark's text sink writes one record per row, its line separator being the last
CRLF of a record. Payloads that occur more than once (by SHA-1, from
`least_bytes` on) are stored once, with the row of the largest page_id; the
others become revisit records.

The reader checks version line, header, length, record end and block digest.
After a failed check it searches for the next version line or gzip member that
passes, and logs the bytes in between as a quarantined gap. Members are unpacked
as a stream: what is held is one record, and the records before a member's damage
are kept. Files come as rows of Spark's binaryFile source, which takes up to 2 GB
each; the writer bounds its own by `file_bytes`. (A damaged length inside a
member of many records can make the reader hold the rest of that member.)

Defined cases: a null payload is empty, a null url is written empty, a null
page_id is written empty and read as null and counts as the smallest; urls and
headers may be of any length; payloads of `least_bytes` and more take part in
revisits, shorter ones never; rows equal in id and payload become equal records;
an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .support import release, small_batches, staged

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEAST_BYTES = 1000
RECORDS_PER_FILE, FILE_BYTES = 4000, 64 << 20
#: A page of more bytes is written apart, with fewer to a file.
LARGE_BYTES = 8 << 20
#: What a header takes besides two urls' bytes, at most.
HEADER_BYTES = 2048
#: Bytes that are unpacked from a member at a time.
UNPACK_BYTES = 1 << 20


# ---------------------------------------------------------------- writing


def record_uri(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    Ids and digests meet in the group-by and the first join. A Bloom filter of
    the revisits' keys of fixed size then lets all other rows pass where they
    are: only what it holds (revisits, and the few rows it mistakes for them) is
    shuffled with its payload to the exact join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    keys = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    largest = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    named = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisits = keys.join(largest, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(named.alias("_id"), "digest", "refers_to").distinct()
    revisits = staged(revisits, "revisits")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield np.array(batch.column(0)).view(np.uint64)

    held = pages.sparkSession.sparkContext.broadcast(bloom.build(revisits.select(F.xxhash64("_id", "digest")), hashes, "once", log_bits))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(held.value.test(key.to_numpy(np.int64).view(np.uint64)))

    flagged = rows.withColumn("_id", named).withColumn("_maybe", maybe(F.xxhash64("_id", "digest")))
    passed = flagged.where(~F.col("_maybe")).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    met = flagged.where("_maybe").join(revisits, ["_id", "digest"], "left")
    columns = ["page_id", "url", "payload", "digest", "refers_to"]
    return passed.select(*columns).unionByName(met.select(*columns))


def records(pages: DataFrame, *, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One WARC record per row as a string column, without its last CRLF, and the page's bytes."""
    rows = with_revisits(pages, least_bytes)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    rows = rows.withColumn("block", F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "payload")))
    head = F.concat(
        F.lit(VERSION.decode()),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_uri(F.col("page_id"), F.col("digest"))),
        field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        field("WARC-Date", F.lit(date)),
        field("Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode("block", "UTF-8")))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", record_uri(F.col("refers_to"), F.col("digest"))))).otherwise(""),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    size = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0))
    return rows.select(F.concat(head, "block", F.lit("\r\n")).alias("value"), size.alias("size"))


def write_archives(pages: DataFrame, path: str, *, date: str = "2000-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Archives of at most `file_bytes`, or of one record; large pages are rare and go to files of their own."""
    small_batches(pages.sparkSession)
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0))
    sizes = pages.groupBy((size > LARGE_BYTES).alias("large")).agg(F.max(size).alias("most")).collect()
    rows = records(pages, date=date, least_bytes=least_bytes)
    mode = "overwrite"
    for part in sorted(sizes, key=lambda r: r["large"]):
        own = rows.where((F.col("size") > LARGE_BYTES) == F.lit(part["large"])).select("value")
        most = max(1, min(records_per_file, file_bytes // (HEADER_BYTES + part["most"])))
        own.write.option("lineSep", "\r\n").option("maxRecordsPerFile", most).mode(mode).text(path)
        mode = "append"
    if not sizes:
        rows.select("value").write.mode(mode).text(path)


# ---------------------------------------------------------------- reading


def _digest_matches(labelled: bytes, block: bytes) -> bool:
    name, _, value = labelled.strip().partition(b":")
    try:
        own = hashlib.new(name.decode("ascii").lower().replace("-", ""), block)
    except (ValueError, UnicodeDecodeError):
        return True  # an algorithm that is unknown here proves nothing
    return value.lower() == own.hexdigest().encode() or value.upper().rstrip(b"=") == base64.b32encode(own.digest()).rstrip(b"=")


#: The end of a header, or the next record that begins before it.
_HEADER_END = re.compile(rb"\r?\n\r?\n|\nWARC/1\.[01]\r?\n")


def parse_record(data: bytes | bytearray, at: int, whole: bool = True) -> tuple[dict[bytes, bytes], bytes, int] | str | int:
    """Header, block and end of the record at this place, or the check that fails; unless `data` is whole, how many bytes it must have to tell."""
    if not whole and len(data) - at < 16:
        return at + 16
    version = VERSION_LINE.match(data, at)
    if not version:
        return "no version line"
    blank = _HEADER_END.search(data, version.end() - 2)
    if not blank and not whole:
        return len(data) + max(1 << 16, (len(data) - at) // 2)
    if not blank or b"W" in blank.group():
        return "header does not end"
    header: dict[bytes, bytes] = {}
    name = b""
    for line in bytes(data[version.end() : blank.start()]).splitlines():
        if line[:1] in (b" ", b"\t") and name:
            header[name] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon:
            return "header line without a colon"
        header[name] = value.strip()
    if not header.get(b"content-length", b"").isdigit():
        return "no length"
    end = blank.end() + int(header[b"content-length"])
    if end + 4 > len(data) and not whole:
        return end + 4
    if end > len(data):
        return "block ends early"
    tail = re.compile(rb"(\r?\n){2}").match(data, end)
    if not tail and end != len(data):
        return "no record end"
    block = bytes(data[blank.end() : end])
    if b"warc-block-digest" in header and not _digest_matches(header[b"warc-block-digest"], block):
        return "block digest differs"
    return header, block, tail.end() if tail else end


class _Member:
    """A gzip member at a place of the data, unpacked piece by piece; then its end, or what failed."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end, self.failure = memoryview(data), at, len(data), ""

    def chunks(self) -> Iterator[bytes]:
        unpack, at = zlib.decompressobj(31), self.at
        rest: bytes | memoryview = b""
        try:
            while not unpack.eof:
                if not len(rest):
                    if at >= len(self.data):
                        self.failure = "gzip member ends early"
                        return
                    rest, at = self.data[at : at + (1 << 16)], min(at + (1 << 16), len(self.data))
                out = unpack.decompress(rest, UNPACK_BYTES)
                rest = unpack.unconsumed_tail
                if out:
                    yield out
        except zlib.error:
            self.failure = "gzip member is damaged"
            return
        self.end = at - len(unpack.unused_data)


def _streamed(chunks: Iterator[bytes]) -> Iterator[tuple[str, int, int, object, object]]:
    """Records and gaps of a stream, with their places in it; of a stream that breaks off, what was whole before."""
    data, base, at, bad_from, reason, whole = bytearray(), 0, 0, -1, "", False
    while True:
        found = parse_record(data, at, whole) if at < len(data) or not whole else None
        if isinstance(found, int):
            while len(data) < found and not whole:
                chunk = next(chunks, None)
                whole = chunk is None
                data += chunk or b""
            continue
        if found is None:
            break
        if isinstance(found, str):
            if bad_from < 0:
                bad_from, reason = base + at, found
            following = VERSION_LINE.search(data, at + 1)
            at = following.start() if following else len(data) if whole else max(at + 1, len(data) - 16)
        else:
            if bad_from >= 0:
                yield "gap", bad_from, base + at - bad_from, reason, None
                bad_from = -1
            header, block, end = found
            yield "record", base + at, end - at, header, block
            at = end
        if at > UNPACK_BYTES:
            del data[:at]
            base, at = base + at, 0
    if bad_from >= 0:
        yield "gap", bad_from, base + len(data) - bad_from, reason, None


_NEXT = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, object]]:
    """("record", offset, length, header, block) and ("gap", offset, length, reason, None), in file order.

    What lies in a gzip member has the member's offset and its own unpacked length.
    A member that breaks off gives the records before the damage, and is a gap up
    to the next record or member that passes.
    """
    at, bad_from, reason = 0, -1, ""
    while at < len(data):
        failure, end, kept = "", at, False
        if data.startswith(GZIP_MAGIC, at):
            member = _Member(data, at)
            for kind, inner, length, head, block in _streamed(member.chunks()):
                if kind == "gap" and member.failure:
                    continue  # the broken record at the member's end is part of the member's gap
                if kind == "record" or kept:
                    if bad_from >= 0:
                        yield "gap", bad_from, at - bad_from, reason, None
                        bad_from = -1
                    kept = kept or kind == "record"
                    yield kind, at, length, head, block
                else:
                    failure = failure or str(head)
            failure, end = member.failure or ("" if kept else failure), member.end
        else:
            found = parse_record(data, at)
            if isinstance(found, str):
                failure = found
            else:
                if bad_from >= 0:
                    yield "gap", bad_from, at - bad_from, reason, None
                    bad_from = -1
                header, block, end = found
                yield "record", at, end - at, header, block
        if failure:
            if bad_from < 0:
                bad_from, reason = at, failure
            following = _NEXT.search(data, at + 1)
            end = following.start() if following else len(data)
        at = end
    if bad_from >= 0:
        yield "gap", bad_from, len(data) - bad_from, reason, None


RECORDS = (
    "path string, kind string, offset long, length long, reason string, record_type string, record_id string, target_uri string, page_id string, "
    "refers_to string, stated_digest string, payload_bytes long, payload_digest string, payload binary"
)


def _payload(header: dict[bytes, bytes], block: bytes) -> bytes:
    if header.get(b"content-type", b"").lower().startswith(b"application/http"):
        _, blank, body = block.partition(b"\r\n\r\n")
        return body if blank else b""
    return block


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files below path. payload_* are of what the record itself holds."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    text = lambda header, key: header[key].decode("utf-8", "replace") if key in header else None
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("offset", "length", "payload_bytes") else pa.string()) for n in names])

    def row(file: str, kind: str, at: int, length: int, head, block) -> dict:
        out = {"path": file, "kind": kind, "offset": at, "length": length}
        if kind == "gap":
            return out | {"reason": head}
        body = _payload(head, block)
        out |= {"record_type": text(head, b"warc-type"), "record_id": text(head, b"warc-record-id"), "target_uri": text(head, b"warc-target-uri"), "page_id": text(head, b"page-id") or None}
        out |= {"refers_to": text(head, b"warc-refers-to"), "stated_digest": text(head, b"warc-payload-digest")}
        return out | {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "payload": body if payloads else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column(0)[i].as_py(), [], 0
                for found in salvage(batch.column(1)[i].as_py() or b""):
                    rows.append(row(file, *found))
                    held += found[2]
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def resolved(found: DataFrame) -> DataFrame:
    """Per record the full payload's size and digest: a revisit takes those of the response it refers to."""
    kept = found.where("kind = 'record'")
    responses = kept.where("record_type = 'response'").select(F.col("record_id").alias("_of"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")).dropDuplicates(["_of"])
    revisits = kept.where("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("_of"), "left")
    own = kept.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to")))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 1000 AND p.page_id IS DISTINCT FROM g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND p.page_id IS DISTINCT FROM g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
