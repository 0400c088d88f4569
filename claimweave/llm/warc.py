"""WARC archives: written by Spark's text sink, read back from bytes with segments reassembled.

Writing. A page becomes a ``response`` record: an HTTP/1.1 head and its payload in chunked transfer
framing. A block longer than the segment size is cut: the first part stays the ``response`` record
with WARC-Segment-Number 1, the others become ``continuation`` records that name it in
WARC-Segment-Origin-ID, the last of them with WARC-Segment-Total-Length. A page whose payload equals
that of an earlier page becomes a ``revisit`` record that refers to it and carries no payload. The
records are strings, so that Spark writes and commits the archive files itself, in any file system.

Reading. Each archive file is one binary row; records are taken off it by their Content-Length, never
by searching for marks, since payloads may hold anything. Continuations are grouped by origin id,
ordered by segment number and joined to the first part; the length is verified, then the chunked
framing is decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_table

#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: Bytes of a chunk in the transfer framing.
CHUNK = 4096
#: Bytes of a record's block beyond which it is segmented.
SEGMENT = 32768
#: Records of an archive file at most; with segments this bounds its bytes.
ARCHIVE_RECORDS = 2048

_CRLF = "\r\n"
_HTTP_HEAD = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Transfer-Encoding: chunked{_CRLF}{_CRLF}"
_DATE = "2024-01-01T00:00:00Z"


def _uri(url: Column) -> Column:
    """A URL fit for a header line: control characters and spaces become %20, null becomes about:blank."""
    return F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, payload_digest, refers_to)`` of each page.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, the smallest page_id is the original
    and the others refer to it. Null html is the empty payload. Of rows that repeat that smallest
    page_id, all are originals. Rows with a null page_id refer to the original if there is one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    named = named.withColumn("payload_digest", F.sha2("payload", 256))
    first = named.filter(F.length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first_id")
    refers = F.when((F.length("payload") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return named.join(first, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def _chunked(payload: Column) -> Column:
    """Chunked transfer framing of a binary column."""
    n = F.length(payload)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))

    def frame(at: Column) -> Column:
        size = F.least(F.lit(CHUNK), n - at)
        return F.concat(F.lower(F.hex(size)), F.lit(_CRLF), F.substring(payload, at + 1, size).cast("string"), F.lit(_CRLF))

    return F.concat(F.array_join(F.transform(starts, frame), ""), F.lit(f"0{_CRLF}{_CRLF}"))


def _record(kind: str, key: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A WARC record without its very last line feed, which the text sink adds."""
    lines = [F.lit(f"WARC/1.1{_CRLF}WARC-Type: {kind}{_CRLF}WARC-Date: {_DATE}{_CRLF}")]
    for name, value in [("WARC-Record-ID", key), *headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise(""))
    return F.concat(*lines, F.lit(_CRLF), block, F.lit(f"{_CRLF}\r"))


def warc_records(marked: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One ``record`` string per WARC record, segments included, for rows of :func:`mark_revisits`.

    Record ids are ``<urn:page:ID:ROW:SEGMENT>``; the row number tells rows apart that repeat a page_id.
    """
    ident = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("row").cast("string"), F.lit(":"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(_CRLF.join(["HTTP/1.1 200 OK", "", ""]))).otherwise(F.concat(F.lit(_HTTP_HEAD), _chunked(F.col("payload"))))
    framed = marked.withColumn("row", F.monotonically_increasing_id()).select("page_id", "refers_to", _uri(F.col("url")).alias("uri"), "payload_digest", ident.alias("ident"), block.cast("binary").alias("block"))
    total = F.length("block")
    last = F.when(total > 0, F.floor((total - 1) / segment)).otherwise(0).cast("int")
    parts = framed.withColumn("total", total).withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    part = F.substring("block", F.col("k") * segment + 1, F.lit(segment)).cast("string")
    key = F.concat("ident", (F.col("k") + 1).cast("string"), F.lit(">"))
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    common = [("WARC-Target-URI", F.col("uri")), ("X-Page-ID", page), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    as_revisit = _record("revisit", key, [*common, ("WARC-Profile", profile), ("X-Refers-To-Page", F.col("refers_to").cast("string"))], part)
    first_segment = F.when(F.col("last") > 0, F.lit("1"))
    as_response = _record("response", key, [*common, ("WARC-Segment-Number", first_segment)], part)
    origin = F.concat("ident", F.lit("1>"))
    length = F.when(F.col("k") == F.col("last"), F.col("total").cast("string"))
    as_continuation = _record("continuation", key, [("WARC-Target-URI", F.col("uri")), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", (F.col("k") + 1).cast("string")), ("WARC-Segment-Total-Length", length)], part)
    return parts.select(F.when(F.col("k") > 0, as_continuation).when(F.col("refers_to").isNotNull(), as_revisit).otherwise(as_response).alias("record"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write the pages as gzip-compressed WARC files of a bounded size below ``path``.

    Segments of one page may come to lie in different files.
    """
    records = warc_records(mark_revisits(pages), segment)
    records.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or gzipped.

    Raises ValueError where the bytes aren't a WARC record or end too early.
    """
    if data[:2] == b"\x1f\x8b":
        whole, rest = [], data
        while rest:
            member = zlib.decompressobj(31)
            whole.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(whole)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} ends after {len(data) - start} of {size} bytes")
        yield head, data[start : start + size]
        at = start + size


def dechunk(body: bytes) -> bytes:
    """The payload inside chunked transfer framing; trailers are skipped.

    Raises ValueError where the framing is broken.
    """
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing ends without its last chunk")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, with its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n"))
    return dechunk(body) if chunked else body


_RECORD = "kind string, record_id string, page_id long, uri string, digest string, refers_to long, origin_id string, segment int, total_length long, block binary"


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for head, block in parse_records(content.as_py()):
                rows.append((head.get("warc-type"), head.get("warc-record-id"), _number(head.get("x-page-id")), head.get("warc-target-uri"), head.get("warc-payload-digest"), _number(head.get("x-refers-to-page")), head.get("warc-segment-origin-id"), _number(head.get("warc-segment-number")), _number(head.get("warc-segment-total-length")), block))
                held += len(block)
                if held > 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, segments not yet joined."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_record_batches, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with whole blocks: ``(kind, record_id, page_id, uri, digest, refers_to, block)``.

    First parts and continuations meet by the origin's record id, in the order of segment numbers.
    A record fails the job if a segment is missing or repeated or its length isn't the total that the
    last segment names. Records without segments don't take part in the shuffle.
    """
    out = ["kind", "record_id", "page_id", "uri", "digest", "refers_to", "block"]
    alone = records.filter("segment IS NULL").select(out)
    key = F.coalesce("origin_id", "record_id")
    parts = records.filter("segment IS NOT NULL").withColumn("key", key).groupBy("key").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "uri", "digest", "refers_to")],
        F.max("total_length").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1)["block"], lambda acc, x: F.concat(acc, x["block"]))
    joined = parts.withColumn("numbers", F.transform("parts", lambda x: x["segment"])).withColumn("block", whole)
    sound = (F.col("numbers") == F.sequence(F.lit(1), F.size("parts"))) & (F.length("block") == F.col("total"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of "), F.col("key"), F.lit(" are not whole"))).cast("binary"))
    return alone.unionByName(joined.withColumn("block", checked).withColumnRenamed("key", "record_id").select(out))


def _payload_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [None if kind == "revisit" else http_payload(block) for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist())]
        keep = [c for c in batch.schema.names if c != "block"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(payloads, pa.binary())], names=[*keep, "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives: ``(kind, record_id, page_id, uri, digest, refers_to, payload)``.

    The payload of a revisit is null: it is that of the page it refers to.
    """
    whole = reassemble(read_records(spark, path))
    return whole.mapInArrow(_payload_batches, "kind string, record_id string, page_id long, uri string, digest string, refers_to long, payload binary")


def page_digests(read: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of read pages.

    A response's figures come from its payload; a revisit's from the response it refers to.
    """
    rows = work_table(read.select("page_id", "refers_to", "digest", F.col("kind").alias("record_type"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")), "pages")
    own = rows.filter("record_type = 'response'")
    again = rows.filter("record_type = 'revisit'").select("page_id", "refers_to", "digest", "record_type")
    same = ["refers_to", "digest"]  # rows that repeat a page_id differ in their payloads
    cited = own.select(F.col("page_id").alias("refers_to"), "digest", "payload_bytes", "payload_digest").join(again.select(same).distinct(), same, "left_semi").dropDuplicates(same)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(out).unionByName(again.join(cited, same, "left").select(out))
