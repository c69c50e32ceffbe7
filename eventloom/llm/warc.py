"""Operator 10, WARC archives: segmented writing, and reading with segment reassembly.

Writing: one HTTP response per page with the html as payload, in chunked transfer framing.  Blocks
longer than ``segment_bytes`` are cut: the first record has ``WARC-Segment-Number: 1``, the rest are
``continuation`` records with the first one's id in ``WARC-Segment-Origin-ID``, and the last has the
``WARC-Segment-Total-Length``.  Of pages with equal payloads of at least ``min_revisit_bytes`` the
smallest page id is written whole, the others as ``revisit`` records, whose ``WARC-Refers-To`` is that
record's id.  Each record is a gzip member of its own.  A row of the writer is some members of about
``row_bytes`` together, a file at most ``rows_per_file`` of them, so files are cut by bytes.

Which page is the first with a payload is told by digest, id and size alone.  Digests that a thousandth of the
pages or more have, at most a thousand, are broadcast, so no key of the join with the pages is a hot one;
pages that can't match have a key of their own.

Reading: members are inflated and records cut out by their Content-Length as they stream.  Only segments are
shuffled: they are grouped by origin id, ordered by number, checked for gaps and total length, joined, and then the
chunked framing is decoded.  A group is one page.  Revisits take their length from the response
with their digest that they refer to; that join can be split by adaptive execution where one response has many revisits.

Edge cases: null html is an empty payload; a null url is written as an empty target; rows with equal
page ids each keep their record (with equal payloads, each of the smallest id is a response; those whose url is the same
too share a record id if others refer to it, and are told apart by their number when read); a null
page id is allowed and its record is always a response; extra columns are ignored; an empty table
reads back as no rows.  Broken records (bad length, gap in the segments, bad framing) raise an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, small_batches

RECORD_SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, segment int, total long, block binary"
)
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _char_cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end where a UTF-8 character ends."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _char_cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (head.encode(), len(block), block)


def response_id(page_id, digest: str, own: str = "") -> str:
    """Of a page's response; ``own`` tells apart those that no other record refers to."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}" + (f";{own}" if own else "")


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero: for one record of 16 MB or more, an empty member follows."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def page_records(record_id: str, page_id, url: str, payload: bytes, digest: str, refers_to, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """All records of one page; ``refers_to`` is the page id of the response with this payload."""
    own = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"\s", "%20", url))]
    own += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    http = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record([("WARC-Type", "revisit"), *own, profile, ("WARC-Refers-To", f"<{response_id(refers_to, digest)}>"), *http], HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *own, *http], block)]
    cuts = _char_cuts(block, segment_bytes)
    out = [_record([("WARC-Type", "response"), *own, *http, ("WARC-Segment-Number", "1")], cuts[0])]
    for k, cut in enumerate(cuts[1:], 2):
        rest = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id};segment={k}>"), *own[1:], ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(k))]
        out.append(_record(rest + ([("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else []), cut))
    return out


def _writer(segment_bytes: int, chunk_bytes: int, row_bytes: int):
    def write(batches):
        part, row, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, html, digest, refers_to, referred in zip(*batch.columns):
                url, html, digest = url.as_py() or "", (html.as_py() or "").encode(), digest.as_py()
                own = response_id(page_id.as_py(), digest, "" if referred.as_py() else f"{part}.{row}")
                row += 1
                for record in page_records(own, page_id.as_py(), url, html, digest, refers_to.as_py(), segment_bytes, chunk_bytes):
                    held.append(member(record))
                    size += len(held[-1])
                    if size >= row_bytes:
                        yield _blob(held)
                        held, size = [], 0
        if held:
            yield _blob(held)

    return write


def _blob(members: list[bytes]) -> pa.RecordBatch:
    # the zero byte that the writer adds to each row is the last one
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])


def write_warc(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 100,
    segment_bytes: int = 16 << 10,
    chunk_bytes: int = 4 << 10,
    row_bytes: int = 64 << 10,
    rows_per_file: int = 256,
) -> None:
    """Write ``pages(page_id, url, html)`` to gzip-compressed archives below ``path``."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    place = F.xxhash64("url")
    # a digest and an id for each page, summed before the shuffle
    firsts = rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", place.alias("at")))).alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first"), F.col("first.at").alias("first_at"), "n"), "warc-firsts")
    most = (firsts.agg(F.sum("n")).first()[0] or 0) / 1000
    # no more than 1000 digests have a thousandth of the rows each
    hot = firsts.where(F.col("n") >= most).select("digest", F.col("first").alias("hot_first"), F.col("first_at").alias("hot_at"))
    cold = firsts.where(F.col("n") < most).select(F.col("digest").alias("key"), "first", "first_at")
    joined = rows.join(F.broadcast(hot), "digest", "left")
    alone = F.col("hot_first").isNotNull() | (F.col("size") < min_revisit_bytes)
    joined = joined.withColumn("key", F.when(alone, F.concat_ws(":", "digest", "page_id", "url")).otherwise(F.col("digest"))).join(cold, "key", "left")
    first, at = F.coalesce("hot_first", "first"), F.coalesce("hot_at", "first_at")
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("size") >= min_revisit_bytes, first).alias("first"), at.alias("at"), place.alias("place"))
    joined = joined.select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"),
        F.coalesce((F.col("page_id") == F.col("first")) & (F.col("place") == F.col("at")), F.lit(False)).alias("referred"),
    )
    # bytes as they are: a cast to string changes none, and the text writer writes them so
    (
        joined.mapInArrow(_writer(segment_bytes, chunk_bytes, row_bytes), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .option("compression", "none")
        .option("maxRecordsPerFile", rows_per_file)
        .text(path)
    )


def records_of(data):
    """(header fields, block) of each record of an archive: uncompressed bytes, or a file object."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    at = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record at byte {at} is cut short")
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, block
        at = stream.tell()


def _row(fields: dict, block: bytes) -> tuple:
    kind = fields["warc-type"]
    number = int(fields.get("warc-segment-number", 0))
    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"]).strip("<>")
    page = int(fields["warc-page-id"]) if "warc-page-id" in fields else None
    if kind == "revisit":
        return origin, page, kind, int(fields["warc-refers-to"].strip("<>").split(":")[2]), None, fields["warc-payload-digest"].split(":")[1], None, None, None
    if number:
        return origin, page, kind if number == 1 else None, None, None, None, number, int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, block
    payload = payload_of(block)
    return origin, page, kind, None, len(payload), hashlib.sha256(payload).hexdigest(), None, None, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_ARROW = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
)


def _read(batches):
    for batch in batches:
        for content in batch.column(0):
            raw = io.BytesIO(content.as_py())
            packed = raw.getbuffer()[:2] == b"\x1f\x8b"
            rows, held = [], 0
            for fields, block in records_of(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 17) if packed else raw):
                if fields["warc-type"] in ("response", "revisit", "continuation"):
                    rows.append(_row(fields, block))
                    held += len(block)
                if len(rows) >= 500 or held > 8 << 20:
                    yield _batch(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _ARROW)


def reassemble(segments: list[tuple], total: int | None) -> bytes:
    """The block of one page from its (number, bytes) in order, which must have no gap and sum to ``total``."""
    if not segments or [n for n, _ in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("a segment is missing or doubled")
    block = b"".join(b for _, b in segments)
    if len(block) != total:
        raise ValueError(f"segments have {len(block)} bytes, not {total}")
    return block


def _join_segments(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            origin, page, kind, total, parts = (c[at].as_py() for c in batch.columns)
            # equal rows that others refer to have one id: as many copies of each segment
            copies = sum(p["segment"] == 1 for p in parts) or 1
            if any(parts[i] != parts[i - i % copies] for i in range(len(parts))):
                raise ValueError(f"segments of {origin} differ or are missing")
            payload = payload_of(reassemble([(p["segment"], p["block"]) for p in parts[::copies]], total))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * copies, t) for x, t in zip((origin, page, kind, None, len(payload), hashlib.sha256(payload).hexdigest()), _ARROW.types)], schema=pa.schema(list(_ARROW)[:6])
            )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; segments come as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, RECORD_SCHEMA)


def read_warc(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row per page, with segments joined and revisits resolved.

    ``tag`` is a path for the parsed records, which are read twice.
    """
    small_batches(spark)
    read_records(spark, path).write.parquet(tag)
    records = spark.read.schema(RECORD_SCHEMA).parquet(tag)
    whole = records.where("segment is null").drop("segment", "total", "block")
    grouped = (
        records.where("segment is not null")
        .groupBy("record_id")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max("record_type").alias("record_type"),
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
    )
    joined = grouped.mapInArrow(_join_segments, ", ".join(RECORD_SCHEMA.split(", ")[:6]))
    pages = whole.unionByName(joined)
    responses = pages.where("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = pages.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*out).unionByName(revisits.select(*out))
