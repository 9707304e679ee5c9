"""WARC archives: writing with revisit records, segments and chunked framing, and
reading back by segment reassembly.

An archive part is a sequence of records, each ended by two line breaks. Parts
are written and read by Spark's text source with separators of our own, so they
need no file system but Spark's, and a reader never holds a whole part. No block
that we write holds the separator: chunk and segment boundaries are put into it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import materialize

END = "\r\n\r\n"
#: Between records: the end of one and the first letters of the next one.
BETWEEN = END + "WARC/1."
#: Bytes of a block in one record, and of data in one chunk.
SEGMENT_BYTES, CHUNK_BYTES = 4_096, 1_024
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FIELDS = "record_id string, type string, page_id string, url string, refers_to string, digest string, origin_id string, segment int, total_length long, complete boolean, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing, with a boundary inside each separator."""
    out, at, mark = [], 0, BETWEEN.encode()
    while at < len(payload):
        end = min(at + size, len(payload))
        if (hit := payload.find(mark, at, end + len(mark))) >= 0:
            end = min(end, hit + len(END) + 2)
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes | None:
    """Payload of chunked framing (extensions and trailers allowed); None if broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        try:
            size = int(data[at:line].split(b";")[0].strip(), 16) if line > at else -1
        except ValueError:
            return None
        if size < 0 or line + 2 + size > len(data):
            return None
        if not size:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size
        if data[at : at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(block: bytes) -> bytes | None:
    """Body of an HTTP response block, transfer framing decoded; None if broken."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = head.lower().split(b"\r\n")[1:]
    if any(f.startswith(b"transfer-encoding:") and b"chunked" in f for f in fields):
        return unchunked(body)
    return body


def segments(block: bytes, size: int) -> list[bytes]:
    """block in parts of about size bytes, none of which starts like a record."""
    out, at = [], 0
    while at < len(block) or not out:
        end = at + size
        # after the line breaks that end a record's fields
        while block.startswith((b"WARC/1.", b"\r\nWARC/1."), end):
            end += 1
        out.append(block[at:end])
        at = end
    return out


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record without its end. Line breaks in a field are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END.encode() + block


def page_records(page_id: str | None, url: str | None, payload: bytes, first: str | None, digest32: str, date: str, size: int) -> Iterator[bytes]:
    """The records of a page: a revisit of page first, or a response in segments."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    fields = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest32}", "X-Page-ID": page_id}
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", fields | {"WARC-Profile": profile, "X-Refers-To-Page-ID": first}, b"")
        return
    block = HTTP + chunked(payload)
    parts = segments(block, size)
    fields["Content-Type"] = "application/http;msgtype=response"
    if len(parts) == 1:
        yield record("response", fields, block)
        return
    yield record("response", fields | {"WARC-Segment-Number": "1"}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(n)}
        if n == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield record("continuation", more, part)


def write(pages: DataFrame, path: str, *, payload: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, payload) as WARC records under path.

    Of pages with equal payloads of at least min_bytes bytes, that with the
    smallest page_id is the response and the others are revisits of it; rows that
    repeat that page_id are responses too. A null payload counts as empty, a null
    page_id comes after all others, a null url is left out of the record.
    """
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), data.alias("data")).withColumn("sha", F.unhex(F.sha1("data")))
    firsts = rows.filter(F.length("data") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    met = rows.join(firsts.select(F.col("sha").alias("own"), "first"), F.col("sha") == F.col("own"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    met = met.select(F.col("page_id").cast("string"), "url", F.when(~again, F.col("data")).alias("data"), F.when(again, F.col("first")).cast("string").alias("first"), "sha")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):  # so that a batch of records stays small
                some, out = b.slice(at, 64).to_pylist(), []
                for r in some:
                    out += page_records(r["page_id"], r["url"], r["data"] or b"", r["first"], base64.b32encode(r["sha"]).decode(), date, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    text = met.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", END).option("compression", "gzip").text(path)


def number(field: bytes | None) -> int | None:
    """A field's number; None if there is none, or no number of zero or more."""
    return int(field) if field is not None and field.isdigit() and len(field) < 19 else None


def head_of(raw: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
    """(fields, what follows them) of a record's bytes; None for an empty part."""
    head, sep, rest = raw.removeprefix(b"WARC/1.").partition(END.encode())
    if not sep and not head.strip():
        return None
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parsed(lines: Iterator[tuple[object, bytes]]) -> Iterator[dict]:
    """Records (fields of FIELDS) of (file, bytes) in order, cut where a record may end.

    A block that holds such a place goes on in the bytes after it: they are taken as
    part of it if its Content-Length ends exactly where some of them end. Otherwise
    the record is not complete, and the next bytes are read as records of their own."""
    held: deque = deque()

    def ahead(k: int) -> tuple[object, bytes] | None:
        while len(held) <= k and (line := next(lines, None)) is not None:
            held.append(line)
        return held[k] if k < len(held) else None

    while (line := ahead(0)) is not None:
        held.popleft()
        found = head_of(line[1])
        if found is None:
            continue
        fields, rest = found
        length, parts, n, k = number(fields.get(b"content-length")), [rest], len(rest), 0
        while length is not None and n < length and (more := ahead(k)) is not None and more[0] == line[0]:
            parts += [BETWEEN.encode(), more[1].removeprefix(b"WARC/1.")]
            n, k = n + len(parts[-1]) + len(BETWEEN), k + 1
        # the last bytes of a file still have the record's end
        last = n - len(END) if parts[-1].endswith(END.encode()) else n
        if k and length in (n, last):
            rest = b"".join(parts)
            for _ in range(k):
                held.popleft()
        text = lambda x, own=fields: own[x].decode("utf-8", "replace") if x in own else None
        yield {
            "record_id": text(b"warc-record-id"), "type": text(b"warc-type"), "page_id": text(b"x-page-id"), "url": text(b"warc-target-uri"),
            "refers_to": text(b"x-refers-to-page-id"), "digest": (text(b"warc-payload-digest") or "").rpartition(":")[2] or None,
            "origin_id": text(b"warc-segment-origin-id"), "segment": segment_number(fields), "total_length": number(fields.get(b"warc-segment-total-length")),
            "complete": length is not None and length <= len(rest), "block": rest[: length or 0],
        }


def segment_number(fields: dict[bytes, bytes]) -> int | None:
    """A record's segment number; 0, which no whole record has, where it is no number."""
    if b"warc-segment-number" not in fields:
        return None
    n = number(fields[b"warc-segment-number"])
    return n if n is not None and n < 1 << 31 else 0


def records(spark: SparkSession, path: str, digested: bool = False) -> DataFrame:
    """FIELDS of every record under path, in archives of any 1.x version, plain or
    gzip. A record shorter than its stated length, or without a length that is a
    number, is marked as not complete; a segment whose number is none has number 0.
    Blocks may hold what looks like the start of a record; only where Spark splits a
    plain archive right there, the record is not complete.

    digested: also payload_bytes and payload_digest of responses that are one
    record, whose block is then left out."""

    def run(batches):
        lines = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for some in itertools.batched(parsed(lines), 64):
            for r in some if digested else ():
                if r["type"] == "response" and r["segment"] is None:
                    payload = payload_of(r["block"]) if r["complete"] else None
                    whole = payload is not None
                    r |= {"block": None, "complete": whole, "payload_bytes": len(payload) if whole else None, "payload_digest": digest(payload) if whole else None}
            yield pa.RecordBatch.from_pylist(list(some), schema=schema)

    schema = pa.schema([*SCHEMA, *DIGESTS]) if digested else SCHEMA
    fields = FIELDS + (", payload_bytes long, payload_digest string" if digested else "")
    return spark.read.option("lineSep", BETWEEN).text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, fields)


SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("complete", pa.bool_()), ("block", pa.binary())])

DIGESTS = [pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string())]


def reassemble(found: DataFrame) -> DataFrame:
    """record_id, page_id, url, digest, payload of every response in found, and
    whether it is complete (payload null if not).

    Segments are grouped by the record they continue, put in order of number, and
    joined if none is missing and the lengths add up to the stated total.
    Responses of one record are decoded where they are read, without a shuffle.
    """
    whole = found.filter("type = 'response' AND segment IS NULL").select("record_id", "page_id", "url", "digest", "complete", F.array("block").alias("blocks"))
    parts = found.filter("segment IS NOT NULL").withColumn("of", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("of").agg(
        first("page_id"), first("url"), first("digest"), F.min("complete").alias("complete"), F.max("total_length").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"),
    )
    numbers = F.transform("s", lambda x: x["segment"])
    right = (numbers == F.sequence(F.lit(1), F.size("s"))) & (F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x["block"])) == F.col("total"))
    joined = joined.select(F.col("of").alias("record_id"), "page_id", "url", "digest", (F.col("complete") & F.coalesce(right, F.lit(False))).alias("complete"), F.transform("s", lambda x: x["block"]).alias("blocks"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                data = [payload_of(b"".join(x)) if ok else None for x, ok in zip(some.column(5).to_pylist(), some.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array([x is not None for x in data]), pa.array(data, pa.binary())], ["record_id", "page_id", "url", "digest", "complete", "payload"])

    return whole.unionByName(joined).mapInArrow(run, "record_id string, page_id string, url string, digest string, complete boolean, payload binary")


def read_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and complete of
    every response and revisit under path. Bytes and digest of a response are
    those of the payload read; a revisit has those of the response it names."""
    found = materialize(records(spark, path, digested=True), "records")

    def run(batches):
        for b in batches:
            data = b.column(1).to_pylist()
            size, own = [None if x is None else len(x) for x in data], [None if x is None else digest(x) for x in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(own, pa.string()), b.column(2), b.column(3)], ["page_id", "payload_bytes", "payload_digest", "digest", "complete"])

    made = reassemble(found.filter("segment IS NOT NULL")).select("page_id", "payload", "digest", "complete")
    joined = made.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, digest string, complete boolean")
    whole = found.filter("type = 'response' AND segment IS NULL").select("page_id", "payload_bytes", "payload_digest", "digest", "complete")
    responses = whole.unionByName(joined)
    responses = responses.withColumn("complete", F.col("complete") & F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(True)))
    revisits = found.filter("type = 'revisit'").select("page_id", F.col("digest").alias("payload_digest"), "refers_to")
    sizes = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = revisits.join(sizes, "payload_digest", "left")
    cast = lambda c: F.col(c).cast(id_type).alias(c)
    out = responses.select(cast("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"), "complete")
    return out.unionByName(revisits.select(cast("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), cast("refers_to"), F.col("payload_bytes").isNotNull().alias("complete")))
