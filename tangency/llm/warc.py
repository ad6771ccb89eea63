"""WARC archives: captures written as records, and put together again by their concurrent-to links.

A capture is three records: request, response (or a revisit of an equal
payload) and metadata, the others pointing at the response by
WARC-Concurrent-To. Archives are text files whose lines end in the separator
of records, so Spark's own writer and reader move them, compressed and to any
store; what a line holds is cut into records by Content-Length alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.llm.common import hot_join, materialised

END = b"\r\n\r\n"
#: Kinds of record that are captures, and those that go with one.
CAPTURES, COMPANIONS = ("response", "revisit", "resource"), ("request", "metadata")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits."""
    part = lambda at, n: F.lpad(F.conv(F.substring(hexadecimal, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _clean(value: Column) -> Column:
    """A field's value on one line: white space as percent codes."""
    for character, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        value = F.replace(value, F.lit(character), F.lit(code))
    return value


def _record_id(kind: str, row: Column, run: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{run}:{kind}:"), row.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _record(kind: str, record_id: Column, date: str, content_type: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record as text, but for the separator after it; a field of null is left out."""
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {date}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n"))
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    length = F.concat(F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, *lines, length, block)


def _capture(revisit: bool, date: str, run: str) -> Column:
    """The three records of a row (row, page_id, url, n, digest, best_row and, unless revisit, html)."""
    own, uri, end = _record_id("capture", F.col("row"), run), _clean(F.col("url")), F.lit(END.decode())
    to = F.concat(F.lit("<"), own, F.lit(">"))
    request = _record("request", _record_id("request", F.col("row"), run), date, "application/http; msgtype=request", [("WARC-Target-URI", uri), ("WARC-Concurrent-To", to)], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), end)
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))]
    if revisit:
        fields += [("WARC-Profile", F.lit(SAME_PAYLOAD)), ("WARC-Refers-To", F.concat(F.lit("<"), _record_id("capture", F.col("best_row"), run), F.lit(">")))]
    kind, block = ("revisit", http) if revisit else ("response", F.concat(http, F.col("html")))
    capture = _record(kind, own, date, "application/http; msgtype=response", fields, block)
    note = F.coalesce(F.concat(F.lit("page-id: "), _clean(F.col("page_id").cast("string")), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", _record_id("metadata", F.col("row"), run), date, "application/warc-fields", [("WARC-Target-URI", uri), ("WARC-Concurrent-To", to)], note)
    return F.concat(request, end, capture, end, metadata)


def write_captures(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", run: str | None = None) -> None:
    """Writes a capture per row (page_id, url, html) to gzip archives in ``folder``.

    Of rows with equal payloads of ``least_bytes`` bytes or more, the one of
    the largest page_id is a response, nulls being smallest; of rows equal in
    that, one of them. The others are revisits of it and hold no payload.
    Smaller payloads are all responses. A null html is an empty payload, a
    null url or page_id is left out of the records. White space in a url
    becomes percent codes. An empty table gives archives of no records.

    Rows go by id, url and digest until they are known to be responses; then
    each text is dealt once, past a table of the responses, and not sorted.
    """
    run = run or uuid.uuid4().hex
    html = F.coalesce("html", F.lit(""))
    digest = F.sha1(html.cast("binary"))
    rows = materialised(pages.select("page_id", "url", digest.alias("digest"), F.octet_length(html).cast("long").alias("n")).withColumn("row", F.monotonically_increasing_id()))
    alike = rows.groupBy("digest", "page_id").agg(F.max("row").alias("row"), F.count("*").alias("copies"))
    best = alike.groupBy("digest").agg(F.max(F.struct("page_id", "row", "copies")).alias("best"))
    best = best.select("digest", F.col("best.row").alias("best_row"), F.col("best.copies").alias("copies"))
    large = materialised(hot_join(rows.where(F.col("n") >= least_bytes), best, ["digest"], F.col("row"), how="inner"))

    page = lambda: F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    first = large.where("row = best_row").withColumn("page", page())
    texts = pages.select(digest.alias("digest"), page().alias("page"), html.alias("html"))
    lone = texts.join(first.where("copies = 1").hint("shuffle_hash"), ["digest", "page"])
    lines = [lone.select(_capture(False, date, run).alias("value")), large.where("row <> best_row").select(_capture(True, date, run).alias("value"))]
    again = first.where("copies > 1")
    # A row that comes more than once has its text more than once: those are made one in an aggregate.
    payloads = texts.select("digest", "html").groupBy("digest").agg(F.first("html").alias("html"))
    if not again.isEmpty():
        lines.append(again.join(payloads, "digest").select(_capture(False, date, run).alias("value")))
    if least_bytes > 0:
        small = rows.where(F.col("n") < least_bytes)
        few = payloads.where(F.octet_length("html") < least_bytes)
        lines.append(hot_join(small, few, ["digest"], F.col("row"), how="inner").withColumn("best_row", F.col("row")).select(_capture(False, date, run).alias("value")))
    out = lines[0]
    for more in lines[1:]:
        out = out.union(more)
    out.write.option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def _fields(lines: list[bytes]) -> tuple[dict[str, str], list[str]]:
    """Named fields by lower-case name, the last of each, and all values of warc-concurrent-to."""
    found: list[list[str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and found:
            found[-1][1] += " " + line.strip(b" \t").decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            found.append([name.strip(b" \t").lower().decode("utf-8", "replace"), value.strip(b" \t").decode("utf-8", "replace")])
    return dict(map(tuple, found)), [v.strip("<>") for k, v in found if k == "warc-concurrent-to"]


class Stream:
    """Records of one archive, from its bytes as they come."""

    def __init__(self, name: str):
        self.name, self.data, self.head, self.need = name, bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict, list, bytes]]:
        self.data += data
        while True:
            if self.head is None:
                at = 0
                while self.data[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                del self.data[:at]
                end = self.data.find(END)
                if end < 0:
                    return
                first, *lines = bytes(self.data[:end]).split(b"\r\n")
                fields, together = _fields(lines)
                if not first.startswith(b"WARC/") or not fields.get("content-length", "").isdecimal():
                    raise ValueError(f"{self.name}: no record begins at {first[:40]!r}")
                self.head, self.need = (fields, together), end + len(END)
                del self.data[: self.need]
                self.need = int(fields["content-length"])
            if len(self.data) < self.need + len(END):
                return
            block = bytes(self.data[: self.need])
            if self.data[self.need : self.need + len(END)] != END:
                raise ValueError(f"{self.name}: a block of {self.need} bytes does not end where it should")
            del self.data[: self.need + len(END)]
            yield *self.head, block
            self.head = None

    def close(self) -> None:
        if self.head is not None or self.data.strip(b"\r\n"):
            raise ValueError(f"{self.name}: the last record is cut off")


_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_id", "kind", "target_uri", "date", "refers_to", "payload_digest")]
    + [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _row(head: dict, together: list, block: bytes, keep: bool) -> tuple:
    kind = head.get("warc-type", "").lower()
    payload = None
    if kind in ("response", "request", "revisit") and head.get("content-type", "").startswith("application/http"):
        payload = block.partition(END)[2]
    elif kind not in ("metadata", "warcinfo", "revisit"):
        payload = block
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest, n, intact = stated, None, None
    if kind in ("response", "resource"):
        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        intact = stated is None or stated == digest
    fields = _fields(block.split(b"\r\n"))[0] if kind in ("metadata", "warcinfo") else None
    record_id, refers = (head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to"))
    return record_id, kind, head.get("warc-target-uri"), head.get("warc-date"), refers, digest, n, intact, sorted(set(together)), fields and list(fields.items()), payload if keep and n is not None else None


def _record_batches(keep: bool, most_rows: int = 2_000, most_bytes: int = 8_000_000):
    names = _RECORD.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string, strings, pairs = pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
        kinds = [string] * 6 + [pa.int64(), pa.bool_(), strings, pairs, pa.binary()]
        made: list[tuple] = []
        size, stream = 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

        for batch in batches:
            for value, name in zip(batch.column("value"), batch.column("name")):
                if stream is None or stream.name != name.as_py():
                    if stream is not None:
                        stream.close()
                    stream = Stream(name.as_py())
                for head, together, block in stream.feed(value.as_py() + END):
                    made.append(_row(head, together, block, keep))
                    size += len(block) if keep else 0
                    if len(made) >= most_rows or size >= most_bytes:
                        yield flush()
                        made, size = [], 0
        if stream is not None:
            stream.close()
        if made:
            yield flush()

    return run


def records(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row per record of the gzip archives in ``folder``.

    Archives compressed whole or record by record are read in order, each by
    one task, a record at a time in memory. payload_digest and payload_bytes of
    a response are counted from its payload, ``intact`` tells whether the
    digest stated is that one; a revisit has the digest stated. ``fields`` are
    those of a metadata record's block. HTTP bodies stay as they were stored.
    A record cut off, or bytes where none begins, raise ValueError.
    """
    lines = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(folder)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("name"))
    return lines.mapInArrow(_record_batches(payload), _RECORD)


def assembled(found: DataFrame) -> DataFrame:
    """(capture, request, metadata): one nested row per response, revisit or resource of the records ``found``.

    A request or metadata record goes with a capture if either names the other
    as concurrent. Of several of one kind the one of least id is nested;
    n_requests and n_metadata count them all. A capture without has null.
    Records of other kinds, and companions of no capture, are not captures
    (see ``unattached``).
    """
    captures = found.where(F.col("kind").isin(*CAPTURES))
    others = found.where(F.col("kind").isin(*COMPANIONS)).select("kind", "record_id", "concurrent_to", F.struct("record_id", "target_uri", "date", "fields").alias("record"))
    linked = _links(captures, others)
    one = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("record")), F.when(F.col("kind") == kind, F.col("record.record_id"))).alias(kind)
    count = lambda kind, name: F.count(F.when(F.col("kind") == kind, 1)).alias(name)
    companions = linked.groupBy("capture_id").agg(one("request"), one("metadata"), count("request", "n_requests"), count("metadata", "n_metadata"))
    own = captures.select(F.col("record_id").alias("capture_id"), F.struct("record_id", "kind", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "intact").alias("capture"))
    zero = F.lit(0).cast("long")
    return own.join(companions, "capture_id", "left").select("capture", "request", "metadata", F.coalesce("n_requests", zero).alias("n_requests"), F.coalesce("n_metadata", zero).alias("n_metadata"))


def _links(captures: DataFrame, others: DataFrame) -> DataFrame:
    """(capture_id, kind, record): companions and the captures they go with, each pair once."""
    ids = captures.select(F.col("record_id").alias("capture_id"), F.col("concurrent_to").alias("named"))
    forth = others.select(F.explode("concurrent_to").alias("capture_id"), "kind", "record")
    back = ids.select("capture_id", F.explode("named").alias("other")).join(others, F.col("other") == F.col("record_id"))
    back = back.where(~F.array_contains("concurrent_to", F.col("capture_id")))
    return forth.union(back.select("capture_id", "kind", "record"))


def unattached(found: DataFrame) -> DataFrame:
    """Request and metadata records that go with no capture of ``found``."""
    captures, others = (found.where(F.col("kind").isin(*kinds)) for kinds in (CAPTURES, COMPANIONS))
    linked = _links(captures, others.select("kind", "record_id", "concurrent_to", F.struct("record_id").alias("record")))
    known = linked.join(captures.select(F.col("record_id").alias("capture_id")), "capture_id", "left_semi").select("record.record_id")
    return others.join(known, "record_id", "left_anti")


def read_captures(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One nested row per capture of the archives in ``folder``, and what it says of its page.

    capture, request, metadata as in ``assembled``; page_id as text;
    record_type; payload_bytes and payload_digest of the full payload, which
    a revisit has from the response it refers to; refers_to, that one's
    page_id. Where that response is not in the archives, bytes and refers_to
    are null. With ``payload`` a response's bytes come too.
    """
    found = materialised(records(spark, folder).drop("payload"))
    rows = materialised(assembled(found).withColumn("page_id", F.col("metadata.fields")["page-id"]))
    rows = rows.withColumn("refers", F.when(F.col("capture.kind") == "revisit", F.col("capture.refers_to")))
    targets = rows.where("capture.kind = 'response'").select(F.col("capture.record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("capture.payload_bytes").alias("their_bytes"))
    full = hot_join(rows, targets, ["refers"], F.hash("capture.record_id"))
    out = full.select(
        "capture", "request", "metadata", "n_requests", "n_metadata", "page_id", F.col("capture.kind").alias("record_type"),
        F.coalesce("capture.payload_bytes", "their_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), "refers_to",
    )
    if payload:
        bodies = records(spark, folder, payload=True).where("payload is not null").select(F.col("record_id").alias("body_of"), "payload")
        out = out.join(bodies, F.col("capture.record_id") == F.col("body_of"), "left").drop("body_of")
    return out


#: The same in DuckDB.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, row_number() OVER () AS r FROM pages
), g AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, r) AS place, max(page_id) OVER (PARTITION BY t) AS best FROM p
)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN best END AS refers_to
FROM g
"""
