"""WARC captures: round trips, assembly of foreign archives, odd rows, damaged files."""

import base64
import collections
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tangency.llm import queries, warc

FOLDER = "/root/testdata/sf0.001"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least_bytes=0):
    """Sorted (page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, html) pairs."""
    groups = collections.defaultdict(list)
    for page_id, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for html, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        n = len(html.encode())
        for k, i in enumerate(ids):
            revisit = n >= least_bytes and k < len(ids) - 1
            out.append((i, n, digest(html), "revisit" if revisit else "response", ids[-1] if revisit else None))
    return sorted(out, key=str)


def derived(rows):
    return sorted(((r.page_id if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is None else int(r.refers_to)) for r in rows), key=str)


def test_whole_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op13_warc_captures(spark, FOLDER).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("least_bytes", [0, 6])
def test_odd_pages(spark, tmp_path, least_bytes):
    rng = random.Random(1)
    tricky = ["".join(rng.choice(("\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "x", "é😀")) for _ in range(rng.randrange(40))) for _ in range(150)]
    edge = "a" * 65_530  # the separator about the ends of the reader's buffers
    tricky += [edge + "\r" * k + "\n\r\n\r" * k for k in range(12)] + ["y" * 3_000_000]
    rows = list(enumerate(tricky)) + [(None, None), (None, ""), (900, ""), (901, "tiny"), (902, "tiny"), (903, "tiny"), (77, "same page"), (77, "same page"), (77, "same page"), (-5, "same page")]
    rows += [(1000 + i, "a very common page") for i in range(400)]
    pages = spark.createDataFrame([(i, "http://a b\r\nWARC-Type: x/\t" if i else None, h) for i, h in rows], "page_id long, url string, html string").repartition(5)
    pages = pages.withColumns({c: F.lit(1) for c in ("digest", "row", "n", "best", "best_row", "salt", "hot", "value")})
    warc.write_captures(pages, f"{tmp_path}/a", least_bytes)
    found = warc.read_captures(spark, f"{tmp_path}/a", payload=True).collect()
    assert derived(found) == plain(rows, least_bytes)
    texts = collections.Counter(h or "" for _, h in rows)
    for r in found:
        assert r.request.record_id != r.metadata.record_id and (r.n_requests, r.n_metadata) == (1, 1)
        assert r.capture.target_uri == ("http://a%20b%0D%0AWARC-Type:%20x/%09" if r.page_id not in (None, "0") else None)
        if r.record_type == "response":
            assert r.capture.intact and bytes(r.payload).decode() in texts and digest(bytes(r.payload).decode()) == r.payload_digest
        else:
            assert r.payload is None
    assert warc.unattached(warc.records(spark, f"{tmp_path}/a")).count() == 0


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_captures(pages, f"{tmp_path}/a")
    assert warc.read_captures(spark, f"{tmp_path}/a").count() == 0


def record(kind, name, block, *fields):
    head = [b"WARC/1.0", f"WARC-Type: {kind}".encode(), f"warc-record-id: <{name}>".encode(), *[f.encode() for f in fields], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members of their own, links either way, none, folded fields, several companions."""
    http, body = "Content-Type: application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n"
    archive = [
        record("warcinfo", "i", b"software: x\r\n"),
        record("response", "r1", body, http, "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m1>", "WARC-Payload-Digest: sha1:WRONG"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("metadata", "m1", b"page-id: 4\r\nnote: one\r\n two\r\n", "WARC-Concurrent-To: <r1>"),
        record("metadata", "m0", b"page-id: 3\r\n", "WARC-Concurrent-To: <r1>"),
        record("resource", "s", b"\x00\xff raw", "WARC-Target-URI: file:x"),
        record("metadata", "lost", b"", "WARC-Concurrent-To: <nobody>"),
        record("revisit", "v", b"", "WARC-Refers-To: <gone>", "WARC-Payload-Digest: sha1:ABC"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, archive)))
    rows = {r.capture.record_id: r for r in warc.read_captures(spark, str(tmp_path), payload=True).collect()}
    assert sorted(rows) == ["r1", "s", "v"]
    first = rows["r1"]
    assert (first.request.record_id, first.metadata.record_id, first.n_requests, first.n_metadata, first.page_id) == ("q1", "m0", 1, 2, "3")
    assert bytes(first.payload) == b"body\r\n" and first.capture.intact is False
    assert bytes(rows["s"].payload) == b"\x00\xff raw" and rows["s"].request is None
    assert (rows["v"].payload_bytes, rows["v"].refers_to, rows["v"].payload_digest) == (None, None, "ABC")
    found = warc.records(spark, str(tmp_path))
    assert found.where("record_id = 'm1'").first().fields == {"page-id": "4", "note": "one two"}
    assert [r.record_id for r in warc.unattached(found).collect()] == ["lost"]


@pytest.mark.parametrize("damage", [lambda d: d[:-9], lambda d: b"junk\r\n\r\n" + d, lambda d: d.replace(b"Content-Length: 5", b"Content-Length: 4")])
def test_damaged_archives(spark, tmp_path, damage):
    (tmp_path / "a.gz").write_bytes(gzip.compress(damage(record("resource", "r", b"abcde"))))
    with pytest.raises(Exception, match="a.gz: "):
        warc.records(spark, str(tmp_path)).collect()
