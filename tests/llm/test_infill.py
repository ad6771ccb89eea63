"""Fill-in-the-middle against a plain version, and on odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tangency.llm import infill, queries

FOLDER = "/root/testdata/sf0.001"


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slices of a Python string."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_fill_in_middle(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        *wanted, output = plain(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == wanted
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_rows_and_exact_round_trip(spark):
    long = "né😀\r\n  ab" * 30_000
    texts = [None, "", " ", "a", "\n", "a<P>b", "<M", "<<S", "é" * 2500, "👩‍👩‍👧 \u0000 x", long, "<S<P", "same", "same"]
    rows = [(i if i < 12 else 12, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 7), (-3, "below zero", 7)]
    # More copies of the marks' edges, so that every form is met.
    rows += [(i, "x<P" if i % 2 else "<S>" if i % 7 == 0 else ">P><M", 7) for i in range(100, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output int").withColumns({c: F.lit(1) for c in ("n", "form", "h1", "h2")})
    out = infill.transformed(docs).withColumn("restored", infill.restored("output", "form")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    wanted = sorted((i, (t or ""), *plain(i, t)) for i, t, _ in rows if i is not None)
    got = sorted((r.doc_id, r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out if r.doc_id is not None)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert [r.restored for r in out if r.doc_id is None] == ["no id"]
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_other_settings_and_empty_table(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(60)], "doc_id int, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = infill.transformed(docs, seed=5, percent=100, spm_percent=50, marks=marks).withColumn("restored", infill.restored("output", "form", marks)).collect()
    assert all(r.restored == f"text number {r.doc_id}" for r in out) and {r.form for r in out} == {"psm", "spm"}
    assert infill.transformed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run, block", [(1, 1), (3, 6), (64, 16_384)])
def test_offsets_by_rank(run, block):
    text = "a\né😀b\r\n" * 40
    units = infill.Units(run, block)
    for n in (0, 1, 2, 3, 63, 64, 65, len(text)):
        part = text[:n]
        assert units.count(part) == n
        assert [units.offset(part, k) for k in range(n + 1)] == list(range(n + 1))
