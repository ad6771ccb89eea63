"""Importance resampling against a plain version, the selection of the k-th key, and odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangency.llm import importance, queries

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """Sorted rows (doc_id, n_features, weight, score, rank) of (doc_id, text) pairs, all in one place."""

    def features(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = WORDS.findall(text)
        return len(own), [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (total_s + buckets) / ((a + 1) * (total_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n >= least, i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    k = percent * len(able) // 100
    out = [(*r[1:], n) for n, r in enumerate(able[:k], 1)] + [(*r[1:], None) for r in able[k:]] + [(*r[1:], None) for r in rows if not r[0]]
    return sorted(out, key=str)


def test_whole_table(spark):
    docs, target = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, queries.op12_importance_resampling(spark, FOLDER).collect()), key=str) == wanted


@pytest.mark.parametrize("longest", [1, 2])
def test_odd_rows(spark, longest):
    rng = random.Random(3)
    some = [" ".join(rng.choice(("Alpha", "beta", "GAMMA9", "żółć", "日本", "x-y", "no_de")) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(some)] + [(None, some[5])] * 7 + [(7, "w " * 25)] * 9 + [(-4, "deep " * 40), (200, None), (201, ""), (202, "a b c " * 20_000), (1 << 62, "big " * 30), (-(1 << 62), "small " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("score", "rank", "row", "place", "bucket", "k0")})
    target = spark.createDataFrame([(None,), ("alpha 日本 日本",), ("",)], "text string")
    out = importance.resampled(docs, target, percent=30, longest=longest, buckets=500).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows, ["alpha 日本 日本"], longest, 500, 30)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert importance.resampled(docs.limit(0), docs).count() == 0
    [row] = importance.resampled(docs, docs.limit(0), percent=100).collect()
    assert row["rank"] == 1


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 63])
def test_the_kth_key(spark, spread):
    rng = random.Random(spread)
    rows = sorted({(rng.randint(-spread, spread - 1), rng.randint(-5, 5), n) for n in range(400)})
    table = spark.createDataFrame(rows, "a long, b long, c long").repartition(4)
    for k in (0, 1, 37, 200, 399, 400):
        found = table.where(importance.least(table, [F.col("a"), F.col("b"), F.col("c")], k, bits=8)).collect()
        assert sorted(map(tuple, found)) == rows[:k]


def test_a_tie_that_would_be_parted_is_an_error(spark):
    table = spark.createDataFrame([(1,), (2,), (2,), (3,)], "a long")
    assert table.where(importance.least(table, [F.col("a")], 3)).count() == 3
    with pytest.raises(ValueError, match="more rows"):
        importance.least(table, [F.col("a")], 2)


def test_gains_of_known_counts():
    assert importance.gains(np.array([0, 0]), np.array([0, 0])).tolist() == [0, 0]
    assert importance.gains(np.array([3, 0]), np.array([0, 3])).tolist() == [math.floor(1000 * math.log(1 / 4)), math.floor(1000 * math.log(4))]
