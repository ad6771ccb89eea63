"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import collections
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tangency.llm import boosting, chat, language, mixing, packing, queries, repetition, simhash, substrings, suffix, topk, toxicity, webpage
from tangency.llm.graph import components

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(rng, n, pool=500):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


#: Names that the operators use, or once used, for columns of their own.
CLASHING = ("_id", "_n", "_hash", "_text_hash", "_o", "_m", "_words", "_order", "_size", "_passes", "_start", "_ident", "_data", "row", "part", "id", "digest", "no_id", "p0", "passes", "words", "order", "hot", "salt")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns with clashing names."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", "a", 5), (None, "some words here", "en", None, 1), (5, "same text", "de", "b", 9), (5, "same text", "de", "b", 9), (6, "é" * 150 + " x", "de", "b", 9)]
    return frame(spark, rows).withColumns({c: F.lit(1) for c in ("score", "size", "taken", "fp", "key", "rank", "pos", "cover", "_ident2", "held_out", *CLASHING)})


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    label = {n: n for n in nodes}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_and_classes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    classes = plain_components(pairs, ids)
    for r in queries.op1_simhash_dedup(spark, FOLDER).collect():
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == classes[r.doc_id]


def test_spark_hashes_shingles_alike(spark):
    text = "a be see"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_of_crowded_buckets_are_complete(spark, bucket):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base:
        for _ in range(40):
            values.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket).collect()
    wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_majority_over_many_hashes():
    rng = np.random.default_rng(0)
    counts = np.array([1, 254, 255, 256, 1000, 2])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = simhash.majority_bits(hashes, counts), 0
    for g, n in zip(got, counts):
        own = hashes[at : at + n]
        at += n
        assert int(g) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def test_simhash_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r.doc_id: r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert empty == {1: 1, 2: 1, 3: 1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6]


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Mixing


def test_targets_by_filling_up(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) + rng.randrange(5) for i in range(9)} | {None: 77}
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, full = sum(sizes.values()), {}
        while True:
            rest = [s for s in names if s not in full]
            level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
            over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
            if not over:
                break
            full |= {s: 3 * sizes[s] for s in over}
        wanted = full | {s: level * weight[s] for s in rest}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == wanted


def test_quotas_are_highest_quotients(spark):
    targets = {"a": 700.0, "b": 310.5, "c": 41.0, "d": 0.0}
    rows = [(s, i + 1, 1000, t) for i, (s, t) in enumerate(targets.items())]
    df = spark.createDataFrame(rows, "source string, place int, source_size long, target double")
    blocks = -(-sum(targets.values()) // 4)
    order = sorted(((-t / (2 * k - 1), i, s) for i, (s, t) in enumerate(targets.items()) if t for k in range(1, 400)))[: int(blocks)]
    got = collections.defaultdict(dict)
    for r in mixing.shard_quotas(df, 4, 50).collect():
        got[r.shard][r.source] = r.quota
    for shard in got:
        own = collections.Counter(s for _, _, s in order[shard * 50 : shard * 50 + 50])
        assert {s: q for s, q in got[shard].items() if q} == dict(own)


def test_mix_takes_the_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.mix(docs, bucket_rows=3).toPandas()
    assert rows["size"].tolist() == [len(t.encode().split()) for t in rows[["doc_id"]].merge(docs.toPandas(), on="doc_id").text]
    assert (rows.taken <= 3 * rows["size"]).all()
    own = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((own.taken - own.target).abs() <= 64).all()
    again = mixing.mix(docs.repartition(5), bucket_rows=3).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    ends = rows.assign(end=rows.start + rows["size"]).sort_values(["source", "start", "end"])
    assert (ends.start == ends.groupby("source")["size"].cumsum() - ends["size"]).all()


def test_mixed_documents_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len(r.text.encode().split())
    assert {r.source: r.n for r in taken if r.n} == dict(got)


def test_every_shard_takes_its_quota(spark):
    """Shard by shard and source by source, against the pools laid out one word after another."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    options = dict(block_words=32, shard_blocks=200, bucket_rows=7)
    rows = mixing.mix(docs, **options).collect()
    sources = {r.source: (r.source_size, r.target) for r in rows}
    places = {s: i + 1 for i, s in enumerate(sorted(sources))}
    frame_ = spark.createDataFrame([(s, places[s], z, t) for s, (z, t) in sources.items()], "source string, place int, source_size long, target double")
    quotas = mixing.shard_quotas(frame_, 32, 200).where("quota > 0").collect()
    blocks = collections.Counter()
    for q in quotas:
        blocks[q.source] += q.quota
    assert len({q.shard for q in quotas}) > 5
    wanted, taken_in = collections.defaultdict(lambda: np.zeros(0, int)), {}
    for source, (size, _) in sources.items():
        wanted[source] = np.zeros(size, int)
    for q in quotas:
        size = sources[q.source][0]
        low, high = (math.floor(size * (b / blocks[q.source])) for b in (q.before, q.before + q.quota))
        left = min(q.quota * 32, 3 * (high - low))
        taken_in[q.shard, q.source] = left
        for _ in range(3):
            now = min(left, high - low)
            wanted[q.source][low : low + now] += 1
            left -= now
        assert q.quota * 32 - taken_in[q.shard, q.source] <= 3
    for r in rows:
        assert r.taken == wanted[r.source][r.start : r.start + r.size].sum(), r.doc_id
    text_words = {r.doc_id: r.text.encode().split() for r in docs.collect()}
    got = collections.defaultdict(collections.Counter)
    for r in mixing.mixed_documents(docs, **options).collect():
        own, whole = r.text.encode().split(), text_words[r.doc_id]
        assert own == whole or any(whole[i : i + len(own)] == own for i in range(len(whole)))
        got[r.doc_id]["words"] += len(own)
    assert {r.doc_id: r.taken for r in rows if r.taken} == {k: v["words"] for k, v in got.items()}


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert set(mixing.mixed_documents(odd).columns) == set(odd.columns)


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_ids_of_words_are_those_of_the_text(tokenizer):
    cache, rng = packing.WordCache(packing.default_tokenizer(), most=50), random.Random(1)
    letters = "aÀß'sStT 1²½ªµ.,#İΣσς́é\xa0\x1c\x85 漢字🙂dll've\nǆ\t"
    for _ in range(500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>x"])
        assert np.frombuffer(cache.ids(s.encode()), "<u4").tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def packed_well(rows):
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096
    return rows.sequence_id.nunique(), -(-rows.length.sum() // 4096)


def test_packing_is_whole_and_tight(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.op3_best_fit_packing(spark, FOLDER).toPandas()
    used, least = packed_well(rows)
    assert used <= least + 1
    at = rows.set_index(["doc_id", "piece"])
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            own = at.loc[(r.doc_id, k // 4096)]
            part = np.array(ids[k : k + 4096], "<u4").tobytes()
            assert (own.start, own.length, own.ids_crc32) == (k, len(part) // 4, zlib.crc32(part))


def test_packing_in_many_shards(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.choice([1, 50, 700, 2500, 4096])) for i in range(900)], "doc_id long, length long")
    used, least = packed_well(packing.pack(rows, shard_sequences=16).toPandas())
    lengths = [r.length for r in rows.collect()]
    assert used <= 1.05 * max(least, sum(n > 2048 for n in lengths)) + 1


def test_placing_lowers_the_sum_of_squares():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 40, 200)
    where, offset = packing.place(lengths, 40)
    gaps: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        fits = sorted({g for g in gaps if g >= s})
        if fits:
            def squares(g):
                left = gaps.copy()
                left.remove(g)
                return sum(v * v for k, v in collections.Counter(left + [g - s]).items() if k)

            best = min(fits, key=squares)
            assert squares(40 - int(offset[i])) == squares(best)
            gaps.remove(40 - int(offset[i]))
            gaps.append(40 - int(offset[i]) - s)
        else:
            assert offset[i] == 0
            gaps.append(40 - s)


def test_packing_odd_rows(spark, odd, none):
    rows = packing.pack_documents(odd).toPandas()
    packed_well(rows)
    assert (rows[rows.doc_id == 1].length == 1).all() and len(rows[rows.doc_id == 5]) == 2
    assert rows[rows.doc_id == 4].piece.max() > 1
    assert packing.pack_documents(none).count() == 0


# Suffix arrays and substrings


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(600):
        n, letters = rng.randint(0, 40), rng.randint(1, 4)
        s = [rng.randint(0, letters) for _ in range(n)]
        if rng.random() < 0.3 and n:
            s = (s[: rng.randint(1, 6)] * 40)[:n]
        order = suffix.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:])
        common = suffix.common_prefixes(np.array(s), order)
        for k in range(1, n):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def plain_cut(texts, length=200):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), spans))
    return out


@pytest.mark.parametrize("most", [20_000, 3])
def test_substrings_equal_brute_force(spark, most):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([150, 199, 200, 201, 260, 500]))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(0, 4))]
        texts.append("".join(parts))
    texts += ["ab" * 400, "x" * 700, texts[3], texts[3]]
    rows = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), most=most).collect()}
    for i, (kept, removed, spans) in enumerate(plain_cut([t.encode() for t in texts])):
        assert (bytes(rows[i].kept), rows[i].n_removed, len(rows[i].spans)) == (kept, removed, spans)


@pytest.mark.parametrize("size", [70, 110, 150, 190, 230])
def test_shared_passages_make_no_large_group(spark, monkeypatch, size):
    rng = random.Random(size)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(size)
    texts = [noise(210) + passage + noise(210) for _ in range(25)] + [noise(30) + passage * 4] * 2
    compare = substrings._compare_batches

    def strict(length):
        def run(batches):
            batches = list(batches)
            groups = collections.Counter(k for b in batches for k in b.column(0).to_pylist())
            assert max(groups.values(), default=0) <= 4
            yield from compare(length)(iter(batches))

        return run

    monkeypatch.setattr(substrings, "_compare_batches", strict)
    rows = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), most=4).collect()}
    for i, (kept, removed, spans) in enumerate(plain_cut([t.encode() for t in texts])):
        assert (bytes(rows[i].kept), rows[i].n_removed, len(rows[i].spans)) == (kept, removed, spans)


def test_substrings_of_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = {r.doc_id: r for r in substrings.remove_repeats(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    for d, (kept, removed, spans) in zip(docs, plain_cut([(d.text or "").encode() for d in docs])):
        assert (bytes(rows[d.doc_id].kept), rows[d.doc_id].n_removed, len(rows[d.doc_id].spans)) == (kept, removed, spans)


def test_long_texts_are_tiled(monkeypatch):
    rng = random.Random(7)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    monkeypatch.setattr(substrings, "_TILE", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([text])], ["i", "t"])
    starts = set()
    for out in substrings._run_batches(200)(iter([batch])):
        for pos in out.column("pos").to_pylist():
            start, size = pos >> 24, (pos >> 12) & 4095
            starts |= set(range(start, start + size - 199))
    assert starts == set(range(4801))


def test_substrings_odd_rows(spark, odd, none):
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and all(r.n_removed == 0 for r in rows if r.doc_id == 1)
    assert substrings.remove_repeats(none).count() == 0
    out = substrings.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert [r.text for r in out.where("doc_id = 1").collect()] == [None]


# Top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.12, (400, 16)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1003, [float("inf")] * 16), (1050, [0.1, 0.2])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, block_rows=64).collect()
    v = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 400, 50):
        scores = v @ v[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in own] == [(i, scores[i]) for i in best]
    assert {r.query_id for r in got} == set(range(0, 400, 50))


def test_block_stops_on_proof_with_postings_unread():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(0, 32, (2000, 64))).astype(np.int64)
    vectors[7] = 0
    block = topk.Block(vectors)
    for i in range(40):
        query = np.floor(vectors[i] * 0.8 + rng.normal(0, 12, 64)).astype(np.int64)
        scores = vectors @ query
        entries, found = block.best(query, 5)
        assert (scores[entries] == found).all()
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(entries.tolist())
        high, _ = block.best(query, 5, float(np.sort(scores)[-3]))
        assert set(np.flatnonzero(scores >= np.sort(scores)[-3])) <= set(high.tolist())
    # Postings of the block, read by 80 searches: a good part was never read.
    assert 0 < block.read < 0.9 * 80 * len(block.ids)
    assert (np.diff([block.height[s] for s in range(topk.LEVELS)]) < 0).all()


def test_top_k_odd_rows(spark):
    def ask(rows, is_query, **options):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score string, block string, ids string")
        return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, is_query, **options).collect())

    more = ("a", "b", "c", "d")
    rows = [(0, [1.0, 0.0], *more), (0, [1.0, 0.0], *more), (1, [1.0, 0.0], *more), (2, [0.5, 0.5], *more), (3, [], *more), (None, [1.0, 1.0], *more), (4, [0.0, 0.0], *more)]
    one = 256 * 256
    wanted = [(0, 1, 1, one), (0, 2, 2, one // 2), (0, 3, 4, 0)]
    assert ask(rows, F.col("vec_id") == 0) == wanted
    assert ask(rows, F.col("vec_id") == 99) == []
    assert ask(rows, F.col("vec_id") == 4) == [(4, 1, 0, 0), (4, 2, 1, 0), (4, 3, 2, 0)]
    assert ask(rows, F.lit(None).cast("boolean")) == []
    # One id with two vectors answers with both; vectors of very unlike norms are in blocks of their own.
    twice = [(0, [1.0, 0.0], *more), (1, [1.0, 0.0], *more), (1, [100.0, 0.0], *more), (2, [0.01, 0.0], *more)]
    assert ask(twice, F.col("vec_id") == 0, block_rows=1) == [(0, 1, 1, 100 * one), (0, 2, 1, one), (0, 3, 2, 2 * 256)]
    many = [(i, [float(i % 7), 1.0], *more) for i in range(300)]
    assert [r[2] for r in ask(many, F.col("vec_id") == 6, block_rows=16, query_rows=1)] == [13, 20, 27, 34, 41]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_other_tokenizer_files_are_not_taken_apart():
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "It's a  test,\nwith ñandú and <|endoftext|> 42 日本"
    for name, plain in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        cache = packing.WordCache(path)
        assert cache.plain == plain
        assert np.frombuffer(cache.ids(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_equal_rows_are_dealt_apart(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1024).cast("long").alias("length"))
    out = packing.pack(rows, 4096, 64).collect()
    shards = {(r.sequence_id >> 24) & 0xFFFF for r in out if not r.sequence_id >> 60}
    assert len(out) == 4000 and len(shards) >= 8
    assert len({r.sequence_id for r in out}) <= 1.1 * 1000


def test_one_row_of_each_component_stays(spark):
    text, other, third = ("alpha beta gamma delta epsilon zeta " * 20, "one two three four five six seven " * 20, "red green blue black white pink " * 20)
    rows = [(1, text), (1, other), (2, text), (None, other), (None, third), (None, third), (3, None), (4, ""), (1, text)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), (1, other), (None, third), (3, None)], key=str)


# Language


def test_language_accuracy_on_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = queries.op6_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    assert rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def plain_language_scores(counts, languages, text):
    """The language scores of a text by dictionaries, one word and one n-gram after another.

    ``counts[n]`` has, per word (0) or n-gram, its counts by language.
    """
    def posterior(n, key):
        logs = []
        for lang in languages:
            total = sum(c.get(lang, 0) for c in counts[n].values()) + 0.5 * (len(counts[n]) + 1)
            logs.append(math.log((counts[n][key].get(lang, 0) + 0.5) / total))
        top = max(logs)
        return [x - top - math.log(sum(math.exp(y - top) for y in logs)) for x in logs]

    sums = [0.0] * len(languages)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        rows = [posterior(0, word)] if word in counts[0] else []
        for n in (5, 4, 3, 2, 1):
            if not rows:
                padded = f" {word} "
                rows = [posterior(n, g) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in counts[n]]
        rows = rows or [[-math.log(len(languages))] * len(languages)]
        sums = [s + sum(r[k] for r in rows) / len(rows) for k, s in enumerate(sums)]
    top = max(sums)
    return sums.index(top), 1 / sum(math.exp(s - top) for s in sums)


def test_language_equals_a_plain_scorer(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("the dog der", "en"), ("der hund schlief", "de"), ("die katze die der", "de"), ("le chien dort 東京都", "fr")] * 3)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=10**6)
    counts = {n: {} for n in range(6)}
    for _, text, lang in rows:
        for word in text.split():
            if word.isalpha():
                for n in range(6):
                    for g in [word] if n == 0 else [f" {word} "[i : i + n] for i in range(len(word) + 3 - n)]:
                        own = counts[n].setdefault(g, {})
                        own[lang] = own.get(lang, 0) + 1
    languages = ("de", "en", "fr")
    assert model.languages == languages
    texts = ["the hund", "kater schlafend", "catnap dogs", "qqq", "東京", "x" * 300, "Die The le LE chiens", "\U0001f600 \U00020000\U00020001 der"]
    for text, (name, score) in zip(texts, language.Scorer(model).predict_all(texts)):
        best, wanted = plain_language_scores(counts, languages, text)
        assert score == pytest.approx(wanted, rel=1e-4), text
        assert wanted < 0.34 or name == languages[best], text
    scorer = language.Scorer(model, most=1)
    assert [scorer.predict_all([t])[0] for t in texts] == language.Scorer(model).predict_all(texts)
    assert scorer.predict_all([None, "", "12 ² ³", "!"]) == [("und", 0.0)] * 4


def test_language_odd_rows(spark, odd, none):
    rows = language.identified(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.identified(none).count() == 0 and language.with_known_language(none).count() == 0
    out = language.with_known_language(odd)
    assert out.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in out.collect()}


# HTML


@pytest.fixture(scope="module")
def trees():
    return webpage.trained()


def test_articles_of_the_pages(spark, trees):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    import html

    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|li|ul)\b[^>]*>", inner)]
        assert webpage.extract(r.html, trees) == "\n\n".join(b for b in blocks if b)


def test_layouts_not_trained_on(trees):
    rng, missed, extra, total = random.Random(123), 0, 0, 0
    for _ in range(120):
        page, main = webpage.training_page(rng)
        got = set(re.findall(r"[mx]\d+e*", webpage.extract(page, trees)))
        missed, extra, total = missed + len(main - got), extra + len(got - main), total + len(main)
    assert missed < 0.03 * total and extra < 0.05 * total


HARBOUR = (
    "The harbour was rebuilt after the storm of 1890, and its two stone piers still stand today, although the fishing fleet left long ago.",
    "Most of the old warehouses have been turned into flats, which the town sold to pay for a new school and a library.",
    "In summer the quay fills with visitors who come for the market, the boats and the long evenings by the water.",
)
_PARAGRAPHS = "".join(f"<p>{x}</p>" for x in HARBOUR * 2)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><div><h1>The old harbour</h1>{_PARAGRAPHS}</div></body></html>",
        f"<body>{_PARAGRAPHS}</body>",
        f'<div class="x9"><h2>The old harbour</h2>{_PARAGRAPHS}</div>',
        f'<body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a><br><a href="/c">Contact us</a></td><td><h1>The old harbour</h1>{_PARAGRAPHS}</td></tr></table></body>',
        f'<body><div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul></div><div><h1>The old harbour</h1>{_PARAGRAPHS}</div><div>Contact Town Press</div></body>',
        '<body><div id="main">' + "<br><br>".join(HARBOUR * 2) + "</div></body>",
        f'<body><header><a href="/">Home</a></header><section><h1>The old harbour</h1>{_PARAGRAPHS}</section><section><h3>News</h3><ul><li><a href="1">One story</a></li><li><a href="2">Other story</a></li></ul></section></body>',
    ],
)
def test_pages_written_by_hand(trees, page):
    """Pages without telling tags or names, made by no rule of the training pages."""
    got = webpage.extract(page, trees)
    assert all(x in got for x in HARBOUR) and not any(x in got for x in ("Home", "Contact", "News", "Other story"))


def test_article_element_is_not_needed(spark, trees):
    pages = [r.html for r in spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/pages.parquet").collect()]
    before = [webpage.extract(p, trees) for p in pages]
    after = [webpage.extract(re.sub(r"<(/?)article>", r"<\1div>", p), trees) for p in pages]
    assert sum(a == b for a, b in zip(after, before)) >= 0.9 * len(pages) and sum(not a for a in after) <= 0.005 * len(pages)


def test_page_work_is_linear():
    began = time.time()
    nodes = webpage.parse("<b>" * 16_000 + "<p>x" * 16_000)
    assert len(nodes) == 32_001
    wide = webpage.parse("<ul>" + "<li>one<li>two" * 20_000)
    found = webpage.features(wide)
    assert found.flags.nbytes + found.numbers.nbytes < 250 * len(wide)
    assert time.time() - began < 20
    few, many = (webpage.features(webpage.parse("<div>" + "<p>a</p><h2>b</h2>" * k)) for k in (99, 300))
    siblings = [round(float(np.expm1(f.numbers[2, 13]))) for f in (few, many)]
    assert siblings == [99, 300]


def test_decoding_never_contradicts_itself():
    rng = np.random.default_rng(0)
    nodes = [webpage.Node("body", -1)] + [webpage.Node("div" if i % 3 else "#text", int(rng.integers(0, max(1, i // 2)))) for i in range(1, 60)]
    for n in nodes[1:]:
        if nodes[n.parent].tag == "#text":
            n.parent = 0
    for _ in range(30):
        keep = webpage.decode(nodes, rng.normal(0, 2, 60), rng.normal(0, 2, 60))
        assert all(keep[i] for i, n in enumerate(nodes) if n.parent >= 0 and keep[n.parent])


def test_parser_on_broken_markup():
    nodes = webpage.parse("<p>a &amp; b<br>c<p>d<ul><li>x<li>y</ul><script>no</script><table><tr><td>1<td>2</table>tail &lt;")
    assert [re.sub(r"\s+", " ", "".join(n.text)).strip() for n in nodes if n.tag == "#text"] == ["a & b c", "d", "x", "y", "1", "2", "tail <"]


@pytest.mark.parametrize(
    "html",
    [
        "<p>a</p><svg viewBox='0'/><p>b</p>", "<p>a</p><script src='x.js'/><p>b</p>", "<p>a</p><iframe src='x'/><math/><p>b</p>",
        "<head><title>t</title><meta charset='u'><body><p>a</p><p>b</p>", "<head><title>t</title><p>a</p><p>b</p>", "<head><title>t</title></head><p>a</p><p>b</p>",
        "<div><p>a</p><select><option>no</div><p>b</p>", "<div><p>a</p><button>no</div><p>b</p>", "<div><p>a</p><noscript><div>no</div></div><p>b</p>",
        "<p>a</p><svg><path d='1'><p>b</p>", "<div><p>a</p><svg><foreignObject><div>no</div></foreignObject></svg></div><p>b</p>", "<head><noscript><img></noscript><script>no</script><body><p>a</p><p>b</p>",
    ],
)
def test_unclosed_skipped_elements_lose_nothing(html):
    assert ["".join(n.text).strip() for n in webpage.parse(html) if n.tag == "#text"] == ["a", "b"]


def test_pages_odd_rows(spark, trees):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>" + "word " * 20_000 + "</p>"), (3, "u", "<b>"), (3, "u", "<b>")]
    got = webpage.extracted(frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), trees).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and not any(r.text for r in got if r.page_id in (1, 2, 3))
    assert webpage.extracted(frame(spark, [], "page_id long, url string, html string"), trees).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x, y, np.ones(2000), columns=1.0)
    fresh = rng.normal(0, 1, (500, 5))
    assert ((trees.logits(fresh) > 0) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0))).mean() > 0.95


# Repetition


def test_repeats_equal_brute_force():
    rng = random.Random(8)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))] for _ in range(40)] + [[b"x"] * 50, []]
    for words_, (covered, _, longest) in zip(texts, repetition.repeat_measures(texts)):
        n = len(words_)
        windows = collections.Counter(tuple(words_[i : i + 8]) for i in range(n - 7))
        inside = {j for i in range(n - 7) if windows[tuple(words_[i : i + 8])] > 1 for j in range(i, i + 8)}
        most = max((k for i in range(n) for j in range(i + 1, n) for k in [next((k for k in range(n - j) if words_[i + k] != words_[j + k]), n - j)]), default=0)
        assert (covered, longest) == (len(inside), most)


def test_quality_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op8_repetition_quality(spark, FOLDER).collect():
        t = docs[r.doc_id]
        w = t.encode().split()
        seen, again = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                again += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), sum(map(t.count, "#*$%&|<>")), again)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and not (r.base_failed and r.kept)


def test_verdict_rejects_what_the_base_rules_pass(spark):
    rng = random.Random(12)
    clean = [words(rng, 200, 5000) for _ in range(20)]
    phrases = [words(rng, 4, 5000) for _ in range(12)]
    short = " ".join(rng.choice(phrases) + f" u{i}" for i in range(50))
    rows = {r.doc_id: r for r in repetition.quality(frame(spark, [(i, t, None, None, None) for i, t in enumerate([*clean, short])])).collect()}
    assert all(rows[i].kept for i in range(20))
    assert not rows[20].base_failed and not rows[20].kept and rows[20].repeat_share > 0.3


def test_marks_of_words():
    texts = ["THE!! Of%%% the&&& plain, (words) don't end.) 5$ | ok! a-b x--y e.g. *** é§ #tag".encode().split()]
    assert repetition.word_marks(texts[0]) == [b"!", b"%", b"&", b"", b"", b"", b"", b"$", b"|", b"", b"", b"", b"", b"*", b"", b"#"]


def test_share_of_repeated_marks_equals_brute_force(spark):
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["a!!", "b$$", "c,", "plain", "| ", "f%%%"]) for _ in range(rng.randint(20, 70))) for _ in range(15)] + [" ".join(f"w{i}!!" for i in range(60)), words(rng, 80, 5000) + " 5$"]
    for r in repetition.quality(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect():
        marks = repetition.word_marks(texts[r.doc_id].encode().split())
        n = len(marks)
        runs = collections.Counter(tuple(marks[i : i + 3]) for i in range(n - 2))
        inside = {j for i in range(n - 2) if runs[tuple(marks[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert r.mark_share == pytest.approx(sum(1 for j in inside if marks[j]) / n)
        assert r.kept == (not r.base_failed and r.repeat_share <= 0.3 and r.longest_repeat <= max(16, 0.15 * r.n_words) and r.mark_share <= 0.1)


def test_verdict_on_labelled_texts(spark):
    """Of what the base rules pass, bad texts go and good ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = repetition.quality(docs).join(labels, "doc_id").where("not base_failed and quality is not null").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    found = {r.quality: (r.n, r.kept) for r in rows}
    assert found[0][0] > 20 and found[0][1] <= 0.05 * found[0][0] and found[1][1] >= 0.99 * found[1][0]


def test_quality_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in repetition.quality(odd).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and rows[4].n_words == 30_000 and rows[4].kept
    assert repetition.quality(none).count() == 0


# Chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_snapshots_collapse(spark):
    u, a = "user", "assistant"
    rows = [(1, 0, u, "hi"), (1, 1, a, "yo"), (2, 0, u, "hi"), (3, 0, u, "hi"), (3, 1, a, "yo"), (4, 0, a, "hi"), (5, 0, u, None), (6, 0, None, "hi"), (None, 0, u, "hi"), (7, 5000, u, "hi"), (7, 9000, a, "yo"), (7, 9000, a, "yo")]
    got = collections.defaultdict(list)
    for r in chat.rendered_turns(conversations(spark, rows)).orderBy("conv_id", "place").collect():
        got[r.conv_id].append(r.rendered)
    assert sorted(got) == [4, 5, 6, 7] and len(got[7]) == 3
    assert got[6] == ["<|im_start|>user\nhi<|im_end|>\n"]
    assert chat.rendered_turns(conversations(spark, [])).count() == 0


# Toxicity


def test_toxicity_on_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.5)).all()
    order = held.score.rank()
    p = held.toxic.sum()
    auc = (order[held.toxic == 1].sum() - p * (p + 1) / 2) / (p * (len(held) - p))
    assert auc > 0.93 and (held.predicted == held.toxic).mean() > 0.95


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 7)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(odd, labels, steps=5).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(none, labels, steps=5).count() == 0


# Registered queries


def test_stages_keep_columns_of_any_name(spark):
    """Foreign columns, named as the stages' own, come out as they went in."""
    rng = random.Random(9)
    plain = [(i, words(rng, 40 + i), "en", "ab"[i % 2], 5) for i in range(30)]
    rows = plain + [plain[3], plain[3], (None, plain[5][1], "en", None, 5), (None, words(rng, 50), "en", None, 5), (40, plain[7][1] + " more", "en", "a", 5)]
    docs = frame(spark, rows).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found, name
        for r in found:
            assert all(r[c] == c + ("none" if r.doc_id is None else str(r.doc_id)) for c in CLASHING), name
        docs = spark.createDataFrame(found, docs.schema)
    assert corpus_pipeline.pack(spark, docs, FOLDER).count() > 0


def test_one_of_equal_rows_stays_and_none_of_another_text_goes(spark):
    rng = random.Random(2)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(None, a, "en", "x", 1)] * 50 + [(7, b, "en", "x", 1)] * 20 + [(7, a, "en", "y", 1), (3, b, "en", "y", 1), (None, "", None, None, 0), (None, None, None, None, 0)]
    out = simhash.keep_first(frame(spark, rows).repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in out if r.text) == sorted([(False, 7, a), (False, 3, b)])
    assert len(out) == 3


def test_equal_rows_are_spread_over_the_stream(spark):
    """Many copies of one row take no one place, and reruns on other partitions agree."""
    rows = [(1, "one two three", "en", "a", 13)] * 300 + [(i, words(random.Random(i), 30), "en", "b", 1) for i in range(2, 60)]
    docs = frame(spark, rows)
    sizes = mixing.document_sizes(docs.repartition(6), 7).toPandas()
    assert len(sizes) == len(rows) and sizes["order"].is_unique and (sizes["order"] >= 0).all()
    again = mixing.document_sizes(docs.repartition(2), 7).toPandas()
    assert sorted(sizes["order"]) == sorted(again["order"])
    taken = [sorted(mixing.mix(docs.repartition(n), bucket_rows=16).toPandas()["taken"]) for n in (2, 5)]
    assert taken[0] == taken[1]


def test_very_long_conversations_and_clashing_columns(spark):
    """Whole texts and turns of any number come through, whatever else the table holds."""
    long = words(random.Random(3), 40_000)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)] + [(2, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(2999)]
    rows += [(3, 0, "user", long), (4, 0, "user", long), (4, 1, "assistant", None)]
    table = conversations(spark, rows).withColumns({c: F.lit(7) for c in ("place", "turns", "rendered", "n_turns", "h1", "h2", "all", "block", "_n")})
    out = chat.rendered_turns(table).orderBy("conv_id", "place").collect()
    kept = collections.Counter(r.conv_id for r in out)
    assert kept == {1: 3000, 4: 2}
    assert out[-2].rendered == f"<|im_start|>user\n{long}<|im_end|>\n" and out[2999].rendered == "<|im_start|>assistant\nturn 2999<|im_end|>\n"


def test_language_tables_without_a_cap(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    small, every = language.train(docs, most_words=50, most_grams=50), language.train(docs, most_words=None, most_grams=None)
    texts = docs.where("lang is not null").limit(60)
    wrong = language.identify(texts.select("doc_id", "text", "lang"), every).where("lang_pred <> lang and lang_pred <> 'und'").count()
    assert wrong <= 2 and small.languages == every.languages


@pytest.mark.parametrize("tag", ["button", "video", "select", "iframe", "noscript", "canvas", "object"])
def test_an_element_that_is_never_closed_hides_no_paragraph(tag):
    texts = lambda html: [n.text[0] for n in webpage.parse(html) if n.tag == "#text" and n.text[0]]
    assert texts(f"<body><div><p>one</p><{tag}><p>two</p><p>three</p></div></body>") == ["one", "two", "three"]
    assert texts(f"<body><div><p>one</p><{tag}>hidden <p>too</p></{tag}><p>three</p></div></body>") == ["one", "three"]


def test_decoding_equals_exhaustive_labelling():
    """The likeliest labelling that agrees along every path, over all labellings of small trees."""
    rng = np.random.default_rng(5)
    for _ in range(120):
        n = int(rng.integers(2, 8))
        nodes = [webpage.Node("body", -1)] + [webpage.Node(str(rng.choice(["div", "p", "#text"])), int(rng.integers(0, i))) for i in range(1, n)]
        for i in range(1, n):  # text runs have no children
            while nodes[nodes[i].parent].tag == "#text":
                nodes[i].parent = nodes[nodes[i].parent].parent
        logits, mixed = rng.normal(0, 2, n), rng.normal(0, 2, n)
        s, m = np.clip(logits, -4, 4), np.clip(mixed, -4, 4)
        m[[x.tag == "#text" for x in nodes]] = -np.inf
        pure = -np.logaddexp(0, m)
        own = np.stack([pure - np.logaddexp(0, -s), pure - np.logaddexp(0, s), -np.logaddexp(0, -m)], 1)
        children = collections.defaultdict(list)
        for i in range(1, n):
            children[nodes[i].parent].append(i)
        best, found = -np.inf, None
        for label in itertools.product(range(3), repeat=n):
            if any(label[nodes[i].parent] != 2 and label[i] != label[nodes[i].parent] for i in range(1, n)):
                continue
            value = sum(own[i][label[i]] for i in range(n))
            for p, below in children.items():
                if label[p] == 2:
                    value -= sum(2.0 for a, b in zip(below, below[1:]) if nodes[a].tag == nodes[b].tag and {label[a], label[b]} == {0, 1})
            if value > best + 1e-9:
                best, found = value, label
        keep = webpage.decode(nodes, logits.copy(), mixed.copy())
        assert keep.tolist() == [label == 0 for label in found]


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    wanted, ours = con.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(wanted.columns)
    # Whole numbers with nulls come as floats on one side.
    ours = ours.astype({c: "Int64" for c in columns if str(wanted[c].dtype) == "Int64"})
    sides = [d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (wanted, ours)]
    assert len(ours) and sides[0].equals(sides[1])


def test_pipeline_stages(spark):


    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER)
        seen[name] = docs.toPandas()
        docs = spark.createDataFrame(seen[name], docs.schema)
        if name != "pack":
            assert docs.columns == columns
        if name == "near_dedup":
            prints = {r.doc_id: plain_fingerprint(r.text) for r in before.collect()}
            pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
            classes = plain_components(pairs, prints)
            assert sorted(seen[name].doc_id) == sorted(set(classes.values()))
        if name == "substring_dedup":
            texts = [r.text for r in before.collect()]
            wanted = [k.decode("utf-8", "ignore") for k, _, _ in plain_cut([t.encode() for t in texts])]
            assert sorted(seen[name].text) == sorted(wanted)
    packed_well(seen["pack"])
    assert len(corpus_pipeline.run(spark, FOLDER).toPandas()) == len(seen["pack"])


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    extra = odd.withColumn("covers", F.lit("x")).withColumn("_ident", F.lit(1)).withColumn("p0", F.lit(2.0))
    for name, docs in (("odd", extra), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
        assert (rows.count() > 0) == (name == "odd")


def test_toxicity_equals_a_plain_scorer(spark):
    """Every text by itself, word by word and filter place by filter place."""
    rng = np.random.default_rng(6)
    model = toxicity.ConvModel(
        rng.normal(0, 0.3, (64, 5)).astype(np.float32), [rng.normal(0, 0.5, (w, 5, 4)).astype(np.float32) for w in (1, 2, 3)],
        [rng.normal(0, 0.1, 4).astype(np.float32) for _ in range(3)], rng.normal(0, 0.5, 12).astype(np.float32), np.array([0.2], np.float32), {"": 0.3, "en": -0.4},
    )
    model.embedding[0] = 0
    languages = language.train(spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([("the cat and dog", "en"), ("der hund und die katze", "de")] * 5)], "doc_id long, text string, lang string"))
    texts = ["the cat, the dog!", "der Hund", None, "", "a" * 50, "the " * 300, "und the die"]

    def plain(text):
        words = (text or "").lower().split()
        units = []
        for w in words:
            w = w.strip(toxicity._EDGES) or w
            parts = [w] + [w[:n] + "*" for n in toxicity.STEMS if len(w) > n]
            units.append(sum(model.embedding[zlib.crc32(p.encode()) % 63 + 1].astype(float) for p in parts))
        units += [np.zeros(5)] * 6
        values = []
        for f, b in zip(model.filters, model.bias):
            answers = [sum(units[i + d] @ f[d].astype(float) for d in range(len(f))) for i in range(len(words) + 3)]
            values += np.maximum(np.max(answers, axis=0) + b, 0).tolist()
        logit = np.dot(values, model.weights.astype(float)) + float(model.intercept[0])
        name = language.Scorer(languages).predict_all([text])[0][0]
        return 1 / (1 + math.exp(-(logit - model.thresholds.get(name, model.thresholds[""]))))

    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, languages).collect()
    for r in rows:
        assert r.score == pytest.approx(plain(texts[r.doc_id]), abs=1e-4) and r.predicted == (r.score >= 0.5)
