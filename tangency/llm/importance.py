"""Importance resampling towards a target distribution.

Runs of words are hashed to buckets. How much more frequent a bucket is in the
target texts than in the documents is its gain, an array of one long per
bucket; a document's weight is the mean of its features' gains, taken from
that array. Seeded Gumbel noise makes the highest scores a draw without
replacement. The score of the last row drawn is found by a distributed radix
selection: histograms of one 16-bit digit of the composite key after another,
each over the rows that agree with the digits found so far. Only the rows
drawn are then sorted, by range, and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.llm.common import materialised

#: Of UTF-8 bytes: digits, letters in lower case and all beyond ASCII belong to words, what is left parts them.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LEAST = -(1 << 63)


def words(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def feature_buckets(own: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` words, repeats included."""
    runs = own
    found = [zlib.crc32(w) for w in own]
    for n in range(2, longest + 1):
        runs = [a + b" " + b for a, b in zip(runs, own[n - 1 :])]
        found += map(zlib.crc32, runs)
    return np.array(found, np.int64) % buckets


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("text").cast("binary").alias("text"))


def bucket_counts(df: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts each bucket holds.

    Every task adds up its own array; arrays meet by bucket in a sum, so what
    is shuffled and what the driver gets is bounded by the number of buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                own = words(text.as_py() or b"")
                if own:
                    total += np.bincount(feature_buckets(own, longest, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = _texts(df).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(smoothed share in the target / smoothed share in the corpus)), in doubles."""
    buckets = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a text's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own = words(text.as_py() or b"")
                held = feature_buckets(own, longest, len(gain))
                rows.append((len(own), len(held), int(gain[held].sum()) // len(held) if len(held) else 0))
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, numbers.T)], ["doc_id", "n_words", "n_features", "weight"])

    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return _texts(docs, "doc_id").mapInArrow(run, T.StructType([docs.schema["doc_id"], *longs]))


def noise(key: Column, seed: int) -> Column:
    """Seeded Gumbel noise of a row in thousandths, floored; a null key is hashed as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(share)))


def least(rows: DataFrame, keys: Sequence[Column], k: int, bits: int = 16) -> Column:
    """Condition that the ``k`` rows of least composite key meet; ``keys`` are longs without nulls.

    A digit at a time, from the highest: the rows that agree with the digits
    found so far are counted by their next one, and the counts, at most
    2 ** ``bits`` of them, tell which digit the k-th key has. Digits that all
    rows share are passed over, and the search ends as soon as a digit's rows
    are all needed. If rows of equal keys would have to be
    parted, ValueError.
    """
    if k <= 0:
        return F.lit(False)
    ends = rows.agg(*[f(key).alias(f"{n}{i}") for i, key in enumerate(keys) for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return F.lit(True)
    below, equal, left = F.lit(False), F.lit(True), k
    for i, key in enumerate(keys):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        # The distance from the least value, if a long holds it; else the order of unsigned longs.
        narrow = high - low < 1 << 63
        digits = key - F.lit(low).cast("long") if narrow else key.bitwiseXOR(F.lit(_LEAST).cast("long"))
        size = (high - low).bit_length() if narrow else 64
        found = 0
        for shift in range(-(-size // bits) * bits - bits, -1, -bits):
            digit = F.shiftrightunsigned(digits, shift).bitwiseAND((1 << bits) - 1)
            agree = equal if shift + bits >= 64 else equal & (F.shiftrightunsigned(digits, shift + bits) == found)
            counts = rows.where(agree).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).toArrow().sort_by("digit")
            upto = np.cumsum(counts["n"].to_numpy())
            at = int(np.searchsorted(upto, left))
            mine, before = int(counts["n"][at].as_py()), int(upto[at - 1]) if at else 0
            found, left = found << bits | counts["digit"][at].as_py(), left - before
            if left == mine:
                # An unsigned prefix of less than 64 bits is never negative; a whole word is compared as stored.
                return below | (equal & (_prefix(digits, shift, narrow) <= _value(found, shift, narrow)))
        below, equal = below | (equal & (_prefix(digits, 0, narrow) < _value(found, 0, narrow))), equal & (_prefix(digits, 0, narrow) == _value(found, 0, narrow))
    raise ValueError("the k-th key is held by more rows than are left to draw")


def _prefix(digits: Column, shift: int, narrow: bool) -> Column:
    """``digits`` without its last ``shift`` bits, in an order that signed comparison keeps."""
    return F.shiftrightunsigned(digits, shift) if narrow or shift else digits.bitwiseXOR(F.lit(_LEAST).cast("long"))


def _value(found: int, shift: int, narrow: bool) -> Column:
    return F.lit(found if narrow or shift else found + _LEAST).cast("long")


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` plus rank, 1, 2, 3 ... in the order of these columns.

    Sorted by range; a row's rank is the sum of the sizes of the ranges before
    it, of which there are as many as partitions, and its place in its own.
    """
    placed = materialised(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(firsts), "part").select(*rows.columns, rank.alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of ``docs``; rank is null where a row is not drawn.

    Of the N documents of ``least_words`` words or more, floor(``percent`` * N
    / 100) with the highest scores are drawn, ties to the smaller doc_id, a
    null id last. Equal rows are each a document of their own: they share a
    score and get ranks of their own. Null and empty texts have no features
    and weight 0. An empty target leaves smoothing alone to decide, an empty
    ``docs`` gives no rows. doc_id must be a whole number. Other columns are
    not read.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Numbered once written, so that equal rows can be told apart.
    rows = materialised(rows.withColumn("row", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("n_features"), F.col("row")]
    drawn = (F.col("n_words") >= least_words) & least(able, keys, k)
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    best = ranked(rows.where(drawn).select("*", *named), [f"k{i}" for i in range(len(keys))])
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return best.select(*columns, "rank").union(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


#: The same in DuckDB; crc32 from its bitwise rule, over the bytes of every distinct word.
ORACLE = r"""
WITH RECURSIVE bits(b, v, i) AS (
  SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8
), crc AS (
  SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), used AS (
  SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(w) AS word FROM texts) GROUP BY ALL
), bytes AS (
  SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT word FROM used)
), bucket AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS k
  FROM bytes, crc
), counts AS (
  SELECT k, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM used JOIN bucket USING (word) GROUP BY k
), full_counts AS (
  SELECT CAST(range AS BIGINT) AS k, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t
  FROM range(10000) LEFT JOIN counts ON counts.k = range
), gain AS (
  SELECT k, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM full_counts
), sums AS (
  SELECT r, sum(n * g) AS total FROM used JOIN bucket USING (word) JOIN gain USING (k) WHERE side = 0 GROUP BY r
), weighed AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features,
    CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(CAST(total AS DOUBLE) / len(w)) END AS BIGINT) AS weight
  FROM texts LEFT JOIN sums USING (r) WHERE side = 0
), scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM weighed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank
FROM placed
"""
