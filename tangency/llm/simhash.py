"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints at
three or fewer differing bits have one segment that differs by at most one
bit, so both hold the same one-wildcard variant of that segment. Variants are
an ordinary column: an equality join finds the candidates and the full
distance is verified on them. Equal fingerprints are grouped first, so a
group of copies of any size is one row in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.llm.common import hot_join, materialised
from tangency.llm.graph import components

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every ``width``-word shingle; fewer words: of them all; none: []."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the 64 bits set in over half of its hashes.

    ``hashes`` holds the documents' hashes one after another, ``counts`` how
    many each has (not 0). Eight bits of every byte lane are counted at once, over runs
    of at most 255 hashes so that no lane overflows.
    """
    first = np.cumsum(counts) - counts
    runs = (counts + 254) // 255
    run_doc = np.repeat(np.arange(len(counts)), runs)
    nth = np.arange(len(run_doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = first[run_doc] + 255 * nth
    doc_cuts = np.cumsum(runs) - runs
    out = np.zeros(len(counts), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_cuts, axis=0)
        for lane in range(8):
            out |= (2 * ones[:, lane] > counts).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def _fingerprint_batches(width: int, at_once: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            out = np.zeros(batch.num_rows, np.uint64)
            hashes, counts, rows, n = [], [], [], 0
            for row in range(batch.num_rows):
                own = shingle_hashes(texts[row].as_py() or b"", width)
                if own:
                    hashes.append(np.array(own, np.uint64))
                    counts.append(len(own))
                    rows.append(row)
                    n += len(own)
                if rows and (n >= at_once or row == batch.num_rows - 1):
                    out[rows] = majority_bits(np.concatenate(hashes), np.array(counts))
                    hashes, counts, rows, n = [], [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the 64-bit fingerprint, as a signed long, of every row's whole text, and the text's hash.

    Null, empty and white-space texts get fingerprint 0.
    """
    doc_id = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_id), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_hash().alias("text_hash")).mapInArrow(_fingerprint_batches(width), schema)


def text_hash() -> Column:
    """Tells the texts of one doc_id apart; a null text is unlike an empty one."""
    return F.xxhash64(F.lit(23), "text", F.col("text").isNull())


def _pick(value: Column, segments: int, bits: int, index: Column) -> Column:
    """One-wildcard variant ``index`` of ``value``: segment index // bits without bit index % bits."""
    shift = F.lit(segments * bits - bits) - F.floor(index / bits) * bits
    segment = F.call_function("shiftrightunsigned", value, shift.cast("int")).bitwiseAND(F.lit((1 << bits) - 1))
    wildcard = F.call_function("shiftleft", F.lit(1).cast("long"), (index % bits).cast("int"))
    return segment.bitwiseAND(F.bitwise_not(wildcard))


def _first_shared(diff: Column, segments: int, bits: int) -> Column:
    """The least variant index that two values with XOR ``diff`` share; null if none."""
    cases = []
    for s in range(segments):
        part = F.call_function("shiftrightunsigned", diff, F.lit((segments - 1 - s) * bits)).bitwiseAND(F.lit((1 << bits) - 1))
        bit = F.when(part == 0, F.lit(0)).otherwise(F.bit_count(part - 1))
        cases.append(F.when(F.bit_count(part) <= 1, bit + s * bits))
    return F.coalesce(*cases)


#: Bits of the two segments that a fingerprint, and then the segment that a crowded variant leaves open, is cut into.
LEVELS = (32, 16, 8)


def _other(value: Column, index: Column, bits: int) -> Column:
    """The segment of the two of ``bits`` in ``value`` that variant ``index`` does not come from."""
    return F.when(index < bits, value.bitwiseAND(F.lit((1 << bits) - 1))).otherwise(F.call_function("shiftrightunsigned", value, F.lit(bits)))


def hamming_links(fps: DataFrame, bucket: int = 1024) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs ``fp`` at distance 3 or less, once each.

    A variant held by more than ``bucket`` fingerprints is not compared within
    itself: its members already agree on 31 bits, so the other half is cut
    again into two segments of 16, of which one differs by at most one bit,
    and the same one-wildcard variants of those are joined instead; what is
    crowded there is cut once more, by segments of 8. Then 11 bits are left
    open, so no group holds more than 2,048 fingerprints. Nothing is dropped:
    a pair is emitted at the first variant it shares on every level. How many
    hold a variant is counted by groups and joined back; the fingerprints of a
    hot variant are spread for that.
    """
    # Dealt out again, as a row becomes 64: adaptive execution would leave few tasks for so small a table.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialised(fps.select("fp").where("fp is not null").distinct().repartition(tasks, "fp")).withColumn("rest", F.col("fp"))
    keys, found = [], None
    for level, bits in enumerate(LEVELS):
        index, key = F.col(f"i{level}"), f"k{level}"
        every = rows.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.lit(2 * bits - 1))).alias(f"i{level}"))
        every = every.withColumn(key, _pick(F.col("rest"), 2, bits, index).bitwiseOR(index.cast("long") * F.lit(1 << bits)))
        keys.append(key)
        counts = materialised(every.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
        last = level == len(LEVELS) - 1
        crowded = F.lit(False) if last else F.col("n") > bucket
        sized = hot_join(every, counts, keys, F.hash("fp"), share=1 << 16, how="inner", counts=counts)
        indexes = [f"i{m}" for m in range(level + 1)]
        calm = sized.where(~crowded)
        left, right = calm.select(*keys, *indexes, F.col("fp").alias("a")), calm.select(*keys, F.col("fp").alias("b"))
        diff = F.col("a").bitwiseXOR(F.col("b"))
        near, part = F.bit_count(diff) <= 3, diff
        for m in range(level + 1):
            near = near & (F.col(f"i{m}") == _first_shared(part, 2, LEVELS[m]))
            part = _other(part, F.col(f"i{m}"), LEVELS[m])
        pairs = left.join(right, keys).where((F.col("a") < F.col("b")) & near).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        if last or counts.where(crowded).isEmpty():
            return found
        rows = sized.where(crowded).select(*keys, *indexes, "fp", _other(F.col("rest"), index, bits).alias("rest"))
    return found


def _labelled(docs: DataFrame, width: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), written, and (fp, component): the least fingerprint that each is linked to."""
    rows = materialised(fingerprints(docs, width))
    groups = rows.select("fp").distinct()
    found = components(hamming_links(groups, bucket)).select(F.col("node").alias("fp"), "component")
    return rows, groups.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, width: int = 3, bucket: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of three or fewer
    differing bits; rows with equal fingerprints are linked. Null, empty and
    blank texts have fingerprint zero and are linked like others; a null
    doc_id stays, and never is a component_id unless all its component has
    null ids. Repeated rows stay repeated. An empty table gives no rows. Other
    columns are not read.
    """
    rows, labels = _labelled(docs, width, bucket)
    known = rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(labels, "fp")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labels.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, width: int = 3, bucket: int = 1024) -> DataFrame:
    """One row of each near-duplicate component: the least doc_id, nulls last, and of its texts there the least hash.

    Every component keeps a row, whatever its ids: rows of one doc_id that are
    no near copies stay each for its own component, and of rows without a
    doc_id one stays if the component has none with. Of equal rows one stays.
    """
    rows, labels = _labelled(docs, width, bucket)
    row = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"))
    # Least rows per fingerprint first, so a group of copies is one row where components meet.
    first = rows.groupBy("fp").agg(F.min(row).alias("row")).join(labels, "fp").groupBy("component").agg(F.min("row").alias("row"))

    def key(doc_id: Column, digest: Column) -> list[Column]:
        return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), digest.alias("digest")]

    keys = ["no_id", "id", "digest"]
    copies = rows.groupBy(*key(F.col("doc_id"), F.col("text_hash"))).agg(F.count("*").alias("copies")).where("copies > 1")
    kept = materialised(first.select(*key(F.col("row.b"), F.col("row.c"))).distinct().join(copies, keys, "left"))
    # Columns go by number, so none clashes with those added here. Texts stream past a table of the
    # keys; only if a row to keep comes more than once are equal rows made one, in an aggregate.
    names = [F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(docs.columns)]
    named = docs.select(*names, *key(F.col("doc_id"), text_hash()))
    found = named.join(kept.where("copies is null").hint("shuffle_hash"), keys, "left_semi")
    again = kept.where("copies is not null")
    if not again.isEmpty():
        found = found.union(named.dropDuplicates(keys).join(again, keys, "left_semi").select(*found.columns))
    return found.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(docs.columns)])
