"""Exact removal of long byte strings that occur elsewhere, by suffix arrays.

No one suffix array over the corpus is built. Every window of ``LENGTH`` bytes
is named by an anchor inside it: the 32-byte gram of least hash. Equal windows
have equal anchors at the same place, so windows only meet within the groups
of one anchor. Consecutive windows with one anchor are a run; a run and the
bytes that its windows cover are its context.

1. Anchors that occur once are dropped: their windows are unique.
2. Equal contexts are counted together (a group of copies is one context).
   Runs whose context occurs more than once are repeated as a whole.
3. Where an anchor has different contexts, each is written as a string of
   32-byte blocks in step with the anchor. A suffix array over the blocks of
   many contexts and its longest common prefixes give the block strings that
   repeat; a window repeats if its whole blocks do and the bytes around them,
   fewer than a block at either end, are the same too.

Anchors, contexts and ends are compared by 64-bit hashes within their group;
whole blocks are compared as they are.

An anchor found very often is divided by further anchors first, equal parts
again counted together, so that no group of step 3 grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.llm.common import hot_join, materialised
from tangency.llm.suffix import common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
BLOCK = 32
#: Texts are scanned in joined portions of about this many bytes.
_PORTION = 1 << 17
_TILE = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM-byte string of ``data``, by doubling."""
    h, step, m = data.astype(np.uint64), 1, _MIX[0]
    while step < GRAM:
        h = h[:-step] * m + h[step:]
        m, step = m * m, 2 * step
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def least_grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """Per window of ``length`` bytes the place of its gram of least hash (its upper half), the leftmost of equals."""
    grams = length - GRAM + 1
    least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= grams:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if grams > size:
        least = np.minimum(least[: size - grams], least[grams - size :])
    return (least & _LOW).astype(np.int64)


def window_runs(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, start, bytes, anchor place in them, anchor hash, context hash) of every run of windows."""
    sizes = [len(p) for p in pieces]
    text = b"".join(pieces)
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    with np.errstate(over="ignore"):
        hashes = gram_hashes(np.frombuffer(text, np.uint8))
    at = least_grams(hashes, length)
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    piece, whole = piece_of[: len(at)], piece_of[: len(at)] == piece_of[length - 1 :]
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])])
    ends = np.r_[starts[1:], len(at)] + length - 1
    starts, ends = starts[whole[starts]], ends[whole[starts]]
    digest = xxhash.xxh64_intdigest
    contexts = np.fromiter((digest(text[i:j]) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    base = np.cumsum(sizes) - sizes
    return piece[starts], starts - base[piece[starts]], ends - starts, at[starts] - starts, hashes[at[starts]], contexts


def _run_batches(length: int):
    """The runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(pieces, idents, bases):
            piece, start, size, place, anchor, context = window_runs(pieces, length)
            start = start + np.array(bases, np.int64)[piece]
            columns = [anchor.view(np.int64), context.view(np.int64), np.array(idents, np.int64)[piece], (start << 24) | (size << 12) | place]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "ident", "pos"])

        for batch in batches:
            idents, texts = batch.column(0).to_pylist(), batch.column(1)
            pieces, owners, bases, held = [], [], [], 0
            for row, ident in enumerate(idents):
                text = texts[row].as_py() or b""
                for base in range(0, max(len(text) - length + 1, 0), _TILE):
                    pieces.append(text[base : base + _TILE + length - 1])
                    owners.append(ident)
                    bases.append(base)
                    held += len(pieces[-1])
                    if held >= _PORTION:
                        yield emit(pieces, owners, bases)
                        pieces, owners, bases, held = [], [], [], 0
            if pieces:
                yield emit(pieces, owners, bases)

    return run


def _split_batches(length: int, level: int):
    """Contexts cut by one more anchor, clear of those in ``used`` (places from the first one).

    A window in which no gram is clear is ``tied``: its part keeps the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, signed = xxhash.xxh64_intdigest, lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            columns = batch.to_pydict()
            out = []
            for key, ident, pos, single, data, used in zip(*(columns[c] for c in ("key", "ident", "pos", "single", "data", "used"))):
                start, place = pos >> 24, pos & 4095
                with np.errstate(over="ignore"):
                    hashes = gram_hashes(np.frombuffer(data, np.uint8)) * (_MIX[2] + np.uint64(2 * level))
                for other in used:
                    hashes[max(0, place + other - GRAM + 1) : max(0, place + other + GRAM)] |= ~_LOW
                at = least_grams(hashes, length)
                at = np.where(hashes[at] >= ~_LOW, -1, at)
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(at)]):
                    found = int(at[i])
                    tied = found < 0
                    own = key if tied else signed(digest(b"%d %d %d" % (key, found - place, int(hashes[found]))))
                    part = data[i : j + length - 1]
                    places = used if tied else [*used, found - place]
                    out.append((own, signed(digest(part)), ident, ((start + i) << 24) | (len(part) << 12) | (place - i), single, part, places, tied))
            arrays = zip(*out) if out else ((),) * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.bool_())
            names = ["key", "digest", "ident", "pos", "single", "data", "used", "tied"]
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names)

    return run


def _window_batches(length: int):
    """Every window of the contexts: key, its hash, and its stretch if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            for key, ident, pos, single, data in zip(*(columns[c] for c in ("key", "ident", "pos", "single", "data"))):
                n = len(data) - length + 1
                hashes = np.fromiter((xxhash.xxh64_intdigest(data[i : i + length]) for i in range(n)), np.uint64, n)
                arrays = [np.full(n, key), hashes.view(np.int64), np.full(n, ident), (((pos >> 24) + np.arange(n)) << 12) | length, np.full(n, single)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "window", "ident", "cover", "single"])

    return run


def repeated_windows(keys: list[int], places: list[int], contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of every window that another context of its group (equal key) holds too.

    ``places`` has the anchor's place in each context. Rows of a group come together.
    """
    symbols: list[int] = []
    offsets, first_block = [], []
    known: dict[tuple[int, bytes], int] = {}
    group, fresh = None, 0
    for key, place, data in zip(keys, places, contexts):
        if key != group:
            known, group = {}, key
        lead = place % BLOCK
        offsets.append(len(symbols))
        first_block.append(lead)
        step = -(place // BLOCK)
        for at in range(lead, len(data) - BLOCK + 1, BLOCK):
            block = (step, data[at : at + BLOCK])
            symbol = known.get(block)
            if symbol is None:
                known[block] = symbol = fresh
                fresh += 1
            symbols.append(symbol)
            step += 1
        symbols.append(fresh)
        fresh += 1
    text = np.array(symbols, np.int64)
    order = suffix_array(text)
    deep = length // BLOCK
    common = common_prefixes(text, order, deep)

    sizes = np.array([len(c) for c in contexts])
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    lead = np.array(first_block)[owner]
    block = -((lead - start) // BLOCK)  # blocks that begin before the window
    block = np.maximum(block, 0)
    whole = lead + block * BLOCK  # where the window's first whole block begins
    tail = whole - start
    depth = (length - tail) // BLOCK
    suffix = np.array(offsets)[owner] + block
    interval = np.empty(len(owner), np.int64)
    shared = np.zeros(len(owner), bool)
    for d in np.unique(depth).tolist():
        number = np.empty(len(text), np.int64)
        number[order] = np.cumsum(common < d)
        at = depth == d
        interval[at] = number[suffix[at]]
        shared[at] = np.bincount(number)[interval[at]] > 1
    owner, start, whole, tail, depth, interval = (x[shared] for x in (owner, start, whole, tail, depth, interval))
    if not len(owner):
        return owner, start

    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = (np.cumsum(sizes) - sizes)[owner]
    with np.errstate(over="ignore"):
        letters = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX[2]
        letters ^= letters >> np.uint64(31)
        power = np.cumprod(np.full(len(data) + 1, _MIX[0]))
        inverse = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_MIX[0]), -1, 1 << 64))))
        sums = np.r_[np.uint64(0), np.cumsum(letters[data] * power[:-1])]

        def ends(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (sums[base + j] - sums[base + i]) * inverse[base + i]

        after = whole + depth * BLOCK
        mixed = (interval * BLOCK + tail).astype(np.uint64) * _MIX[1] + ends(start, whole) * _MIX[2]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[3] + ends(after, start + length) * _MIX[4]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1]
    _, same, count = np.unique(mixed, return_inverse=True, return_counts=True)
    found = count[same] > 1
    return owner[found], start[found]


def _compare_batches(length: int, at_once: int = 8192):
    def covers(rows: list[tuple]) -> pa.RecordBatch:
        keys, idents, pos, single, data = zip(*rows)
        owner, start = repeated_windows(keys, [p & 4095 for p in pos], data, length)
        wanted = np.array(single)[owner]
        owner, start = owner[wanted], start[wanted]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]) if len(owner) else owner
        last = np.r_[first[1:], len(owner)] - 1 if len(owner) else owner
        begin = (np.array(pos, np.int64) >> 24)[owner[first]] + start[first]
        cover = (begin << 12) | (start[last] - start[first] + length)
        return pa.RecordBatch.from_arrays([pa.array(np.array(idents, np.int64)[owner[first]]), pa.array(cover)], ["ident", "cover"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if len(rows) >= at_once and row[0] != rows[-1][0]:
                    yield covers(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield covers(rows)

    return run


def with_ident(docs: DataFrame) -> DataFrame:
    """``docs`` plus _ident, a 64-bit hash of doc_id and text; equal rows share it, unequal ones never do.

    Hashes that unequal rows share, of which a table of n rows has about n^2 /
    2^65, are found by a second hash and given anew with another seed.
    """
    shared: list[list[int]] = []

    def name(salt: int):
        out = F.xxhash64("doc_id", "text")
        for i, clashes in enumerate(shared[:salt]):
            out = F.when(out.isin(clashes), F.xxhash64(F.lit(i), "doc_id", "text")).otherwise(out)
        return out

    while True:
        rows = docs.select(name(len(shared)).alias("a"), F.xxhash64(F.lit(-1), "doc_id", "text").alias("b"))
        twice = rows.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high")
        clashes = [r.a for r in twice.select("a").collect()]
        if not clashes:
            return docs.withColumn("_ident", name(len(shared)))
        shared.append(clashes)


_PART = "key long, digest long, ident long, pos long, single boolean, data binary, used array<int>, tied boolean"


def _cover(pos: str = "pos"):
    """The stretch of a run as start * 4096 + bytes."""
    return (F.shiftright(pos, 24) * 4096 + F.shiftright(pos, 12).bitwiseAND(F.lit(4095).cast("long"))).alias("cover")


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    """(key, crowded): keys of more than ``most`` rows."""
    return rows.groupBy("key").count().where(F.col("count") > most).select("key", F.lit(True).alias("crowded"))


def _divided(rows: DataFrame, length: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts (key, ident, pos, single, data, used) of crowded anchors, divided until no key has over ``most``.

    Gives the rows (key, ident, pos, single, data) to compare, and frames
    (ident, cover) of what is known to repeat. Each round cuts the contexts of
    a crowded key by a further anchor; equal parts are then one row, and their
    stretches repeat as a whole. Anchors stay clear of each other, so the
    rounds end: windows without room for one more are counted by their hash.
    """
    ready, known, tied = [], [], []
    level = 0
    while True:
        parts = materialised(rows.mapInArrow(_split_batches(length, level), _PART))
        tied.append(parts.where("tied").select("key", "ident", "pos", "single", "data"))
        parts = parts.where("not tied")
        one = F.min(F.struct("ident", "pos", "single", "data", "used")).alias("one")
        merged = materialised(parts.groupBy("key", "digest").agg(F.count("*").alias("n"), one))
        # Only rows of their own: the stretches of the others are known.
        again = merged.where("n > 1").select("key", "digest")
        known.append(parts.where("single").join(again, ["key", "digest"]).select("ident", _cover()))
        single = (F.col("one.single") & (F.col("n") == 1)).alias("single")
        rows = merged.select("key", "one.ident", "one.pos", single, "one.data", "one.used")
        crowded = materialised(_crowded(rows, most))
        if crowded.isEmpty():
            ready.append(rows.select("key", "ident", "pos", "single", "data"))
            break
        flagged = materialised(hot_join(rows, crowded, ["key"], F.hash("ident", "pos"), share=4096))
        ready.append(flagged.where("crowded is null").select("key", "ident", "pos", "single", "data"))
        rows = flagged.where("crowded").drop("crowded")
        level += 1
    windows = tied[0]
    for more in tied[1:]:
        windows = windows.union(more)
    if not windows.isEmpty():
        windows = materialised(windows.mapInArrow(_window_batches(length), "key long, window long, ident long, cover long, single boolean"))
        again = materialised(windows.groupBy("key", "window").count().where("count > 1").select("key", "window"))
        known.append(windows.where("single").join(again, ["key", "window"]).select("ident", "cover"))
    out = ready[0]
    for more in ready[1:]:
        out = out.union(more)
    return out, known


def repeated_covers(docs: DataFrame, length: int = LENGTH, most: int = 20_000) -> DataFrame:
    """(_ident, covers): per row of (doc_id, _ident, _data) the stretches, as start * 4096 + bytes, that strings found elsewhere cover.

    Rows without any are absent. Stretches overlap and come in any order; one
    is less than two windows long. Anchors found over ``most`` times are
    divided by further anchors until no group has over ``most`` contexts; none
    is left out.
    """
    texts = docs.select("_ident", "_data")
    runs = texts.mapInArrow(_run_batches(length), "anchor long, context long, ident long, pos long")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    # Written first, so that both sides of the join are plain exchanges and a frequent anchor can be split.
    kind = F.when(F.col("low") == F.col("high"), 0).when(F.col("n") <= most, 1).otherwise(2)
    anchors = materialised(anchors.where("n > 1").select("anchor", kind.alias("kind")))
    shared = materialised(runs.join(anchors, "anchor"))
    cover = _cover()

    mixed = shared.where("kind > 0")
    contexts = mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("ident", "pos")).alias("one"))
    again = materialised(contexts.where("n > 1").select("anchor", "context", "n"))
    # The rows of a context that is found very often are spread.
    found = hot_join(mixed, again.drop("n"), ["anchor", "context"], F.hash("ident", "pos"), share=4096, how="inner", counts=again)
    whole = shared.where("kind = 0").select("ident", cover).union(found.select("ident", cover))

    wanted = contexts.select(F.col("anchor").alias("key"), "one.ident", "one.pos", (F.col("n") == 1).alias("single"))
    crowded = None
    if not anchors.where("kind = 2").isEmpty():
        crowded = materialised(_crowded(wanted, most))
        if crowded.isEmpty():
            crowded = None
        else:
            wanted = hot_join(materialised(wanted), crowded, ["key"], F.hash("ident", "pos"), share=4096)
    # Equal rows share an ident; either text will do. With doc_id the texts are dealt just
    # as for the cut itself, so both joins read one exchange.
    start, size = F.shiftright("pos", 24).cast("int") + 1, F.shiftright("pos", 12).bitwiseAND(F.lit(4095).cast("long")).cast("int")
    dealt = docs.select("doc_id", "_ident", "_data")
    pieces = wanted.join(dealt, F.col("ident") == F.col("_ident")).select(*wanted.columns, F.substring("_data", start, size).alias("data"), "doc_id")
    known = []
    if crowded is not None:
        rows = materialised(pieces.where("crowded").select("key", "ident", "pos", "single", "data", F.array(F.lit(0)).alias("used")))
        divided, known = _divided(rows, length, most)
        pieces = pieces.where("crowded is null").drop("crowded").union(divided.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    compared = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_batches(length), "ident long, cover long")
    for more in (*known, compared):
        whole = whole.union(more)
    return whole.groupBy(F.col("ident").alias("_ident")).agg(F.collect_set("cover").alias("covers"))


def removed_spans(covers: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs of bytes, in order, of stretches start * 4096 + bytes."""
    covers = np.sort(np.asarray(covers, np.int64))
    if not len(covers):
        return []
    starts = covers >> 12
    ends = np.maximum.accumulate(starts + (covers & 4095))
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[first].tolist(), ends[np.r_[first[1:], len(starts)] - 1].tolist()))


def cut_text(text: bytes, covers) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``text``, and the spans removed."""
    if covers is None or not len(covers):
        return text, []
    spans = removed_spans(np.asarray(covers, np.int64))
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), spans


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists, out = batch.column(1), batch.column(2), []
        for row in range(batch.num_rows):
            text = texts[row].as_py() or b""
            kept, spans = cut_text(text, lists[row].values)
            out.append((len(text), len(text) - len(kept), spans, kept))
        sizes, removed, spans, kept = zip(*out) if out else ((),) * 4
        spans = pa.array([[{"start": i, "end": j} for i, j in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that also starts anywhere
    else, in this text or another, covers it; strings are judged on the texts
    as they came in. ``spans`` are the maximal removed runs, ``kept`` the
    bytes left. Null texts count as empty; texts shorter than ``length`` stay
    whole; equal texts of that length or more are removed in every copy; a
    null doc_id stays null. An empty table gives no rows. Other columns are
    not read.
    """
    rows = with_ident(docs).select("doc_id", "_ident", F.col("text").cast("binary").alias("_data"))
    covers = repeated_covers(rows, length, most)
    rows = rows.join(covers, "_ident", "left").select("doc_id", "_data", "covers")
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())]
        + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]
    )
    return rows.mapInArrow(_cut_batches, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, most: int = 20_000) -> DataFrame:
    """``docs`` with the repeated bytes cut from text, all columns and rows kept.

    A cut may fall within a character; bytes that no longer form one go too.
    ``n_chars``, if there, is counted anew where text was cut. Null texts stay null.
    """
    names = docs.columns
    # Other columns go by number, so none clashes with those added here.
    rest = {c: f"p{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    named = with_ident(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for c, p in rest.items()])).withColumn("_data", F.col("text").cast("binary"))
    covers = repeated_covers(named.select("doc_id", "_ident", "_data"), length, most)
    rows = named.join(covers, "_ident", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("covers")
            out = [None if texts[i].as_py() is None else cut_text(texts[i].as_py(), lists[i].values)[0].decode("utf-8", "ignore") for i in range(batch.num_rows)]
            columns = {"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())} | {c: batch.column(p) for c, p in rest.items()}
            if "n_chars" in rest:
                old = columns["n_chars"]
                counts = [old[i].as_py() if lists[i].values is None else len(out[i]) for i in range(batch.num_rows)]
                columns["n_chars"] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return rows.select("doc_id", *rest.values(), F.col("_data").alias("text"), "covers").mapInArrow(run, docs.schema)
