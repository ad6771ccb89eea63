"""Best-fit packing of tokenised documents by the sum of squares.

Every document becomes token ids and one end id. Only documents longer than a
sequence are cut, into whole sequences and a shorter rest. Pieces are dealt at
random into shards of some thousand sequences; in a shard they are placed from
long to short, each into the open sequence for which the sum over residual
gaps of the squared number of open sequences becomes smallest. A new sequence
is opened only if no open one has room, since sequences are to be few. What a
shard leaves part-filled is then placed again, whole, by the same rule in far
fewer shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.llm.common import materialised, per_process

SEQUENCE = 4096
END_ID = 1
_WIDTH = 4


def default_tokenizer() -> str:
    """Place of the public 49k word BPE file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the tokenizer file cuts words, and the normal form that it gives them before.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_PARTS = regex.compile(_CUT)


def cuts_as_expected(tokenizer) -> bool:
    """True if a tokenizer lower-cases, drops white space and cuts words as this module does by itself."""
    parts = json.loads(tokenizer.to_str())
    normal, cut = ((parts.get(k) or {}).get(n, []) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    regexes = [x.get("pattern", {}).get("Regex") for x in [*normal, *cut]]
    return (
        [(x["type"], r) for x, r in zip(normal, regexes)] == _NORMAL
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and regexes[len(normal)] == _CUT
        and (cut[0].get("behavior"), cut[0].get("invert")) == ("Removed", True)
        and not cut[1].get("add_prefix_space")
        and not parts.get("post_processor")
    )


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Generations(dict):
    """A cache of ``make(key)`` in two generations of at most ``most`` keys; the older one is dropped."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordCache:
    """Ids of white-space separated words as little-endian bytes.

    The tokenizer drops white space before it forms tokens and no token spans
    it, so a text's ids are those of its words one after another. A new word
    of Latin-1 letters and marks, to which normal forms make no difference, is
    cut into parts as the tokenizer would and each part is given to the BPE
    model; any other word, or one with the beginning of a special token, goes
    through the whole tokenizer. A file that cuts in another way is not taken
    apart: whole texts go through it.
    """

    def __init__(self, path: str, most: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = cuts_as_expected(self.tokenizer)
        self.letters = _byte_letters()
        self.words = _Generations(self._word, most)
        self.parts = _Generations(self._part, most // 2)

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if max(text) > "\xff" or "<|" in text:
            return self._whole(text)
        text = text.lower()
        if text.isalpha():
            return self.parts[text]
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text)))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        if not self.plain:
            return self._whole(text.decode())
        return b"".join(map(self.words.__getitem__, text.split()))


def _piece_batches(path: str | None, sequence: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_ = path or default_tokenizer()
        cache = per_process(("words", place_), lambda: WordCache(place_))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, rows, out = batch.column(1), [], []
            for row in range(batch.num_rows):
                ids = cache.ids(texts[row].as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), sequence * _WIDTH)):
                    part = ids[at : at + sequence * _WIDTH]
                    rows.append(row)
                    out.append((piece, at // _WIDTH, len(part) // _WIDTH, zlib.crc32(part)))
            piece, start, length, crc = zip(*out) if out else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's whole text; null text: empty, one piece of one id."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_piece_batches(tokenizer, sequence, end_id), schema)


def place(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, at most ``sequence``, in any order of input.

    Placing a piece of s into a gap g changes the sum of squares by
    2 * (n[g - s] - n[g]) + 2, or by 1 - 2 * n[g] if it fills the gap: so the
    best gap is the one with the least n[g - s] - n[g], where n[0] counts as
    minus one half. Ties take the smallest gap.
    """
    count = np.zeros(sequence + 1)
    count[0] = -0.5
    bins: list[list[int]] = [[] for _ in range(sequence + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        room = count[s:]
        change = np.where(room > 0, count[: len(room)] - room, np.inf)
        if s == 0 or not len(room):
            raise ValueError(f"a piece has {s} ids")
        g = int(np.argmin(change)) + s
        if change[g - s] == np.inf:
            g, b = sequence, opened
            opened += 1
        else:
            b = bins[g].pop()
            count[g] -= 1
        where[i], offset[i] = b, sequence - g
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset


def _deal(items: DataFrame, shards: int, sequence: int, round_: int) -> DataFrame:
    """``items`` plus seq, the sequence they are placed in, and at, the place in it.

    ``items`` come from a written table. An item's shard is a hash of its row
    and its place there, so a rerun deals it alike and equal rows do not meet
    in one shard. Sequences are numbered within their shard and round.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        where, at = place(group["length"].to_numpy(), sequence)
        return group.assign(seq=(round_ << 60) + group["shard"].to_numpy() * (1 << 24) + where, at=at)

    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_), F.monotonically_increasing_id(), *items.columns), F.lit(shards)).cast("long"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("seq", T.LongType()), T.StructField("at", T.LongType())])
    return dealt.groupBy("shard").applyInPandas(run, schema).drop("shard")


def pack(rows: DataFrame, sequence: int = SEQUENCE, shard_sequences: int = 1024) -> DataFrame:
    """``rows``, with a column length of 1 to ``sequence``, plus sequence_id and offset.

    Shards hold about ``shard_sequences`` sequences by the sum of all lengths,
    so tasks stay of one size as the input grows. Sequences that a shard
    leaves with a gap of 1/64 or more are dealt again, each as one item, to a
    64th as many shards. Numbers of sequences have no meaning.
    """
    rows = materialised(rows)
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, -(-total // (sequence * shard_sequences)))
    first = materialised(_deal(rows, shards, sequence, 0))
    filled = first.groupBy(F.col("seq").alias("old")).agg(F.sum("length").alias("length"))
    again = _deal(materialised(filled.where(F.col("length") <= sequence - sequence // 64)), -(-shards // 64), sequence, 1)
    again = again.select("old", F.col("seq").alias("new"), F.col("at").alias("base"))
    return first.join(again, F.col("seq") == F.col("old"), "left").select(
        *rows.columns,
        F.coalesce("new", "seq").alias("sequence_id"),
        (F.col("at") + F.coalesce("base", F.lit(0).cast("long"))).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows are
    packed as often as they come; a null doc_id stays null. An empty table
    gives no rows. Other columns are not read.
    """
    return pack(pieces(docs, tokenizer, sequence, end_id), sequence, **options)
