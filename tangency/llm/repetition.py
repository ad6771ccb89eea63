"""Quality rules by repetition within a text, from suffix arrays over words.

Many texts are sorted at once: a symbol stands for a word of one text, so no
match leaves its text, and every text ends in a symbol of its own. The suffix
array comes from prefix doubling, in which only suffixes that still share
their rank take part; the ranks of each step are kept and give the longest
common prefixes. Each suffix's longest repeat is the larger of the prefixes
shared with its neighbours, that is the deepest LCP interval it lies in; the
union of these maximal repeats is what repeats in the text. The same is done
with the marks of the words alone: a text whose words all end in the same few
symbols repeats itself there, whatever its letters are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 8
#: Least words of the repeats that the verdict looks at; shorter than those of the base rules.
SHORT = 3
_SYMBOLS = "#*$%&|<>"
#: What is left of a word without letters and digits is no mark if it is made of these, or one exclamation mark.
_ORDINARY = b".,;:?'\"()-"
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum())


def word_marks(words: list[bytes]) -> list[bytes]:
    """The first symbol of each word's mark, empty without one."""
    found: dict[bytes, bytes] = {}

    def mark(word: bytes) -> bytes:
        rest = word.translate(None, _LETTERS)
        return b"" if rest == b"!" or not rest.strip(_ORDINARY) else rest.strip(_ORDINARY)[:1]

    return [found[w] if w in found else found.setdefault(w, mark(w)) for w in words]


def word_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``symbols``, whose last is unique, and the ranks by the first 1, 2, 4, ... symbols."""
    n = len(symbols)
    _, dense, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[dense]
    levels = [rank]
    shared = np.flatnonzero(counts[dense] > 1)
    step = 1
    while len(shared):
        key = rank[shared] * n + rank[shared + step]
        order = np.argsort(key, kind="stable")
        shared, key = shared[order], key[order]
        old = rank[shared]
        new_class = np.r_[True, old[1:] != old[:-1]]
        new_key = np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(shared))
        place = old + index - np.maximum.accumulate(np.where(new_class, index, 0))
        first = np.maximum.accumulate(np.where(new_key, index, 0))
        rank = rank.copy()
        rank[shared] = place[first]
        levels.append(rank)
        sizes = np.diff(np.r_[np.flatnonzero(new_key), len(shared)])
        shared = shared[np.repeat(sizes, sizes) > 1]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """Per place the length of the longest string from there that also starts elsewhere."""
    order, levels = word_suffixes(symbols)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    common = np.zeros(len(pairs), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        rank = levels[depth]
        common += (rank[a + common] == rank[b + common]).astype(np.int64) << depth
    out = np.zeros(len(symbols), np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def repeat_measures(texts: list[list[bytes]], least: int = WINDOW, short: int | None = None) -> list[tuple[int, int, int]]:
    """Per text (of words): words in repeats of ``least`` or more words, bytes of words in those of ``short`` (or ``least``) or more, and the longest repeat in words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    symbols = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    lengths = np.zeros(len(symbols), np.int64)
    fresh, at = 0, 0
    for words in texts:
        number: dict[bytes, int] = {}
        symbols[at : at + len(words)] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        symbols[at : at + len(words)] += fresh
        lengths[at : at + len(words)] = np.fromiter(map(len, words), np.int64, len(words))
        symbols[at + len(words)] = fresh = fresh + len(number)
        fresh, at = fresh + 1, at + len(words) + 1
    if not len(symbols):
        return []
    repeats = longest_repeats(symbols)

    def inside(least: int) -> np.ndarray:
        starts = np.flatnonzero(repeats >= least)
        edge = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + repeats[starts], -1)
        return np.cumsum(edge[:-1]) > 0

    covered = inside(least)
    shorter = covered if short is None else inside(short)
    first = ends - sizes
    return list(
        zip(
            np.add.reduceat(covered.astype(np.int64), first).tolist(),
            np.add.reduceat(np.where(shorter, lengths, 0), first).tolist(),
            np.maximum.reduceat(repeats, first).tolist(),
        )
    )


def _measure_batches(most_covered: float, most_longest: float, most_marked: float, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(1)
            held: list[list[bytes]] = []
            partial: list[tuple] = []
            n = 0
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                data = text.encode()
                words = data.split()
                chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
                lines = [x for x in data.split(b"\n") if x and not x.isspace()]
                partial.append((len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines))))
                held.append(words)
                n += len(words) + 1
                if n >= at_once or row == batch.num_rows - 1:
                    measures = zip(partial, repeat_measures(held, short=SHORT), repeat_measures([word_marks(w) for w in held], least=SHORT), held)
                    for (size, *base), (covered, covered_bytes, longest), (_, marked, _), w in measures:
                        failed = size < 20 or 100 * covered > 30 * size
                        share, marked = covered_bytes / max(1, sum(map(len, w))), marked / max(1, size)
                        kept = not failed and share <= most_covered and longest <= max(2 * WINDOW, most_longest * size) and marked <= most_marked
                        out.append((size, *base, covered, failed, kept, share, longest, marked))
                    held, partial, n = [], [], 0
            columns = list(zip(*out)) if out else [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *_NAMES])

    return run


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_share", "longest_repeat", "mark_share")


def quality(docs: DataFrame, most_covered: float = 0.3, most_longest: float = 0.15, most_marked: float = 0.1, at_once: int = 400_000) -> DataFrame:
    """Per row of ``docs``: the base counts, base_failed, kept, repeat_share, longest_repeat (words) and mark_share.

    A repeat is a maximal string of words found twice or more in the text. A
    text is kept if the base rules pass, repeats of 3 or more words cover at
    most ``most_covered`` of its bytes in words (repeat_share), the longest
    repeat is at most ``most_longest`` of its words (16 words always pass), and
    the words whose marks repeat, 3 or more words on end, are at most
    ``most_marked`` of all (mark_share). The bounds were set on the labelled
    rows of 10,000 documents. A null text has
    no words and fails; a null doc_id stays. Whole texts are read; an empty
    table gives no rows. Other columns are not read.
    """
    longs = [T.StructField(c, T.LongType()) for c in _NAMES[:5]]
    flags = [T.StructField(c, T.BooleanType()) for c in _NAMES[5:7]]
    rest = [T.StructField("repeat_share", T.DoubleType()), T.StructField("longest_repeat", T.LongType()), T.StructField("mark_share", T.DoubleType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs, *flags, *rest])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_measure_batches(most_covered, most_longest, most_marked, at_once), schema)
