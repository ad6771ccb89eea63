"""Fill-in-the-middle: a text cut in three and put in an order that ends with its middle.

A text's units are isolated matches of the tokenizers library's Split
pre-tokenizer; nothing is trained. Its code-point offsets are the array that a
document is cut by: their number is n, and the offsets of two seeded ranks are
the ends of prefix and middle. Numbers that decide form and cuts come from the
document's id alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
class Units:
    """The code points of a text, as isolated matches of a pre-tokenizer, by rank.

    Two arrays of offsets, coarse and fine: matches of up to ``run`` units,
    and, within the one match where a rank falls or the text ends, those of
    single units. A text goes through in blocks of whole matches, so that a
    very long one never has all its offsets in memory.
    """

    def __init__(self, run: int = 64, block: int = 16_384):
        # Any one code point, line ends included.
        self.fine = pre_tokenizers.Split(Regex(r"[\s\S]"), "isolated")
        self.coarse = pre_tokenizers.Split(Regex(rf"[\s\S]{{1,{run}}}"), "isolated")
        self.run, self.block = run, -(-block // run) * run

    def runs(self, text: str, first: int) -> list[tuple[str, tuple[int, int]]]:
        """The coarse matches of the block that begins at ``first``."""
        return self.coarse.pre_tokenize_str(text[first : first + self.block])

    def count(self, text: str) -> int:
        """How many units there are: all matches but a block's last are full, and that one's fine array has a length."""
        n = 0
        for first in range(0, len(text), self.block):
            found = self.runs(text, first)
            n += (len(found) - 1) * self.run + len(self.fine.pre_tokenize_str(found[-1][0]))
        return n

    def offset(self, text: str, rank: int) -> int:
        """Where the first ``rank`` units end."""
        if rank == 0:
            return 0
        first = (rank - 1) // self.block * self.block
        part, (start, _) = self.runs(text, first)[(rank - 1 - first) // self.run]
        return first + start + self.fine.pre_tokenize_str(part)[(rank - 1) % self.run][1][1]


def arranged(prefix: str, middle: str, suffix: str, form: str, marks: Sequence[str] = MARKS) -> str:
    p, s, m = marks
    return f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"


def _transformed_batches(marks: Sequence[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            texts, forms, one, two = (batch.column(c) for c in ("text", "form", "h1", "h2"))
            rows, since, size = [], 0, 0
            for i in range(batch.num_rows):
                text, form = texts[i].as_py(), forms[i].as_py()
                n = units.count(text)
                if form == "plain":
                    rows.append((n, None, None, text))
                else:
                    low, high = sorted((one[i].as_py() % (n + 1), two[i].as_py() % (n + 1)))
                    a, b = (units.offset(text, rank) for rank in (low, high))
                    rows.append((n, a, b - a, arranged(text[:a], text[a:b], text[b:], form, marks)))
                size += len(text)
                if size > most or i == batch.num_rows - 1:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                    ids = batch.column("doc_id").slice(since, len(rows))
                    yield pa.RecordBatch.from_arrays([ids, columns[0], forms.slice(since, len(rows)), *columns[1:]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    rows, since, size = [], i + 1, 0

    return run


def transformed(
    docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: Sequence[str] = MARKS, batch_chars: int = 4_000_000
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs``.

    ``percent`` of the documents are transformed, ``spm_percent`` of these with
    the suffix first. Empty texts and texts that hold a mark stay plain, as
    their parts could not be told apart. A null text counts as empty; a null
    doc_id is hashed as no digits and stays null. Repeated rows give repeated
    rows, an empty table none. A text of any length is worked on whole, its
    offsets in blocks. Other columns are not read. Rows never meet, so there
    is no exchange.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (number(2) % 100 >= percent), "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), number(0).alias("h1"), number(1).alias("h2"))
    longs = [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), *longs, T.StructField("output", T.StringType())])
    return rows.mapInArrow(_transformed_batches(tuple(marks), batch_chars), schema)


def restored(output: Column | str, form: Column | str, marks: Sequence[str] = MARKS) -> Column:
    """The text, rebuilt from output and form alone.

    Marks begin and end with characters of their own and the text holds none,
    so the first of each is where it was put.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks

    def after(mark: str) -> Column:
        return F.substr(output, F.position(F.lit(mark), output) + len(mark))

    middle = after(m)
    psm = F.concat(F.substring_index(after(p), s, 1), middle, F.substring_index(after(s), m, 1))
    spm = F.concat(F.substring_index(after(p), m, 1), middle, F.substring_index(after(s), p, 1))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


#: The same in DuckDB; the rebuilt text must be the text.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), r AS (
  SELECT doc_id, t, n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
           OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT doc_id, n, form, t, least(a, b) AS lo, greatest(a, b) AS hi,
    substr(t, 1, least(a, b)) AS prefix, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix
  FROM r
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
