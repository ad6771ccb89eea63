"""Chat formatting after cumulative-snapshot collapse.

A logged conversation that is a prefix of a longer one is a snapshot of it.
Every turn has a hash of its place, role and text; the exclusive or of the
hashes of the first k turns names a conversation's prefix of k turns. An
anti-join against the prefixes of longer conversations leaves the maximal
conversations, of equal ones the first, and only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.llm.common import materialised

START = "<|im_start|>"
END = "<|im_end|>"


def numbered_turns(turns: DataFrame, block: int = 1024) -> DataFrame:
    """(conv_id, place, role, text, chunk) with turns numbered from 0 in each conversation.

    Order: turn (null first), role, text. A conversation of any length is
    numbered in chunks of ``block`` turn values, with offsets from counts per
    chunk, so none is one group as a whole unless its turn values coincide.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text", chunk.alias("chunk"))
    counts = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("offset"))
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("within", F.row_number().over(within) - 1).join(counts, ["conv_id", "chunk"])
    return rows.select("conv_id", (F.col("offset") + F.col("within")).alias("place"), "role", "text", "chunk")


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """(conv_id, turns, h1, h2): the two hashes of every prefix of every conversation."""
    own = [F.xxhash64(F.lit(seed), "place", "role", F.col("role").isNull(), "text", F.col("text").isNull()).alias(f"g{seed}") for seed in (1, 2)]
    rows = numbered.select("conv_id", "chunk", "place", *own)
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("g1").alias("c1"), F.bit_xor("g2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(f"c{i}").over(earlier), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)]
    chunks = chunks.select("conv_id", "chunk", *before)
    upto = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"h{i}": F.bit_xor(f"g{i}").over(upto) for i in (1, 2)}).join(chunks, ["conv_id", "chunk"])
    return rows.select("conv_id", (F.col("place") + 1).alias("turns"), *[F.col(f"h{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations that are no prefix of a longer one; of equal ones the least id."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("turns").alias("all"))
    marked = prefixes.join(sizes, "conv_id")
    whole = marked.where(F.col("turns") == F.col("all")).groupBy("turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where(F.col("turns") < F.col("all")).select("turns", "h1", "h2").distinct()
    return whole.join(inner, ["turns", "h1", "h2"], "left_anti").select("conv_id", "turns")


def rendered_turns(turns: DataFrame, block: int = 1024) -> DataFrame:
    """(conv_id, place, n_turns, rendered) of the turns of maximal conversations.

    ``rendered`` is one turn in the chat template; a conversation's text is
    its turns by place joined by nothing. One row per turn, so no conversation
    has to fit one row. Turns keep their order by turn number; null roles are
    written as ``user`` and null texts as empty, and repeated turns stay. Texts
    are written as they are, so a text that holds a marker of the template
    shows it; tokenise such text without special tokens. Rows
    of a null conv_id belong to no conversation and are left out. An empty
    table gives no rows. Other columns are not read.
    """
    numbered = materialised(numbered_turns(turns, block))
    kept = maximal_conversations(materialised(prefix_hashes(numbered)))
    text = F.concat(F.lit(START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    return numbered.join(kept, "conv_id").select("conv_id", "place", F.col("turns").alias("n_turns"), text.alias("rendered"))


#: The same rows by comparing whole conversations as strings.
ORACLE = f"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
prefixes AS (
  SELECT conv_id, place, role, text,
         list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY place) AS turns_so_far,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM numbered),
whole AS (SELECT turns_so_far, n_turns, min(conv_id) AS conv_id FROM prefixes WHERE place = n_turns - 1 GROUP BY turns_so_far, n_turns),
inside AS (SELECT DISTINCT turns_so_far FROM prefixes WHERE place < n_turns - 1),
kept AS (SELECT conv_id, n_turns FROM whole WHERE turns_so_far NOT IN (SELECT turns_so_far FROM inside))
SELECT n.conv_id, n.place, k.n_turns,
       '{START}' || coalesce(n.role, 'user') || chr(10) || coalesce(n.text, '') || '{END}' || chr(10) AS rendered
FROM numbered n JOIN kept k USING (conv_id)
"""
