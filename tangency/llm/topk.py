"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are integers. Equal vectors are one entry of the index. The entries
are cut into blocks of some thousand, each of vectors of like norm. A block
holds posting lists: per dimension the entries whose component is not zero, in
segments by descending quantised size of the component. A query goes through
the segments of all dimensions by descending impact, its weight times the
segment's size, and adds them to one accumulator per entry.

What an entry can still gain is at most the norm of what is unread of it times
the norm of the query over those dimensions (Cauchy-Schwarz); both are kept as
shares that shrink with every posting. A query leaves a block only on proof:
when the entries that this bound cannot rule out are cheaper to score exactly
than the next postings are to read. Those are scored exactly, so no result
rests on quantised values. A first pass over one block of each query gives a
score that its k-th best reaches, which later blocks are held against: a block
in which norms alone cannot reach it is never visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.llm.common import materialised

SCALE = 256
#: Sizes that components are quantised to within a block, and rounds of equally many postings.
LEVELS = 8
ROUNDS = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of every component; rows with a null or non-finite one are left out."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()).select("vec_id", vector.alias("vector"))


def distinct_vectors(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """(vector, ids): per distinct vector its k + 1 least ids, which are all that a result of k can need.

    Copies are ranked within ``salts`` parts of the ids first, so a vector
    that a third of all rows share is not one group.
    """
    salted = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"))
    for keys in (["vector", "salt"], ["vector"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    return salted.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Block:
    """Entries of one block and their posting segments; ``read`` counts the postings that queries have read.

    Segment s holds the entries and components ``ids[start[s]:start[s] +
    size[s]]`` of dimension ``dim[s]``, none larger than ``height[s]``.
    """

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS, rounds: int = ROUNDS):
        self.vectors, self.rounds, self.read = vectors, rounds, 0
        n, width = vectors.shape
        sizes = np.abs(vectors)
        step = max(1, -(-int(sizes.max(initial=0)) // levels))
        entry, dim = np.nonzero(sizes)
        key = dim * levels + levels + (-sizes[entry, dim] // step)
        order = np.argsort(key, kind="stable")
        values = vectors[entry, dim].astype(np.float64)
        squares = (vectors.astype(np.float64) ** 2).sum(1)
        self.norms = np.sqrt(squares)
        self.ids, self.values = entry[order], values[order]
        self.shares = (values**2 / squares[entry])[order]
        self.size = np.bincount(key, minlength=width * levels)
        self.start = np.cumsum(self.size) - self.size
        self.dim = np.repeat(np.arange(width), levels)
        self.height = np.tile((levels - np.arange(levels)) * float(step), width)

    def best(self, query: np.ndarray, k: int, line: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores) of all that may be among the ``k`` best of the block and reach ``line``, ties included."""
        n, width = self.vectors.shape
        q = query.astype(np.float64)
        norm2 = float(q @ q)
        reach = np.sqrt(norm2) * self.norms
        slack = 1e-9 * (1.0 + float(reach.max(initial=0.0)))
        impact = np.abs(q)[self.dim] * self.height
        order = np.argsort(-impact, kind="stable")
        order = order[(impact[order] > 0) & (self.size[order] > 0)]
        upto = np.cumsum(self.size[order])
        total = int(upto[-1]) if len(order) else 0
        share = max(1, -(-total // self.rounds))
        score, seen = np.zeros(n), np.zeros(n)
        may, at = np.arange(n), 0
        while True:
            room = reach * np.maximum(0.0, 1.0 - 0.5 * seen)
            if n >= k:
                line = max(line, float(np.partition(score - room, n - k)[n - k]))
            may = np.flatnonzero(score + room >= line - slack)
            if at == len(order) or len(may) * width <= share:
                return may, self.vectors[may] @ query
            cut = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + share)) + 1
            now = order[at:cut]
            at = min(cut, len(order))
            spans = [slice(a, a + b) for a, b in zip(self.start[now].tolist(), self.size[now].tolist())]
            weights = np.repeat(q[self.dim[now]], self.size[now])
            ids = np.concatenate([self.ids[s] for s in spans])
            self.read += len(ids)
            score += np.bincount(ids, np.concatenate([self.values[s] for s in spans]) * weights, n)
            seen += np.bincount(ids, np.concatenate([self.shares[s] for s in spans]) + weights * weights / norm2, n)


def _search_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, own = None, None, []
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keys = list(zip(*(column[c].to_pylist() for c in ("width", "level", "block"))))
            for row, here in enumerate(keys):
                if here != key:
                    vectors = column["vectors"][row].values.to_numpy(zero_copy_only=False).reshape(-1, here[0])
                    key, block, own = here, Block(vectors), column["ids"][row].as_py()
                queries = column["queries"][row].values.to_numpy(zero_copy_only=False).reshape(-1, here[0])
                out: list[tuple[int, int, int]] = []
                for query, asks, line in zip(queries, column["query_ids"][row].as_py(), column["lines"][row].as_py()):
                    # One more than k, as the query itself may be among them.
                    entries, scores = block.best(query, k + 1, -np.inf if line is None else line)
                    pairs = [(-s, i) for e, s in zip(entries.tolist(), scores.tolist()) for i in own[e] if i != asks]
                    out.extend((asks, i, -s) for s, i in sorted(pairs)[:k])
                arrays = zip(*out) if out else ((),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score long"
_PLACE = ["width", "level", "block"]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE, block_rows: int = 4096, query_rows: int = 512
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row where ``is_query`` holds.

    Best by integer inner product of the quantised vectors, ties to the
    smaller vec_id. Vectors that are null or hold a null or non-finite
    component neither ask nor answer, nor do those of a null id. Repeated rows
    count as one id; an id with two vectors asks with both and its rows are
    ranked together. Vectors of other lengths than a query's are no answer to
    it, and empty ones neither ask nor answer. Fewer than k rows: all. Other
    columns are not read. Groups of queries meet the blocks of entries that
    their scores do not rule out: the one stated query set against all rows.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    level = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 2)).otherwise(-1).cast("int")
    rows = quantised(vectors, scale).distinct().withColumn("width", F.size("vector")).where("width > 0")
    entries = materialised(distinct_vectors(rows, k).withColumn("width", F.size("vector")).withColumn("norm", norm).withColumn("level", level))
    # One row per length of vectors and half power of two of their norms.
    sizes = entries.groupBy("width", "level").agg(F.count("*").alias("n"), F.max("norm").alias("top"))
    sizes = materialised(sizes.withColumn("blocks", F.ceil(F.col("n") / block_rows)))
    entries = entries.join(sizes.select("width", "level", "blocks"), ["width", "level"])
    entries = entries.withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")))
    blocks = entries.groupBy(*_PLACE).agg(F.flatten(F.collect_list("vector")).alias("vectors"), F.collect_list("ids").alias("ids"))
    # A block is little to read and long to search: tasks by the number of blocks, not by bytes.
    n = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    tasks = max(1, min(2 * n, max(4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 8)))

    def search(asked: DataFrame) -> DataFrame:
        # Merged in order of blocks, so that a task indexes a block once for all its groups of queries.
        pairs = blocks.repartition(tasks, *_PLACE).join(asked.hint("merge"), _PLACE)
        return pairs.sortWithinPartitions(*_PLACE).mapInArrow(_search_batches(k), _FOUND)

    asking = rows.where(is_query).withColumn("norm", norm)
    lists = [F.flatten(F.collect_list("vector")).alias("queries"), F.collect_list("vec_id").alias("query_ids")]
    fullest = sizes.groupBy("width").agg(F.max_by(F.struct("level", "blocks"), F.struct("n", "level")).alias("f"))
    first = asking.join(fullest, "width").select("width", "f.level", F.pmod(F.xxhash64("vec_id"), F.col("f.blocks")).alias("block"), "vec_id", "vector")
    first = first.groupBy(*_PLACE).agg(*lists).withColumn("lines", F.transform("query_ids", lambda _: F.lit(None).cast("long")))
    lines = materialised(_ranked(search(first), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("line")))

    levels = sizes.groupBy("width").agg(F.collect_list(F.struct("level", "blocks", "top")).alias("levels"))
    groups = asking.groupBy("width").agg(F.ceil(F.count("*") / query_rows).alias("groups"))
    asked = asking.join(lines, "vec_id", "left").join(groups, "width").withColumn("group", F.pmod(F.xxhash64("vec_id"), F.col("groups")))
    asked = asked.groupBy("width", "group").agg(*lists, F.collect_list(F.struct("line", "norm")).alias("hopes"))
    asked = asked.join(levels, "width").withColumn("at", F.explode("levels"))
    open_ = F.exists("hopes", lambda h: h["line"].isNull() | (h["norm"] * F.col("at.top") * (1 + 1e-9) >= h["line"]))
    asked = asked.where(open_).select("width", "at.level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at.blocks") - 1)).alias("block"), "queries", "query_ids", F.col("hopes.line").alias("lines"))
    return _ranked(search(asked), k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
