"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame functions only. The mix has a size in words, cut into blocks of
``block_words``. The blocks go to the sources by the highest quotients
target / (2k - 1); since that order never takes a block back, cutting it into
shards gives every shard integer quotas per source. A source's documents, laid
end to end in a seeded order, are dealt to the shards in proportion to their
quotas, and a shard takes its quota of blocks from its own part of each source,
in that seeded order and up to ``max_epochs`` times over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangency.llm.common import WORD, materialised, written

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, place, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share the
    sum of all sizes. A target stops at ``max_epochs`` times its source's
    size; what is over goes to the others by weight. With sources in order of
    cap / weight, the level at each is what is left over the weights left, and
    the common level is the highest of them: then target = min(cap, level *
    weight) without iteration. The windows run over one row per source.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    rows = rows.withColumn("place", place).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - before) / left)
    level = F.max("level").over(everything)
    return rows.select("source", "place", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def shard_quotas(targets: DataFrame, block_words: int = 32, shard_blocks: int = 32_768) -> DataFrame:
    """(shard, source, place, source_size, target, before, quota): blocks of each source in each shard.

    ``before`` counts the source's blocks in earlier shards. The seats after N
    blocks are found without going through them one by one: with n sources, a
    source has at least round(target * (N - n/2) / T) and at most
    round(target * (N + n/2) / T) of them, and only the few quotients between
    are ranked. Ties go to the source that comes first. Sums per shard are
    exact; the last shard takes what is left. Sources of target 0 get none.
    """
    everything = Window.partitionBy()
    rows = targets.withColumn("total", F.sum("target").over(everything)).withColumn("n", F.count("*").over(everything))
    rows = rows.withColumn("blocks", F.ceil(F.col("total") / block_words))
    shards = F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / shard_blocks))
    rows = rows.where("total > 0").withColumn("shard", F.explode(shards))
    rows = rows.withColumn("upto", F.least("blocks", (F.col("shard") + 1) * shard_blocks))

    def seats(blocks: Column) -> Column:
        return F.floor(F.col("target") * F.greatest(blocks, F.lit(0.0)) / F.col("total") + 0.5)

    rows = rows.withColumn("low", F.greatest(seats(F.col("upto") - F.col("n") / 2) - 1, F.lit(0).cast("long")))
    rows = rows.withColumn("high", F.greatest(seats(F.col("upto") + F.col("n") / 2) + 1, F.col("low")))
    in_shard = Window.partitionBy("shard")
    rows = rows.withColumn("open", F.col("upto") - F.sum("low").over(in_shard))
    tries = rows.where("high > low and target > 0").withColumn("k", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    best = in_shard.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "place", "k")
    won = tries.withColumn("rank", F.row_number().over(best)).where("rank <= open").groupBy("shard", "place").agg(F.count("*").alias("won"))
    upto = rows.join(won, ["shard", "place"], "left").withColumn("upto_here", F.col("low") + F.coalesce("won", F.lit(0).cast("long")))
    earlier = F.coalesce(F.lag("upto_here").over(Window.partitionBy("place").orderBy("shard")), F.lit(0).cast("long"))
    return upto.withColumn("before", earlier).select(
        "shard", "source", "place", "source_size", "target", "before", (F.col("upto_here") - F.col("before")).alias("quota")
    )


def document_sizes(docs: DataFrame, seed: int, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, order), written: words of the whole text, and the seeded order as an unsigned 63-bit hash.

    Equal rows would share their place, so the nth of them has n in its hash:
    a group of copies of any size is spread over the stream. They are counted
    by the part of the table that they are in, and in each of those by row, so
    that no task orders a whole group.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = F.monotonically_increasing_id() if row is None else row
    rows = materialised(docs.select(row.alias("row"), "doc_id", "source", size.alias("size"), key.alias("key")))
    rows = rows.withColumn("part", F.shiftright("row", 33))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = before.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("key", "part").orderBy("row")) - 1
    rows = rows.withColumn("here", nth).join(before, ["key", "part"])
    order = F.shiftrightunsigned(F.when(F.col("before") + F.col("here") == 0, F.col("key")).otherwise(F.xxhash64("key", F.col("before") + F.col("here"))), 1)
    return materialised(rows.select("row", "doc_id", "source", "size", order.alias("order")))


def shard_pools(quotas: DataFrame, block_words: int) -> DataFrame:
    """(place, shard, begin, end, words): the part of its source's stream that a shard draws from, and the words it draws."""
    source = Window.partitionBy("place")
    total = F.sum("quota").over(source)
    cut = lambda blocks: F.floor(F.col("source_size") * (blocks / total))
    rows = quotas.where("quota > 0").select("place", "shard", cut(F.col("before")).alias("begin"), cut(F.col("before") + F.col("quota")).alias("end"), (F.col("quota") * block_words).alias("words"))
    return rows.where("end > begin")


def bucket_pools(pools: DataFrame, buckets: DataFrame) -> DataFrame:
    """(place, bucket, offset, pools): per bucket of a stream, from word ``offset``, the pools that it meets, in order.

    Both are cut into cells as wide as a source's pools are on average; a pair
    counts in the first cell that it shares. A bucket's list is as long as the
    bucket is in pools, whatever the source's size.
    """
    width = pools.groupBy("place").agg(F.greatest(F.ceil(F.max("end") / F.count("*")), F.lit(1).cast("long")).alias("width"))

    def cells(rows: DataFrame, low: str, high: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / F.col("width")) for c in (low, high))
        return rows.join(width, "place").withColumn("cell", F.explode(F.sequence(first, last)))

    a = cells(buckets.where("bucket_size > 0").withColumn("last", F.col("offset") + F.col("bucket_size") - 1), "offset", "last")
    b = cells(pools.withColumn("until", F.col("end") - 1), "begin", "until").drop("width")
    both = a.join(b, ["place", "cell"]).where((F.col("begin") <= F.col("last")) & (F.col("until") >= F.col("offset")))
    both = both.where(F.floor(F.greatest("begin", "offset") / F.col("width")) == F.col("cell"))
    found = both.groupBy("place", "bucket").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "words", "shard"))).alias("pools"))
    return buckets.select("place", "bucket", "offset").join(found, ["place", "bucket"], "left")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = 3,
    block_words: int = 32,
    shard_blocks: int = 32_768,
    seed: int = 7,
    bucket_rows: int = 1024,
    row: Column | None = None,
) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken, start, pools) per row of ``docs``.

    ``taken`` counts the words that the selected blocks cover, repeats
    included, never over ``max_epochs`` times ``size``; ``start`` is the
    document's place in its source's seeded stream, ``pools`` the shards' parts
    of the stream about there. ``row`` names the rows of ``docs``, without
    ties; by itself it is a number that the rows get here.

    A source may hold a third of all rows, so its stream is never one group:
    it is cut by the order hash into buckets of about ``bucket_rows`` rows,
    sums over buckets give each bucket's offset and a window only runs within
    a bucket. Null or empty texts have size 0 and nothing taken; a null source
    is a source of its own; equal rows are interchangeable, so reruns agree;
    an empty table gives no rows. Other columns are not read.
    """
    sized = document_sizes(docs, seed, row)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    targets = source_targets(per_source.select("source", "size"), weights, max_epochs)
    counts = per_source.select(F.col("source").alias("s"), F.greatest(F.ceil(F.col("rows") / bucket_rows), F.lit(1).cast("long")).alias("buckets"))
    sources = materialised(targets.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    pools = materialised(shard_pools(shard_quotas(sources.drop("buckets"), block_words, shard_blocks), block_words))

    named = sources.select(F.col("source").alias("s"), "place", "source_size", "target", "buckets")
    # The top 31 bits of the order pick the bucket, so buckets follow the order.
    bucket = F.floor(F.shiftrightunsigned("order", 32).cast("double") * F.col("buckets") / float(1 << 31))
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    offsets = rows.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0).cast("long")))
    within = Window.partitionBy("place", "bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    rows = rows.join(bucket_pools(pools, offsets), ["place", "bucket"])
    rows = rows.withColumn("start", F.col("offset") + F.col("inner"))
    return rows.withColumn("taken", words_taken(max_epochs)).select("row", "doc_id", "source", "size", "source_size", "target", "taken", "start", "pools")


def _part(pool: Column, epoch: int) -> tuple[Column, Column]:
    """The words of a document, from and to, that a pool's pass ``epoch`` (from 0) takes: the pool's first ones, all but in its last pass."""
    width = pool["end"] - pool["begin"]
    upto = pool["begin"] + F.greatest(F.lit(0).cast("long"), F.least(width, pool["words"] - width * epoch))
    low, high = F.greatest(F.col("start"), pool["begin"]), F.least(F.col("start") + F.col("size"), upto)
    return low - F.col("start"), F.greatest(low, high) - F.col("start")


def words_taken(epochs: int) -> Column:
    def own(pool: Column) -> Column:
        return sum((to - since for since, to in (_part(pool, e) for e in range(epochs))), F.lit(0).cast("long"))

    return F.coalesce(F.aggregate("pools", F.lit(0).cast("long"), lambda a, pool: a + own(pool)), F.lit(0).cast("long"))


def ranges_taken(epochs: int) -> Column:
    """Array of (since, to): the words of a document that each pass takes, whole documents as one range."""
    def of(epoch: int) -> Column:
        parts = F.transform("pools", lambda pool: F.struct(*[c.alias(n) for c, n in zip(_part(pool, epoch), ("since", "to"))]))
        parts = F.filter(parts, lambda r: r["to"] > r["since"])
        words = F.aggregate(parts, F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["since"])
        whole = F.array(F.struct(F.lit(0).cast("long").alias("since"), F.col("size").alias("to")))
        return F.when((words == F.col("size")) & (F.col("size") > 0), whole).otherwise(parts)

    return F.concat(*[of(e) for e in range(epochs)])


def mixed_documents(docs: DataFrame, max_epochs: int = 3, seed: int = 7, **options) -> DataFrame:
    """The mix as documents: one row per pass that takes a document, with the columns of ``docs``.

    A document that the last block of a shard's part of its source cuts is
    written with the words that were taken, joined by spaces; there are at most
    a few per shard and source. Documents of no words are never taken.
    ``n_chars``, if there, is counted anew for a cut text.
    """
    names = docs.columns
    # Columns go by number, so none clashes with those added here, and rows by one that is written with them.
    rows = written(docs.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(names)]).withColumn("row", F.monotonically_increasing_id()))
    own = {c: F.col(f"p{i}") for i, c in enumerate(names)}
    mixed = mix(rows.select(*[own[c].alias(c) for c in ("doc_id", "source", "text")], "row"), max_epochs=max_epochs, seed=seed, row=F.col("row"), **options)
    taken = mixed.where("taken > 0").select("row", "size", ranges_taken(max_epochs).alias("passes"))
    rows = rows.join(taken.hint("shuffle_hash"), "row").withColumn("words", F.explode("passes"))
    length = F.col("words.to") - F.col("words.since")
    cut = length < F.col("size")
    part = F.slice(F.regexp_extract_all(own["text"], F.lit(WORD), F.lit(0)), (F.col("words.since") + 1).cast("int"), length.cast("int"))
    text = F.when(cut, F.array_join(part, " ")).otherwise(own["text"])
    out = own | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[out[c].alias(c) for c in names])
