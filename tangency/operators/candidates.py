"""Compaction of raw hits to candidates, density, recall, conservation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("object", "patch", "proxy")
KEY = ("query_id", "slab_id", "object_a", "patch_a", "object_b", "patch_b", "type_a", "type_b")
#: Hit counts are held in 32 bits; more is an error, not a wrap.
MOST_HITS = 2**32 - 1


def canonical(hits: DataFrame) -> DataFrame:
    """Each hit with its sides in order of (object, patch, proxy)."""
    swap = F.struct(*[f"{s}_a" for s in SIDES]) > F.struct(*[f"{s}_b" for s in SIDES])
    out = {}
    for s in (*SIDES, "type"):
        a, b = F.col(f"{s}_a"), F.col(f"{s}_b")
        out[f"{s}_a"], out[f"{s}_b"] = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return hits.withColumns(out)


def compact(hits: DataFrame) -> DataFrame:
    """One candidate per key: hits added, motion bounds' element-wise maxima, flags or-ed, raw_hits the rows merged.

    candidate_id numbers the candidates of a query from 1 in key order.
    """
    bound = [F.max(F.col("motion_bound")[i]) for i in range(4)]
    rows = canonical(hits).groupBy(*KEY).agg(
        F.count("*").alias("raw_hits"), F.sum("hit_count").alias("hit_count"), F.array(*bound).alias("motion_bound"), F.bit_or("flags").alias("flags")
    )
    over = F.raise_error(F.lit("hit count exceeds 32 bits")).cast("long")
    rows = rows.withColumn("hit_count", F.when(F.col("hit_count") > MOST_HITS, over).otherwise(F.col("hit_count")))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(*KEY[1:]))
    return rows.withColumn("candidate_id", number.cast("long"))


def ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _proxy_counts(proxies: DataFrame) -> DataFrame:
    """Per query its proxies, slabs, objects and cross-object pairs, these from group sizes: per slab (n^2 - sum n_o^2) / 2."""
    # Without null queries, which the joins leave out, the proxies are dealt out as the pairs' spheres are, once for both.
    own = proxies.where("query_id is not null").groupBy("query_id", "slab_id", "object_id").agg(F.count("*").alias("n"))
    slabs = own.groupBy("query_id", "slab_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    pairs = slabs.groupBy("query_id").agg(
        F.sum("n").alias("proxy_count"), F.count("*").alias("slab_count"),
        F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).cast("long").alias("pair_count"),
    )
    return pairs.join(own.groupBy("query_id").agg(F.countDistinct("object_id").alias("object_count")), "query_id")


def _ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "raw_hits_per_proxy": ratio(F.col("raw_hit_count"), F.col("proxy_count")),
            "candidates_per_proxy": ratio(F.col("candidate_count"), F.col("proxy_count")),
            "candidates_per_slab": ratio(F.col("candidate_count"), F.col("slab_count")),
            "overlap_ratio": ratio(F.col("raw_hit_count"), F.col("pair_count")),
            "hits_per_candidate": ratio(F.col("_hits"), F.col("candidate_count")),
        }
    ).drop("_hits")


def density(proxies: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per query, from its proxies and compacted candidates: counts and ratios."""
    kept = candidates.groupBy("query_id").agg(F.sum("raw_hits").alias("raw_hit_count"), F.count("*").alias("candidate_count"), F.sum("hit_count").alias("_hits"))
    return _ratios(_proxy_counts(proxies).join(kept, "query_id", "left").fillna(0))


def with_density(proxies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Compacted candidates with the ``density`` of their query, whose candidates are counted in place: they are made once."""
    own = Window.partitionBy("query_id")
    rows = candidates.withColumns({"raw_hit_count": F.sum("raw_hits").over(own), "candidate_count": F.count("*").over(own), "_hits": F.sum("hit_count").over(own)})
    return _ratios(rows.join(_proxy_counts(proxies), "query_id"))


def conservation_faults(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side lacks or that either side repeats, with the kind of fault; empty: conserved."""
    keys = list(keys)
    counts = [d.groupBy(*keys).agg(F.count("*").alias(f"n_{s}")) for d, s in ((left, "left"), (right, "right"))]
    both = counts[0].join(counts[1], keys, "full").fillna(0, ["n_left", "n_right"])
    kind = F.when(F.col("n_left") == 0, "missing_left").when(F.col("n_right") == 0, "missing_right").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated")
    return both.withColumn("fault", kind).where("fault is not null")


def recall(truth: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(positives, covered, recall) of the keys of ``truth`` among those of ``found``."""
    hit = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    rows = truth.select(*keys).distinct().join(hit, list(keys), "left")
    return rows.agg(F.count("*").alias("positives"), F.count("_hit").alias("covered")).withColumn("recall", ratio(F.col("covered"), F.col("positives")))


def recall_of(truth: DataFrame, found: Column) -> DataFrame:
    """(positives, covered, recall) of the rows of ``truth``, of which those are covered where ``found``."""
    return truth.agg(F.count("*").alias("positives"), F.count_if(found).alias("covered")).withColumn("recall", ratio(F.col("covered"), F.col("positives")))
