"""Per-group ranking with early stop, top-k proposals and fallback, as windows.

A group may hold a third of all rows. Where every row needs a rank it ranks in
one sort that spills; where the first rows or hits do, they are heaps and
aggregates, which combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.functions import geometry as g
from tangency.operators.heaps import first_rows
from tangency.sources.views import checkpointed


#: The order of a schedule as columns, and whether they descend.
ORDER = (("priority", True), ("cost", False), ("candidate_id", False))


def order_window(group: str = "query_id"):
    """Priority down, cost up, then input order."""
    return Window.partitionBy(group).orderBy(F.col("priority").desc(), "cost", "candidate_id")


def ranked(candidates: DataFrame, group: str = "query_id") -> DataFrame:
    return candidates.withColumn("rn", F.row_number().over(order_window(group)))


def reordered(candidates: DataFrame, group: str = "query_id") -> DataFrame:
    """Per group how many candidates the schedule moves from their input place."""
    before = F.row_number().over(Window.partitionBy(group).orderBy("candidate_id"))
    moved = ranked(candidates, group).withColumn("_before", before)
    return moved.groupBy(group).agg(F.count_if(F.col("rn") != F.col("_before")).alias("reordered"), F.count("*").alias("candidates"))


def positive_cost(cost: str, fallback):
    c = F.col(cost)
    return F.when(c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf")), fallback).otherwise(c)


#: A group of more rows than this is not ranked in one sort.
MOST_RANKED = 200_000


def early_stop(candidates: DataFrame, limit: int = 4, threshold: float = 0.97, penalty: float = 1.0, certified: bool = False, most: int = MOST_RANKED) -> DataFrame:
    """One row per group: calls, work and outcome of a scheduled run that stops at the first proof.

    Rows run in schedule order at their narrow cost. The run stops at the
    first of: an uncertain row, from where rows run at full cost until a
    collision; a collision in the predicted interval; or, from the
    ``limit``-th attempt on, a collision outside it, which costs a full run.
    Otherwise the group is taken as free, which may be wrong; ``certified``
    runs such groups once more at full cost.

    Groups are ranked by a window; groups of more than ``most`` rows are not:
    their stops are least keys, aggregates joined back, and the ``limit``-th
    row comes from heaps. Both give the same.
    """
    rows = candidates.withColumn("full", positive_cost("full_cost", F.lit(1.0)))
    rows = rows.withColumn("narrow", positive_cost("narrow_cost", F.col("full")))
    met = g.intervals_touch(F.col("interval_t0"), F.col("interval_t1"), F.col("contact_t0"), F.col("contact_t1"))
    unsure = F.col("uncertainty") >= threshold
    rows = rows.withColumns({"_unsure": unsure, "_inside": F.col("collides") & met & ~unsure, "miss": F.col("collides") & ~met & ~unsure})
    big = candidates.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("query_id")
    if big.isEmpty():
        out = _worked(_ranked_stops(rows, limit), penalty)
    else:
        big = checkpointed(big)
        small, large = (rows.join(big, "query_id", how) for how in ("left_anti", "left_semi"))
        out = _worked(_ranked_stops(small, limit), penalty).union(_worked(_keyed_stops(large, limit), penalty))
    return _certified(out) if certified else out


def _ranked_stops(rows: DataFrame, limit: int) -> DataFrame:
    """Adds _at, a row's rank, and trip, hit, late and found, ranks of the group's first such rows."""
    rows = ranked(rows).withColumnRenamed("rn", "_at")
    group = Window.partitionBy("query_id")
    first = lambda c: F.min(F.when(c, F.col("_at"))).over(group)
    rows = rows.withColumns({"trip": first(F.col("_unsure")), "hit": first(F.col("_inside")), "late": first(F.col("miss") & (F.col("_at") >= limit))})
    return rows.withColumn("found", first(F.col("collides") & (F.col("_at") >= F.col("trip"))))


def _keyed_stops(rows: DataFrame, limit: int) -> DataFrame:
    """The same with keys that sort as ranks do, without a sort of a group."""
    rows = rows.withColumn("_at", order_key())
    heads = first_rows(rows.select("query_id", *[c for c, _ in ORDER]), ["query_id"], ORDER, limit).where(F.col("rn") == limit)
    rows = rows.join(heads.select("query_id", order_key().alias("_limit")), "query_id", "left")
    first = lambda c: F.min(F.when(c, F.col("_at")))
    ends = rows.groupBy("query_id").agg(first(F.col("_unsure")).alias("trip"), first(F.col("_inside")).alias("hit"), first(F.col("miss") & (F.col("_at") >= F.col("_limit"))).alias("late"))
    rows = rows.drop("_limit").join(ends, "query_id")
    found = rows.groupBy("query_id").agg(first(F.col("collides") & (F.col("_at") >= F.col("trip"))).alias("found"))
    return rows.join(found, "query_id")


def _worked(rows: DataFrame, penalty: float) -> DataFrame:
    """Calls, work and outcome per group of rows with their stops."""
    rows = rows.withColumn("stop", F.least("trip", "hit", "late"))
    tripped = F.coalesce(F.col("stop") == F.col("trip"), F.lit(False))
    on_hit = ~tripped & F.coalesce(F.col("stop") == F.col("hit"), F.lit(False))
    on_late = ~tripped & ~on_hit & F.col("stop").isNotNull()
    before = F.col("stop").isNull() | (F.col("_at") < F.col("stop"))
    at = F.col("_at") == F.col("stop")
    in_fallback = tripped & (F.col("_at") >= F.col("trip")) & (F.col("found").isNull() | (F.col("_at") <= F.col("found")))
    zero = F.lit(0.0)
    work = (
        F.when(before, F.col("narrow") + F.when(F.col("miss"), F.col("full") * penalty).otherwise(zero))
        .when(in_fallback, F.col("full"))
        .when(at & on_hit, F.col("narrow"))
        .when(at & on_late, F.col("narrow") + F.col("full") * (1.0 + penalty))
        .otherwise(zero)
    )
    calls = F.when(before | in_fallback | (at & on_hit), 1).when(at & on_late, 2).otherwise(0)
    fallback = F.when(in_fallback, 1).when(at & on_late & ~in_fallback, 1).otherwise(0)
    predicted = F.max(F.when(tripped, F.col("found").isNotNull()).otherwise(F.col("stop").isNotNull()))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.sum("full").alias("all_work"), F.max("collides").alias("truth"),
        F.sum(calls).alias("calls"), F.sum(work).alias("work"), F.sum(fallback).alias("fallback_calls"), predicted.alias("predicted"),
    )


def _certified(out: DataFrame) -> DataFrame:
    """Groups taken as free, run once more at full cost."""
    again = ~F.col("predicted")
    return out.withColumns(
        {
            "calls": F.col("calls") + F.when(again, F.col("candidates")).otherwise(0),
            "work": F.col("work") + F.when(again, F.col("all_work")).otherwise(0.0),
            "fallback_calls": F.col("fallback_calls") + F.when(again, F.col("candidates")).otherwise(0),
            "predicted": F.col("predicted") | F.col("truth"),
        }
    )


def order_key(priority="priority", cost="cost", number="candidate_id"):
    """A struct that sorts rows as ``order_window`` does: by its least value comes the first row, nulls and NaN alike."""
    p = F.col(priority) if isinstance(priority, str) else priority
    rest = [F.col(c) for c in (cost, number) if c is not None]
    return F.struct(p.isNull().alias("a"), (~F.coalesce(F.isnan(p.cast("double")), F.lit(False))).alias("b"), (-p).alias("c"), *[c.alias(f"d{i}") for i, c in enumerate(rest)])


def first_hits(candidates: DataFrame, key, hit="collides", group: str = "query_id") -> DataFrame:
    """Candidates with ``_key`` and ``_first``, the key of their group's first hit in that order (null without one).

    A group is never sorted or held: its first hit is an aggregate that
    combines before it shuffles, and goes back by a join that skewed groups may split.
    """
    rows = candidates.withColumn("_key", key)
    first = rows.where(hit).groupBy(group).agg(F.min("_key").alias("_first"))
    return rows.join(first, group, "left")


def any_hit(candidates: DataFrame) -> DataFrame:
    """Per group the calls until the first collision in schedule order; all of them if there is none (rank: size + 1)."""
    rows = first_hits(candidates, order_key()).groupBy("query_id")
    size, upto, truth = F.count("*"), F.count_if(F.col("_key") <= F.col("_first")), F.coalesce(F.max("collides"), F.lit(False))
    return rows.agg(size.alias("all_calls"), F.when(truth, upto).otherwise(size).alias("calls"), F.when(truth, upto).otherwise(size + 1).alias("first_rank"), F.max("collides").alias("truth"))


def certified_until_hit(candidates: DataFrame, certify, first: int = 8, group: str = "query_id") -> DataFrame:
    """Runs ``certify`` on the candidates of each group in schedule order until its first collision.

    Gives (group, all_calls, calls, evaluated, truth): ``calls`` up to the
    first collision or all, ``evaluated`` the rows that were certified. Ranks
    are taken in waves of ``first``, twice as many, and so on, each written; a
    wave certifies only groups that have not collided, so at most about twice
    the calls are spent and the rounds are the logarithm of the largest group.
    ``certify`` adds a boolean column collides.
    """
    rows = checkpointed(ranked(candidates, group))
    sizes = checkpointed(rows.groupBy(group).agg(F.count("*").alias("all_calls")))
    waves, open_, since, most = [], sizes.select(group), 0, sizes.agg(F.max("all_calls")).first()[0] or 0
    while since < most:
        upto = 2 * since + first
        wave = rows.where((F.col("rn") > since) & (F.col("rn") <= upto)).join(open_, group, "left_semi")
        wave = checkpointed(certify(wave).groupBy(group).agg(F.min(F.when(F.col("collides"), F.col("rn"))).alias("hit"), F.count("*").alias("evaluated")))
        waves.append(wave)
        open_ = wave.where("hit is null").select(group)
        since = upto
    if not waves:
        return sizes.select(group, "all_calls", F.col("all_calls").alias("calls"), F.lit(0).cast("long").alias("evaluated"), F.lit(False).alias("truth"))
    every = waves[0]
    for wave in waves[1:]:
        every = every.union(wave)
    found = every.groupBy(group).agg(F.min("hit").alias("hit"), F.sum("evaluated").alias("evaluated"))
    rows = sizes.join(found, group)
    return rows.select(group, "all_calls", F.coalesce("hit", "all_calls").alias("calls"), "evaluated", F.col("hit").isNotNull().alias("truth"))


def first_positive(candidates: DataFrame, cost: str, key=None) -> DataFrame:
    """Per group with a collision its rank in schedule order and the cost of what comes before it."""
    rows = first_hits(candidates, order_key() if key is None else key).where("_first is not null").groupBy("query_id")
    before = F.col("_key") < F.col("_first")
    return rows.agg((F.count_if(before) + 1).alias("first_rank"), F.sum(F.when(before, F.col(cost)).otherwise(0.0)).alias("cost_before"))


def top_k_then_scan(candidates: DataFrame, k: int, most: int = MOST_RANKED) -> DataFrame:
    """Per group: ``k`` proposals by priority, then, without a hit, a scan of the rest in input order.

    Groups are ranked by a window unless one has more than ``most`` rows. Then
    proposals come from heaps of ``k`` rows, so a group is never sorted; where
    none hits, the scan ends at the group's first hit in input order, which is
    an aggregate, and costs the rows up to it that were not proposed.
    """
    if candidates.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).isEmpty():
        return _ranked_then_scanned(candidates, k)
    proposals = first_rows(candidates.select("query_id", "candidate_id", "priority", "cost", "collides"), ["query_id"], ORDER, k)
    best = proposals.groupBy("query_id").agg(
        F.min(F.when(F.col("collides"), F.col("rn"))).alias("proposed"), F.count("*").alias("tried"), F.collect_list("candidate_id").alias("_own")
    )
    rows = first_hits(candidates.select("query_id", "candidate_id", "collides"), F.col("candidate_id"))
    scan = rows.groupBy("query_id").agg(F.count("*").alias("size"), F.count_if(F.col("_key") <= F.col("_first")).alias("upto"), F.max("_first").alias("_first"), F.max("collides").alias("truth"))
    out = scan.join(best, "query_id")
    skipped = F.size(F.filter("_own", lambda c: c <= F.col("_first")))
    scanned = F.when(F.col("_first").isNull(), F.col("size") - F.col("tried")).otherwise(F.col("upto") - skipped)
    return out.select(
        "query_id", F.coalesce("proposed", "tried").cast("long").alias("proposal_calls"),
        F.when(F.col("proposed").isNotNull(), F.lit(0)).otherwise(scanned).cast("long").alias("fallback_calls"), "truth",
    )


def _ranked_then_scanned(candidates: DataFrame, k: int) -> DataFrame:
    rows = ranked(candidates)
    group = Window.partitionBy("query_id")
    proposed = F.min(F.when(F.col("collides") & (F.col("rn") <= k), F.col("rn"))).over(group)
    rest = F.row_number().over(Window.partitionBy("query_id", F.col("rn") <= k).orderBy("candidate_id"))
    rows = rows.withColumns({"proposed": proposed, "rest": rest})
    scanned = F.min(F.when(F.col("collides") & (F.col("rn") > k), F.col("rest")))
    size = F.count("*")
    return rows.groupBy("query_id").agg(
        F.coalesce(F.max("proposed"), F.least(F.lit(k), size)).cast("long").alias("proposal_calls"),
        F.when(F.max("proposed").isNotNull(), F.lit(0)).otherwise(F.coalesce(scanned, F.greatest(size - k, F.lit(0)))).cast("long").alias("fallback_calls"),
        F.max("collides").alias("truth"),
    )


def with_predictions(candidates: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Left join of predictions on (query_id, candidate_id); says why a row falls back: missing, invalid, unusual, unsure.

    Two predictions for one candidate are an error.
    """
    keys = ["query_id", "candidate_id"]
    rest = [c for c in predictions.columns if c not in keys]
    once = predictions.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_p"))
    twice = F.raise_error(F.lit("a candidate has two predictions")).cast("boolean")
    once = once.select(*keys, "_p.*", F.when(F.col("_n") > 1, twice).otherwise(F.lit(True)).alias("_there"))
    rows = candidates.join(once, keys, "left")
    missing = F.col("_there").isNull()
    invalid = ~missing & (F.col("score").isNull() | F.isnan("score"))
    unusual = F.coalesce(F.exists("features", lambda x: F.isnan(x) | (F.abs(x) > 1.0e5)), F.lit(False))
    unsure = F.coalesce(F.col("pred_uncertainty") >= threshold, F.lit(False))
    rows = rows.withColumns({"missing": missing, "invalid": invalid, "unusual": unusual, "unsure": unsure})
    return rows.withColumn("fallback", F.col("missing") | F.col("invalid") | F.col("unusual") | F.col("unsure")).drop("_there")


def merge_schedule(rows: DataFrame, schedule: DataFrame, group: str, index: str) -> DataFrame:
    """Rows with their place: scheduled ones by score (best of repeats), the rest after them in input order."""
    best = schedule.groupBy(group, index).agg(F.max("score").alias("score"))
    order = Window.partitionBy(group).orderBy(F.col("score").desc_nulls_last(), index)
    return rows.join(best, [group, index], "left").withColumn("place", F.row_number().over(order))


def interleave(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Round-robin over groups: first of each, second of each, and so on."""
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return rows.orderBy("round", group)


def quota(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group: the feature itself, not a shortcut."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def oversample(rows: DataFrame, positive, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(positive, F.lit(times)).otherwise(F.lit(1)))))


def changes(rows: DataFrame, group: str, order: list, value: str) -> DataFrame:
    """Rows whose ``value`` differs from the row before; the first of a group always does."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1
    return rows.withColumns({"_b": before, "_f": first}).where(F.col("_f") | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_f")
