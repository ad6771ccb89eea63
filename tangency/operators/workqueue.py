"""The queue of exact work: certify, refine what stays undecided, until nothing is left; and what it must conserve.

A work item is a query over an interval of time. Items of a query are numbered
like a binary heap: the root has 1 and the halves of item n have 2 n and
2 n + 1, so ids are known without counting and say where an item came from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangency.operators.certificate import COLLISION, SEPARATION, UNDECIDED, Limits, certificates
from tangency.sources.views import checkpointed

_EVERY = ("work_item_id", "depth", "t0", "t1")


def roots(queries: DataFrame) -> DataFrame:
    """One item per query: the whole of [0, 1]."""
    return queries.withColumns({"work_item_id": F.lit(1).cast("long"), "depth": F.lit(0), "t0": F.lit(0.0), "t1": F.lit(1.0)})


def halves(items: DataFrame) -> DataFrame:
    """Both halves of each item, numbered after it."""
    mid = (F.col("t0") + F.col("t1")) * 0.5
    part = lambda k, a, b: F.struct(F.lit(k).cast("long").alias("k"), a.alias("a"), b.alias("b"))
    rows = items.withColumn("_part", F.explode(F.array(part(0, F.col("t0"), mid), part(1, mid, F.col("t1")))))
    return rows.withColumns({"work_item_id": F.col("work_item_id") * 2 + F.col("_part.k"), "depth": F.col("depth") + 1, "t0": F.col("_part.a"), "t1": F.col("_part.b")}).drop("_part")


def process(
    queries: DataFrame, limits: Limits = Limits(depth=4), deepest: int = 40, keys: Sequence[str] = ("query_id",), certify: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Every item that was ever in the queue, with its certificate: keys, work_item_id, depth, t0, t1, status, toi_upper, margin, evaluations, refined.

    The queue begins with ``roots``. A round certifies all its items at the
    shallow ``limits``; an undecided item that is longer than eps_time and
    less deep than ``deepest`` is ``refined``: its halves are the next round's
    items, with the query's own columns. The queue ends when it is empty, at
    the latest when items are as short as eps_time. Each round is written, so
    a lost executor costs one round. Queries without an item of their own stay
    out of later rounds; null values of ``queries`` stay null.
    """
    certify = certify or (lambda items: certificates(items, limits))
    queue, rounds = roots(queries), []
    while True:
        done = certify(queue)
        again = (F.col("status") == UNDECIDED) & (F.col("depth") < deepest) & (F.col("t1") - F.col("t0") > limits.eps_time)
        done = checkpointed(done.withColumn("refined", again))
        rounds.append(done.select(*keys, *_EVERY, "status", "toi_upper", "margin", "evaluations", "refined"))
        open_ = done.where("refined").drop("status", "toi_upper", "margin", "evaluations", "refined")
        if open_.isEmpty():
            break
        queue = halves(open_)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.union(more)
    return out


def outcomes(items: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """One row per query from its final items: status, toi_upper (the earliest collision), margin, items, evaluations.

    A collision anywhere decides; else an undecided item; else it is separate
    by the least margin.
    """
    final = ~F.col("refined")
    hit = final & (F.col("status") == COLLISION)
    rows = items.groupBy(*keys).agg(
        F.max(hit).alias("c"), F.max(final & (F.col("status") == UNDECIDED)).alias("u"), F.min(F.when(hit, F.col("toi_upper"))).alias("toi"),
        F.min(F.when(final, F.col("margin"))).alias("m"), F.count("*").alias("items"), F.sum("evaluations").alias("evaluations"), F.max("depth").alias("deepest"),
    )
    status = F.when(F.col("c"), COLLISION).when(F.col("u"), UNDECIDED).otherwise(SEPARATION)
    margin = F.when(status == SEPARATION, F.col("m")).otherwise(F.lit(0.0))
    return rows.select(*keys, status.cast("int").alias("status"), F.coalesce("toi", F.lit(1.0)).alias("toi_upper"), margin.alias("margin"), "items", "evaluations", "deepest")


def audit(items: DataFrame, keys: Sequence[str] = ("query_id",), first_event_id: int = 1) -> DataFrame:
    """Two events per item, dequeue and certify, numbered without a gap per query in the order of rounds and items.

    Rounds go on where the one before ended. A query's own items are at most
    two per shortest interval, which bounds the window.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "work_item_id"))
    rows = items.withColumn("_rn", rn).withColumn("action", F.explode(F.array(F.lit("dequeue"), F.lit("certify"))))
    event = F.lit(first_event_id) + F.col("_rn") * 2 - F.when(F.col("action") == "dequeue", 2).otherwise(1)
    return rows.select(*keys, "work_item_id", "depth", "action", event.cast("long").alias("event_id"), F.when(F.col("action") == "certify", F.col("status")).alias("status"))


# Conservation


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell one bag of rows from another whatever their order: count, sum and xor of two hashes."""
    one, two = F.xxhash64(*columns), F.hash(*columns).cast("long")
    wide = one.cast("decimal(38,0)")
    return [F.count("*").alias("n"), F.sum(wide).alias("total"), F.bit_xor(one).alias("bits"), F.sum(two).alias("more")]


def conservation(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check_name, rows_left, rows_right, conserved): whether the two relations of each check hold the same rows, as often.

    Relations of one check have the same columns in the same order and types.
    All are folded to fingerprints in one pass, each combined before it is
    shuffled, so no relation is joined with another. An empty relation has
    zero rows; two of them are conserved.
    """
    marks = None
    for name, sides in checks.items():
        left, right = (d.dtypes for d in sides)
        if [k for _, k in left] != [k for _, k in right]:
            raise ValueError(f"{name}: the relations are of different types")
        for side, rows in zip(("left", "right"), sides):
            found = rows.toDF(*[f"c{i}" for i in range(len(left))]).agg(*fingerprint([f"c{i}" for i in range(len(left))]))
            found = found.select(F.lit(name).alias("check_name"), F.lit(side).alias("side"), F.struct("n", "total", "bits", "more").alias("mark"))
            marks = found if marks is None else marks.union(found)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("mark")))
    rows = marks.groupBy("check_name").agg(side("left").alias("l"), side("right").alias("r"))
    return rows.select("check_name", F.col("l.n").alias("rows_left"), F.col("r.n").alias("rows_right"), F.col("l").eqNullSafe(F.col("r")).alias("conserved"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one relation has more often than the other, with n_left and n_right; for a check that failed."""
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.toDF(*columns).select("*", F.lit(0), F.lit(1)))
    found = both.groupBy(*columns).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return found.where("n_left <> n_right")


def run_checks(candidates: DataFrame, items: DataFrame, certificates: DataFrame, schedule: DataFrame, keys: Sequence[str] = ("query_id",)) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The four relations that a run must conserve, for ``conservation``.

    queue: every item has one certificate; candidates: every candidate has one
    item; schedule: scheduling moves candidates but keeps them and their
    families; numbers: work item ids are told apart within a query.
    """
    own = list(keys)
    return {
        "queue": (items.select(*own, "work_item_id"), certificates.select(*own, "work_item_id")),
        "candidates": (candidates.select(*own, "candidate_id"), items.select(*own, "candidate_id")),
        "schedule": (candidates.select(*own, "candidate_id", "family_mask"), schedule.select(*own, "candidate_id", "family_mask")),
        "numbers": (items.select(*own, "work_item_id"), items.select(*own, "work_item_id").distinct()),
    }
