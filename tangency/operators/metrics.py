"""Confusion, recall, latency and work metrics as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangency.operators import ranks
from tangency.operators.candidates import ratio


def confusion(rows: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, tn, fp, fn, recall and precision over rows of known truth, in total or ``by`` columns."""
    t, p = F.col(truth), F.col(predicted)
    counts = [F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]
    out = rows.where(t.isNotNull()).groupBy(*by).agg(*counts)
    return out.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})


#: A group of more rows than this is neither held nor sorted whole.
MOST_HELD = 1_000_000


def _held(rows: DataFrame, by: Sequence[str]) -> bool:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > MOST_HELD).isEmpty()


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, and the extremes; by ranges of values where a group is too large to be held."""
    points = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not _held(rows, by):
        return ranks.percentiles(usable, value, points, by)
    found = F.percentile(value, F.array(*[F.lit(p) for p in points.values()]))
    out = usable.groupBy(*by).agg(F.count(value).alias("n"), found.alias("_p")).where("n > 0")
    return out.select(*by, "n", *[F.col("_p")[i].alias(c) for i, c in enumerate(points)])


def weighted_median(rows: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """The first value, in order, at which half of the weight is reached; by ranges of values, so no group is sorted."""
    return ranks.weighted_median(rows, value, weight, by)


def rollup(rows: DataFrame, levels: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Measures overall, by the first level and by all levels; ``level`` says which."""
    view = rows.withColumn("_one", F.lit(1))
    sets = [[], levels[:1], list(levels)]
    names = [F.col(c) for c in levels]
    grouped = view.groupingSets([[F.col(c) for c in s] for s in sets], *names)
    level = F.grouping_id(*names).alias("level")
    return grouped.agg(level, *[m.alias(c) for c, m in measures.items()])


def threshold_curve(rows: DataFrame, score: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion at each threshold; the thresholds are a short list, exploded per row before one aggregate."""
    points = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    each = rows.select(F.col(score).alias("s"), F.col(truth).alias("t"), points).withColumn("p", F.col("s") >= F.col("threshold"))
    return confusion(each, "t", "p", ["threshold"])


def zero_miss_threshold(rows: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """The highest threshold that misses no positive; -1e30 without positives."""
    least = F.min(F.when(F.col(truth), F.col(score)))
    return rows.groupBy(*by).agg(F.coalesce(least, F.lit(-1.0e30)).alias("threshold"), F.count_if(F.col(truth)).alias("positives"))


def standard_scores(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds z_<column>: (x - mean) / population deviation within ``by``; 0 where the deviation is 1e-12 or less.

    Non-finite values stand at the mean. Means come from a small aggregate joined back.
    """
    def usable(c: str) -> Column:
        x = F.col(c)
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    stats = rows.groupBy(*by).agg(*[f(usable(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = rows.join(stats, list(by))
    out = {}
    for c in columns:
        mean, dev = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        out[f"z_{c}"] = F.when(F.coalesce(dev, F.lit(0.0)) <= 1.0e-12, F.lit(0.0)).otherwise((F.coalesce(usable(c), mean) - mean) / dev)
    return joined.withColumns(out).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def unit_interval(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Adds unit_<column>: min-max scaled within ``by``; 0.5 where all are equal. Non-finite values do not set the ends and stand at 0."""
    x = F.col(column)
    usable = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    stats = rows.groupBy(*by).agg(F.min(usable).alias("_lo"), F.max(usable).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span <= 1.0e-12, F.lit(0.5)).otherwise(F.coalesce((usable - F.col("_lo")) / span, F.lit(0.0)))
    return rows.join(stats, list(by)).withColumn(f"unit_{column}", unit).drop("_lo", "_hi")


def policy_scores(rows: DataFrame, by: Sequence[str], head: str) -> DataFrame:
    """Adds policy_score by one of the heads ``priority_only``, ``cost_aware`` and ``risk_proximity_hybrid``."""
    # The weights of each head.
    weights = {
        "priority_only": {},
        "cost_aware": {"priority": 1.0, "cost": -0.20, "uncertainty": -0.10},
        "risk_proximity_hybrid": {"priority": 0.50, "cost": -0.25, "uncertainty": -0.15, "gap": -0.55, "overlap": 0.20, "degeneracy": -0.10},
    }[head]
    if not weights:
        return rows.withColumn("policy_score", F.col("priority"))
    scored = standard_scores(rows, list(weights), by)
    total = sum((F.col(f"z_{c}") * w for c, w in weights.items()), F.lit(0.0))
    return scored.withColumn("policy_score", total).drop(*[f"z_{c}" for c in weights])


# Heads found best for some sources, parts of the names of primitive-query sources, and the
# candidates per query of a dense group.
SOURCE_HEADS = {"common_modeling_large": "priority_only", "fusion360_full_assembly": "cost_aware", "shapenet_ood_dense": "cost_aware"}
PRIMITIVE_SOURCES = ("tight_inclusion", "nyu")
DENSE_GROUP = 256


def policy_head(source: str, density: float | None = None, hard_negative: bool = False, heads: dict[str, str] | None = None) -> str:
    """The head for a source: hybrid for primitive queries and hard negatives, then the one set for it, then hybrid for dense groups, else cost aware.

    ``heads`` adds to, or replaces, the heads by source.
    """
    known = (SOURCE_HEADS | (heads or {})).get(source)
    if hard_negative or any(part in source for part in PRIMITIVE_SOURCES):
        return "risk_proximity_hybrid"
    return known or ("risk_proximity_hybrid" if (density or 0) >= DENSE_GROUP else "cost_aware")


def group_mix(rows: DataFrame, group: str, truth: str) -> DataFrame:
    """How many groups are all positive, mixed or all negative, and the rows in them."""
    own = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(truth)).alias("p"))
    kind = F.when(F.col("p") == 0, "negative").when(F.col("p") == F.col("n"), "positive").otherwise("mixed")
    return own.groupBy(kind.alias("mix")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def expected_random(rows: DataFrame, group: str, truth: str) -> DataFrame:
    """Per positive group the calls a random order needs on average, (n + 1) / (p + 1), and the best share 1 / n."""
    own = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(truth)).alias("p")).where("p > 0")
    return own.withColumns({"random_calls": (F.col("n") + 1) / (F.col("p") + 1), "best_share": 1.0 / F.col("n")})


def rank_policies(rows: DataFrame, group: str, truth: str, policies: dict[str, Column], order: str) -> DataFrame:
    """Per policy over positive groups: calls, share of calls saved, percentiles of the first positive's rank."""
    # All policies in one pass for first hits and one for ranks; no group is sorted.
    keys = {name: F.struct(score.isNull().alias("a"), (-score).alias("b"), F.col(order).alias("c")) for name, score in policies.items()}
    known = rows.select(group, truth, *[key.alias(f"_k{i}") for i, key in enumerate(keys.values())])
    first = known.where(truth).groupBy(group).agg(*[F.min(f"_k{i}").alias(f"_f{i}") for i in range(len(keys))])
    counted = known.join(first, group, "left").groupBy(group).agg(
        F.count("*").alias("n"), F.max(truth).alias("_hit"), *[F.count_if(F.col(f"_k{i}") <= F.col(f"_f{i}")).alias(f"_c{i}") for i in range(len(keys))]
    )
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.when(F.col("_hit"), F.col(f"_c{i}")).alias("first")) for i, name in enumerate(keys)])).alias("p")
    parts = counted.select("n", each).select("n", "p.*").withColumn("calls", F.coalesce("first", "n"))
    p = F.percentile("first", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = parts.groupBy("policy").agg(F.sum("n").alias("all_calls"), F.sum("calls").alias("calls"), p.alias("_p"))
    return out.select("policy", "all_calls", "calls", (1.0 - F.col("calls") / F.col("all_calls")).alias("saved"), *[F.col("_p")[i].alias(f"rank_p{n}") for i, n in enumerate((50, 90, 99))])


def parameter_sweep(rows: DataFrame, options: dict[int, Column], truth: str, cost: str) -> DataFrame:
    """Per option (a short list of predicates that keep rows) its calls, misses, recall and work, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("option"), keep.alias("kept")) for i, keep in options.items()])).alias("o")
    own = rows.select(F.col(truth).alias("truth"), F.col(cost).alias("cost"), each).select("truth", "cost", "o.*")
    kept, hit = F.col("kept"), F.col("truth")
    out = own.groupBy("option").agg(F.count_if(kept).alias("calls"), F.count_if(hit & ~kept).alias("fn"), F.count_if(hit & kept).alias("_tp"), F.sum(F.when(kept, F.col("cost")).otherwise(0.0)).alias("work"))
    return out.withColumn("recall", ratio(F.col("_tp"), F.col("_tp") + F.col("fn"))).drop("_tp")


def calls_by_family(rows: DataFrame, family: str, measures: dict[str, Column], known: Sequence) -> DataFrame:
    """Measures per known family; what is of none of them is one row ``unknown``, so rows add up to all calls."""
    name = F.when(F.col(family).isin(*known), F.col(family).cast("string")).otherwise("unknown")
    return rows.groupBy(name.alias("family")).agg(*[m.alias(c) for c, m in measures.items()])


def known_recall(rows: DataFrame, truth: str, active: str, by: Sequence[str] = ()) -> DataFrame:
    """Recall over rows of known truth in two ways: positives that stayed active, and one less misses over all known rows."""
    t, a = F.col(truth), F.col(active)
    out = rows.where(t.isNotNull()).groupBy(*by).agg(F.count("*").alias("known"), F.count_if(t).alias("positives"), F.count_if(t & ~a).alias("misses"))
    covered = F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(1.0 - F.col("misses") / F.col("positives"))
    return out.withColumns({"recall": covered, "known_recall": 1.0 - ratio(F.col("misses"), F.col("known"))})


def mean_interval(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and half width of the 95 % interval, 1.96 s / sqrt(n)."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("ci95", F.col("std") * 1.96 / F.sqrt("n"))


def benchmark_row(rows: DataFrame, by: Sequence[str] = (), *more: Column) -> DataFrame:
    """Counts of a run of (truth, predicted, evaluated, cost): misses, false alarms, calls, averages and ratios; ``more`` are further aggregates."""
    t, p = F.col("truth"), F.col("predicted")
    known = t.isNotNull()
    out = rows.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(F.col("evaluated")).alias("exact_calls"), F.count_if(known & t & ~p).alias("fn"),
        F.count_if(known & ~t & p).alias("fp"), F.count_if(t).alias("positives"), F.sum(F.when(F.col("evaluated"), F.col("cost")).otherwise(0.0)).alias("work"), *more,
    )
    return out.withColumns(
        {
            "recall": F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(1.0 - F.col("fn") / F.col("positives")),
            "call_ratio": ratio(F.col("exact_calls"), F.col("queries")),
            "work_per_call": ratio(F.col("work"), F.col("exact_calls")),
        }
    )


def label_metrics(rows: DataFrame) -> DataFrame:
    """Top-1 recall of interval bins and subset recall of the best two families over (interval_scores, interval_bin, family_scores, family)."""
    best = F.array_position("interval_scores", F.array_max("interval_scores")) - 1
    order = F.transform(F.sequence(F.lit(0), F.size("family_scores") - 1), lambda i: F.struct((-F.element_at("family_scores", i + 1)).alias("s"), i.alias("i")))
    two = F.transform(F.slice(F.array_sort(order), 1, 2), lambda x: x["i"])
    return rows.agg(F.count("*").alias("n"), F.avg((best == F.col("interval_bin")).cast("double")).alias("interval_top1"), F.avg(F.array_contains(two, F.col("family")).cast("double")).alias("family_top2"))


def best_setting(rows: DataFrame, setting: str, score: str, tie: str) -> DataFrame:
    """The setting of least score, ties to the least ``tie`` and then the least setting."""
    return rows.agg(F.min_by(F.struct(setting, score, tie), F.struct(score, tie, setting)).alias("best")).select("best.*")


def stratified_split(files: DataFrame, strata: Sequence[str], name: str, train: float = 0.7, validation: float = 0.1) -> DataFrame:
    """Adds split within strata by a hash order: train, validation, heldout; a lone file is heldout."""
    order = Window.partitionBy(*strata).orderBy(F.sha2(F.col(name).cast("string"), 256))
    rn, n = F.row_number().over(order), F.count("*").over(Window.partitionBy(*strata))
    split = F.when(n == 1, "heldout").when(rn <= F.floor(n * train), "train").when(rn <= F.floor(n * train) + F.floor(n * validation), "validation").otherwise("heldout")
    return files.withColumn("split", split)


def run_rows(rows: DataFrame, runs: DataFrame, latencies: DataFrame | None = None, families: DataFrame | None = None) -> DataFrame:
    """Benchmark rows of the earlier contract as rows of the later one, what that adds being inferred.

    ``rows`` has run_id and the columns of ``validators.benchmark``; ``runs``
    (run_id, dataset, scene, method, config_hash, seed) describes them. The
    percentiles come from ``latencies`` (run_id, ms) or, for a run without,
    are all the mean per query; negative ones do not count. The calls by family
    come from ``families`` (run_id and ``validators.FAMILY_CALLS``); those that
    no family accounts for are of unknown family. Candidates
    per call and calls per candidate follow from the means. A row whose run is
    not described is an error when it is read.
    """
    names = {"latency_min_ms": 0.0, "latency_p50_ms": 0.5, "latency_p90_ms": 0.9, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99, "latency_max_ms": 1.0}
    calls = ("point_triangle_calls", "edge_edge_calls", "conservative_calls", "unknown_calls")
    out = rows.join(runs.withColumn("_run", F.lit(True)), "run_id", "left")
    out = out.where(F.when(F.col("_run"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no description of run "), "run_id")).cast("boolean"))).drop("_run")
    if latencies is not None:
        out = out.join(ranks.percentiles(latencies.where("ms >= 0"), "ms", names, ["run_id"]).drop("n"), "run_id", "left")
    if families is not None:
        out = out.join(families.select("run_id", *calls), "run_id", "left")
    missing = [c for c in (*names, *calls) if c not in out.columns]
    out = out.withColumns({c: F.lit(None).cast("double" if c in names else "long") for c in missing}) if missing else out
    mean = F.coalesce(F.try_divide("total_ms", "queries"), F.lit(0.0))
    exact, candidates = F.bround(F.col("calls_per_query") * F.col("queries")).cast("long"), F.greatest(F.lit(0.0), F.col("candidates_per_query") * F.col("queries"))
    out = out.withColumns({"_exact": exact, "_all": candidates, **{c: F.coalesce(c, mean) for c in names}, **{c: F.coalesce(c, F.lit(0).cast("long")) for c in calls}})
    # Calls that no family accounts for are of unknown family.
    told = sum((F.col(c) for c in calls[1:]), F.col(calls[0]))
    out = out.withColumn(calls[3], F.col(calls[3]) + F.greatest(F.col("_exact") - told, F.lit(0).cast("long")))
    one = lambda c: F.greatest(c, F.lit(1.0))
    return out.withColumns(
        {
            "exact_calls": told, "candidates_per_call": F.col("_all") / one(F.col("_exact").cast("double")),
            "queue_occupancy": F.least(F.lit(1.0), F.col("_exact") / one(F.col("_all"))), "tail_ms": F.col("latency_p99_ms"),
        }
    ).drop("_exact", "_all")
