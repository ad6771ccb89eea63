"""Exact percentiles and weighted medians of groups of any size: count by ranges of values, then look only where a rank falls.

A group is never sorted or held. Its values are counted in equal ranges
between its least and its largest; the ranges that hold the ranks asked for
are few, and only their values are counted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(rows: DataFrame, value: str, by: Sequence[str], weight: Column, ranges: int) -> DataFrame:
    """(_g, _v, _w, _r): the group as a struct, in which nulls are equal, values that are not null or NaN, their weight and their range, a number from 0."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_none"))
    rows = rows.select(group.alias("_g"), F.col(value).cast("double").alias("_v"), weight.alias("_w")).where("_v is not null and not isnan(_v)")
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return rows.join(ends, "_g").select("_g", "_v", "_w", F.least(F.floor(share * ranges), F.lit(ranges - 1)).cast("int").alias("_r"))


def _located(ranged: DataFrame, ranks: Column) -> DataFrame:
    """(_g, _r, _before, _all, _k, _rank): for each of ``ranks`` (an array by place, of the total ``_all``) the range in which the running weight reaches it."""
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_g", "_r").agg(F.sum("_w").alias("_s"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(earlier), F.lit(0)), "_all": F.sum("_s").over(Window.partitionBy("_g"))})
    found = sums.select("_g", "_r", "_s", "_before", "_all", F.posexplode(ranks).alias("_k", "_rank"))
    return found.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_s"))).drop("_s")


def _values(ranged: DataFrame, located: DataFrame) -> DataFrame:
    """(_g, _k, _v, _all): the value at which each rank is reached."""
    keys = ["_g", "_r"]
    few = ranged.join(located.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "_v").agg(F.sum("_w").alias("_s"))
    upto = few.withColumn("_upto", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_v")))
    rows = upto.join(located, keys).where(F.col("_before") + F.col("_upto") >= F.col("_rank"))
    return rows.groupBy("_g", "_k").agg(F.min("_v").alias("_v"), F.any_value("_all").alias("_all"))


def percentiles(rows: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = (), ranges: int = 1024) -> DataFrame:
    """(by, n, one column per point): exact percentiles with linear interpolation.

    Nulls and NaN are not counted; a group without a value has no row, and
    null keys are a group.
    """
    ranged = _ranged(rows, value, by, F.lit(1).cast("long"), ranges)
    at = lambda p: (F.col("_all") - 1) * p
    wanted = F.array(*[f(at(p)).cast("long") + 1 for p in points.values() for f in (F.floor, F.ceil)])
    found = _values(ranged, _located(ranged, wanted))
    out = found.groupBy("_g").agg(F.any_value("_all").alias("n"), F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    own = []
    for i, (name, p) in enumerate(points.items()):
        low, high = F.col("_m")[F.lit(2 * i)], F.col("_m")[F.lit(2 * i + 1)]
        part = (F.col("n") - 1) * p
        share = part - F.floor(part)
        own.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias(name))
    return out.select(*[F.col("_g")[c].alias(c) for c in by], "n", *own)


def weighted_median(rows: DataFrame, value: str, weight: str, by: Sequence[str], ranges: int = 1024) -> DataFrame:
    """(by, weighted_median): the first value, in order, at which half of the weight is reached.

    Values without a weight above 0 do not count; without any there is no row.
    """
    weighted = rows.where(F.col(weight) > 0)
    ranged = _ranged(weighted, value, by, F.col(weight), ranges)
    found = _values(ranged, _located(ranged, F.array(F.col("_all") * 0.5)))
    return found.select(*[F.col("_g")[c].alias(c) for c in by], F.col("_v").alias("weighted_median"))
