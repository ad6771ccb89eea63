"""Row contracts: named rules, strict columns, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status and source codes of the row contracts.
STATUS = {"collision": 0, "separation": 1, "undecided": 2}
SOURCE = {"raw": 0, "refined": 1, "fallback": 2}

CANDIDATE = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("query_id", "candidate_id", "object_a", "object_b", "patch_a", "patch_b", "slab_id")]
    + [T.StructField("motion_bound", T.ArrayType(T.FloatType(), False), False), T.StructField("hit_count", T.LongType(), False), T.StructField("flags", T.LongType(), False)]
)
WORK_ITEM = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("work_item_id", "query_id", "candidate_id", "slab_id")]
    + [T.StructField("t0", T.DoubleType(), False), T.StructField("t1", T.DoubleType(), False), T.StructField("family_mask", T.IntegerType(), False)]
    + [T.StructField("depth", T.IntegerType(), False), T.StructField("priority", T.FloatType(), False), T.StructField("source", T.ShortType(), False)]
)


def faults(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds faults, the names of the rules that a row breaks; a rule of unknown outcome is broken."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn("faults", F.array_compact(broken))


def split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their faults."""
    marked = faults(rows, rules)
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def work_item_rules() -> dict[str, Column]:
    t0, t1 = F.col("t0"), F.col("t1")
    return {
        "ids": (F.col("work_item_id") > 0) & (F.col("query_id") > 0),
        "interval": ~F.isnan(t0) & ~F.isnan(t1) & (t0 >= 0) & (t1 <= 1) & (t0 <= t1),
        "family": F.col("family_mask") > 0,
        "source": F.col("source").isin(*SOURCE.values()),
        "priority": ~F.isnan("priority"),
    }


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` in the order and types of ``schema``; a missing or an extra column is an error."""
    own, wanted = set(rows.columns), set(schema.names)
    if own != wanted:
        raise ValueError(f"missing {sorted(wanted - own)}, not in the contract {sorted(own - wanted)}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
