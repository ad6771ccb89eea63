"""Runs a suite of named methods over a folder of tables from one JSON description."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.plans import catalogue

METHODS = {
    "PureExact": "m1_pure_exact",
    "BroadPhaseExact": "m2_broad_phase_exact",
    "SortBroadPhaseExact": "m3_sort_exact",
    "RuntimeExact": "m4_runtime_exact",
    "NoProposal": "m6_no_proposal",
    "ScheduledExact": "m5_scheduled_exact",
    "DiscreteCheck": "m8_discrete_check",
    "SlabCheck": "m9_slab_recall",
    "LearnedSurrogate": "m10_learned_surrogate",
    "RobotMargin": "m11_robot_margin",
    "GroupEarlyStop": "a11_group_early_stop",
    "TopKFallback": "a14_topk_fallback",
    "RankPolicies": "a16_rank_policy",
}


@dataclass(frozen=True)
class Case:
    name: str
    method: str


@dataclass(frozen=True)
class Suite:
    name: str
    seed: int
    cases: tuple[Case, ...]

    @classmethod
    def from_json(cls, text: str) -> Suite:
        """Strict: unknown or missing keys, unknown methods and repeated names are errors."""
        data = json.loads(text)
        if set(data) != {"schema_version", "suite_name", "seed", "cases"} or data["schema_version"] != 1:
            raise ValueError("a suite has schema_version 1, suite_name, seed and cases")
        cases = tuple(Case(**c) for c in data["cases"])
        if unknown := {c.method for c in cases} - set(METHODS):
            raise ValueError(f"unknown methods: {sorted(unknown)}")
        if len({c.name for c in cases}) != len(cases):
            raise ValueError("case names repeat")
        return cls(data["suite_name"], int(data["seed"]), cases)


def run(spark: SparkSession, suite: Suite, folder: str, out: str | None = None) -> DataFrame:
    """(suite, case, method, rows, seconds) per case; results go to ``out``/<case> as Parquet if given."""
    done = []
    for case in suite.cases:
        began = time.time()
        df = catalogue.QUERIES[METHODS[case.method]](spark, folder)
        if out is None:
            rows = df.count()
        else:
            df.write.mode("overwrite").parquet(f"{out}/{case.name}")
            rows = spark.read.parquet(f"{out}/{case.name}").count()
        done.append((suite.name, case.name, case.method, rows, time.time() - began))
    return spark.createDataFrame(done, "suite string, case string, method string, rows long, seconds double")


def misses_nothing(confusion: DataFrame) -> DataFrame:
    """Rows of a confusion table with a missed collision; empty means the gate is passed."""
    return confusion.where(F.col("fn") > 0)
