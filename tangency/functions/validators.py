"""The rules that rows of each contract keep, by name, for ``contracts.faults`` and ``contracts.split``.

A rule of unknown outcome (a null) is broken, so a required column that is
null is a fault like a wrong one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tangency.functions.contracts import SOURCE, STATUS

# Codes of the contracts besides those of status and source.
PROXY_TYPES = {"swept_box": 1, "capsule": 2}
REFINEMENT = {"none": 0, "bisect": 1, "geometry": 2, "precision": 3}
STAGES = {"trace": 0, "proposal": 1, "exact": 2, "refine": 3, "certify": 4}


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def non_negative(c: str) -> Column:
    return finite(c) & (F.col(c) >= 0)


def positive(c: str) -> Column:
    return finite(c) & (F.col(c) > 0)


def ratio(c: str) -> Column:
    return finite(c) & F.col(c).between(0, 1)


def named(c: str) -> Column:
    """An id that is there: not null and not 0."""
    return F.col(c) != 0


def unit_interval(t0: str = "t0", t1: str = "t1") -> Column:
    return finite(t0) & finite(t1) & (F.col(t0) >= 0) & (F.col(t1) <= 1) & (F.col(t0) <= F.col(t1))


def _every(array: str, size: int, rule) -> Column:
    return (F.size(array) == size) & F.forall(array, rule)


def _number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def candidate() -> dict[str, Column]:
    rules = {c: named(c) for c in ("candidate_id", "query_id", "hit_count")}
    rules |= {c: F.col(c).isin(*PROXY_TYPES.values()) for c in ("type_a", "type_b")}
    return rules | {"motion_bound": _every("motion_bound", 4, lambda x: _number(x) & (x >= 0))}


def proposal() -> dict[str, Column]:
    rules = {"candidate_id": named("candidate_id"), "priority": finite("priority"), "cost": non_negative("cost"), "uncertainty": non_negative("uncertainty")}
    return rules | {c: _every(c, 8, _number) for c in ("interval_scores", "family_scores")}


def work_item() -> dict[str, Column]:
    rules = {c: named(c) for c in ("work_item_id", "candidate_id", "query_id", "family_mask")}
    return rules | {"interval": unit_interval(), "priority": finite("priority"), "source": F.col("source").isin(*SOURCE.values())}


def certificate() -> dict[str, Column]:
    """A collision lies in its interval, has witnesses and asks for nothing more; a separation has a margin and covers a family; what is undecided says why and what next."""
    hit, free, open_ = (F.col("status") == STATUS[s] for s in ("collision", "separation", "undecided"))
    asks = F.col("next_mode") != REFINEMENT["none"]
    rules = {c: named(c) for c in ("work_item_id", "query_id")}
    rules |= {
        "status": F.col("status").isin(*STATUS.values()), "interval": unit_interval(), "toi_upper": finite("toi_upper"), "safe_margin": finite("safe_margin"),
        "eps_time": positive("eps_time"), "eps_space": positive("eps_space"), "next_mode": F.col("next_mode").isin(*REFINEMENT.values()),
        "collision_time": ~hit | F.col("toi_upper").between(F.col("t0"), F.col("t1")), "collision_witness": ~hit | ((F.col("witness_a") >= 0) & (F.col("witness_b") >= 0)),
        "separation_margin": ~free | (F.col("safe_margin") >= 0), "separation_family": ~free | (F.col("covered_mask") != 0),
        "decided_asks": open_ | ~asks, "undecided_reason": ~open_ | (F.col("reason") != 0), "undecided_asks": ~open_ | asks,
    }
    return rules


def audit() -> dict[str, Column]:
    rules = {c: named(c) for c in ("event_id", "query_id", "timestamp_us")}
    return rules | {"stage": F.col("stage").isin(*STAGES.values()), "interval": unit_interval(), "value_0": finite("value_0"), "value_1": finite("value_1")}


def benchmark() -> dict[str, Column]:
    rules = {"queries": F.col("queries") > 0, "misses": (F.col("fn") >= 0) & (F.col("fn") <= F.col("queries")), "false_alarms": F.col("fp") >= 0}
    rules |= {c: ratio(c) for c in ("recall", "fallback_ratio")}
    return rules | {c: non_negative(c) for c in ("candidates_per_query", "calls_per_query", "depth_per_query", "trace_ms", "proposal_ms", "exact_ms", "total_ms", "queries_per_second")}


#: Percentiles of latency, which never fall.
LATENCIES = ("latency_min_ms", "latency_p50_ms", "latency_p90_ms", "latency_p95_ms", "latency_p99_ms", "latency_max_ms")
FAMILY_CALLS = ("point_triangle_calls", "edge_edge_calls", "conservative_calls", "unknown_calls")


def benchmark_run() -> dict[str, Column]:
    """The later, wider benchmark row: also names its run, orders its percentiles and adds up its calls by family."""
    rules = benchmark() | {c: F.trim(c) != "" for c in ("run_id", "dataset", "method", "config_hash")}
    rules |= {c: non_negative(c) for c in LATENCIES}
    rules["latency_order"] = F.forall(F.arrays_zip(*[F.slice(F.array(*LATENCIES), at, 5).alias(n) for at, n in ((1, "a"), (2, "b"))]), lambda x: x["a"] <= x["b"])
    total = F.col(FAMILY_CALLS[0])
    for c in FAMILY_CALLS[1:]:
        total = total + F.col(c)
    return rules | {"family_calls": total == F.col("exact_calls")}


def run_meta() -> dict[str, Column]:
    rules = {c: F.trim(c) != "" for c in ("run_id", "created_utc", "dataset", "method")}
    rules |= {"config_hash": F.sha2(F.col("config_json").cast("binary"), 256) == F.col("config_hash"), "row_count": F.col("row_count") >= 0}
    return rules | {"created": F.try_to_timestamp("created_utc").isNotNull()}


CONTRACTS = {"candidate": candidate, "proposal": proposal, "work_item": work_item, "certificate": certificate, "audit": audit, "benchmark": benchmark, "benchmark_run": benchmark_run, "run_meta": run_meta}
