"""Registered queries of the work queue, sweeps, bounded top-k, hashes and training, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.functions import hashes, scores
from tangency.operators import candidates, closest, heaps, runtime, schedule, sweep, training, workqueue
from tangency.plans import certificate_sql
from tangency.plans.group_catalogue import RANKED, dense
from tangency.plans.pairs_catalogue import _SCENE, _TOUCH, BOXES, boxes, r6, raw_hits, scene_boxes
from tangency.plans.runtime_catalogue import _DENSITY, _TRIANGLES, _WIDE, order_samples
from tangency.sources import samples, views

QUERIES: dict = {}
_FOUND = "WITH RECURSIVE " + certificate_sql.certificates(_WIDE)
#: Also the texts of three queries that are registered elsewhere.
ORACLES: dict[str, str] = {
    "x1_certificate": _FOUND + " SELECT query_id, family, status, round(toi_upper, 6) + 0e0 AS toi_upper, round(margin, 6) + 0e0 AS margin, evaluations FROM found",
    "m5_scheduled_exact": _FOUND
    + """, c AS (
  SELECT query_id // 1000000 AS grp, status <> 1 AS collides,
    row_number() OVER (PARTITION BY query_id // 1000000 ORDER BY -abs(x0 - x1) DESC, query_id) AS rn
  FROM found JOIN q USING (query_id)
), g AS (SELECT grp, count(*) AS n, min(CASE WHEN collides THEN rn END) AS hit FROM c GROUP BY grp)
SELECT grp AS query_id, n AS all_calls, coalesce(hit, n) AS calls,
  least(n, CAST(8 * (pow(2, ceil(log2(coalesce(hit, n) / 8e0 + 1e0 - 1e-12))) - 1) AS BIGINT)) AS evaluated, hit IS NOT NULL AS truth
FROM g""",
    "m21_mesh_exact": "WITH RECURSIVE "
    + certificate_sql.mesh_queries(_TRIANGLES.removeprefix("WITH "), _TOUCH)
    + ", "
    + certificate_sql.certificates("SELECT * EXCLUDE (scene, a_number, b_number, turned) FROM wide")
    + """, r AS (SELECT scene, w.family, status, toi_upper, margin, row_number() OVER (PARTITION BY scene ORDER BY CASE WHEN status = 0 THEN 0 ELSE 1 END, CASE WHEN w.family = 'vf' THEN 0 ELSE 1 END, a_number, b_number, turned) AS n
  FROM found JOIN wide w USING (query_id)),
s AS (SELECT scene, min(status) = 0 AS c, max(status) = 2 AS u, max(CASE WHEN n = 1 AND status = 0 THEN toi_upper END) AS toi, min(margin) AS m, CAST(bit_or(CASE WHEN family = 'vf' THEN 1 ELSE 2 END) AS INTEGER) AS mask, count(*) AS primitives FROM r GROUP BY scene)
SELECT scene, CAST(CASE WHEN c THEN 0 WHEN u THEN 2 ELSE 1 END AS INTEGER) AS status, round(coalesce(toi, 1e0), 6) + 0e0 AS toi_upper, round(CASE WHEN c OR u OR m IS NULL THEN 0e0 ELSE m END, 6) + 0e0 AS margin, coalesce(mask, 0) AS mask, coalesce(primitives, 0) AS primitives
FROM (SELECT DISTINCT scene FROM t) LEFT JOIN s USING (scene)""",
}


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# The queue to its fixed point, and what it conserves.


@query(_FOUND + " SELECT query_id, status FROM found")
def x5_queue_outcomes(spark, d):
    """Work items certified four levels deep, refined until decided: the outcome is that of the certificate at full depth."""
    return workqueue.outcomes(workqueue.process(views.vertex_queries(spark, d))).select("query_id", "status")


@query(_FOUND + ", v(check_name) AS (VALUES ('certified'), ('children')) SELECT check_name, true AS conserved FROM v")
def x5_queue_conservation(spark, d):
    """No item of the queue is lost or doubled: every item is certified once, and every refined one has both halves."""
    items = workqueue.process(views.vertex_queries(spark, d))
    events = workqueue.audit(items)
    done = events.where("action = 'certify'").select("query_id", "work_item_id")
    wanted = workqueue.halves(items.where("refined").select("query_id", "work_item_id", "depth", "t0", "t1"))
    children = items.where("work_item_id > 1")
    checks = {"certified": (items.select("query_id", "work_item_id"), done), "children": tuple(x.select("query_id", "work_item_id", "depth", "t0", "t1") for x in (wanted, children))}
    return workqueue.conservation(checks).select("check_name", "conserved")


_CHECKS = """, n AS (SELECT count(*) AS n, count(*) FILTER (candidate_id % 97 = 0) AS few FROM cand)
SELECT check_name, CASE check_name WHEN 'doubled' THEN n + few ELSE n END AS rows_left, CASE check_name WHEN 'lost' THEN n - few ELSE n END AS rows_right, few = 0 OR check_name IN ('queue', 'candidates', 'schedule', 'numbers') AS conserved
FROM n, (VALUES ('queue'), ('candidates'), ('schedule'), ('numbers'), ('lost'), ('doubled'), ('altered')) v(check_name)"""


@query(_DENSITY + _CHECKS)
def j16_four_checks(spark, d):
    """The four relations that a run conserves, and three in which a row is lost, doubled or altered."""
    found = candidates.compact(raw_hits(spark, d)).withColumn("family_mask", F.lit(runtime.POINT_TRIANGLE | runtime.EDGE_EDGE))
    found = views.checkpointed(found.select("query_id", "candidate_id", "family_mask", "hit_count", "slab_id"))
    items = views.checkpointed(runtime.work_items(found))
    order = schedule.ranked(found.withColumns({"priority": F.col("hit_count"), "cost": F.col("slab_id")}))
    checks = workqueue.run_checks(found, items, items.select("query_id", "work_item_id"), order)
    few, keys = F.col("candidate_id") % 97 == 0, ["query_id", "candidate_id", "family_mask"]
    rows = found.select(*keys)
    checks |= {
        "lost": (rows, rows.where(~few)),
        "doubled": (rows.union(rows.where(few)), rows),
        "altered": (rows, rows.withColumn("family_mask", F.when(few, runtime.EDGE_EDGE).otherwise(F.col("family_mask")))),
    }
    return workqueue.conservation(checks)


# Sweeps.


@query(f"WITH boxes AS ({_SCENE}) SELECT a.body_id AS a_body_id, b.body_id AS b_body_id FROM boxes a JOIN boxes b ON a.body_id < b.body_id AND {_TOUCH}")
def j3_sweep_pairs(spark, d):
    """All touching boxes of one scene, by sweeps along strips of the x axis."""
    return sweep.sweep_pairs(scene_boxes(spark, d), ()).select("a_body_id", "b_body_id")


@query(
    f"""WITH boxes AS MATERIALIZED ({BOXES}),
open AS (SELECT b.query_id, b.body_id, count(a.body_id) AS n FROM boxes b LEFT JOIN boxes a ON a.query_id = b.query_id AND a.max_x >= b.min_x AND (a.min_x < b.min_x OR (a.min_x = b.min_x AND a.body_id < b.body_id)) GROUP BY ALL),
last AS (SELECT query_id, max(min_x) AS last_x FROM boxes GROUP BY query_id),
gone AS (SELECT query_id, count(*) FILTER (max_x < last_x) AS removals FROM boxes JOIN last USING (query_id) GROUP BY query_id)
SELECT query_id, count(*) AS boxes, CAST(sum(n) AS BIGINT) AS tests, any_value(removals) AS removals, max(n) + 1 AS peak FROM open JOIN gone USING (query_id) GROUP BY query_id"""
)
def j3_sweep_counters(spark, d):
    """Per order of spheres the work of its sweep."""
    return sweep.sweep_counters(boxes(spark, d))


# The first rows of groups, without a sort of a group.


@query(RANKED + "SELECT query_id, candidate_id, rn FROM r WHERE rn <= 5")
def w7_heap_top_k(spark, d):
    rows = dense(spark, d).select("query_id", "candidate_id", "priority", "cost")
    return heaps.first_rows(rows, ["query_id"], schedule.ORDER, 5).select("query_id", "candidate_id", "rn")


# Certificates and hashes.


@query(
    "WITH RECURSIVE " + certificate_sql.best_distances(_WIDE)
    + " SELECT query_id, family, status, round(toi, 6) + 0e0 AS toi, round(margin, 6) + 0e0 AS margin, round(least_distance, 6) + 0e0 AS least_distance, evaluations, depth FROM found"
)
def x4_best_distance(spark, d):
    """The certificate that keeps the nearest of its samples, for every primitive query."""
    rows = closest.best_certificates(views.vertex_queries(spark, d))
    return rows.select("query_id", "family", "status", *[r6(F.col(c)).alias(c) for c in ("toi", "margin", "least_distance")], "evaluations", "depth")


_WRAP = "18446744073709551616::HUGEINT"


_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END AS BIGINT)"


def _times(x: str, factor: int) -> str:
    """x times factor modulo 2 ** 64: the upper half of x is cut first, as a HUGEINT holds 127 bits."""
    low, high = factor & 0xFFFFFFFF, factor >> 32
    return f"(({x} * {low}::HUGEINT + (({x} * {high}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT) % {_WRAP})"


@query(
    f"""WITH t AS (SELECT event_id, event_type || ':' || CAST(event_id AS VARCHAR) AS text FROM events),
b AS (SELECT event_id, list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS HUGEINT)) AS bytes FROM t),
h AS (SELECT event_id, list_reduce(list_concat([{hashes.FNV_OFFSET}::HUGEINT], bytes), lambda h, x: (xor(h, x) * {hashes.FNV_PRIME}::HUGEINT) % {_WRAP}) AS h FROM b),
m0 AS (SELECT event_id, h, (h + {hashes.MIX_STEP}::HUGEINT) % {_WRAP} AS z FROM h),
m1 AS (SELECT event_id, h, xor(z, z // 1073741824::HUGEINT) AS z FROM m0), m2 AS (SELECT event_id, h, {_times('z', hashes.MIX_MULTIPLIERS[0])} AS z FROM m1),
m3 AS (SELECT event_id, h, xor(z, z // 134217728::HUGEINT) AS z FROM m2), m4 AS (SELECT event_id, h, {_times('z', hashes.MIX_MULTIPLIERS[1])} AS z FROM m3),
m5 AS (SELECT event_id, h, xor(z, z // 2147483648::HUGEINT) AS z FROM m4)
SELECT event_id, {_SIGNED.format('h')} AS fnv, {_SIGNED.format('z')} AS mixed, CAST(z // 2048::HUGEINT AS DOUBLE) / 9007199254740992e0 AS share FROM m5"""
)
def f19_hashes(spark, d):
    """Hash of a name's bytes, mixed, and as a number from 0 to 1, per event."""
    rows = views.table(spark, d, "events").select("event_id", hashes.fnv1a(F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("fnv"))
    rows = rows.withColumn("mixed", hashes.mix64("fnv"))
    return rows.select("event_id", "fnv", "mixed", hashes.unit(F.col("mixed")).alias("share"))


# Training over tasks.


def training_rows(spark, d) -> DataFrame:
    """Features and targets of the seeded samples, one per order."""
    rows = samples.labelled(order_samples(spark, d))
    families = [F.lit(1.0), (F.col("hardness") >= 0.5).cast("double"), *[F.lit(0.0)] * 6]
    return rows.select(
        "features", scores.one_hot(F.col("interval_target"), 8).alias("interval_targets"), F.array(*families).alias("family_targets"),
        "priority_target", (1.0 + F.col("hardness")).alias("cost_target"), "uncertainty_target",
    )


@query(None)
def e6_training(spark, d):
    """Loss before each step of a training on all labelled samples."""
    _, history = training.train(training_rows(spark, d), plan=training.Plan(epochs=12, batches=2))
    return spark.createDataFrame(history, "epoch int, batch int, loss double")
