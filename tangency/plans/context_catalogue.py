"""Registered queries of group features, contracts, closest points and approach motions, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.functions import contracts, validators
from tangency.operators import broadphase, closest, group_features, metrics, motion, schedule, slabs
from tangency.plans import certificate_sql
from tangency.plans.group_catalogue import _CONFUSED, _STOP, DENSE, dense
from tangency.plans.pairs_catalogue import _TOUCH, CONTACTS, contacts, r6
from tangency.plans.runtime_catalogue import _SAMPLES, _WIDE, ablation, slots, sql_slots
from tangency.sources import samples, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Features of primitive queries in their group: a supplier's queries, of which each is a step's candidate.

_K = "xyz"


def _norm(parts: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


def _span(i: int, j: int, frame: int = 0) -> str:
    """Distance of vertices i and j at the start (0) or the end (4)."""
    return _norm([f"{k}{i + frame} - {k}{j + frame}" for k in _K])


def _mean(k: str, places) -> str:
    return "((" + " + ".join(f"{k}{i}" for i in places) + f") / {len(places)}e0)"


def _cross(a: tuple[int, int], b: tuple[int, int]) -> list[str]:
    u, v = ({k: f"({k}{p} - {k}{q})" for k in _K} for p, q in (a, b))
    return [f"{u[m]} * {v[n]} - {u[n]} * {v[m]}" for m, n in (("y", "z"), ("z", "x"), ("x", "y"))]


_EVERY = {k: ", ".join(f"{k}{i}" for i in range(8)) for k in _K}
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_GAPS = f"({_WIDE})"
for _i in range(group_features.SAMPLES):
    _GAPS = certificate_sql.gap(_GAPS, f"{_i / (group_features.SAMPLES - 1)!r}::DOUBLE", f"gap{_i}")
_LEAST = ", ".join(f"gap{i}" for i in range(group_features.SAMPLES))
_MEASURED = f"""WITH base AS MATERIALIZED (SELECT *, query_id // 1000000 AS group_id, query_id % 1000000 AS place FROM {_GAPS}),
m1 AS (SELECT *, {", ".join(f"greatest({_EVERY[k]}) - least({_EVERY[k]}) AS extent_{k}, {_mean(k, range(8))} AS middle_{k}" for k in _K)},
  {", ".join(f"{_span(i + 4, i)} AS speed_{i}" for i in range(4))}, {", ".join(f"{_span(i, 0)} AS from_{i}" for i in (1, 2, 3))},
  least({", ".join(_span(i, j) for i, j in _PAIRS)}) AS spread_0, least({", ".join(_span(i, j, 4) for i, j in _PAIRS)}) AS spread_1,
  {_norm([f"({k}4 - {k}0 + {k}5 - {k}1) * 0.5e0 - ({k}6 - {k}2 + {k}7 - {k}3) * 0.5e0" for k in _K])} AS relative_motion, {_norm([f"{_mean(k, range(4, 8))} - {_mean(k, range(4))}" for k in _K])} AS drift,
  greatest({", ".join(f"abs({k}{i})" for k in _K for i in range(8))}) AS farthest, {" + ".join(f"({k}4 - {k}0) * ({k}7 - {k}3)" for k in _K)} AS dot_03,
  least({_LEAST}) AS gap, 0.5e0 * {_norm(_cross((2, 1), (3, 1)))} AS area, least({_EVERY["z"]}) AS low_z, greatest({_EVERY["z"]}) AS high_z FROM base),
m2 AS (SELECT *, {_norm([f"extent_{k}" for k in _K])} AS diagonal, greatest(speed_0, speed_1, speed_2, speed_3) AS top_speed, (speed_0 + speed_1 + speed_2 + speed_3) / 4e0 AS mean_speed,
  sqrt(({" + ".join(f"({k}{i} - middle_{k}) * ({k}{i} - middle_{k})" for i in range(8) for k in _K)}) / 8e0) AS deviation,
  CASE {" ".join(f"WHEN gap{i} <= gap + {group_features.TIE} THEN {i / (group_features.SAMPLES - 1)!r}::DOUBLE" for i in range(group_features.SAMPLES))} END AS closest_time,
  CASE WHEN family = 'vf' THEN {_norm([f"{k}0 - ({k}1 + {k}2 + {k}3) / 3e0" for k in _K])} ELSE {_span(1, 0)} END AS first, CASE WHEN family = 'vf' THEN area ELSE {_span(3, 2)} END AS second,
  CAST(CASE WHEN family = 'vf' THEN area < 1e-10 ELSE {_span(1, 0)} < 1e-8 OR {_span(3, 2)} < 1e-8 END AS DOUBLE) AS degenerate FROM m1)"""
#: The cross product of the first and the last motion, vertex 0 and vertex 3.
_MOVES = [f"({k}4 - {k}0)" for k in _K], [f"({k}7 - {k}3)" for k in _K]
_CROSS_03 = _norm([f"{_MOVES[0][a]} * {_MOVES[1][b]} - {_MOVES[0][b]} * {_MOVES[1][a]}" for a, b in ((1, 2), (2, 0), (0, 1))])
_ENVELOPE_SQL = {
    "is_vf": "CAST(family = 'vf' AS DOUBLE)", "is_ee": "CAST(family = 'ee' AS DOUBLE)", "volume_log": "ln(1e0 + " + " * ".join(f"greatest(extent_{k}, 1e-9)" for k in _K) + ")",
    "least_spread": "least(spread_0, spread_1)", "nearness": "1e0 / (1e0 + least(spread_0, spread_1))", "speed_share": "top_speed / (1e0 + diagonal)", "index_log": "ln(1e0 + place)",
    "one": "1e0", "cross_03": _CROSS_03,
}


def group_rows(spark, d) -> DataFrame:
    rows = views.vertex_queries(spark, d)
    return rows.withColumns({"group_id": F.floor(F.col("query_id") / 1_000_000), "place": F.col("query_id") % 1_000_000})


@query(_MEASURED + "SELECT query_id, family, " + sql_slots([_ENVELOPE_SQL.get(n, n) for n in group_features.ENVELOPE], 8) + " FROM m2")
def r15_envelope_features(spark, d):
    return slots(group_features.envelope_features(group_rows(spark, d)), "query_id", "family", places=8)


_GROUP_SQL = {
    "is_vf": "CAST(family = 'vf' AS DOUBLE)", "is_ee": "CAST(family = 'ee' AS DOUBLE)", "size_share": f"log2(greatest(size, 2)) / {group_features.SIZE_SCALE}", "time_share": "group_id / CAST(greatest(last, 1) AS DOUBLE)",
    "diagonal_log": "ln(1e0 + wide)", "volume_floor_log": "ln(1e0 + " + " * ".join(f"greatest(extent_{k}, 1e-12)" for k in _K) + ")", "place": "place / CAST(greatest(size - 1, 1) AS DOUBLE)",
    "soft": "CAST(group_id % 7 IN (1, 2, 5) AS DOUBLE)", "bits_share": "0e0", "one": "1e0", "risk": "exp(-gap / greatest(1e-6, (first + second) * 0.25e0 + wide * 0.1e0))",
}
_GROUP_SQL |= {f"scene_{i}": f"CAST(group_id % 7 = {i} AS DOUBLE)" for i in range(6)} | {f"extent_{k}_log": f"ln(1e0 + greatest(extent_{k}, 1e-12))" for k in _K}
_GROUP_SQL |= {f"{c}_log": f"ln(1e0 + {c})" for c in ("gap", "mean_speed", "top_speed", "drift", "first", "second")}
_GROUP_SQL |= {f"{s}_box_log": f"ln(1e0 + (query_id * 2 + {i}) % {group_features.BOX_MODULUS}) / {group_features.BOX_SCALE}" for i, s in enumerate("ab")}


@query(
    _MEASURED
    + f""", sizes AS (SELECT group_id, count(*) AS size FROM m2 GROUP BY group_id), lasts AS (SELECT group_id % 7 AS scene, max(group_id) AS last FROM m2 GROUP BY ALL),
g AS (SELECT *, {_norm([f"greatest(extent_{k}, 1e-12)" for k in _K])} AS wide FROM m2 JOIN sizes USING (group_id) LEFT JOIN (SELECT * REPLACE (CASE WHEN scene < 6 THEN last END AS last) FROM lasts) l ON l.scene = group_id % 7),
h AS (SELECT * REPLACE (coalesce(last, group_id) AS last) FROM g)
SELECT query_id, family, {sql_slots([_GROUP_SQL.get(n, n) for n in group_features.GROUP])} FROM h"""
)
def r15_group_features(spark, d):
    rows = group_rows(spark, d).withColumns({"scene": F.col("group_id") % 7, "step": F.col("group_id"), "a_box": F.col("query_id") * 2, "b_box": F.col("query_id") * 2 + 1, "bits": F.lit(0.0)})
    return slots(group_features.group_features(rows), "query_id", "family")


# Contracts.

_CERTIFICATE_ROWS = f"""WITH c AS ({DENSE}), r AS (SELECT query_id, candidate_id % 50 AS work_item_id, interval_t0 AS t0, interval_t1 * 1.01e0 AS t1, candidate_id % 4 AS status, contact_t0 AS toi_upper, 0.3e0 - uncertainty AS safe_margin,
  CASE WHEN candidate_id % 11 = 0 THEN 0e0 ELSE 1e-4 END AS eps_time, candidate_id % 5 AS next_mode, candidate_id % 6 - 1 AS witness_a, candidate_id % 3 AS covered_mask, candidate_id % 2 AS reason FROM c)"""
_CERTIFICATE_FAULTS = {
    "work_item_id": "work_item_id = 0", "query_id": "query_id = 0", "status": "status > 2", "interval": "NOT (t0 >= 0 AND t1 <= 1 AND t0 <= t1)", "toi_upper": "false", "safe_margin": "false", "eps_time": "eps_time <= 0",
    "eps_space": "false", "next_mode": "next_mode > 3", "collision_time": "status = 0 AND NOT toi_upper BETWEEN t0 AND t1", "collision_witness": "status = 0 AND witness_a < 0", "separation_margin": "status = 1 AND safe_margin < 0",
    "separation_family": "status = 1 AND covered_mask = 0", "decided_asks": "status <> 2 AND next_mode <> 0", "undecided_reason": "status = 2 AND reason = 0", "undecided_asks": "status = 2 AND next_mode = 0",
}


@query(
    _CERTIFICATE_ROWS
    + ", f AS (SELECT unnest([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _CERTIFICATE_FAULTS.items()) + "]) AS fault FROM r) SELECT fault, count(*) AS rows FROM f WHERE fault IS NOT NULL GROUP BY fault"
)
def p6_certificate_faults(spark, d):
    """Certificates by the rules that they break."""
    k = F.col("candidate_id")
    rows = dense(spark, d).select(
        "query_id", (k % 50).alias("work_item_id"), F.col("interval_t0").alias("t0"), (F.col("interval_t1") * 1.01).alias("t1"), (k % 4).alias("status"), F.col("contact_t0").alias("toi_upper"),
        (0.3 - F.col("uncertainty")).alias("safe_margin"), F.when(k % 11 == 0, 0.0).otherwise(1e-4).alias("eps_time"), F.lit(1e-6).alias("eps_space"), (k % 5).alias("next_mode"),
        (k % 6 - 1).alias("witness_a"), F.lit(0).alias("witness_b"), (k % 3).alias("covered_mask"), (k % 2).alias("reason"),
    )
    return contracts.faults(rows, validators.certificate()).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("rows"))


# Closest points, approach motions, lines left over.


@query(f"SELECT query_id, family, round(gap, 6) + 0e0 AS gap FROM {certificate_sql.gap(f'({_WIDE})', '0.5e0')}")
def f3_closest_points(spark, d):
    """The distance of the nearest points of the two primitives of every query, half way."""
    return closest.closest_points(views.vertex_queries(spark, d), 0.5).select("query_id", "family", r6(F.col("gap")).alias("gap"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.1e0 AS ax, l_discount * 20e0 AS ay, l_tax * 20e0 AS az, l_extendedprice * 1e-4 AS bx, l_linenumber * 0.7e0 AS "by", CAST(l_partkey % 13 AS DOUBLE) * 0.3e0 AS bz, CAST(l_partkey % 5 AS DOUBLE) * 0.4e0 AS da, CAST(l_suppkey % 7 AS DOUBLE) * 0.3e0 AS db FROM lineitem),
g AS (SELECT *, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) + (bz - az) * (bz - az)) AS size, greatest(da, db, 1e0) * 0.25e0 AS step FROM p)
SELECT l_orderkey, l_linenumber, round(ax + (bx - ax) / size * step, 6) + 0e0 AS x1, round(ay + ("by" - ay) / size * step, 6) + 0e0 AS y1, round(az + (bz - az) / size * step, 6) + 0e0 AS z1 FROM g"""
)
def r21_approach_motions(spark, d):
    real = lambda c, f: F.col(c).cast("double") * f
    rows = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 0.1).alias("a_x0"), (F.col("l_discount") * 20.0).alias("a_y0"), (F.col("l_tax") * 20.0).alias("a_z0"), (F.col("l_extendedprice") * 1e-4).alias("b_x0"),
        real("l_linenumber", 0.7).alias("b_y0"), ((F.col("l_partkey") % 13).cast("double") * 0.3).alias("b_z0"), ((F.col("l_partkey") % 5).cast("double") * 0.4).alias("a_diagonal"), ((F.col("l_suppkey") % 7).cast("double") * 0.3).alias("b_diagonal"),
    )
    return motion.approach_motions(rows, 0.25).select("l_orderkey", "l_linenumber", *[r6(F.col(f"a_{k}1")).alias(f"{k}1") for k in _K])


@query("SELECT l_suppkey, CAST(count(*) % 8 AS BIGINT) AS lines FROM lineitem GROUP BY l_suppkey HAVING count(*) % 8 > 0")
def w10_leftover_lines(spark, d):
    """The lines of each supplier that fill no group of eight and so are in no primitive query."""
    return views.leftover_lines(spark, d)


# Grids of settings, confusion of scenes, robot links.

_GRID = tuple((n, p) for n in (1, 2, 4) for p in (1, 2))


def _grid_sql(n: int, p: int) -> str:
    at = {k: [f"{k}0 + ({k}1 - {k}0) * {t}" for t in ("t0", "t1")] for k in _K}
    shift = {k: f"CASE WHEN patch % 3 = {i} THEN ((patch + 0.5e0) / {float(p)}e0 - 0.5e0) * r * 0.5e0 ELSE 0e0 END" for i, k in enumerate(_K)}
    ends = ", ".join(f"least({', '.join(at[k])}) + {shift[k]} - r / {float(p)}e0 AS min_{k}, greatest({', '.join(at[k])}) + {shift[k]} + r / {float(p)}e0 AS max_{k}" for k in _K)
    rows = f"SELECT s.*, i AS slab_id, patch, CAST(i AS DOUBLE) * {1 / n!r}::DOUBLE AS t0, CASE WHEN i = {n - 1} THEN 1e0 ELSE (i + 1) * {1 / n!r}::DOUBLE END AS t1 FROM ({views.MOVING_SPHERES_SQL}) s, range({n}) t(i), range({p}) u(patch)"
    return f"SELECT {n} AS slabs, {p} AS patches, query_id, slab_id, body_id, {ends} FROM ({rows})"


@query(
    CONTACTS
    + f""", grid AS MATERIALIZED ({" UNION ALL ".join(_grid_sql(n, p) for n, p in _GRID)}),
met AS MATERIALIZED (SELECT a.slabs, a.patches, a.query_id, a.body_id AS a_body_id, b.body_id AS b_body_id, {_TOUCH} AS touch FROM grid a JOIN grid b ON a.slabs = b.slabs AND a.patches = b.patches AND a.query_id = b.query_id AND a.slab_id = b.slab_id AND a.body_id < b.body_id),
found AS (SELECT slabs, patches, query_id, a_body_id, b_body_id, count(*) AS n FROM met WHERE touch GROUP BY ALL), truth AS MATERIALIZED (SELECT query_id, a_body_id, b_body_id FROM contacts WHERE collided),
o AS (SELECT slabs, patches, CAST(sum(n) AS BIGINT) AS raw_hits, count(*) AS candidates, count(t.query_id) AS covered, any_value(positives) AS positives FROM found LEFT JOIN truth t USING (query_id, a_body_id, b_body_id), (SELECT count(*) AS positives FROM truth) GROUP BY slabs, patches)
SELECT CAST(slabs AS INTEGER) AS slabs, CAST(patches AS INTEGER) AS patches, raw_hits, candidates, covered, covered = positives AS feasible,
  row_number() OVER (ORDER BY CASE WHEN covered = positives THEN 0 ELSE 1 END, candidates, raw_hits, slabs, patches) = 1 AS best FROM o"""
)
def m12_grid_ablation(spark, d):
    """Slabs and patches a motion is cut into: what each setting finds, and the feasible one of fewest candidates."""
    setting = ["slabs", "patches"]
    rows = ablation(views.moving_spheres(spark, d), _GRID).withColumn("feasible", F.col("covered") == F.col("positives"))
    # One row per setting: the order of a dozen.
    rows = rows.groupBy().agg(F.collect_list(F.struct("*")).alias("_rows"), F.min_by(F.struct(*setting), F.struct((~F.col("feasible")).alias("a"), "candidates", "raw_hits", *setting)).alias("_best"))
    rows = rows.select(F.explode("_rows").alias("_own"), "_best").select("_own.*", "_best")
    return rows.select(*setting, "raw_hits", "candidates", "covered", "feasible", (F.struct(*setting) == F.col("_best")).alias("best"))


@query(f"SELECT query_id % 10 AS scene, {_CONFUSED} FROM ({_STOP}) GROUP BY ALL")
def a13_scene_confusion(spark, d):
    """Scenes replayed with early stops: what they tell of each group, against the truth."""
    rows = schedule.early_stop(dense(spark, d)).withColumn("scene", F.col("query_id") % 10)
    return metrics.confusion(rows, "truth", "predicted", ["scene"]).select("scene", "tp", "tn", "fp", "fn")


_LINKS = _SAMPLES.replace(_SAMPLES[_SAMPLES.index("WITH s AS (") : _SAMPLES.index("r AS MATERIALIZED")], f"WITH s AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN '{samples.ROBOT_LAWS[0]}' ELSE '{samples.ROBOT_LAWS[1]}' END AS split FROM orders),\n")


@query(_LINKS + f"""SELECT sample_id, {", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in ("a_r", "b_r", "a_x0", "a_x1", "b_x0", "b_x1"))},
  round((CASE WHEN sample_id % 2 = 0 THEN {samples.LAWS[samples.ROBOT_LAWS[0]][3]}e0 ELSE {samples.LAWS[samples.ROBOT_LAWS[1]][3]}e0 END) + {samples.ROBOT_HARDER}e0, 6) AS hardness, true AS capsules FROM m""")
def s17_robot_links(spark, d):
    """Samples of robot links: near contacts and grazing ones in turn, as capsules."""
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(samples.ROBOT_LINKS).alias("split"))
    return samples.sphere_samples(rows, 3).select("sample_id", *[r6(F.col(c)).alias(c) for c in ("a_r", "b_r", "a_x0", "a_x1", "b_x0", "b_x1", "hardness")], "capsules")


_RUN_ROWS = f"""WITH c AS ({DENSE}), rows AS (SELECT 'run' || CAST(query_id % 10 AS VARCHAR) AS run_id, count(*) AS queries, count(*) FILTER (WHERE collides AND priority < 0.0503e0) AS fn, 2.5e0 AS candidates_per_query, CAST(count(*) FILTER (WHERE uncertainty >= 0.2003e0) AS DOUBLE) / count(*) AS calls_per_query, sum(full_cost) AS total_ms FROM c GROUP BY ALL),
lat AS (SELECT 'run' || CAST(query_id % 10 AS VARCHAR) AS run_id, quantile_cont(full_cost, 0.5) AS p50, quantile_cont(full_cost, 0.99) AS p99, max(full_cost) AS top FROM c WHERE query_id % 10 < 5 GROUP BY ALL)
SELECT run_id, queries, fn, CAST(round(calls_per_query * queries) AS BIGINT) AS exact_calls, CAST(round(calls_per_query * queries) AS BIGINT) AS unknown_calls, round(candidates_per_query * queries / greatest(1e0, round(calls_per_query * queries)), 6) AS candidates_per_call,
  round(least(1e0, round(calls_per_query * queries) / greatest(1e0, candidates_per_query * queries)), 6) AS queue_occupancy, round(coalesce(p50, total_ms / queries), 6) AS latency_p50_ms, round(coalesce(p99, total_ms / queries), 6) AS tail_ms, round(coalesce(top, total_ms / queries), 6) AS latency_max_ms
FROM rows LEFT JOIN lat USING (run_id)"""


@query(_RUN_ROWS)
def r19_run_rows(spark, d):
    """Benchmark rows of the earlier contract, one per part of the groups, as rows of the later one; half of the runs have latencies."""
    run = F.concat(F.lit("run"), (F.col("query_id") % 10).cast("string")).alias("run_id")
    own = dense(spark, d)
    rows = own.groupBy(run).agg(
        F.count("*").alias("queries"), F.count_if(F.col("collides") & (F.col("priority") < 0.0503)).alias("fn"), F.lit(2.5).alias("candidates_per_query"),
        (F.count_if(F.col("uncertainty") >= 0.2003).cast("double") / F.count("*")).alias("calls_per_query"), F.sum("full_cost").alias("total_ms"),
    )
    runs = rows.select("run_id", F.lit("dense").alias("dataset"), F.col("run_id").alias("scene"), F.lit("early stop").alias("method"), F.lit("0").alias("config_hash"), F.lit(1).alias("seed"))
    out = metrics.run_rows(rows, runs, own.where(F.col("query_id") % 10 < 5).select(run, F.col("full_cost").alias("ms")))
    return out.select("run_id", "queries", "fn", "exact_calls", "unknown_calls", *[r6(F.col(c)).alias(c) for c in ("candidates_per_call", "queue_occupancy", "latency_p50_ms", "tail_ms", "latency_max_ms")])
