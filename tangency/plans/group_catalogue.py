"""Registered queries on candidate groups, metrics and tables, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.functions import geometry as g
from tangency.operators import broadphase, candidates, certificate, mesh, metrics, schedule, slabs
from tangency.plans.pairs_catalogue import r6
from tangency.sources import rational, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


DENSE = views.DENSE_CANDIDATES_SQL
RANKED = f"WITH c AS ({DENSE}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, cost, candidate_id) AS rn FROM c)"


def dense(spark, d) -> DataFrame:
    return views.dense_candidates(spark, d)


@query(RANKED + "SELECT query_id, candidate_id, rn FROM r")
def w1_rank(spark, d):
    return schedule.ranked(dense(spark, d)).select("query_id", "candidate_id", F.col("rn").cast("long").alias("rn"))


@query(RANKED + "SELECT query_id, CAST(sum(CASE WHEN rn <> candidate_id THEN 1 ELSE 0 END) AS BIGINT) AS reordered, count(*) AS candidates FROM r GROUP BY query_id")
def w5_reordered(spark, d):
    return schedule.reordered(dense(spark, d))


_STOP = RANKED + """, m AS (SELECT *, uncertainty >= 0.97e0 AS hi, collides AND greatest(interval_t0, contact_t0) <= least(interval_t1, contact_t1) AS inside FROM r),
f AS (SELECT *, min(CASE WHEN hi THEN rn END) OVER q AS trip, min(CASE WHEN inside AND NOT hi THEN rn END) OVER q AS hit, min(CASE WHEN collides AND NOT inside AND NOT hi AND rn >= 4 THEN rn END) OVER q AS late FROM m WINDOW q AS (PARTITION BY query_id)),
s AS (SELECT *, least(trip, hit, late) AS stop FROM f),
b AS (SELECT *, min(CASE WHEN collides AND rn >= trip THEN rn END) OVER (PARTITION BY query_id) AS fb FROM s),
e AS (SELECT *, CASE WHEN stop IS NULL THEN 'none' WHEN stop = trip THEN 'trip' WHEN stop = hit THEN 'hit' ELSE 'late' END AS kind FROM b)
SELECT query_id, count(*) AS candidates, bool_or(collides) AS truth,
  CAST(sum(CASE WHEN stop IS NULL OR rn < stop THEN 1 WHEN kind = 'trip' AND rn <= coalesce(fb, 1000000000) THEN 1 WHEN kind = 'hit' AND rn = stop THEN 1 WHEN kind = 'late' AND rn = stop THEN 2 ELSE 0 END) AS BIGINT) AS calls,
  round(sum(CASE WHEN stop IS NULL OR rn < stop THEN narrow_cost + CASE WHEN collides AND NOT inside AND NOT hi THEN full_cost ELSE 0e0 END WHEN kind = 'trip' AND rn <= coalesce(fb, 1000000000) THEN full_cost WHEN kind = 'hit' AND rn = stop THEN narrow_cost
    WHEN kind = 'late' AND rn = stop THEN narrow_cost + 2e0 * full_cost ELSE 0e0 END), 6) AS work,
  CAST(sum(CASE WHEN kind = 'trip' AND rn >= stop AND rn <= coalesce(fb, 1000000000) THEN 1 WHEN kind = 'late' AND rn = stop THEN 1 ELSE 0 END) AS BIGINT) AS fallback_calls,
  bool_or(CASE WHEN kind = 'trip' THEN fb IS NOT NULL ELSE stop IS NOT NULL END) AS predicted
FROM e GROUP BY query_id"""  # fmt: skip


@query(_STOP)
def a11_group_early_stop(spark, d):
    rows = schedule.early_stop(dense(spark, d)).drop("all_work")
    return rows.withColumn("work", r6(F.col("work"))).withColumns({c: F.col(c).cast("long") for c in ("calls", "fallback_calls")})


_CONFUSED = "CAST(count(*) FILTER (WHERE truth AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT truth AND NOT predicted) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE NOT truth AND predicted) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE truth AND NOT predicted) AS BIGINT) AS fn"


@query(f"SELECT {_CONFUSED} FROM ({_STOP})")
def a10_confusion(spark, d):
    return metrics.confusion(schedule.early_stop(dense(spark, d)), "truth", "predicted").select("tp", "tn", "fp", "fn")


@query(RANKED + "SELECT query_id, count(*) AS all_calls, coalesce(min(CASE WHEN collides THEN rn END), count(*)) AS calls, coalesce(min(CASE WHEN collides THEN rn END), count(*) + 1) AS first_rank, bool_or(collides) AS truth FROM r GROUP BY query_id")
def a12_any_hit(spark, d):
    return schedule.any_hit(dense(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("calls", "first_rank")})


@query(RANKED + """, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, rn <= 5 ORDER BY candidate_id) AS rest FROM r)
SELECT query_id, coalesce(min(CASE WHEN collides AND rn <= 5 THEN rn END), least(5, count(*))) AS proposal_calls,
  CASE WHEN min(CASE WHEN collides AND rn <= 5 THEN rn END) IS NOT NULL THEN 0 ELSE coalesce(min(CASE WHEN collides AND rn > 5 THEN rest END), greatest(count(*) - 5, 0)) END AS fallback_calls, bool_or(collides) AS truth FROM s GROUP BY query_id""")  # fmt: skip
def a14_topk_fallback(spark, d):
    return schedule.top_k_then_scan(dense(spark, d), 5)


@query(f"""WITH c AS ({DENSE}), p AS (SELECT query_id, candidate_id, collides, pol, row_number() OVER (PARTITION BY pol, query_id ORDER BY CASE pol WHEN 'priority' THEN priority WHEN 'cheap' THEN -full_cost ELSE uncertainty END DESC, candidate_id) AS rn FROM c, (VALUES ('priority'), ('cheap'), ('unsure')) v(pol)),
q AS (SELECT pol, query_id, count(*) AS n, min(CASE WHEN collides THEN rn END) AS first FROM p GROUP BY ALL)
SELECT pol AS policy, CAST(sum(n) AS BIGINT) AS all_calls, CAST(sum(coalesce(first, n)) AS BIGINT) AS calls, round(1e0 - sum(coalesce(first, n)) / sum(n), 6) + 0e0 AS saved, round(quantile_cont(first, 0.5), 6) AS rank_p50, round(quantile_cont(first, 0.9), 6) AS rank_p90, round(quantile_cont(first, 0.99), 6) AS rank_p99 FROM q GROUP BY pol""")  # fmt: skip
def a16_rank_policy(spark, d):
    policies = {"priority": F.col("priority"), "cheap": -F.col("full_cost"), "unsure": F.col("uncertainty")}
    rows = metrics.rank_policies(dense(spark, d), "query_id", "collides", policies, "candidate_id")
    return rows.withColumns({c: r6(F.col(c)) for c in ("saved", "rank_p50", "rank_p90", "rank_p99")})


@query(f"WITH c AS ({DENSE}) SELECT query_id % 10 AS part, count(full_cost) AS n, round(avg(full_cost), 6) AS mean, round(stddev_samp(full_cost), 6) AS std, round(1.96e0 * stddev_samp(full_cost) / sqrt(count(full_cost)), 6) AS ci95 FROM c GROUP BY query_id % 10")
def a17_mean_interval(spark, d):
    rows = metrics.mean_interval(dense(spark, d).withColumn("part", F.col("query_id") % 10), "full_cost", ["part"])
    return rows.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "ci95")})


_MIX = f"WITH c AS ({DENSE}), o AS (SELECT query_id * 100 + candidate_id % 100 AS grp, count(*) AS n, count(*) FILTER (WHERE collides) AS p FROM c GROUP BY ALL)"


@query(_MIX + "SELECT CASE WHEN p = 0 THEN 'negative' WHEN p = n THEN 'positive' ELSE 'mixed' END AS mix, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM o GROUP BY ALL")
def a18_group_mix(spark, d):
    return metrics.group_mix(dense(spark, d).withColumn("grp", F.col("query_id") * 100 + F.col("candidate_id") % 100), "grp", "collides")


@query(_MIX + "SELECT grp, n, p, round((n + 1) / CAST(p + 1 AS DOUBLE), 6) AS random_calls, round(1e0 / n, 6) AS best_share FROM o WHERE p > 0")
def a34_expected_random(spark, d):
    rows = metrics.expected_random(dense(spark, d).withColumn("grp", F.col("query_id") * 100 + F.col("candidate_id") % 100), "grp", "collides")
    return rows.withColumns({c: r6(F.col(c)) for c in ("random_calls", "best_share")})


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY event_type")
def a19_latency_percentiles(spark, d):
    rows = metrics.percentiles(views.table(spark, d, "events"), "value", ["event_type"])
    return rows.withColumns({c: r6(F.col(c)) for c in ("min", "p50", "p90", "p95", "p99", "max")})


@query("""WITH e AS (SELECT event_type, value, user_id % 7 + 1 AS weight FROM events), w AS (SELECT *, sum(weight) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY event_type) * 0.5e0 AS half FROM e)
SELECT event_type, round(min(value), 6) AS weighted_median FROM w WHERE run >= half GROUP BY event_type""")  # fmt: skip
def a20_weighted_median(spark, d):
    rows = views.table(spark, d, "events").withColumn("weight", F.col("user_id") % 7 + 1)
    return metrics.weighted_median(rows, "value", "weight", ["event_type"]).withColumn("weighted_median", r6(F.col("weighted_median")))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS queries, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))")
def a21_grouping_sets(spark, d):
    measures = {"queries": F.count("*"), "mean_quantity": r6(F.avg("l_quantity"))}
    return metrics.rollup(views.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], measures)


@query("""WITH e AS (SELECT vec_id, k, list_transform(embedding[16 * k + 1:16 * k + 8], lambda x: CAST(x AS DOUBLE)) AS s, list_transform(embedding[16 * k + 9:16 * k + 16], lambda x: CAST(x AS DOUBLE)) AS f, vec_id % 8 AS b FROM embeddings, range(4) t(k)),
u AS (SELECT vec_id, k, s, f, b, unnest(range(8)) AS i FROM e), o AS (SELECT b, list_position(s, list_max(s)) - 1 = b AS t, count(*) FILTER (WHERE i <> b AND (f[i + 1] > f[b + 1] OR (f[i + 1] = f[b + 1] AND i < b))) < 2 AS two FROM u GROUP BY vec_id, k, s, f, b)
SELECT count(*) AS n, round(avg(CASE WHEN t THEN 1e0 ELSE 0e0 END), 6) AS interval_top1, round(avg(CASE WHEN two THEN 1e0 ELSE 0e0 END), 6) AS family_top2 FROM o""")  # fmt: skip
def a22_label_metrics(spark, d):
    part = lambda a: F.transform(F.slice("embedding", F.col("k") * 16 + a, F.lit(8)), lambda x: x.cast("double"))
    bin_ = (F.col("vec_id") % 8).cast("int")
    rows = views.table(spark, d, "embeddings").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    rows = rows.select(part(1).alias("interval_scores"), bin_.alias("interval_bin"), part(9).alias("family_scores"), bin_.alias("family"))
    return metrics.label_metrics(rows).withColumns({c: r6(F.col(c)) for c in ("interval_top1", "family_top2")})


@query(f"WITH c AS ({DENSE}) SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE collides AND uncertainty >= t) AS tp, count(*) FILTER (WHERE NOT collides AND uncertainty < t) AS tn, count(*) FILTER (WHERE NOT collides AND uncertainty >= t) AS fp, count(*) FILTER (WHERE collides AND uncertainty < t) AS fn FROM c, (VALUES (0.1003e0), (0.3003e0), (0.5003e0), (0.9003e0)) v(t) GROUP BY t")
def a23_threshold_curve(spark, d):
    return metrics.threshold_curve(dense(spark, d), "uncertainty", "collides", [0.1003, 0.3003, 0.5003, 0.9003]).select("threshold", "tp", "tn", "fp", "fn")


@query(f"WITH c AS ({DENSE}) SELECT query_id, round(coalesce(min(CASE WHEN collides THEN uncertainty END), -1e30), 6) AS threshold, count(*) FILTER (WHERE collides) AS positives FROM c GROUP BY query_id")
def a24_zero_miss_threshold(spark, d):
    return metrics.zero_miss_threshold(dense(spark, d), "uncertainty", "collides", ["query_id"]).withColumn("threshold", r6(F.col("threshold")))


@query(f"WITH c AS ({DENSE}) SELECT CASE WHEN query_id % 4 IN (1, 2) THEN CAST(query_id % 4 AS VARCHAR) ELSE 'unknown' END AS family, count(*) AS exact_calls, CAST(sum(CASE WHEN collides THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(full_cost), 4) AS work FROM c WHERE uncertainty < 0.8003e0 GROUP BY ALL")
def a27_calls_by_family(spark, d):
    rows = dense(spark, d).where("uncertainty < cast('0.8003' as double)").withColumn("family", F.col("query_id") % 4)
    measures = {"exact_calls": F.count("*"), "hits": F.count_if("collides"), "work": F.round(F.sum("full_cost"), 4)}
    return metrics.calls_by_family(rows, "family", measures, [1, 2])


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(max(value), 6) AS slowest FROM events GROUP BY event_type")
def a28_stage_summary(spark, d):
    return views.table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), r6(F.max("value")).alias("slowest"))


@query(f"WITH c AS ({DENSE}), o AS (SELECT query_id, round(avg(full_cost), 6) AS score, count(*) AS size FROM c GROUP BY ALL) SELECT query_id, score, size FROM o ORDER BY score, size, query_id LIMIT 1")
def a29_argmin(spark, d):
    rows = dense(spark, d).groupBy("query_id").agg(r6(F.avg("full_cost")).alias("score"), F.count("*").alias("size"))
    return metrics.best_setting(rows, "query_id", "score", "size")


@query(f"WITH c AS ({DENSE}), s AS (SELECT query_id, avg(priority) AS m, stddev_pop(priority) AS v FROM c GROUP BY ALL) SELECT c.query_id, candidate_id, round(CASE WHEN v <= 1e-12 THEN 0e0 ELSE (priority - m) / v END, 6) + 0e0 AS z FROM c JOIN s USING (query_id)")
def a31_zscore(spark, d):
    rows = metrics.standard_scores(dense(spark, d), ["priority"], ["query_id"])
    return rows.select("query_id", "candidate_id", r6(F.col("z_priority")).alias("z"))


_Z = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("priority", "cost", "uncertainty"))
_ZS = {c: f"CASE WHEN s_{c} <= 1e-12 THEN 0e0 ELSE ({c} - m_{c}) / s_{c} END" for c in ("priority", "cost", "uncertainty")}


@query(f"WITH c AS ({DENSE}), s AS (SELECT query_id, {_Z} FROM c GROUP BY ALL) SELECT c.query_id, candidate_id, round({_ZS['priority']} - 0.2e0 * ({_ZS['cost']}) - 0.1e0 * ({_ZS['uncertainty']}), 5) + 0e0 AS policy_score FROM c JOIN s USING (query_id)")
def f16_policy_head(spark, d):
    rows = metrics.policy_scores(dense(spark, d), ["query_id"], "cost_aware")
    return rows.select("query_id", "candidate_id", (F.round("policy_score", 5) + 0.0).alias("policy_score"))


@query(f"WITH c AS ({DENSE}), s AS (SELECT query_id, min(full_cost) AS lo, max(full_cost) AS hi FROM c GROUP BY ALL) SELECT c.query_id, candidate_id, round(CASE WHEN hi - lo <= 1e-12 THEN 0.5e0 ELSE (full_cost - lo) / (hi - lo) END, 6) + 0e0 AS unit FROM c JOIN s USING (query_id)")
def a31_unit_interval(spark, d):
    return metrics.unit_interval(dense(spark, d), "full_cost", ["query_id"]).select("query_id", "candidate_id", r6(F.col("unit_full_cost")).alias("unit"))


@query(f"WITH c AS ({DENSE}) SELECT query_id, candidate_id, CAST(least(7, floor(least(1e0, greatest(0e0, (interval_t0 + interval_t1) * 0.5e0)) * 8)) AS INTEGER) AS bin FROM c")
def f13_interval_bin(spark, d):
    return dense(spark, d).select("query_id", "candidate_id", g.interval_bin(F.col("interval_t0"), F.col("interval_t1")).alias("bin"))


@query(f"""WITH c AS ({DENSE}), p AS (SELECT *, CASE WHEN candidate_id % 9 = 0 THEN 'nan'::DOUBLE ELSE priority END AS score, uncertainty >= 0.9003e0 AS unsure FROM c WHERE candidate_id % 5 <> 0)
SELECT c.query_id, count(*) AS candidates, count(*) FILTER (WHERE p.query_id IS NULL) AS missing, count(*) FILTER (WHERE isnan(p.score)) AS invalid, count(*) FILTER (WHERE p.unsure) AS unsure,
  count(*) FILTER (WHERE p.query_id IS NULL OR isnan(p.score) OR p.unsure) AS fallback FROM c LEFT JOIN p ON c.query_id = p.query_id AND c.candidate_id = p.candidate_id GROUP BY ALL""")  # fmt: skip
def j10_left_predictions(spark, d):
    rows = dense(spark, d).select("query_id", "candidate_id", "priority", "uncertainty")
    score = F.when(F.col("candidate_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("priority"))
    made = rows.where("candidate_id % 5 <> 0").select("query_id", "candidate_id", score.alias("score"), F.col("uncertainty").alias("pred_uncertainty"), F.array(F.col("priority")).alias("features"))
    out = schedule.with_predictions(rows, made, 0.9003).groupBy("query_id")
    return out.agg(F.count("*").alias("candidates"), *[F.count_if(c).alias(c) for c in ("missing", "invalid", "unsure", "fallback")])


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR abs(x) > 0.3e0)) > 0 AS ood FROM embeddings")
def p8_ood(spark, d):
    return views.table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) > 0.3)).alias("ood"))


@query("""SELECT l_returnflag AS flag, count(*) AS rows, count(*) FILTER (WHERE NOT (l_discount >= 0 AND l_discount <= 0.0703e0)) AS bad_discount, count(*) FILTER (WHERE NOT (l_linenumber BETWEEN 1 AND 6)) AS bad_line, count(*) FILTER (WHERE l_orderkey IS NULL) AS no_id FROM lineitem GROUP BY ALL""")
def p6_validate_rows(spark, d):
    from tangency.functions.contracts import faults

    rules = {"bad_discount": F.col("l_discount").between(0.0, 0.0703), "bad_line": F.col("l_linenumber").between(1, 6), "no_id": F.col("l_orderkey").isNotNull()}
    rows = faults(views.table(spark, d, "lineitem"), rules)
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("rows"), *[F.count_if(F.array_contains("faults", c)).alias(c) for c in rules])


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(exp(-abs(ln((a.s_acctbal + 2000e0) / (b.s_acctbal + 2000e0)))), 6) AS score FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def j13_combinations(spark, d):
    rows = views.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") + 2000.0).alias("w"))
    a, b = (rows.select("s_nationkey", F.col("s_suppkey").alias(s), F.col("w").alias(f"w{s}")) for s in "ab")
    return a.join(b, "s_nationkey").where("a < b").select("a", "b", r6(F.exp(-F.abs(F.ln(F.col("wa") / F.col("wb"))))).alias("score"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), b AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.k, a.o_orderkey, coalesce(b.event_id, -1) AS event_id FROM a LEFT JOIN b USING (k, i)""")  # fmt: skip
def j14_positional_join(spark, d):
    a = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = views.table(spark, d, "events").select(F.col("user_id").alias("k"), "event_id")
    return rational.positional_join(a, b, "k", "o_orderkey", "event_id").withColumn("event_id", F.coalesce("event_id", F.lit(-1).cast("long")))


@query(f"""WITH c AS ({DENSE}), s AS (SELECT query_id, candidate_id, max(priority) AS score FROM c WHERE candidate_id % 3 = 0 GROUP BY ALL)
SELECT c.query_id, c.candidate_id, row_number() OVER (PARTITION BY c.query_id ORDER BY s.score DESC NULLS LAST, c.candidate_id) AS place FROM c LEFT JOIN s USING (query_id, candidate_id)""")  # fmt: skip
def j15_merge_schedule(spark, d):
    rows = dense(spark, d).select("query_id", "candidate_id", "priority")
    made = rows.where("candidate_id % 3 = 0").withColumnRenamed("priority", "score")
    return schedule.merge_schedule(rows, made, "query_id", "candidate_id").select("query_id", "candidate_id", F.col("place").cast("long").alias("place"))


@query("""WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY ALL)
SELECT k, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right, CASE WHEN l.n IS NULL THEN 'missing_left' WHEN r.n IS NULL THEN 'missing_right' ELSE 'repeated' END AS fault FROM l FULL JOIN r USING (k) WHERE l.n IS NULL OR r.n IS NULL OR l.n > 1 OR r.n > 1""")  # fmt: skip
def j16_conservation(spark, d):
    left = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return candidates.conservation_faults(left, views.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR b IS DISTINCT FROM event_type")
def w8_changes(spark, d):
    return schedule.changes(views.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS round FROM events")
def w9_round_robin(spark, d):
    return schedule.interleave(views.table(spark, d, "events"), "event_type", "event_id").select("event_type", "event_id", F.col("round").cast("long").alias("round"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def w11_quota(spark, d):
    return schedule.quota(views.table(spark, d, "events"), "user_id", "event_id", 5).select("user_id", "event_id")


@query(f"WITH c AS ({DENSE}) SELECT query_id, count(*) AS rows FROM c, range(3) t(i) WHERE collides OR i = 0 GROUP BY query_id")
def w11_oversample(spark, d):
    return schedule.oversample(dense(spark, d), F.col("collides"), 3).groupBy("query_id").agg(F.count("*").alias("rows"))


@query("""WITH n AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS n FROM lineitem)
SELECT l_suppkey * 1000000 + n // 8 AS query_id, CASE WHEN (n // 8) % 2 = 0 THEN 'vf' ELSE 'ee' END AS family, round(sum(l_quantity * 0.0973e0), 6) AS x_sum FROM n GROUP BY l_suppkey, n // 8 HAVING count(*) = 8""")  # fmt: skip
def w10_chunk_by_8(spark, d):
    total = sum((F.col(f"v{3 * i}") for i in range(1, 8)), F.col("v0"))
    return views.vertex_queries(spark, d).select("query_id", "family", r6(total).alias("x_sum"))


@query("SELECT s_nationkey, s_suppkey, CASE WHEN n = 1 THEN 'heldout' WHEN i <= floor(n * 0.7e0) THEN 'train' WHEN i <= floor(n * 0.7e0) + floor(n * 0.1e0) THEN 'validation' ELSE 'heldout' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256(CAST(s_suppkey AS VARCHAR))) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)")
def f20_split(spark, d):
    return metrics.stratified_split(views.table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey").select("s_nationkey", "s_suppkey", "split")


@query("""SELECT CAST(s AS INTEGER) AS slab_id, count(*) AS rows, CAST(sum(n % 4 + 1) AS BIGINT) AS hits, round(sum(1e0 + n / 13e0), 4) AS full_cost FROM (SELECT s, (s_suppkey * 31 + s * 17 + a * 7 + b * 3) % 13 AS n FROM supplier, range(4) x(s), range(3) y(a), range(3) z(b)) GROUP BY s""")
def r10_dense_workload(spark, d):
    rows = slabs.dense_workload(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id")), 4, 3, 3)
    return rows.groupBy("slab_id").agg(F.count("*").alias("rows"), F.sum("hits").alias("hits"), F.round(F.sum("full_cost"), 4).alias("full_cost"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 211 AS mesh, o_orderkey % 23 AS a, (o_orderkey * 5 + o_custkey) % 23 AS b FROM orders), u AS (SELECT mesh, a, b FROM e UNION SELECT mesh, b, a FROM e),
r AS (SELECT mesh, a AS node, a AS reach FROM u UNION SELECT r.mesh, r.node, u.b FROM r JOIN u ON r.mesh = u.mesh AND r.reach = u.a) SELECT mesh, node, min(reach) AS component FROM r GROUP BY ALL""")  # fmt: skip
def a32_components(spark, d):
    rows = views.table(spark, d, "orders")
    edges = rows.select((F.col("o_custkey") % 211).alias("mesh"), (F.col("o_orderkey") % 23).alias("a"), ((F.col("o_orderkey") * 5 + F.col("o_custkey")) % 23).alias("b"))
    return mesh.components(edges.distinct())


@query("""WITH t AS (SELECT o_custkey % 50 AS mesh, o_orderkey % 41 AS v0, (o_orderkey * 3 + 1) % 41 AS v1, (o_orderkey * 7 + 2) % 41 AS v2 FROM orders), e AS (SELECT mesh, v0 AS a, v1 AS b FROM t UNION ALL SELECT mesh, v1, v2 FROM t UNION ALL SELECT mesh, v2, v0 FROM t)
SELECT DISTINCT mesh, least(a, b) AS a, greatest(a, b) AS b FROM e""")  # fmt: skip
def a6_unique_edges(spark, d):
    k = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("mesh"), (k % 41).alias("v0"), ((k * 3 + 1) % 41).alias("v1"), ((k * 7 + 2) % 41).alias("v2"))
    return mesh.unique_edges(rows)


@query("SELECT s_suppkey AS body, s_nationkey AS mesh, s_suppkey % 3 = 0 AS fixed_a, b.k AS other FROM supplier a JOIN (SELECT s_suppkey AS k, s_nationkey AS nk FROM supplier) b ON a.s_nationkey = b.nk AND a.s_suppkey < b.k WHERE NOT (a.s_suppkey % 3 = 0 AND b.k % 3 = 0)")
def p12_rigid_pairs(spark, d):
    rows = views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("mesh"), F.col("s_suppkey").alias("body_id"), (F.col("s_suppkey") % 3 == 0).alias("fixed"))
    found = broadphase.rigid_pairs(rows, ("mesh",))
    return found.select(F.col("a_body_id").alias("body"), "mesh", F.col("a_fixed").alias("fixed_a"), F.col("b_body_id").alias("other"))


@query("""WITH t AS (SELECT o_orderkey % 1000 AS mesh, o_custkey % 3 AS patch, o_totalprice * 0.001e0 AS x0, CAST(o_custkey AS DOUBLE) * 0.01e0 AS y0, CAST(o_orderkey % 7 AS DOUBLE) AS z0 FROM orders),
c AS (SELECT *, x0 + 1e0 AS x1, y0 AS y1, z0 AS z1, x0 AS x2, y0 + 2e0 AS y2, z0 AS z2, 1e0 AS area FROM t), s AS (SELECT mesh, patch, count(*) AS triangles, sum(area) AS area, avg((x0 + x1 + x2) / 3) AS cx, avg((y0 + y1 + y2) / 3) AS cy, avg((z0 + z1 + z2) / 3) AS cz FROM c GROUP BY ALL)
SELECT s.mesh, s.patch AS patch_id, triangles, round(s.area, 6) AS area, round(cx, 3) AS cx, round(max(sqrt(greatest((x0-cx)**2+(y0-cy)**2+(z0-cz)**2, (x1-cx)**2+(y1-cy)**2+(z1-cz)**2, (x2-cx)**2+(y2-cy)**2+(z2-cz)**2))), 3) AS radius FROM s JOIN c ON s.mesh = c.mesh AND s.patch = c.patch GROUP BY ALL""")  # fmt: skip
def a3_patch_stats(spark, d):
    x, y, z = F.col("o_totalprice") * 0.001, F.col("o_custkey").cast("double") * 0.01, (F.col("o_orderkey") % 7).cast("double")
    rows = views.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 1000).alias("mesh"), (F.col("o_custkey") % 3).alias("patch_id"), x.alias("x0"), y.alias("y0"), z.alias("z0"),
        (x + 1.0).alias("x1"), y.alias("y1"), z.alias("z1"), x.alias("x2"), (y + 2.0).alias("y2"), z.alias("z2"),
    )
    out = mesh.patch_stats(rows)
    return out.select("mesh", "patch_id", "triangles", r6(F.col("area")).alias("area"), F.round("cx", 3).alias("cx"), F.round("radius", 3).alias("radius"))


@query(f"""WITH c AS ({DENSE}), i AS (SELECT *, candidate_id % 3 AS status, candidate_id % 9 AS depth, interval_t0 + 0.05e0 AS toi FROM c WHERE candidate_id % 9 < 8),
k AS (SELECT query_id, candidate_id, 0 AS child, interval_t0 AS t0, toi AS t1, depth FROM i WHERE status = 0 UNION ALL SELECT query_id, candidate_id, 0, interval_t0, (interval_t0 + interval_t1) * 0.5e0, depth FROM i WHERE status = 2 UNION ALL SELECT query_id, candidate_id, 1, (interval_t0 + interval_t1) * 0.5e0, interval_t1, depth FROM i WHERE status = 2)
SELECT query_id, candidate_id, CAST(child AS INTEGER) AS child, round(t0, 6) AS t0, round(t1, 6) AS t1, depth + 1 AS depth FROM k""")  # fmt: skip
def x6_refine_children(spark, d):
    rows = dense(spark, d).select(
        "query_id", "candidate_id", F.col("interval_t0").alias("t0"), F.col("interval_t1").alias("t1"), (F.col("candidate_id") % 9).alias("depth"),
        (F.col("candidate_id") % 3).alias("status"), (F.col("interval_t0") + 0.05).alias("toi_upper"),
    )
    return certificate.refined(rows).select("query_id", "candidate_id", "child", r6(F.col("t0")).alias("t0"), r6(F.col("t1")).alias("t1"), "depth")


@query(f"""WITH c AS ({DENSE}), p AS (SELECT query_id, candidate_id // 4 AS item, CASE WHEN candidate_id % 2 = 0 THEN 'vf' ELSE 'ee' END AS family, candidate_id AS ord, CASE WHEN collides THEN 0 WHEN candidate_id % 13 = 0 THEN 2 ELSE 1 END AS status, interval_t0 AS toi, full_cost AS margin, 1 << CAST(candidate_id % 2 AS INTEGER) AS mask FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY CASE WHEN status = 0 THEN 0 ELSE 1 END, CASE WHEN family = 'vf' THEN 0 ELSE 1 END, ord) AS n FROM p)
SELECT query_id, item, CAST(CASE WHEN min(status) = 0 THEN 0 WHEN max(status) = 2 THEN 2 ELSE 1 END AS INTEGER) AS status, round(coalesce(max(CASE WHEN n = 1 AND status = 0 THEN toi END), 1e0), 6) AS toi_upper, coalesce(max(CASE WHEN n = 1 AND status = 0 THEN ord END), -1) AS witness,
  round(CASE WHEN min(status) = 1 AND max(status) = 1 THEN min(margin) ELSE 0e0 END, 6) AS margin, CAST(bit_or(mask) AS INTEGER) AS mask, count(*) AS primitives FROM w GROUP BY query_id, item""")  # fmt: skip
def a8_certificate_reduction(spark, d):
    k = F.col("candidate_id")
    rows = dense(spark, d).select(
        "query_id", F.floor(k / 4).alias("item"), F.when(k % 2 == 0, "vf").otherwise("ee").alias("family"), k.alias("ord"),
        F.when(F.col("collides"), 0).when(k % 13 == 0, 2).otherwise(1).alias("status"), F.col("interval_t0").alias("toi_upper"), F.col("full_cost").alias("margin"),
        F.call_function("shiftleft", F.lit(1), (k % 2).cast("int")).alias("mask"),
    )
    out = certificate.reduce_primitives(rows, ["query_id", "item"])
    return out.withColumns({"toi_upper": r6(F.coalesce("toi_upper", F.lit(1.0))), "witness": F.coalesce("witness", F.lit(-1).cast("long")), "margin": r6(F.col("margin"))})


@query("SELECT user_id, event_id, a AS action, CAST(2 * n - CASE WHEN a = 'dequeue' THEN 1 ELSE 0 END AS BIGINT) AS audit_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), (VALUES ('dequeue'), ('certify')) v(a)")
def x5_audit_rows(spark, d):
    rows = views.table(spark, d, "events").select("user_id", F.col("event_id").alias("item"))
    return certificate.audit(rows, "user_id", "item").select("user_id", F.col("item").alias("event_id"), "action", F.col("event_id").alias("audit_id"))


@query(None)
def x1_certificate(spark, d):
    rows = certificate.certificates(views.vertex_queries(spark, d))
    return rows.select("query_id", "family", "status", r6(F.col("toi_upper")).alias("toi_upper"), r6(F.col("margin")).alias("margin"), "evaluations")


@query(None)
def m5_scheduled_exact(spark, d):
    """Scored candidates in order, each group until its first possible collision, certified or undecided; later ones are not certified."""
    rows = views.vertex_queries(spark, d)
    scored = rows.select(
        "*", F.floor(F.col("query_id") / 1_000_000).alias("grp"), F.col("query_id").alias("candidate_id"), (-F.abs(F.col("v0") - F.col("v3"))).alias("priority"), F.lit(0.0).alias("cost")
    )

    def certify(wave: DataFrame) -> DataFrame:
        return certificate.certificates(wave).withColumn("collides", F.col("status") != certificate.SEPARATION)

    scored = scored.drop("query_id").withColumnRenamed("grp", "query_id")
    return schedule.certified_until_hit(scored, certify)
