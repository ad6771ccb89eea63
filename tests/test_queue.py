"""The work queue, sweeps, bounded top-k, best distance, hashes and training against plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangency.functions import hashes, scores
from tangency.operators import broadphase, certificate, closest, heaps, inference, metrics, schedule, sweep, training, workqueue
from tangency.sources import views

FOLDER = "/root/testdata/sf0.001"
TRIANGLE = [(0, 0, 0), (1, 0, 0), (0, 1, 0)]


def _query(start, end):
    return [float(x) for p in (*start, *end) for x in p]


@pytest.fixture(scope="module")
def primitives(spark):
    """A point through a triangle, one that stays off, crossing edges, and a point that slides close above it (undecided)."""
    rows = [
        (1, "vf", *_query([(0.25, 0.25, 1), *TRIANGLE], [(0.25, 0.25, -3), *TRIANGLE])),
        (2, "vf", *_query([(0.25, 0.25, 2), *TRIANGLE], [(0.25, 0.25, 2), *TRIANGLE])),
        (3, "ee", *_query([(-1, 0, 0), (1, 0, 0), (0, -1, 1), (0, 1, 1)], [(-1, 0, 0), (1, 0, 0), (0, -1, -3), (0, 1, -3)])),
        (4, "vf", *_query([(0.1, 0.1, 1e-5), *TRIANGLE], [(0.4, 0.4, 1e-5), *TRIANGLE])),
    ]
    return spark.createDataFrame(rows, "query_id long, family string, " + ", ".join(f"{v} double" for v in certificate.VALUES))


# The queue


def test_queue_reaches_the_outcome_of_full_depth(spark, primitives):
    whole = {r.query_id: r.status for r in certificate.certificates(primitives).collect()}
    items = workqueue.process(primitives).cache()
    found = {r.query_id: r for r in workqueue.outcomes(items).collect()}
    assert {k: r.status for k, r in found.items()} == whole and set(whole.values()) == {0, 1, 2}
    assert found[1].toi_upper == pytest.approx(0.25, abs=1e-6)
    final = items.where("status = 2 and not refined").select(F.col("t1") - F.col("t0")).collect()
    assert final and all(r[0] <= 1.0e-4 for r in final)


def test_queue_loses_and_doubles_nothing(spark):
    items = workqueue.process(views.vertex_queries(spark, FOLDER)).cache()
    rows = items.collect()
    keys = Counter((r.query_id, r.work_item_id) for r in rows)
    assert max(keys.values()) == 1
    for r in rows:
        assert r.work_item_id == 1 or (r.query_id, r.work_item_id // 2) in keys
        assert ((r.query_id, r.work_item_id * 2) in keys) == ((r.query_id, r.work_item_id * 2 + 1) in keys) == r.refined
    events = workqueue.audit(items).toPandas()
    for _, own in events.groupby("query_id"):
        assert sorted(own["event_id"]) == list(range(1, len(own) + 1))
    # The final items of a query are a partition of its time.
    for _, own in items.where("not refined").toPandas().groupby("query_id"):
        own = own.sort_values("t0")
        assert own["t0"].iloc[0] == 0 and own["t1"].iloc[-1] == 1 and (own["t0"].to_numpy()[1:] == own["t1"].to_numpy()[:-1]).all()


def test_empty_queue(spark, primitives):
    assert workqueue.outcomes(workqueue.process(primitives.limit(0))).count() == 0


def test_conservation_finds_what_was_lost_doubled_or_altered(spark):
    rows = [(q, c, 3) for q in range(5) for c in range(40)]
    table = spark.createDataFrame(rows, "query_id long, candidate_id long, family_mask int")
    other = lambda r: spark.createDataFrame(r, table.schema)
    swapped = [(q, 1 - c if c < 2 else c, m) for q, c, m in rows]
    sides = {
        "same": rows[::-1], "swapped": swapped, "lost": rows[1:], "doubled": rows + rows[:1], "altered": [(0, 0, 1), *rows[1:]],
        "moved": [(1, 0, 3), *rows[1:]], "one for another": [*rows[1:], rows[1]],
    }
    found = {r.check_name: r for r in workqueue.conservation({k: (table, other(r)) for k, r in sides.items()}).collect()}
    assert {k: r.conserved for k, r in found.items()} == {k: k in ("same", "swapped") for k in sides}
    assert (found["lost"].rows_left, found["lost"].rows_right) == (200, 199)
    assert [tuple(r) for r in workqueue.differences(table, other(sides["altered"])).orderBy("family_mask").collect()] == [(0, 0, 1, 0, 1), (0, 0, 3, 1, 0)]
    assert workqueue.conservation({"none": (table.limit(0), table.limit(0))}).first().conserved
    with pytest.raises(ValueError, match="types"):
        workqueue.conservation({"x": (table, table.select("query_id"))})


# Sweeps


def _boxes(spark, n, groups, seed, wide=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        low = [round(rng.random() * 4, 1) for _ in range(3)]
        rows.append((i % groups, i, *low, *[x + round(rng.random() * wide * 10, 1) for x in low]))
    return spark.createDataFrame(rows, "query_id long, body_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"), rows


def _touching(rows):
    return {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and all(a[2 + k] <= b[5 + k] and b[2 + k] <= a[5 + k] for k in range(3))}


@pytest.mark.parametrize("axis, strip_rows", [("x", 20_000), ("y", 40), ("x", 7)])
def test_sweep_finds_all_pairs_once_and_counts_as_one_sweep(spark, axis, strip_rows):
    boxes, rows = _boxes(spark, 300, 3, 5)
    found = [tuple(r) for r in sweep.sweep_pairs(boxes.repartition(5), axis=axis, strip_rows=strip_rows).collect()]
    assert len(found) == len(set(found)) and set(found) == _touching(rows)
    k = "xyz".index(axis)
    counters = {r.query_id: r for r in sweep.sweep_counters(boxes, axis=axis, strip_rows=strip_rows).collect()}
    for q in range(3):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2 + k], r[1]))
        open_, tests, removals, peak = [], 0, 0, 0
        for r in own:
            left = [o for o in open_ if o[5 + k] >= r[2 + k]]
            removals, tests = removals + len(open_) - len(left), tests + len(left)
            open_ = [*left, r]
            peak = max(peak, len(open_))
        assert (counters[q].boxes, counters[q].tests, counters[q].removals, counters[q].peak) == (len(own), tests, removals, peak)


def test_sweep_of_a_scene_and_of_odd_boxes(spark):
    boxes, rows = _boxes(spark, 200, 1, 8)
    found = {tuple(r) for r in sweep.sweep_pairs(boxes.drop("query_id"), (), strip_rows=30).collect()}
    assert found == {p[1:] for p in _touching(rows)}
    odd = spark.createDataFrame([(None, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (None, 2, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (1, 3, None, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 4, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)], boxes.schema)
    assert [tuple(r) for r in sweep.sweep_pairs(odd).collect()] == [(None, 1, 2)]
    assert sweep.sweep_pairs(boxes.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 90, 0])
def test_pairs_of_crowded_keys(spark, most):
    """Keys of many boxes by grids, others by a join: all pairs once, either way."""
    boxes, rows = _boxes(spark, 260, 1, 3)
    few, more = _boxes(spark, 60, 4, 4)
    rows, more = [(9, *r[1:]) for r in rows], more
    table = boxes.withColumn("query_id", F.lit(9).cast("long")).union(few).withColumn("note", F.col("body_id") * 2)
    found = [(r.query_id, r.a_body_id, r.b_body_id) for r in broadphase.query_pairs(table, most=most).collect()]
    assert len(found) == len(set(found)) and set(found) == _touching(rows + more)
    assert len(found) == broadphase.query_pairs(table, most=most, counted=table.select("query_id")).count()
    assert all(r.a_note == 2 * r.a_body_id and r.b_note == 2 * r.b_body_id for r in broadphase.query_pairs(table, most=most).collect())


# The first rows of groups


@pytest.mark.parametrize("k", [1, 3, 50])
def test_heaps_equal_a_window(spark, k):
    rng = random.Random(k)
    rows = [(None if i % 41 == 0 else 7 if i % 2 else i % 9, i, rng.choice([None, float("nan"), -1.0, 0.0, 2.0]), rng.choice([None, float("nan"), 0.0, 1.0, 2.0])) for i in range(1500)]
    table = spark.createDataFrame(rows, "query_id long, candidate_id long, priority double, cost double").repartition(6)
    found = {(r.query_id, r.rn): r.candidate_id for r in heaps.first_rows(table, ["query_id"], schedule.ORDER, k, held=20).collect()}
    wanted = {(r.query_id, r.rn): r.candidate_id for r in schedule.ranked(table).where(F.col("rn") <= k).collect()}
    assert found == wanted
    assert heaps.first_rows(table.limit(0), ["query_id"], schedule.ORDER, k).count() == 0


@pytest.mark.parametrize("most, certified", [(0, False), (560, True), (0, True)])
def test_groups_too_large_for_a_rank_stop_alike(spark, most, certified):
    """Stops by keys and joins are those by ranks, also where priorities tie or are missing."""
    rows = views.dense_candidates(spark, FOLDER)
    rows = rows.withColumn("priority", F.when(F.col("candidate_id") % 17 == 0, F.lit(None)).when(F.col("candidate_id") % 19 == 0, float("nan")).otherwise(F.col("priority")))
    rows = rows.union(rows.limit(2).withColumn("query_id", F.lit(-1).cast("long")))
    wanted, found = (sorted(map(str, schedule.early_stop(rows, certified=certified, most=m).withColumn("work", F.round("work", 6)).withColumn("all_work", F.round("all_work", 6)).collect())) for m in (schedule.MOST_RANKED, most))
    assert found == wanted and len(found) == 11


@pytest.mark.parametrize("k", [1, 5, 10_000])
def test_proposals_by_heaps_are_those_by_ranks(spark, k):
    rows = views.dense_candidates(spark, FOLDER).withColumn("collides", F.col("collides") & (F.col("query_id") > 2))
    wanted, found = (sorted(map(tuple, schedule.top_k_then_scan(rows, k, most=m).collect())) for m in (schedule.MOST_RANKED, 0))
    assert found == wanted and len(found) == 10


# The best-distance certificate


def _plain(row, face, limits, t0=0.0, t1=1.0, depth=0):
    """(status, toi, margin, evaluations, depth, samples) by recursion."""
    at = lambda t: float(certificate.distance((row[:12] + (row[12:] - row[:12]) * t).reshape(1, 4, 3), face)[0])
    mid = 0.5 * (t0 + t1)
    tried = [(t0, at(t0)), (mid, at(mid)), (t1, at(t1))]
    best = min(tried, key=lambda x: x[1])
    if best[1] <= limits.eps_space:
        return 0, best[0], 0.0, 3, depth, tried
    speed = np.linalg.norm((row[12:] - row[:12]).reshape(4, 3), axis=1)
    reach = speed[0] + speed[1:].max() if face else speed[:2].max() + speed[2:].max()
    bound = tried[1][1] - reach * 0.5 * (t1 - t0)
    if bound > limits.eps_space:
        return 1, t1, bound - limits.eps_space, 3, depth, tried
    if depth >= limits.depth or t1 - t0 <= limits.eps_time:
        return 2, t1, 0.0, 3, depth, tried
    left = _plain(row, face, limits, t0, mid, depth + 1)
    if left[0] == 0:
        return *left[:3], left[3] + 3, left[4], tried + left[5]
    right = _plain(row, face, limits, mid, t1, depth + 1)
    n, deep, tried = left[3] + right[3] + 3, max(left[4], right[4]), tried + left[5] + right[5]
    if right[0] == 0:
        return *right[:3], n, deep, tried
    if left[0] == right[0] == 1:
        return 1, t1, min(left[2], right[2]), n, deep, tried
    return 2, t1, 0.0, n, deep, tried


def test_best_distance_equals_recursion(spark, primitives):
    limits = certificate.Limits(depth=9)
    for r in closest.best_certificates(primitives.union(views.vertex_queries(spark, FOLDER).limit(150)), limits).collect():
        status, toi, margin, evaluations, depth, tried = _plain(np.array([r[v] for v in certificate.VALUES]), r.family == "vf", limits)
        assert (r.status, r.evaluations, r.depth) == (status, evaluations, depth)
        assert r.toi == (toi if status == 0 else 1.0) and r.margin == pytest.approx(margin, abs=1e-12)
        assert r.least_distance == min(d for _, d in tried)
        assert r.least_time in [t for t, d in tried if d == r.least_distance] and r.sample in closest.SAMPLES
    found = {r.query_id: r for r in closest.best_certificates(primitives).collect()}
    assert found[1].toi == pytest.approx(0.25, abs=1e-6) and found[1].status == 0 and found[3].status == 0


# Hashes


def test_hashes_against_python(spark):
    texts = ["", "a", "foobar", "é😀", "x" * 300, None]

    def fnv(text):
        h = hashes.FNV_OFFSET
        for b in text.encode():
            h = ((h ^ b) * hashes.FNV_PRIME) % (1 << 64)
        return h

    def mix(x):
        x = (x + hashes.MIX_STEP) % (1 << 64)
        for shift, factor in zip((30, 27), hashes.MIX_MULTIPLIERS):
            x = ((x ^ x >> shift) * factor) % (1 << 64)
        return x ^ x >> 31

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashes.fnv1a("t").alias("h")).withColumn("m", hashes.mix64("h"))
    for r in rows.withColumn("u", hashes.unit(F.col("m"))).collect():
        if r.t is None:
            assert (r.h, r.m, r.u) == (None, None, None)
        else:
            assert r.h % (1 << 64) == fnv(r.t) and r.m % (1 << 64) == mix(fnv(r.t)) and r.u == (mix(fnv(r.t)) >> 11) / (1 << 53)
    ends = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 0x123456789ABCDEF]
    pairs = spark.createDataFrame([(a, b) for a in ends for b in ends], "a long, b long")
    for r in pairs.select("a", "b", hashes.add64(F.col("a"), F.col("b")).alias("s"), hashes.multiply64(F.col("a"), 0xBF58476D1CE4E5B9).alias("p")).collect():
        assert r.s % (1 << 64) == (r.a + r.b) % (1 << 64) and r.p % (1 << 64) == (r.a * 0xBF58476D1CE4E5B9) % (1 << 64)


def test_digests_of_configurations():
    assert hashes.config_digest({"b": 1, "a": [1.5, None]}) == hashes.config_digest({"a": [1.5, None], "b": 1}) != hashes.config_digest({"a": [1.5], "b": 1})
    assert hashes.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    with pytest.raises(ValueError):
        hashes.canonical_json(float("nan"))
    assert hashes.blake_id("x:1") == hashes.blake_id("x:1") != hashes.blake_id("x:2") and 0 <= hashes.blake_unit("x") <= 1


def test_one_hot(spark):
    rows = spark.createDataFrame([(0,), (2,), (5,), (None,)], "i int").select(scores.one_hot(F.col("i"), 3).alias("v")).collect()
    assert [list(r.v) for r in rows] == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]


def test_order_of_policy_heads():
    assert metrics.policy_head("common_modeling_large", density=300) == "priority_only"
    assert metrics.policy_head("shapenet_ood_dense", density=300) == "cost_aware"
    assert metrics.policy_head("common_modeling_large", hard_negative=True) == "risk_proximity_hybrid"


# Training


def _training_rows(spark, n=400):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(n):
        x = rng.normal(size=32)
        k = int(x[0] > 0) + 2 * int(x[1] > 0)
        rows.append((x.tolist(), np.eye(8)[k].tolist(), [float(x[2] > 0)] * 2 + [0.0] * 6, float(x[0] > 0), float(1 + abs(x[1])), float(x[3] > 0)))
    rows += [(None, *rows[0][1:]), ([float("nan")] * 32, *rows[0][1:]), (*rows[0][:3], None, 1.0, 0.0)]
    return spark.createDataFrame(rows, "features array<double>, interval_targets array<double>, family_targets array<double>, priority_target double, cost_target double, uncertainty_target double")


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    n = 20
    targets = {"interval_targets": np.eye(8)[rng.integers(0, 8, n)], "family_targets": rng.integers(0, 2, (n, 8)).astype(float)}
    targets |= {t: rng.random(n) * 3 for t in training.TARGETS[2:]}
    network, x = inference.Network.seeded(8, 2), rng.normal(size=(n, 32))
    loss, slope = training.gradient(network, x, targets)
    values = training.flattened(network)
    assert slope.shape == values.shape and loss > 0
    for i in rng.integers(0, len(values), 60):
        step = np.zeros_like(values)
        step[i] = 1e-6
        one, two = (training.gradient(training.unflattened(values + s * step, network), x, targets)[0] for s in (1, -1))
        assert (one - two) / 2e-6 == pytest.approx(slope[i], rel=1e-3, abs=1e-4)


def test_training_over_tasks(spark):
    rows = _training_rows(spark)
    plan = training.Plan(epochs=8, batches=2)
    one, history = training.train(rows.coalesce(1), inference.Network.seeded(16), plan)
    two, again = training.train(rows.repartition(8), inference.Network.seeded(16), plan)
    assert np.allclose(training.flattened(one), training.flattened(two), atol=1e-8)
    assert [h[:2] for h in history] == [h[:2] for h in again] == [(e, b) for e in range(8) for b in range(2)]
    assert history[-1][2] < 0.7 * history[0][2]
    scored = inference.scored(rows.where("features is not null").withColumn("id", F.monotonically_increasing_id()), one, ["id"])
    assert scored.where("not ood and priority between 0 and 1").count() == 401


def test_training_without_rows(spark):
    network, history = training.train(_training_rows(spark).limit(0), inference.Network.seeded(16), training.Plan(epochs=2))
    assert history == [] and np.array_equal(training.flattened(network), training.flattened(inference.Network.seeded(16)))
