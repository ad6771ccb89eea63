"""Analytic cases, readers and streams."""

import itertools
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tangency.functions import contracts
from tangency.functions import geometry as g
from tangency.operators import broadphase, certificate, inference, mesh, metrics, schedule
from tangency.plans import suite
from tangency.sources import meshes, rational
from tangency.streaming import audit_stream


def _row(vertices0, vertices1):
    return np.concatenate([np.array(vertices0, float).ravel(), np.array(vertices1, float).ravel()])


TRIANGLE = [(0, 0, 0), (1, 0, 0), (0, 1, 0)]


def test_certificate_finds_point_through_triangle():
    rows = np.stack([_row([(0.25, 0.25, 1), *TRIANGLE], [(0.25, 0.25, -3), *TRIANGLE]), _row([(0.25, 0.25, 2), *TRIANGLE], [(0.25, 0.25, 2), *TRIANGLE])])
    found = certificate.certify(rows, np.array([True, True]), np.zeros(2), np.ones(2))
    assert found["status"].tolist() == [certificate.COLLISION, certificate.SEPARATION]
    assert found["toi_upper"][0] == pytest.approx(0.25, abs=1e-6) and found["margin"][1] > 1.9


def test_certificate_finds_crossing_edges():
    start = [(-1, 0, 0), (1, 0, 0), (0, -1, 1), (0, 1, 1)]
    end = [(-1, 0, 0), (1, 0, 0), (0, -1, -3), (0, 1, -3)]
    found = certificate.certify(_row(start, end)[None], np.array([False]), np.zeros(1), np.ones(1))
    assert found["status"][0] == certificate.COLLISION and found["toi_upper"][0] == pytest.approx(0.25, abs=1e-6)


def _recursive(row, face, t0, t1, limits, depth=0):
    """One interval at a time, left before right."""
    at = lambda t: (row[:12] + (row[12:] - row[:12]) * t).reshape(1, 4, 3)
    mid = 0.5 * (t0 + t1)
    gaps = [certificate.distance(at(t), face)[0] for t in (t0, mid, t1)]
    for t, d in zip((t0, mid, t1), gaps):
        if d <= limits.eps_space:
            return certificate.COLLISION, t, 0.0, 1
    speed = np.linalg.norm((row[12:] - row[:12]).reshape(4, 3), axis=1)
    reach = speed[0] + speed[1:].max() if face else speed[:2].max() + speed[2:].max()
    bound = gaps[1] - reach * 0.5 * (t1 - t0)
    if bound > limits.eps_space:
        return certificate.SEPARATION, 1.0, bound - limits.eps_space, 1
    if depth >= limits.depth or t1 - t0 <= limits.eps_time:
        return certificate.UNDECIDED, 1.0, 0.0, 1
    left = _recursive(row, face, t0, mid, limits, depth + 1)
    if left[0] == certificate.COLLISION:
        return (*left[:3], left[3] + 1)
    right = _recursive(row, face, mid, t1, limits, depth + 1)
    calls = left[3] + right[3] + 1
    if right[0] == certificate.COLLISION:
        return (*right[:3], calls)
    if left[0] == right[0] == certificate.SEPARATION:
        return certificate.SEPARATION, 1.0, min(left[2], right[2]), calls
    return certificate.UNDECIDED, 1.0, 0.0, calls


def test_certificate_of_grazing_rows_stays_small():
    """Rows in lasting near-contact open every interval to the last; memory does not grow with those."""
    import tracemalloc

    row = _row([(0.2, 0.2, 2e-6), *TRIANGLE], [(0.4, 0.4, 2e-6), *TRIANGLE])
    limits = certificate.Limits(eps_time=2e-3)
    tracemalloc.start()
    found = certificate.certify(np.stack([row] * 400), np.ones(400, bool), np.zeros(400), np.ones(400), limits)
    assert (found["status"] == certificate.UNDECIDED).all() and (found["evaluations"] == 1023).all()
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()


def test_certificate_equals_one_by_one_recursion():
    rng = np.random.default_rng(3)
    rows = rng.uniform(-1, 1, (60, 24))
    faces = rng.random(60) < 0.5
    limits = certificate.Limits(eps_time=1e-3, eps_space=0.05, depth=9)
    found = certificate.certify(rows, faces, np.zeros(60), np.ones(60), limits)
    for i in range(60):
        status, toi, margin, calls = _recursive(rows[i], bool(faces[i]), 0.0, 1.0, limits)
        assert found["status"][i] == status and found["toi_upper"][i] == toi
        assert found["evaluations"][i] == calls
        if status == certificate.SEPARATION:
            assert found["margin"][i] == pytest.approx(margin)


def test_certificate_of_no_rows(spark):
    rows = spark.createDataFrame([], ", ".join(["query_id long", "family string", *[f"v{i} double" for i in range(24)]]))
    assert certificate.certificates(rows).count() == 0


def test_discrete_check_misses_a_tunnelling_pair(spark):
    df = spark.createDataFrame([(0.0, -1.0, 1.0)], "a double, b0 double, b1 double")
    zero = F.lit(0.0)
    a, b0, b1 = (F.col("a"), zero, zero), (F.col("b0"), zero, zero), (F.col("b1"), zero, zero)
    exact = g.swept_spheres(a, a, b0, b1, F.lit(0.2))
    row = df.select(exact["collided"].alias("c"), exact["toi"].alias("t"), g.sampled_margin(a, a, b0, b1, F.lit(0.2), 2).alias("m")).first()
    assert row.c and row.t == pytest.approx(0.4) and row.m > 0


def test_grid_join_finds_each_touching_pair_once(spark):
    rng = np.random.default_rng(1)
    low = rng.uniform(0, 10, (80, 3))
    size = rng.uniform(0.1, 3, (80, 3))
    data = pd.DataFrame(np.c_[np.arange(80), low, low + size], columns=["body_id", *[f"min_{k}" for k in "xyz"], *[f"max_{k}" for k in "xyz"]])
    found = broadphase.grid_pairs(spark.createDataFrame(data), 1.0).select("a_body_id", "b_body_id").collect()
    wanted = {(i, j) for i, j in itertools.combinations(range(80), 2) if (low[i] <= low[j] + size[j]).all() and (low[j] <= low[i] + size[i]).all()}
    assert len(found) == len(wanted) and {(int(a), int(b)) for a, b in found} == wanted


def test_certified_early_stop_misses_nothing(spark):
    rng = np.random.default_rng(2)
    n = 400
    data = pd.DataFrame({
        "query_id": rng.integers(0, 20, n), "candidate_id": np.arange(n), "priority": rng.random(n).round(1), "cost": rng.random(n).round(1), "uncertainty": rng.random(n) * 0.9,
        "full_cost": rng.integers(-1, 4, n).astype(float), "narrow_cost": rng.random(n), "interval_t0": rng.random(n), "contact_t0": rng.random(n), "collides": rng.random(n) < 0.1,
    })
    data["interval_t1"], data["contact_t1"] = data.interval_t0 + 0.1, data.contact_t0 + 0.1
    rows = spark.createDataFrame(data)
    plain, sure = (schedule.early_stop(rows, certified=c).toPandas() for c in (False, True))
    assert (sure.predicted == sure.truth).all() and (sure.calls >= plain.sort_values("query_id").calls).all()
    for q, own in data.sort_values(["query_id", "priority", "cost", "candidate_id"], ascending=[True, False, True, True]).groupby("query_id"):
        calls, work, predicted = 0, 0.0, False
        for attempt, r in enumerate(own.itertuples(), 1):
            full = r.full_cost if r.full_cost > 0 else 1.0
            calls, work = calls + 1, work + r.narrow_cost
            if r.collides:
                if max(r.interval_t0, r.contact_t0) <= min(r.interval_t1, r.contact_t1):
                    predicted = True
                    break
                work += full
                if attempt >= 4:
                    calls, work, predicted = calls + 1, work + full, True
                    break
        got = plain[plain.query_id == q].iloc[0]
        assert (got.calls, bool(got.predicted)) == (calls, predicted) and got.work == pytest.approx(work)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(60)] + [(1, 5, 9)], "mesh long, a long, b long")
    rows = mesh.components(edges).collect()
    assert len(rows) == 63 and {(r.mesh, r.component) for r in rows} == {(0, 0), (1, 5)}


def test_mesh_readers_agree(spark, tmp_path):
    obj = "# box corner\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\ng part\nf 1/1/1 2 3 4\nf -4 -3 -1\n"
    (tmp_path / "a.obj").write_text(obj)
    (tmp_path / "b.off").write_text("OFF\n4 1 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 0, 0), (1, 1, 0), (0, 1, 0)]
    facets = b"".join(struct.pack("<12fH", 0, 0, 1, *[float(x) for p in corners[i : i + 3] for x in p], 0) for i in (0, 3))
    (tmp_path / "c.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 2) + facets)
    text = "solid\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join("vertex %g %g %g\n" % p for p in corners[i : i + 3]) + "endloop\nendfacet\n" for i in (0, 3)) + "endsolid\n"
    (tmp_path / "d.stl").write_text(text)
    head = "ply\nformat %s 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "e.ply").write_text(head % "ascii" + "0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    binary = b"".join(struct.pack(">3f", *map(float, p)) for p in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))) + struct.pack(">B4i", 4, 0, 1, 2, 3)
    (tmp_path / "f.ply").write_bytes((head % "binary_big_endian").encode() + binary)
    (tmp_path / "note.txt").write_text("no mesh")
    rows = meshes.read_meshes(spark, str(tmp_path))
    stats = {r.mesh.rsplit("/", 1)[-1]: r for r in meshes.mesh_stats(rows).collect()}
    assert sorted(stats) == ["a.obj", "b.off", "c.stl", "d.stl", "e.ply", "f.ply"]
    assert {n: (r.vertices, r.triangles) for n, r in stats.items()} == {"a.obj": (4, 3)} | {n: (4, 2) for n in ("b.off", "c.stl", "d.stl", "e.ply", "f.ply")}
    assert all(r.diagonal == pytest.approx(2**0.5) for r in stats.values())
    patches = mesh.patch_stats(mesh.corners(meshes.triangles(rows), meshes.vertices(rows)))
    area = {r.mesh.rsplit("/", 1)[-1]: r.area for r in patches.collect()}
    assert area["b.off"] == pytest.approx(1.0) and area["f.ply"] == pytest.approx(1.0)
    leaves = mesh.median_patches(mesh.corners(meshes.triangles(rows), meshes.vertices(rows)), 1)
    assert leaves.groupBy("mesh", "patch_id").count().agg(F.max("count")).first()[0] == 1


def test_rational_queries_and_labels(spark, tmp_path):
    (tmp_path / "case" / "vf").mkdir(parents=True)
    line = "1,2,3,4,-5,1,1\n"
    (tmp_path / "case" / "vf" / "q.csv").write_text(line * 16)
    rows = rational.rational_queries(spark, str(tmp_path / "case")).orderBy("query_index").collect()
    assert len(rows) == 2 and rows[0].truth and (rows[1].v0, rows[1].v1, rows[1].v2, rows[1].v23) == (0.5, 0.75, -5.0, -5.0)
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "q.json").write_text("[true]")
    joined = rational.with_labels(rational.rational_queries(spark, str(tmp_path / "case")), rational.read_labels(spark, str(tmp_path / "labels")))
    assert [r.label for r in joined.orderBy("query_index").collect()] == [True, None]
    assert [(r.case, r.kind) for r in rational.listing(spark, str(tmp_path / "case")).collect()] == [("case", "vf")]


@pytest.mark.parametrize("text", ["1,2,3,4,5,6,1\n" * 7, "1,2,3,4,5,6,1\n" * 7 + "1,2,3,4,5,6,0\n", "1,2,3\n" * 8])
def test_bad_rational_files_fail(spark, tmp_path, text):
    (tmp_path / "q.csv").write_text(text)
    with pytest.raises(Exception, match="eight lines|truths differ|number of values|INVALID_ARRAY_INDEX"):
        rational.rational_queries(spark, str(tmp_path)).collect()


def test_contracts(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0, 0.0, 0.5, 1, 0, 1.0, 2), (0, 1, 1, 0, 0.5, 0.2, 1, 0, 1.0, 9)], "work_item_id long, query_id long, candidate_id long, slab_id long, t0 double, t1 double, family_mask int, depth int, priority float, source short")
    good, bad = contracts.split(contracts.conformed(rows, contracts.WORK_ITEM), contracts.work_item_rules())
    assert good.count() == 1 and bad.first().faults == ["ids", "interval", "source"]
    with pytest.raises(ValueError, match="missing"):
        contracts.conformed(rows.drop("t0"), contracts.WORK_ITEM)


def test_run_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "h", 1.5)], "run_id string, config_hash string, value double")
    meta = spark.createDataFrame([("r1", "h")], "run_id string, config_hash string")
    rational.write_run(rows, meta, str(tmp_path))
    assert rational.read_run(spark, str(tmp_path), "r1").first().value == 1.5
    with pytest.raises(ValueError, match="differ"):
        rational.write_run(rows.withColumn("config_hash", F.lit("x")), meta, str(tmp_path))


def test_network_learns_and_passes_unusual_rows_by(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, inference.FEATURES))
    y = (x[:, 0] > 0).astype(float)
    network = inference.fit(inference.Network.seeded(), x, y, steps=300, rate=0.3)
    assert ((network.predict(x)["priority"] > 0.5) == y).mean() > 0.9
    data = [(1, x[0].tolist()), (2, [float("nan"), *x[1].tolist()[1:]])]
    got = {r.k: r for r in inference.scored(spark.createDataFrame(data, "k long, features array<double>"), network, ["k"]).collect()}
    assert not got[1].ood and got[2].ood and got[2].uncertainty == 1.0


def test_policy_heads():
    assert metrics.policy_head("nyu_x") == "risk_proximity_hybrid" and metrics.policy_head("other") == "cost_aware"
    assert metrics.policy_head("other", density=300) == "risk_proximity_hybrid"


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = audit_stream.window_counts(audit_stream.read_events(spark, str(tmp_path / "in"), 1), "1 day", "60 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("slabs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    ours = spark.table("slabs").select("t0", "event_type", "events").toPandas().sort_values(["t0", "event_type"]).reset_index(drop=True)
    batch = audit_stream.window_counts(events, "1 day", None).select("t0", "event_type", "events").toPandas().sort_values(["t0", "event_type"]).reset_index(drop=True)
    assert ours.equals(batch)
    assert audit_stream.session_counts(events, late=None).agg(F.sum("events")).first()[0] == events.count()


def test_any_hit_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.8, True), (1, 3, 0.7, True), (2, 4, 0.5, False)], "query_id long, candidate_id long, priority double, collides boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = audit_stream.any_hit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.query_id, r.calls, r.hit) for r in spark.table("hits").collect()} == {(1, 2, True), (2, 1, False)}


def test_suite(spark, tmp_path):
    text = '{"schema_version": 1, "suite_name": "s", "seed": 1, "cases": [{"name": "a", "method": "DiscreteCheck"}]}'
    rows = suite.run(spark, suite.Suite.from_json(text), "/root/testdata/sf0.001", str(tmp_path)).collect()
    assert [(r.case, r.rows) for r in rows] == [("a", 1)]
    with pytest.raises(ValueError, match="unknown"):
        suite.Suite.from_json(text.replace("DiscreteCheck", "Other"))


def test_scheduled_exact_keeps_real_crossings(spark, monkeypatch):
    from tangency.plans import catalogue
    from tangency.sources import views

    # Points that fall from z = 1 to z = -h, beside or through a fixed triangle, at x: brute force is the sign of x.
    def row(i, x, h):
        fixed = [0.0, -1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0]
        return (i, "vf", x, 0.0, 1.0, *fixed, x, 0.0, -h, *fixed)

    rows = [row(1_000_000, 0.3, 0.7), row(2_000_000, -1.5e-4, 1.0), row(3_000_000, -0.5, 0.7), row(3_000_001, 0.2, 0.9)]
    made = spark.createDataFrame(rows, "query_id long, family string, " + ", ".join(f"v{i} double" for i in range(24)))
    monkeypatch.setattr(views, "vertex_queries", lambda spark, folder: made)
    found = {r.query_id: r.truth for r in catalogue.QUERIES["m5_scheduled_exact"](spark, "").collect()}
    assert found == {1: True, 2: False, 3: True}
    status = {r.query_id: r.status for r in catalogue.QUERIES["x1_certificate"](spark, "").collect()}
    assert status[2_000_000] == 1 and status[3_000_000] == 1 and status[1_000_000] != 1 and status[3_000_001] != 1


def test_waves_equal_running_everything(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(int(q), i, float(rng.random() < 0.5), float(rng.random()), bool(rng.random() < (0.0 if q == 3 else 0.02))) for q in range(6) for i in range(int(rng.integers(1, 90)))]
    rows += [(9, i, 0.5, 0.5, i == 199) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id long, candidate_id long, priority double, cost double, label boolean")
    every = {(r.query_id, r.all_calls, r.calls, r.truth) for r in schedule.any_hit(df.withColumnRenamed("label", "collides")).collect()}
    got = schedule.certified_until_hit(df, lambda wave: wave.withColumn("collides", F.col("label")), first=4).collect()
    assert {(r.query_id, r.all_calls, r.calls, r.truth) for r in got} == every
    assert all(r.calls <= r.evaluated <= min(r.all_calls, 2 * r.calls + 8) for r in got)
    assert schedule.certified_until_hit(df.where("false"), lambda wave: wave.withColumn("collides", F.col("label"))).count() == 0


def test_first_hits_follow_the_schedule_order(spark):
    nan = float("nan")
    rows = [(1, 1, None, 0.0, True), (1, 2, nan, 1.0, False), (1, 3, 0.5, None, False), (1, 4, 0.5, 0.1, True), (1, 5, 0.5, 0.1, True), (2, 1, 0.1, 0.1, False), (3, 1, None, None, True)]
    df = spark.createDataFrame(rows, "query_id long, candidate_id long, priority double, cost double, collides boolean")
    by_window = {r.query_id: r.first for r in schedule.ranked(df).where("collides").groupBy("query_id").agg({"rn": "min"}).toDF("query_id", "first").collect()}
    got = {r.query_id: (r.first_rank, r.calls, r.truth) for r in schedule.any_hit(df).collect()}
    assert got == {1: (by_window[1], 3, True), 2: (2, 1, False), 3: (1, 1, True)}
    assert {r.query_id: r.first_rank for r in schedule.first_positive(df, "candidate_id").collect()} == {1: 3, 3: 1}


def test_strips_find_every_pair_once(spark):
    rng = np.random.default_rng(5)
    low = rng.uniform(0, 10, (120, 3)).round(1)
    size = np.where(rng.random((120, 1)) < 0.1, 6.0, 0.8) * rng.random((120, 3)).round(1)
    low[3], size[3] = low[4], size[4]
    rows = [(int(i % 2), i, *low[i].tolist(), *(low[i] + size[i]).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "query_id long, body_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = [(r.a_body_id, r.b_body_id) for r in broadphase.sorted_pairs(df, 0.7).collect()]
    high = low + size
    wanted = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_head_of_a_source():
    assert metrics.policy_head("cad", 10) == "cost_aware" and metrics.policy_head("cad", 256) == "risk_proximity_hybrid"
    assert metrics.policy_head("nyu_x") == "risk_proximity_hybrid" and metrics.policy_head("nyu_x", heads={"nyu_x": "priority_only"}) == "risk_proximity_hybrid"
    assert metrics.policy_head("cad", 300, heads={"cad": "priority_only"}) == "priority_only"


def test_meshes_equal_all_primitive_pairs(spark):
    """Both directions of vertices and faces and all edges, against every pair without boxes or a grid."""
    rng = np.random.default_rng(12)
    rows = []
    for scene in range(12):
        for side in (0, 1):
            for t in range(3):
                start = rng.uniform(0, 2, 9) + (3.0 * side if scene % 3 == 0 else 1.2 * side)
                rows.append((scene, side, 10 * scene + 3 * side + t, *start.tolist(), *(start + np.tile(rng.uniform(-1, 1, 3), 3)).tolist()))
    names = ", ".join(f"{e}{i} double" for e in "pq" for i in range(9))
    df = spark.createDataFrame(rows, f"scene long, side int, tri_id long, {names}")
    limits = certificate.Limits(eps_time=1e-3, eps_space=1e-3)
    got = {r.scene: r for r in mesh.mesh_certificates(df, 0.9, 10_000, limits).collect()}
    for scene in range(12):
        sides = [[np.array(r[3:]).reshape(2, 3, 3) for r in rows if r[0] == scene and r[1] == side] for side in (0, 1)]
        queries, faces = [], []
        for a in sides[0]:
            for b in sides[1]:
                for v, f in ((a, b), (b, a)):
                    for i in range(3):
                        queries.append(np.concatenate([np.concatenate([v[e][i : i + 1], f[e]]).ravel() for e in (0, 1)]))
                        faces.append(True)
                for i in range(3):
                    for j in range(3):
                        queries.append(np.concatenate([np.concatenate([a[e][[i, (i + 1) % 3]], b[e][[j, (j + 1) % 3]]]).ravel() for e in (0, 1)]))
                        faces.append(False)
        found = certificate.certify(np.stack(queries), np.array(faces), np.zeros(len(queries)), np.ones(len(queries)), limits)
        every = certificate.COLLISION if (found["status"] == 0).any() else certificate.UNDECIDED if (found["status"] == 2).any() else certificate.SEPARATION
        assert (got[scene].status if scene in got else certificate.SEPARATION) == every
    with pytest.raises(ValueError, match="budget"):
        mesh.mesh_certificates(df, 0.9, 3)


def test_shards_agree_with_their_manifest(spark, tmp_path):
    from pyspark.sql import functions as F

    from tangency.sources import samples

    names = list(samples.LAWS)
    rows = spark.range(500).select(F.col("id").alias("sample_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 5 + 1).cast("int")).alias("split"))
    made = samples.labelled(samples.sphere_samples(rows, 9))
    again = samples.labelled(samples.sphere_samples(rows.repartition(7), 9))
    assert sorted(made.select("sample_id", "toi", "a_r").collect()) == sorted(again.select("sample_id", "toi", "a_r").collect())
    hits = {r.split: r.n for r in made.groupBy("split").agg(F.count_if("collided").alias("n")).collect()}
    assert hits["easy_negatives"] == 0 and hits["multiple_contact_intervals"] == 100
    samples.write_shards(made.select("sample_id", "split", "features", "toi"), str(tmp_path / "set"))
    assert samples.read_shards(spark, str(tmp_path / "set"), "ood_meshes").count() == 100
    spark.createDataFrame([("ood_meshes", 99, 1)], "split string, rows long, version long").write.mode("append").json(str(tmp_path / "set" / "manifest"))
    with pytest.raises(ValueError, match="manifest"):
        samples.read_shards(spark, str(tmp_path / "set"))
    with pytest.raises(Exception, match="unknown split"):
        samples.sphere_samples(rows.withColumn("split", F.lit("other"))).count()


def test_runtime_configuration_is_strict():
    import json

    from tangency.sources import files

    data = {
        "schema_version": 1, "epsilon": {"eps_time": 1e-4, "eps_space": 1e-6, "eps_proxy": 1e-5, "eps_cert": 1e-6},
        "runtime": {"max_interval_bins": 8, "max_family_scores": 8, "enable_audit_log": True}, "benchmark": {"write_csv": True, "write_jsonl": False},
    }
    assert files.RuntimeConfig.from_json(json.dumps(data)).epsilon.eps_time == 1e-4
    for path, value in ((("epsilon", "eps_time"), 0), (("runtime", "max_interval_bins"), 9), (("runtime", "max_interval_bins"), True), (("benchmark", "write_csv"), 1), (("epsilon", "more"), 1), (("schema_version",), 2)):
        wrong = json.loads(json.dumps(data))
        at = wrong
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
        with pytest.raises(ValueError):
            files.RuntimeConfig.from_json(json.dumps(wrong))


def test_schedules_and_selections(spark, tmp_path):
    from pyspark.sql import functions as F

    from tangency.sources import files

    rows = spark.createDataFrame([(1, "c", "ee", "a/b.csv", 0, 0.25), (1, "c", "ee", "a/b.csv", 1, 1e-7), (2, "d", "vf", "c.csv", 0, -3.5)], "group_id long, case string, kind string, csv_path string, query_index long, score double")
    files.write_schedule(rows, str(tmp_path / "schedule"))
    (tmp_path / "plain.csv").write_text("csv_path,query_index,score\n\nx\\y.csv, 3 ,2.5e-1\nno,line\n")
    assert sorted(tuple(r) for r in files.read_schedule(spark, str(tmp_path / "schedule")).collect()) == [("a/b.csv", 0, 0.25), ("a/b.csv", 1, 1e-7), ("c.csv", 0, -3.5)]
    assert [tuple(r) for r in files.read_schedule(spark, str(tmp_path / "plain.csv")).collect()] == [("x/y.csv", 3, 0.25)]
    for number, limit in enumerate((0.0, 0.2)):
        marked = rows.withColumn("keep", F.col("score") > limit)
        mode = files.write_selection(marked, "keep", str(tmp_path / f"s{number}"))
        assert mode == ("exclude", "include")[number]
        used = files.use_selection(rows, spark, str(tmp_path / f"s{number}"), mode)
        assert used.count() == marked.where("keep").count()
    files.append_rows(rows.withColumn("f", F.array("score", F.lit(0.1))), str(tmp_path / "out"))
    files.append_rows(rows.withColumn("f", F.array("score", F.lit(0.1))), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "csv"))
    assert back.count() == 6 and "f_1" in back.columns and {float(r.f_1) for r in back.collect()} == {0.1}


def test_grids_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(15)
    low = rng.uniform(-5, 5, (150, 3)).round(2)
    size = (rng.random((150, 3)) * rng.choice([0.1, 1.0, 9.0], (150, 1))).round(2)
    low[0], size[0] = (-1000, -1000, -1000), (2000, 2000, 2000)
    high = low + size
    names = "query_id long, body_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    df = spark.createDataFrame([(int(i % 2), i, *low[i].tolist(), *high[i].tolist()) for i in range(150)], names)
    touch = {(i, j) for i in range(150) for j in range(i + 1, 150) if i % 2 == j % 2 and (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    got = [(r.a_body_id, r.b_body_id) for r in broadphase.grid_pairs(df, 0.4, keys=("query_id",)).collect()]
    assert len(got) == len(set(got)) and set(got) == touch
    both = [(r.a_body_id, r.b_body_id) for r in broadphase.grid_bipartite(df.where("body_id % 3 = 0"), df.where("body_id % 3 <> 0"), 0.4, ("query_id",)).collect()]
    assert len(both) == len(set(both)) and {tuple(sorted(p)) for p in both} == {p for p in touch if (p[0] % 3 == 0) != (p[1] % 3 == 0)} and all(p[0] % 3 == 0 for p in both)


def test_rigid_scenes(spark, tmp_path):
    import json

    from tangency.sources import rigid

    bodies = [
        {"mesh": "cube.obj", "position": [0, 1], "linear_velocity": [1, 0, 0], "scale": 2, "is_dof_fixed": False},
        {"vertices": [[0, 0, 0], [2, 0, 0], [0, 1, 2]], "position": [3, 0, 0], "scale": [1, -2], "is_dof_fixed": [True, True, True]},
        {"type": "static", "position": [5, 0, 0]},
        {"type": "dynamic", "position": [7, 0, 0], "is_dof_fixed": [True, False]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"max_time": 2.0, "rigid_body_problem": {"rigid_bodies": bodies}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"rigid_body_problem": {"rigid_bodies": []}}))
    rows = rigid.read_scenes(spark, str(tmp_path))
    got = {r.body_id: (r.fixed, r.x, r.y, r.z, r.vx, r.radius) for r in rows.collect()}
    assert got == {0: (False, 0.0, 1.0, 0.0, 1.0, 1.0), 1: (True, 3.0, 0.0, 0.0, 0.0, 3.0), 2: (True, 5.0, 0.0, 0.0, 0.0, 0.5), 3: (False, 7.0, 0.0, 0.0, 0.0, 0.5)}
    pairs = {(r.a_body_id, r.b_body_id): r.a_x1 for r in rigid.scene_pairs(rows).collect()}
    assert set(pairs) == {(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)} and pairs[0, 1] == 2.0
