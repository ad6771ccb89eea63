"""Cloth, rigid scenes, contracts, manifests, closest points, group features and motions on written fixtures."""

import hashlib
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangency.functions import contracts, validators
from tangency.operators import certificate, closest, cloth, group_features, mesh, metrics, motion, runtime
from tangency.sources import artifacts, files, meshes, rational, rigid

GRID = 4


def _frames(tmp_path, heights):
    """PLY frames of a square cloth whose last row of vertices is folded to x = 0.5 at the given heights."""
    n = GRID
    faces = [t for i in range(n - 1) for j in range(n - 1) for t in ((i * n + j, i * n + j + 1, (i + 1) * n + j), (i * n + j + 1, (i + 1) * n + j + 1, (i + 1) * n + j))]
    frames = []
    for k, h in enumerate(heights):
        points = [(float(i), float(j), 0.0) if i < n - 1 else (0.4, j + 0.3, h) for i in range(n) for j in range(n)]
        text = f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
        text += "".join(f"{x} {y} {z}\n" for x, y, z in points) + "".join(f"3 {a} {b} {c}\n" for a, b, c in faces)
        (tmp_path / f"frame{k:03d}.ply").write_text(text)
        frames.append(np.array(points))
    return frames, faces


def _brute(p, q, faces, limits):
    """Statuses of all vertex-face and edge-edge pairs of one segment without a common vertex, boxes or not."""
    edges = sorted({(min(a, b), max(a, b)) for f in faces for a, b in zip(f, f[1:] + f[:1])})
    vf = [(v, *f) for v in range(len(p)) for f in faces if v not in f]
    ee = [(*a, *b) for a, b in itertools.combinations(edges, 2) if not set(a) & set(b)]
    found = []
    for rows, kind in ((vf, True), (ee, False)):
        values = np.stack([np.concatenate([p[list(r)].ravel(), q[list(r)].ravel()]) for r in rows])
        found.append(certificate.certify(values, np.full(len(rows), kind), np.zeros(len(rows)), np.ones(len(rows)), limits))
    return np.concatenate([f["status"] for f in found]), np.concatenate([f["toi_upper"] for f in found])


def test_cloth_equals_all_pairs(spark, tmp_path):
    frames, faces = _frames(tmp_path, [1.0, 0.5, -0.5, -0.6])
    rows = meshes.read_meshes(spark, str(tmp_path))
    limits = certificate.Limits(depth=12)
    found = {r.scene: r for r in cloth.self_collisions(meshes.vertices(rows), meshes.triangles(rows), 0.7, limits=limits).collect()}
    assert sorted(found) == [1, 2, 3]
    for k in (1, 2, 3):
        status, toi = _brute(frames[k - 1], frames[k], faces, limits)
        wanted = 0 if (status == 0).any() else 2 if (status == 2).any() else 1
        assert found[k].status == wanted and found[k].primitives == found[k].vertex_face + found[k].edge_edge
        if wanted == 0:
            assert toi[status == 0].min() - 1e-9 <= found[k].toi_upper <= 1 and found[k].witness is not None
    assert found[1].status == 1 and found[2].status == 0


def test_cloth_of_one_frame_and_far_apart(spark, tmp_path):
    _frames(tmp_path, [50.0])
    rows = meshes.read_meshes(spark, str(tmp_path))
    assert cloth.self_collisions(meshes.vertices(rows), meshes.triangles(rows), 1.0).count() == 0
    single = [("m", "vertex", i, *map(float, p), -1) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0)])] + [("m", "triangle", 0, 0.0, 1.0, 2.0, 0)]
    two = [(f"m{k}", *r[1:]) for k in (1, 2) for r in single]
    rows = spark.createDataFrame(two, "mesh string, kind string, n long, a double, b double, c double, patch_id long")
    [r] = cloth.self_collisions(meshes.vertices(rows), meshes.triangles(rows), 1.0).collect()
    assert (r.scene, r.status, r.primitives) == (1, 1, 0)


def test_rigid_scenes_through_the_exact_run(spark, tmp_path):
    body = lambda x, v, **more: {"vertices": [[-0.5, 0, 0], [0.5, 0, 0]], "position": [x, 0, 0], "linear_velocity": [v, 0, 0], **more}
    scene = {"max_time": 2.0, "rigid_body_problem": {"rigid_bodies": [body(0, 2), body(5, 0), body(9, 0, type="static"), body(20, 0, type="static"), body(-8, 0)]}}
    (tmp_path / "a.json").write_text(json.dumps(scene))
    (tmp_path / "b.json").write_text(json.dumps({"rigid_body_problem": {"rigid_bodies": [body(0, 1), body(1.5, -1)]}}))
    pairs = rigid.scene_pairs(rigid.read_scenes(spark, str(tmp_path)))
    found = {(r.file[-6], r.a_body_id, r.b_body_id): r for r in runtime.scene_run(pairs).collect()}
    assert ("a", 2, 3) not in found and len(found) == 10
    # Radii of half a unit: the first body meets the second after 4 of its way of 4, that is at the end.
    assert found["a", 0, 1].predicted and found["a", 0, 1].toi_upper == pytest.approx(1.0) and found["a", 0, 1].calls == found["a", 0, 1]["items"] == 1
    assert found["b", 0, 1].predicted and found["b", 0, 1].toi_upper == pytest.approx(0.25) and found["b", 0, 1].calls <= 2
    assert not found["a", 0, 4].predicted and not found["a", 0, 4].evaluated


def _row(kind, **changed):
    own = {
        "candidate": {"candidate_id": 1, "query_id": 2, "hit_count": 1, "type_a": 1, "type_b": 2, "motion_bound": [0.0, 1.0, 2.0, 0.5]},
        "proposal": {"candidate_id": 1, "priority": 0.5, "cost": 0.0, "uncertainty": 1.0, "interval_scores": [0.0] * 8, "family_scores": [1.0] * 8},
        "work_item": {"work_item_id": 1, "candidate_id": 1, "query_id": 1, "family_mask": 3, "t0": 0.0, "t1": 1.0, "priority": 1.0, "source": 0},
        "certificate": {"work_item_id": 1, "query_id": 1, "status": 0, "t0": 0.0, "t1": 0.5, "toi_upper": 0.25, "safe_margin": 0.0, "eps_time": 1e-4, "eps_space": 1e-6, "next_mode": 0, "witness_a": 0, "witness_b": 3, "covered_mask": 0, "reason": 0},
        "audit": {"event_id": 1, "query_id": 1, "timestamp_us": 1, "stage": 4, "t0": 0.0, "t1": 1.0, "value_0": 0.0, "value_1": -1.0},
        "benchmark": {"queries": 2, "fn": 1, "fp": 0, "recall": 0.5, "fallback_ratio": 0.0} | {c: 1.0 for c in ("candidates_per_query", "calls_per_query", "depth_per_query", "trace_ms", "proposal_ms", "exact_ms", "total_ms", "queries_per_second")},
    }
    own["benchmark_run"] = own["benchmark"] | {"run_id": "r", "dataset": "d", "method": "m", "config_hash": "h", "exact_calls": 4} | dict(zip(validators.LATENCIES, (0.0, 1.0, 1.0, 2.0, 3.0, 9.0))) | {c: 1 for c in validators.FAMILY_CALLS}
    own["run_meta"] = {"run_id": "r", "created_utc": "2024-05-01T10:00:00Z", "dataset": "d", "method": "m", "config_json": "{}", "config_hash": hashlib.sha256(b"{}").hexdigest(), "row_count": 0}
    return own[kind] | changed


NAN, INF = float("nan"), float("inf")
FAULTS = {
    "candidate": [({"candidate_id": 0}, "candidate_id"), ({"query_id": None}, "query_id"), ({"type_b": 0}, "type_b"), ({"motion_bound": [0.0, -1.0, 0.0, 0.0]}, "motion_bound"), ({"motion_bound": [0.0]}, "motion_bound"), ({"hit_count": 0}, "hit_count")],
    "proposal": [({"priority": NAN}, "priority"), ({"cost": -1.0}, "cost"), ({"uncertainty": INF}, "uncertainty"), ({"family_scores": [NAN] * 8}, "family_scores"), ({"interval_scores": [0.0] * 7}, "interval_scores")],
    "work_item": [({"t0": 0.6, "t1": 0.5}, "interval"), ({"t1": 1.5}, "interval"), ({"family_mask": 0}, "family_mask"), ({"source": 3}, "source"), ({"priority": None}, "priority")],
    "certificate": [
        ({"toi_upper": 0.75}, "collision_time"), ({"witness_b": -1}, "collision_witness"), ({"next_mode": 1}, "decided_asks"), ({"status": 1, "covered_mask": 0}, "separation_family"), ({"status": 1, "covered_mask": 1, "safe_margin": -0.1}, "separation_margin"),
        ({"status": 2, "next_mode": 1}, "undecided_reason"), ({"status": 2, "reason": 5}, "undecided_asks"), ({"eps_time": 0.0}, "eps_time"), ({"status": 2, "reason": 1, "next_mode": 9}, "next_mode"),
    ],
    "audit": [({"stage": 5}, "stage"), ({"timestamp_us": 0}, "timestamp_us"), ({"value_1": INF}, "value_1"), ({"t0": -0.1}, "interval")],
    "benchmark": [({"fn": 3}, "misses"), ({"recall": 1.1}, "recall"), ({"queries": 0, "fn": 0}, "queries"), ({"exact_ms": -1.0}, "exact_ms")],
    "benchmark_run": [({"latency_p95_ms": 4.0}, "latency_order"), ({"unknown_calls": 2}, "family_calls"), ({"run_id": " "}, "run_id")],
    "run_meta": [({"config_json": "{ }"}, "config_hash"), ({"created_utc": "yesterday"}, "created"), ({"row_count": -1}, "row_count")],
}


@pytest.mark.parametrize("kind", list(validators.CONTRACTS))
def test_contract_rules(spark, kind):
    rows = [_row(kind)] + [_row(kind, **changed) for changed, _ in FAULTS[kind]]
    types = {int: "long", float: "double", str: "string", list: "array<double>"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in rows[0].items())
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)
    found = [r.faults for r in contracts.faults(table, validators.CONTRACTS[kind]()).collect()]
    assert found[0] == [] and found[1:] == [[name] for _, name in FAULTS[kind]]


def test_digests_of_a_manifest(spark, tmp_path):
    (tmp_path / "set" / "deep er").mkdir(parents=True)
    data = {"a.bin": b"\x00\x01", "deep er/b.txt": b"text", "c.txt": b"", "d.txt": b"more"}
    for name, content in data.items():
        (tmp_path / "set" / name).write_bytes(content)
    entry = lambda n, c, **more: json.dumps({"path": n, "bytes": len(c), "sha256": hashlib.sha256(c).hexdigest()} | more) + "\n"
    good = "".join(entry(n, c) for n, c in data.items())
    (tmp_path / "good.jsonl").write_text(good)
    assert artifacts.manifest_faults(spark, f"{tmp_path}/set", f"{tmp_path}/good.jsonl").count() == 0
    bad = entry("a.bin", b"\x00\x02") + entry("deep er/b.txt", b"text", bytes=5) + entry("c.txt", b"") * 2 + entry("gone", b"x") + "no json\n"
    (tmp_path / "bad.jsonl").write_text(bad)
    found = {(r.path, r.fault) for r in artifacts.manifest_faults(spark, f"{tmp_path}/set", f"{tmp_path}/bad.jsonl").collect()}
    assert found == {("a.bin", "sha256"), ("deep er/b.txt", "bytes"), ("c.txt", "listed twice"), ("gone", "missing"), ("d.txt", "not listed"), (None, "no entry")}


def test_closest_points_are_the_nearest():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 4, 3))
    v[:20, 3] = v[:20, 2]  # flat triangles, edges of no length
    v[20:40, 2] = v[20:40, 0] + 1.0
    v[20:40, 3] = v[20:40, 1] + 1.0  # parallel edges
    one, two = closest.between_segments(*(v[:, i] for i in range(4)))
    on = closest.on_triangle(*(v[:, i] for i in range(4)))
    t = np.linspace(0, 1, 41)
    for i in range(200):
        a, b = v[i, 0] + np.outer(t, v[i, 1] - v[i, 0]), v[i, 2] + np.outer(t, v[i, 3] - v[i, 2])
        least = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min()
        assert np.linalg.norm(one[i] - two[i]) <= least + 1e-9
        inside = np.array([v[i, 1] + x * (v[i, 2] - v[i, 1]) + y * (v[i, 3] - v[i, 1]) for x in t for y in t if x + y <= 1])
        assert np.linalg.norm(v[i, 0] - on[i]) <= np.sqrt(((inside - v[i, 0]) ** 2).sum(1)).min() + 1e-9
        assert np.linalg.norm(v[i, 0] - on[i]) == pytest.approx(certificate.point_triangle(*(v[i : i + 1, k] for k in range(4)))[0], abs=1e-9)


def test_group_features_of_odd_rows(spark):
    rows = [(i, "vf" if i % 2 else "ee", i // 4, i % 9 if i else None, i // 4, i % 4, i, i + 1, 8.0, *[float((i * 7 + k) % 5) for k in range(24)]) for i in range(16)]
    rows.append((99, "vf", 3, 0, 0, 0, 0, 0, 0.0, *[None] * 24))
    names = ["query_id long", "family string", "group_id long", "scene int", "step int", "place int", "a_box long", "b_box long", "bits double", *[f"v{i} double" for i in range(24)]]
    table = spark.createDataFrame(rows, ", ".join(names))
    out = {r.query_id: r for r in group_features.group_features(table).collect()}
    assert len(out) == 17 and all(len(r.features) == 32 and all(np.isfinite(x) for x in r.features) for r in out.values())
    at = {n: i for i, n in enumerate(group_features.GROUP)}
    assert out[5].features[at["size_share"]] == pytest.approx(np.log2(4) / 18) and out[13].features[at["size_share"]] == pytest.approx(np.log2(5) / 18)
    assert out[6].features[at["place"]] == pytest.approx(2 / 3) and out[6].features[at["is_ee"]] == 1 and out[3].features[at["scene_3"]] == 1
    assert group_features.group_features(table.limit(0)).count() == 0


def test_approach_motions(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 3.0, 4.0, 0.0, 2.0, 8.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1, 0.2)], "a_x0 double, a_y0 double, a_z0 double, b_x0 double, b_y0 double, b_z0 double, a_diagonal double, b_diagonal double")
    one, two = motion.approach_motions(rows.coalesce(1), 0.5).collect()
    assert (one.a_x1, one.a_y1, one.b_x1) == (pytest.approx(2.4), pytest.approx(3.2), 3.0) and (two.a_x1, two.a_y1) == (1.5, 1.0)


def test_faulty_schedule_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("csv_path,query_index,score\na.csv,1,0.5\n\nb.csv,x,1\njust text\n")
    with pytest.raises(Exception, match="no line of a schedule"):
        files.read_schedule(spark, str(tmp_path / "s.csv"), strict=True).collect()
    assert [tuple(r) for r in files.read_schedule(spark, str(tmp_path / "s.csv")).collect()] == [("a.csv", 1, 0.5)]
    assert sorted(r.value for r in files.schedule_faults(spark, str(tmp_path / "s.csv")).collect()) == ["b.csv,x,1", "just text"]


def test_scenes_of_meshes_that_do_not_touch(spark):
    corner = lambda z: [0.0, 0.0, z, 1.0, 0.0, z, 0.0, 1.0, z]
    rows = [(s, side, i, *corner(z), *corner(z)) for i, (s, side, z) in enumerate([(1, 0, 0.0), (1, 1, 9.0), (2, 0, 0.0), (2, 1, 0.0)])]
    table = spark.createDataFrame(rows, "scene int, side int, tri_id long, " + ", ".join(f"{e}{i} double" for e in "pq" for i in range(9)))
    found = {r.scene: r for r in mesh.mesh_certificates(table, 1.0).collect()}
    assert (found[1].status, found[1].primitives, found[1].mask) == (1, 0, 0) and found[2].status == 0 and found[2].primitives > 0


def test_box_pairs_and_registry(spark, tmp_path):
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes" / "3vf.json").write_text("[[4, 7], [1, 2]]")
    queries = spark.createDataFrame([("x/3vf.csv", 0), ("x/3vf.csv", 1), ("x/3vf.csv", 2), ("x/9ee.csv", 0)], "file string, query_index int")
    found = {(r.file, r.query_index): (r.a_box, r.b_box) for r in rational.with_boxes(queries, rational.read_box_pairs(spark, str(tmp_path / "boxes"))).collect()}
    assert found == {("x/3vf.csv", 0): (4, 7), ("x/3vf.csv", 1): (1, 2), ("x/3vf.csv", 2): (None, None), ("x/9ee.csv", 0): (None, None)}
    (tmp_path / "boxes" / "4vf.json").write_text("[[4], [1, 2]]")
    with pytest.raises(Exception, match="no pairs of boxes"):
        rational.read_box_pairs(spark, str(tmp_path / "boxes")).collect()
    rows = rational.registry(spark, str(tmp_path), {"pairs": r"^boxes/.*json$", "nothing": r"\\.zip$"}).collect()
    assert {r.source: (r.available, r.files, r.bytes) for r in rows} == {"pairs": (True, 2, 29), "nothing": (False, 0, 0)}


def test_negatives_kept_by_a_stride(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 10 == 0).alias("hit"))
    for stride, low, high in ((0, 400, 400), (1, 4000, 4000), (4, 1100, 1500)):
        kept = rows.where(runtime.negatives_kept(F.col("hit"), F.col("id"), stride))
        assert low <= kept.count() <= high and kept.where("hit").count() == 400


def test_rows_of_a_run_that_is_not_described(spark):
    rows = spark.createDataFrame([("a", 4, 1, 2.0, 0.5, 8.0), ("b", 0, 0, 0.0, 0.0, 0.0)], "run_id string, queries long, fn long, candidates_per_query double, calls_per_query double, total_ms double")
    runs = spark.createDataFrame([("a", "d"), ("b", "d")], "run_id string, dataset string")
    families = spark.createDataFrame([("a", 1, 2, 3, 4)], "run_id string, point_triangle_calls long, edge_edge_calls long, conservative_calls long, unknown_calls long")
    one, two = metrics.run_rows(rows, runs, families=families).orderBy("run_id").collect()
    assert (one.exact_calls, one.unknown_calls, one.candidates_per_call, one.queue_occupancy, one.latency_p99_ms) == (10, 4, 4.0, 0.25, 2.0)
    few = metrics.run_rows(rows, runs, families=families.withColumns({c: F.lit(0).cast("long") for c in ("edge_edge_calls", "conservative_calls", "unknown_calls")})).orderBy("run_id").first()
    assert (few.point_triangle_calls, few.unknown_calls, few.exact_calls) == (1, 1, 2)
    assert (two.exact_calls, two.unknown_calls, two.candidates_per_call, two.queue_occupancy, two.latency_max_ms) == (0, 0, 0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="no description of run"):
        metrics.run_rows(rows, runs.where("run_id = 'a'")).collect()
