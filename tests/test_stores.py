"""NPZ shards and zip archives: round trips, faults, damage."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangency.sources import archives, npz

SCHEMA = "ids array<long>, features array<float>, label int, margin double, split string, ood boolean"


@pytest.fixture(scope="module")
def rows(spark):
    npz.register(spark)
    made = [([i, 2 * i], [float(i)] * 32, i % 3, i / 7, "ab"[i % 2], i % 5 == 0) for i in range(95)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def test_shards_round_trip(spark, rows, tmp_path):
    path = f"{tmp_path}/set"
    rows.write.format("npz").option("rowsPerShard", 10).option("unsigned", "ids").mode("append").save(path)
    found = spark.read.format("npz").load(path)
    assert {f.name: f.dataType.simpleString() for f in found.schema} == {f.name: f.dataType.simpleString() for f in rows.schema}
    assert sorted(map(str, found.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert found.select("label").where("label = 1").count() == 32
    with np.load(npz.shard_files(path)[0]) as shard:
        assert shard["ids"].dtype == np.uint64 and shard["ids"].shape == (len(shard["label"]), 2) and shard["features"].dtype == np.float32
    manifest = json.load(open(f"{path}/{npz.MANIFEST}"))
    assert manifest["rows"] == 95 and max(f["rows"] for f in manifest["files"]) == 10
    assert sum(f["splits"].get("a", 0) for f in manifest["files"]) == 48
    assert npz.manifest_faults(path) == [] and not [n for n in os.listdir(path) if n.startswith("_temporary")]
    with pytest.raises(Exception, match="there are shards already"):
        rows.write.format("npz").mode("append").save(path)
    rows.limit(7).write.format("npz").mode("overwrite").save(path)
    assert spark.read.format("npz").load(path).count() == 7 and npz.manifest_faults(path) == []


def test_faulty_shards(spark, rows, tmp_path):
    path = f"{tmp_path}/set"
    os.makedirs(path)
    for name, version, n in (("version", 2, 3), ("count", 1, 4)):
        np.savez(f"{path}/x.npz", label=np.arange(3), metadata_json=np.asarray(json.dumps({"schema_version": version, "row_count": n})))
        with pytest.raises(Exception, match="schema_version" if name == "version" else "row_count"):
            spark.read.format("npz").load(path).collect()
    with pytest.raises(Exception, match="no shards"):
        spark.read.format("npz").load(f"{tmp_path}/nowhere").collect()
    for bad in (rows.withColumn("label", F.lit(None).cast("int")), rows.withColumn("ids", F.expr("slice(ids, 1, label)"))):
        with pytest.raises(Exception, match="nulls|length"):
            bad.write.format("npz").mode("append").save(f"{tmp_path}/bad")
        assert not [n for n in os.listdir(f"{tmp_path}/bad") if n.endswith(".npz")] if os.path.isdir(f"{tmp_path}/bad") else True


def test_manifest_tells_what_is_wrong(spark, rows, tmp_path):
    path = f"{tmp_path}/set"
    rows.write.format("npz").option("rowsPerShard", 40).mode("append").save(path)
    files = npz.shard_files(path)
    os.rename(files[0], f"{path}/other.npz")
    faults = npz.manifest_faults(path)
    assert sorted(f.split(": ")[1] for f in faults) == ["missing", "not listed"]


OBJ = "# a mesh\nv 0 0 0\nv 3 4 0\r\nv x y z\nvn 1 0 0\nf 1 2 3\nv 1 1 12"


def test_archives_equal_their_unpacked_files(spark, tmp_path):
    texts = {"a/models/one.obj": OBJ, "a/models/two.obj": "v 1 2 3\n" * 40_000 + "f 1 1 1\n", "b/empty.obj": "", "b/notes.txt": OBJ}
    for name, method in (("one.zip", zipfile.ZIP_DEFLATED), ("two.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(f"{tmp_path}/{name}", "w", method) as out:
            for member, text in texts.items():
                out.writestr(member, text)
    paths = [f"{tmp_path}/one.zip", f"file://{tmp_path}/two.zip"]
    found = {(r.archive, r.member): r for r in archives.archive_stats(spark, paths).collect()}
    assert set(found) == {(p, m) for p in paths for m in texts if m.endswith(".obj")}
    for (_, member), r in found.items():
        wanted = archives.obj_stats(iter([texts[member].encode()]))
        assert (r.vertices, r.faces, r.min_x, r.min_y, r.min_z, r.max_x, r.max_y, r.max_z, r.diagonal) == wanted
        assert r.fault is None and r["size"] == len(texts[member])
    one = found[paths[0], "a/models/one.obj"]
    assert (one.vertices, one.faces, one.diagonal) == (3, 1, 13.0)
    empty = found[paths[0], "b/empty.obj"]
    assert (empty.vertices, empty.min_x, empty.max_x) == (0, 0.0, 1.0)


def test_damaged_archives_are_rows_with_their_fault(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/bad.zip", "w", zipfile.ZIP_STORED) as out:
        out.writestr("good.obj", OBJ)
        out.writestr("hurt.obj", "v 5 5 5\n" * 100)
    data = bytearray(open(f"{tmp_path}/bad.zip", "rb").read())
    data[data.index(b"v 5 5 5") + 2] = ord("6")
    open(f"{tmp_path}/bad.zip", "wb").write(data)
    open(f"{tmp_path}/none.zip", "wb").write(b"not a zip")
    found = {(r.archive.rsplit("/", 1)[1], r.member): r for r in archives.archive_stats(spark, [f"{tmp_path}/{n}.zip" for n in ("bad", "none", "lost")]).collect()}
    assert found["bad.zip", "good.obj"].fault is None and found["bad.zip", "good.obj"].vertices == 3
    assert found["bad.zip", "hurt.obj"].fault == "checksum" and found["bad.zip", "hurt.obj"].vertices is None
    assert found["none.zip", None].fault.startswith("directory") and found["lost.zip", None].fault.startswith("directory")
