"""Mesh files as vertex and triangle tables: OBJ, STL (text and binary), OFF, PLY (text and binary).

A file is one row of ``binaryFile`` and is parsed where it lies; the parser is
a small numpy helper per file, all statistics are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# PLY scalar types.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}


def _fan(face: list[int]) -> list[tuple[int, int, int]]:
    return [(face[0], face[i], face[i + 1]) for i in range(1, len(face) - 1)]


def parse_obj(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, triangles and patch numbers; indices from 1 or negative from the end; polygons as fans; o and g begin patches."""
    vertices, triangles, patches, patch = [], [], [], 0
    for line in data.decode("utf-8", "replace").splitlines():
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        if words[0] == "v":
            vertices.append([float(x) for x in words[1:4]])
        elif words[0] in ("o", "g"):
            patch += bool(triangles) and patches[-1] == patch
        elif words[0] == "f":
            ids = [int(w.split("/")[0]) for w in words[1:]]
            ids = [i - 1 if i > 0 else len(vertices) + i for i in ids]
            if len(ids) < 3 or min(ids) < 0 or max(ids) >= len(vertices):
                raise ValueError(f"bad face: {line!r}")
            for t in _fan(ids):
                triangles.append(t)
                patches.append(patch)
    return np.array(vertices, float).reshape(-1, 3), np.array(triangles, np.int64).reshape(-1, 3), np.array(patches, np.int64)


def _merged(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal corners become one vertex."""
    vertices, index = np.unique(corners, axis=0, return_inverse=True)
    triangles = index.reshape(-1, 3)
    return vertices.astype(float), triangles, np.zeros(len(triangles), np.int64)


def parse_stl(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary if the size is 84 + 50 n for the count it states, else text."""
    if len(data) >= 84 and len(data) == 84 + 50 * int.from_bytes(data[80:84], "little"):
        rows = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
        return _merged(rows["v"].reshape(-1, 3))
    points = [[float(x) for x in w[1:4]] for w in (line.split() for line in data.decode("utf-8", "replace").splitlines()) if w[:1] == ["vertex"]]
    if len(points) % 3:
        raise ValueError("a facet has not three vertices")
    return _merged(np.array(points, float).reshape(-1, 3))


def parse_off(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [w for line in data.decode().splitlines() for w in line.split("#", 1)[0].split()]
    words = words[1:] if words and words[0].upper().endswith("OFF") else words
    n, faces = int(words[0]), int(words[1])
    vertices, at, triangles = np.array(words[3 : 3 + 3 * n], float).reshape(-1, 3), 3 + 3 * n, []
    for _ in range(faces):
        k = int(words[at])
        triangles += _fan([int(x) for x in words[at + 1 : at + 1 + k]])
        at += 1 + k
    return vertices, np.array(triangles, np.int64).reshape(-1, 3), np.zeros(len(triangles), np.int64)


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head, body = data.split(b"end_header", 1)
    body = body[body.index(b"\n") + 1 :]
    lines = [x.split() for x in head.decode().splitlines()]
    kind = next(x[1] for x in lines if x and x[0] == "format")
    elements: list[tuple[str, int, list[list[str]]]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    order = ">" if kind == "binary_big_endian" else "<"
    words, at = (body.split(), 0) if kind == "ascii" else ([], 0)
    vertices, triangles = np.zeros((0, 3)), []
    for name, count, properties in elements:
        rows = []
        for _ in range(count):
            row = {}
            for p in properties:
                if kind == "ascii":
                    size = int(words[at]) if p[0] == "list" else 1
                    at += p[0] == "list"
                    values = [float(w) for w in words[at : at + size]]
                    at += size
                else:
                    size = 1
                    if p[0] == "list":
                        t = np.dtype(order + PLY_TYPES[p[1]])
                        size = int(np.frombuffer(body, t, 1, at)[0])
                        at += t.itemsize
                    t = np.dtype(order + PLY_TYPES[p[-2]])
                    values = np.frombuffer(body, t, size, at).tolist()
                    at += t.itemsize * size
                row[p[-1]] = values if p[0] == "list" else values[0]
            rows.append(row)
        if name == "vertex":
            vertices = np.array([[r["x"], r["y"], r["z"]] for r in rows], float).reshape(-1, 3)
        elif name == "face":
            for r in rows:
                triangles += _fan([int(i) for i in next(v for v in r.values() if isinstance(v, list))])
    return vertices, np.array(triangles, np.int64).reshape(-1, 3), np.zeros(len(triangles), np.int64)


PARSERS = {"obj": parse_obj, "stl": parse_stl, "off": parse_off, "ply": parse_ply}
_SCHEMA = "mesh string, kind string, n long, a double, b double, c double, patch_id long"


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind ``vertex`` (n; x, y, z in a, b, c) and ``triangle`` (n; vertex numbers in a, b, c; patch_id) of all mesh files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    end = F.lower(F.element_at(F.split("path", r"\."), -1))
    files = files.where(end.isin(*PARSERS)).select("path", end.alias("end"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path_, end_, content in part.itertuples(index=False):
                vertices, triangles, patches = PARSERS[end_](content)
                for kind, rows, patch in (("vertex", vertices, np.full(len(vertices), -1)), ("triangle", triangles.astype(float), patches)):
                    yield pd.DataFrame({"mesh": path_, "kind": kind, "n": np.arange(len(rows)), "a": rows[:, 0], "b": rows[:, 1], "c": rows[:, 2], "patch_id": patch})

    return files.mapInPandas(run, _SCHEMA)


def vertices(meshes: DataFrame) -> DataFrame:
    return meshes.where("kind = 'vertex'").selectExpr("mesh", "n AS vertex_id", "a AS x", "b AS y", "c AS z")


def triangles(meshes: DataFrame) -> DataFrame:
    return meshes.where("kind = 'triangle'").selectExpr("mesh", "n AS tri_id", "cast(a as long) AS v0", "cast(b as long) AS v1", "cast(c as long) AS v2", "patch_id")


def mesh_stats(meshes: DataFrame) -> DataFrame:
    """Counts, bounding box and its diagonal per mesh."""
    is_vertex = F.col("kind") == "vertex"
    ends = [f(F.when(is_vertex, F.col(c))).alias(f"{n}_{k}") for k, c in zip("xyz", "abc") for n, f in (("min", F.min), ("max", F.max))]
    out = meshes.groupBy("mesh").agg(F.count_if(is_vertex).alias("vertices"), F.count_if(~is_vertex).alias("triangles"), *ends)
    spans = [F.col(f"max_{k}") - F.col(f"min_{k}") for k in "xyz"]
    return out.withColumn("diagonal", F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]))
