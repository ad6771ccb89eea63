"""Rigid-body scenes of JSON fixtures as body rows and pairs of bodies to test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.operators.broadphase import rigid_pairs

# The keys of a fixture that are read; what may be one value or a list is taken as text first.
BODY = "struct<mesh: string, type: string, position: array<double>, linear_velocity: array<double>, is_dof_fixed: string, scale: string, vertices: array<array<double>>>"


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row per body: file, body_id, mesh, fixed, x, y, z, vx, vy, vz, radius, max_time.

    A body is fixed if its type is static or all its degrees of freedom are.
    Positions of two numbers get z = 0. The radius is half the diagonal of the
    inline vertices times the largest scale, or half the scale without any.
    """
    schema = f"struct<max_time: double, rigid_body_problem: struct<rigid_bodies: array<{BODY}>>>"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    data = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("j"))
    rows = data.select("file", F.col("j.max_time").alias("max_time"), F.posexplode("j.rigid_body_problem.rigid_bodies").alias("body_id", "b")).select("file", "max_time", "body_id", "b.*")
    flags = F.regexp_extract_all(F.lower("is_dof_fixed"), F.lit("(true|false)"), F.lit(0))
    fixed = (F.lower("type") == "static") | ((F.size(flags) > 0) & ~F.array_contains(flags, "false"))
    numbers = F.transform(F.regexp_extract_all("scale", F.lit(r"(-?[0-9.]+(?:[eE][-+]?\d+)?)"), F.lit(0)), lambda x: F.abs(x.cast("double")))
    scale = F.coalesce(F.array_max(numbers), F.lit(1.0))
    along = lambda k: F.transform("vertices", lambda v: F.coalesce(F.get(v, F.lit(k)), F.lit(0.0)))
    spread = [along(k) for k in range(3)]
    diagonal = F.sqrt(sum(((F.array_max(c) - F.array_min(c)) ** 2 for c in spread), F.lit(0.0)))
    radius = F.when(F.size("vertices") > 0, F.greatest(diagonal * scale * 0.5, F.lit(1.0e-6))).otherwise(scale * 0.5)
    at = lambda column, k: F.coalesce(F.get(F.col(column), F.lit(k)), F.lit(0.0))
    return rows.select(
        "file", F.col("body_id").cast("long").alias("body_id"), "mesh", F.coalesce(fixed, F.lit(False)).alias("fixed"),
        *[at("position", k).alias(a) for k, a in enumerate("xyz")], *[at("linear_velocity", k).alias(f"v{a}") for k, a in enumerate("xyz")], radius.alias("radius"), "max_time",
    )


def scene_pairs(bodies: DataFrame) -> DataFrame:
    """Pairs of bodies of a scene, not both fixed, as moving spheres over [0, max_time or 1]: a_*, b_* with x0 to z1 and r."""
    time = F.coalesce("max_time", F.lit(1.0))
    moved = bodies.select(
        "file", "body_id", "fixed", *[F.col(k).alias(f"{k}0") for k in "xyz"],
        *[F.when(F.col("fixed"), F.col(k)).otherwise(F.col(k) + F.col(f"v{k}") * time).alias(f"{k}1") for k in "xyz"], F.col("radius").alias("r"),
    )
    return rigid_pairs(moved, ("file",))
