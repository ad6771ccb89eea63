"""Manifests of files: digests and sizes of what is there against what is listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path below ``folder``, bytes, sha256) of all files whose names fit ``pattern``; a file is one row of one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    # The folder's own name as Spark gives it: what comes before the path of a file below it.
    base = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    below = F.substring(path, F.locate(base, path) + len(base), F.length(path))
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_faults(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(path, fault) of files that are missing, not listed, or of other bytes or digest than the JSON-lines ``manifest`` (path, bytes, sha256) says.

    A path that is listed twice is a fault too; the manifest itself is passed
    over if it lies in the folder. Spark's reader does not see files of no
    bytes, so an entry of 0 bytes and the digest of nothing is no fault. Lines
    that are no JSON are faults with no path.
    """
    lines = spark.read.schema("path string, bytes long, sha256 string, _corrupt_record string").json(manifest).cache()
    listed = lines.where("path is not null").groupBy("path").agg(F.count("*").alias("n"), F.min("bytes").alias("b"), F.min("sha256").alias("s"))
    name = manifest.rstrip("/").rsplit("/", 1)[-1]
    there = file_digests(spark, folder).where(F.col("path") != name)
    rows = listed.join(there, "path", "full")
    empty = (F.col("b") == 0) & (F.lower("s") == F.sha2(F.lit(b""), 256))
    fault = (
        F.when(F.col("n").isNull(), "not listed").when(F.col("n") > 1, "listed twice").when(empty & F.col("sha256").isNull(), None).when(F.col("sha256").isNull(), "missing")
        .when(~F.col("b").eqNullSafe(F.col("bytes")), "bytes").when(~F.lower("s").eqNullSafe(F.col("sha256")), "sha256")
    )
    bad = lines.where("path is null").select(F.lit(None).cast("string").alias("path"), F.lit("no entry").alias("fault"))
    return rows.select("path", fault.alias("fault")).where("fault is not null").union(bad)
