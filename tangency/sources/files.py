"""Configuration, schedule and selection files, and table sinks of single runs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields
from typing import get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Epsilon:
    eps_time: float
    eps_space: float
    eps_proxy: float
    eps_cert: float


@dataclass(frozen=True)
class Limits:
    max_interval_bins: int
    max_family_scores: int
    enable_audit_log: bool


@dataclass(frozen=True)
class Output:
    write_csv: bool
    write_jsonl: bool


@dataclass(frozen=True)
class RuntimeConfig:
    """Strict: a missing or unknown key, a wrong type, or a number out of bounds is an error."""

    epsilon: Epsilon
    runtime: Limits
    benchmark: Output

    @classmethod
    def from_json(cls, text: str) -> RuntimeConfig:
        data = json.loads(text)
        if not isinstance(data, dict) or data.pop("schema_version", None) != 1:
            raise ValueError("a runtime configuration is an object of schema_version 1")
        return _strict(cls, data, "configuration")


#: Whole numbers lie between 1 and this.
MOST = 8


def _strict(kind: type, data, name: str):
    if not isinstance(data, dict) or set(data) != {f.name for f in fields(kind)}:
        raise ValueError(f"{name} has the keys {sorted(f.name for f in fields(kind))}")
    out = {}
    for key, wanted in get_type_hints(kind).items():
        value, number = data[key], isinstance(data[key], (int, float)) and not isinstance(data[key], bool)
        fits = {float: number and math.isfinite(value) and value > 0, int: type(value) is int and 1 <= value <= MOST, bool: isinstance(value, bool)}
        if wanted in fits:
            if not fits[wanted]:
                raise ValueError(f"{name}.{key} is no valid {wanted.__name__}")
            out[key] = wanted(value)
        else:
            out[key] = _strict(wanted, value, key)
    return kind(**out)


_SCHEDULE_LINE = r"^\s*(?:[^,]*,[^,]*,[^,]*,)?(.*?)\s*,\s*(\d+)\s*,\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s*$"


_SCHEDULE_HEADER = r"^\s*(?:group_id\s*,.*|csv_path\s*,\s*query_index\s*,\s*score\s*)$"


def write_schedule(rows: DataFrame, folder: str) -> None:
    """(group_id, case, kind, csv_path, query_index, score) as CSV with a header per file."""
    columns = ["group_id", "case", "kind", "csv_path", "query_index", "score"]
    rows.select(*columns).write.mode("error").option("header", True).csv(folder)


def _schedule_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank and no header, with ``fits``: whether they are of a schedule's shape."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(~F.col("value").rlike(_SCHEDULE_HEADER)).withColumn("fits", F.col("value").rlike(_SCHEDULE_LINE))


def read_schedule(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(csv_path, query_index, score) of lines whose last two values are an index and a score.

    Lines of six values, as ``write_schedule`` writes them, and of three are
    read; paths come back with forward slashes. Blank lines and headers are
    passed over; lines of another shape are left to ``schedule_faults``, or,
    if ``strict``, an error when they are read.
    """
    group = lambda i: F.regexp_extract("value", _SCHEDULE_LINE, i)
    lines = _schedule_lines(spark, path)
    fault = F.raise_error(F.concat(F.lit("no line of a schedule: "), F.col("value"))).cast("boolean")
    lines = lines.where(F.when(F.col("fits"), F.lit(True)).otherwise(fault) if strict else F.col("fits"))
    return lines.select(F.translate(group(1), "\\", "/").alias("csv_path"), group(2).cast("long").alias("query_index"), group(3).cast("double").alias("score"))


def schedule_faults(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a schedule that are neither read, blank nor a header."""
    return _schedule_lines(spark, path).where(~F.col("fits")).select("value")


def write_selection(rows: DataFrame, selected: str, folder: str) -> str:
    """Selected and skipped queries (csv_path, query_index) as two CSV folders; gives the mode that lists fewer: include or exclude."""
    chosen = F.coalesce(F.col(selected), F.lit(False))
    pair = rows.select("csv_path", "query_index", chosen.alias("_s"))
    n, kept = pair.agg(F.count("*"), F.count_if("_s")).first()
    for name, part in (("selected", pair.where("_s")), ("skipped", pair.where("not _s"))):
        part.select("csv_path", "query_index").write.mode("error").csv(f"{folder}/{name}")
    return "exclude" if kept > n // 2 else "include"


def use_selection(queries: DataFrame, spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """Queries of a selection by the list that ``mode`` names."""
    if mode not in ("include", "exclude"):
        raise ValueError(f"unknown mode {mode}")
    listed = spark.read.schema("csv_path string, query_index long").csv(f"{folder}/{'selected' if mode == 'include' else 'skipped'}")
    return queries.join(listed, ["csv_path", "query_index"], "left_semi" if mode == "include" else "left_anti")


def append_rows(rows: DataFrame, folder: str) -> None:
    """Adds rows to a CSV (17 digits, with header) and a JSON-lines folder; arrays become one CSV column per element."""
    wide = []
    for f in rows.schema.fields:
        if f.dataType.typeName() == "array":
            size = rows.agg(F.max(F.size(f.name))).first()[0] or 0
            wide += [F.get(F.col(f.name), F.lit(i)).alias(f"{f.name}_{i}") for i in range(size)]
        else:
            wide.append(F.col(f.name))
    digits = [F.format_string("%.17g", c).alias(n) if t in ("double", "float") else c for c, (n, t) in zip(wide, rows.select(*wide).dtypes)]
    rows.select(*digits).write.mode("append").option("header", True).csv(f"{folder}/csv")
    rows.write.mode("append").json(f"{folder}/json")
