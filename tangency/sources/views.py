"""Geometry views over the star-schema tables; ids are numbered within a query, never over all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a
    fresh temporary folder if nothing is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def moving_spheres(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, body_id, x0..z1, r): one sphere per order line, in linear motion over [0, 1]."""
    # Numbered by query_id itself, so that the spheres lie as later joins and groups by query want them and are dealt
    # out only once; as the table's own columns, which are fewer than what is made of them.
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("query_id"), *_ORDER)
    rows = rows.withColumn("body_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*_ORDER)).cast("long"))
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    x0, y0, z0 = q * 0.0973, d * 19.37, t * 21.13
    return rows.select(
        "query_id", "body_id",
        x0.alias("x0"), y0.alias("y0"), z0.alias("z0"),
        (x0 + (d - 0.0513) * 31.7).alias("x1"), (y0 + (t - 0.0411) * 18.9).alias("y1"), z0.alias("z1"),
        (0.2137 + (F.col("l_partkey") % 7) * 0.0519).alias("r"),
    )


#: DuckDB text of the view moving_spheres.
MOVING_SPHERES_SQL = """
SELECT l_orderkey AS query_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS body_id,
  l_quantity * 0.0973e0 AS x0, l_discount * 19.37e0 AS y0, l_tax * 21.13e0 AS z0,
  l_quantity * 0.0973e0 + (l_discount - 0.0513e0) * 31.7e0 AS x1, l_discount * 19.37e0 + (l_tax - 0.0411e0) * 18.9e0 AS y1, l_tax * 21.13e0 AS z1,
  0.2137e0 + CAST(l_partkey % 7 AS DOUBLE) * 0.0519e0 AS r
FROM lineitem"""


def swept_boxes(spheres: DataFrame) -> DataFrame:
    """Adds the box a sphere sweeps over [0, 1], inflated by its radius."""
    out = {}
    for k in "xyz":
        out[f"min_{k}"] = F.least(f"{k}0", f"{k}1") - F.col("r")
        out[f"max_{k}"] = F.greatest(f"{k}0", f"{k}1") + F.col("r")
    return spheres.withColumns(out)


SWEPT_BOXES_SQL = "SELECT *, " + ", ".join(f"least({k}0, {k}1) - r AS min_{k}, greatest({k}0, {k}1) + r AS max_{k}" for k in "xyz") + f" FROM ({MOVING_SPHERES_SQL})"


def dense_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Scored candidates in dense groups: one group per supplier, costs, intervals and label from its order lines."""
    order = ("l_orderkey", *_ORDER)
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("long")
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    full = 1.0 + F.col("l_quantity") % 5
    t0 = ((part * 13) % 80) / 100.0
    c0 = ((part * 29) % 90) / 100.0
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        number.alias("candidate_id"),
        (F.col("l_discount") + 0.0).alias("priority"),
        (F.col("l_tax") + 0.0).alias("cost"),
        ((part % 97) / 97.0).alias("uncertainty"),
        full.alias("full_cost"), (full * 0.25).alias("narrow_cost"),
        t0.alias("interval_t0"), (t0 + 0.2).alias("interval_t1"),
        c0.alias("contact_t0"), (c0 + 0.05).alias("contact_t1"),
        ((part * 7 + line) % 11 == 0).alias("collides"),
    )


DENSE_CANDIDATES_SQL = """
SELECT l_suppkey AS query_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS candidate_id,
  l_discount + 0e0 AS priority, l_tax + 0e0 AS cost, CAST(l_partkey % 97 AS DOUBLE) / 97e0 AS uncertainty,
  1e0 + l_quantity % 5e0 AS full_cost, (1e0 + l_quantity % 5e0) * 0.25e0 AS narrow_cost,
  CAST((l_partkey * 13) % 80 AS DOUBLE) / 100e0 AS interval_t0, CAST((l_partkey * 13) % 80 AS DOUBLE) / 100e0 + 0.2e0 AS interval_t1,
  CAST((l_partkey * 29) % 90 AS DOUBLE) / 100e0 AS contact_t0, CAST((l_partkey * 29) % 90 AS DOUBLE) / 100e0 + 0.05e0 AS contact_t1,
  (l_partkey * 7 + l_linenumber) % 11 = 0 AS collides
FROM lineitem"""


def motion_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(object_id, segment_id, t0, t1, p*0, p*1, q*0, q*1): rigid motion of each customer through its orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("object_id"),
        F.row_number().over(w).cast("long").alias("segment_id"),
        F.col("o_orderkey").alias("k0"), F.lead("o_orderkey").over(w).alias("k1"),
    ).where("k1 is not null")
    out = [F.col("object_id"), F.col("segment_id"), (F.col("segment_id") - 1).cast("double").alias("t0"), F.col("segment_id").cast("double").alias("t1")]
    for end in "01":
        k = F.col(f"k{end}")
        out += [((k * m) % 101 / 10.0).alias(f"p{a}{end}") for a, m in zip("xyz", (3, 7, 11))]
        out += [((k * m) % 19 / 10.0 + 0.1).alias(f"q{a}{end}") for a, m in zip("xyzw", (1, 3, 5, 7))]
    return rows.select(*out)


MOTION_SEGMENTS_SQL = (
    "SELECT object_id, segment_id, CAST(segment_id - 1 AS DOUBLE) AS t0, CAST(segment_id AS DOUBLE) AS t1, "
    + ", ".join(
        [f"CAST((k{e} * {m}) % 101 AS DOUBLE) / 10e0 AS p{a}{e}" for e in "01" for a, m in zip("xyz", (3, 7, 11))]
        + [f"CAST((k{e} * {m}) % 19 AS DOUBLE) / 10e0 + 0.1e0 AS q{a}{e}" for e in "01" for a, m in zip("xyzw", (1, 3, 5, 7))]
    )
    + """ FROM (SELECT o_custkey AS object_id, row_number() OVER w AS segment_id, o_orderkey AS k0, lead(o_orderkey) OVER w AS k1
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE k1 IS NOT NULL"""
)


def vertex_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, family, v0..v23): primitive queries of four vertices in motion, from eight lines of a supplier each.

    Values 3 i to 3 i + 2 are vertex i % 4 at the start (i < 4) or the end. What is left of a
    supplier's lines is no query; ``leftover_lines`` tells them.
    """
    order = ("l_orderkey", *_ORDER)
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    rows = table(spark, folder, "lineitem").withColumn("n", number)
    point = F.struct(F.pmod("n", F.lit(8)).alias("i"), (F.col("l_quantity") * 0.0973).alias("x"), (F.col("l_discount") * 19.37).alias("y"), (F.col("l_tax") * 21.13).alias("z"))
    rows = rows.groupBy("l_suppkey", F.floor(F.col("n") / 8).alias("chunk")).agg(F.array_sort(F.collect_list(point)).alias("v")).where(F.size("v") == 8)
    values = [F.col("v")[i][a].alias(f"v{3 * i + j}") for i in range(8) for j, a in enumerate("xyz")]
    return rows.select((F.col("l_suppkey") * 1_000_000 + F.col("chunk")).alias("query_id"), F.when(F.col("chunk") % 2 == 0, "vf").otherwise("ee").alias("family"), *values)


def leftover_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(l_suppkey, lines): how many lines of a supplier are left over by ``vertex_queries``, where any are."""
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey").agg((F.count("*") % 8).alias("lines"))
    return rows.where("lines > 0")
