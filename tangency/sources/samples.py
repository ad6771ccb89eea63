"""Seeded samples of moving sphere pairs, labelled data sets of them, and their shards.

A random number is a hash of seed, sample and its own number, so a sample is
the same whichever task makes it and however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.functions import geometry as g
from tangency.operators.features import outcome_features

VERSION = 1
# Fixed values, by split: the gap at the start over the sum of radii (from, to), the gap at the end as a share of that
# sum plus a number (from, to), the hardness, and the radii of either sphere (from, to).
SMALL = ((0.18, 0.36), (0.16, 0.34))
LAWS = {
    "easy_negatives": ((1.6, 3.2), 1.0, (1.0, 2.4), 0.05, SMALL),
    "near_contact_hard_negatives": ((0.10, 0.28), 1.0, (0.03, 0.12), 0.55, SMALL),
    "grazing_contacts": ((0.08, 0.18), 1.0, (-0.035, -0.005), 0.82, SMALL),
    "multiple_contact_intervals": ((0.35, 0.65), -1.0, (-0.42, -0.18), 0.92, SMALL),
    "ood_meshes": ((4.0, 7.0), 1.0, (-0.7, -0.2), 1.0, ((0.65, 1.2), (0.55, 1.1))),
}

# The split of robot links, whose even and odd samples follow these two laws in turn, with capsules and
# so much more hardness.
ROBOT_LINKS, ROBOT_LAWS, ROBOT_HARDER = "robot_link_validation", ("near_contact_hard_negatives", "grazing_contacts"), 0.08


def uniform(seed: int, sample: Column, number: int, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """A number in [low, high) from the first 32 bits of a digest of seed, sample and number."""
    text = F.concat_ws(":", F.lit(str(seed)), sample.cast("string"), F.lit(str(number)))
    unit = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return low + unit * (high - low)


def _by_split(pick) -> Column:
    out = None
    for name, law in LAWS.items():
        value = F.lit(float(pick(law)))
        out = F.when(F.col("_law") == name, value) if out is None else out.when(F.col("_law") == name, value)
    return out


def sphere_samples(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Pairs of spheres in motion for rows (sample_id, split): a_x0 to b_z1, a_r, b_r, hardness, ood, capsules.

    The first sphere moves a little, the second from its start gap to its end
    gap along x; heights differ by some jitter. Unknown splits are an error.
    """
    known = F.assert_true(F.col("split").isin(*LAWS, ROBOT_LINKS), F.concat(F.lit("unknown split "), F.col("split")))
    robot = F.col("split") == ROBOT_LINKS
    law = F.when(robot, F.when(F.pmod("sample_id", F.lit(2)) == 0, ROBOT_LAWS[0]).otherwise(ROBOT_LAWS[1])).otherwise(F.col("split"))
    u = lambda number, low, high: uniform(seed, F.col("sample_id"), number, low, high)
    jitter = lambda number, size: u(number, -size, size)
    rows = rows.where(F.coalesce(known.cast("string"), F.lit("")) == "").withColumn("_law", law).withColumns(
        {
            "a_r": u(0, _by_split(lambda law: law[4][0][0]), _by_split(lambda law: law[4][0][1])),
            "b_r": u(1, _by_split(lambda law: law[4][1][0]), _by_split(lambda law: law[4][1][1])),
            "hardness": F.when(robot, F.least(F.lit(1.0), _by_split(lambda law: law[3]) + ROBOT_HARDER)).otherwise(_by_split(lambda law: law[3])),
            "capsules": robot,
            "ood": F.col("split") == "ood_meshes",
            "_y": jitter(2, 0.12),
        }
    )
    radii, many = F.col("a_r") + F.col("b_r"), F.col("_law") == "multiple_contact_intervals"
    start = radii + u(3, _by_split(lambda law: law[0][0]), _by_split(lambda law: law[0][1]))
    end = radii * _by_split(lambda law: law[1]) + u(4, _by_split(lambda law: law[2][0]), _by_split(lambda law: law[2][1]))
    zero = F.lit(0.0)
    return rows.withColumns(
        {
            "a_x0": jitter(5, 0.05), "a_y0": F.col("_y"), "a_z0": zero,
            "a_x1": F.when(many, jitter(6, 0.05) + 0.15).otherwise(jitter(6, 0.09) + 0.55),
            "a_y1": F.when(many, F.col("_y")).otherwise(F.col("_y") + jitter(7, 0.08)), "a_z1": zero,
            "b_x0": start, "b_y0": F.col("_y") + jitter(8, 0.08), "b_z0": zero,
            "b_x1": end, "b_y1": F.col("_y") + F.when(many, jitter(9, 0.04)).otherwise(jitter(9, 0.08)), "b_z1": zero,
        }
    ).drop("_y", "_law")


def labelled(samples: DataFrame) -> DataFrame:
    """Samples with their exact contact, features and targets."""
    ends = tuple(g.vec(*[f"{s}_{k}{e}" for k in "xyz"]) for s in "ab" for e in "01")
    solved = samples.withColumns(g.swept_spheres(*ends, F.col("a_r") + F.col("b_r")))
    return outcome_features(solved.withColumns({"type_a": F.lit(0), "type_b": F.lit(0)}))


def write_shards(rows: DataFrame, folder: str) -> None:
    """Rows by split as Parquet, and a manifest of the rows written of each; a folder that is there is an error."""
    rows.write.partitionBy("split").parquet(f"{folder}/rows")
    counts = rows.sparkSession.read.parquet(f"{folder}/rows").groupBy("split").agg(F.count("*").alias("rows"))
    counts.withColumn("version", F.lit(VERSION)).coalesce(1).write.json(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """The rows of a data set, of one split if named; another version or other counts than the manifest's are an error."""
    rows = spark.read.parquet(f"{folder}/rows")
    manifest = spark.read.schema("split string, rows long, version long").json(f"{folder}/manifest")
    found = rows.groupBy("split").agg(F.count("*").alias("found"))
    faults = manifest.join(found, "split", "full").where((F.coalesce("version", F.lit(-1)) != VERSION) | ~F.col("rows").eqNullSafe(F.col("found")))
    if not faults.isEmpty():
        raise ValueError("the shards differ from their manifest")
    return rows if split is None else rows.where(F.col("split") == split)
