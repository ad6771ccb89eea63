"""Small helpers shared by the text-pipeline operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a
    fresh temporary folder if nothing is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder; for rows that hold texts."""
    folder = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def hot_join(rows: DataFrame, others: DataFrame, keys: Sequence[str], number: Column, share: int = 256, salts: int = 64, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``others``, which has one row per ``keys``, without a key's rows meeting in one task.

    A key of more than 1 / ``share`` of the rows is hot; there are fewer than
    ``share`` of those, so their list may go everywhere. Its rows are spread by
    ``number`` over ``salts`` copies of the other side's row. Null keys meet
    none and are spread too. ``counts``, if known, has ``n`` rows per key.
    """
    total = rows.count()
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(known & (F.col("n") * share > total))
    hot = F.broadcast(materialised(hot.select(*keys, F.lit(True).alias("hot"))))
    salt = F.pmod(number, F.lit(salts)).cast("int")
    spread = rows.join(hot, list(keys), "left").withColumn("salt", F.when(F.col("hot") | ~known, salt).otherwise(0)).drop("hot")
    copies = others.join(hot, list(keys), "left")
    copies = copies.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return spread.join(copies, [*keys, "salt"], how).drop("salt")


def held_out(key: Column | str, modulus: int, remainder: int) -> Column:
    """True where crc32 of ``key`` as text leaves ``remainder``; never null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


_held: dict = {}


def per_process(key, make: Callable):
    """What ``make`` gives, kept in this process for later tasks that ask with the same key.

    Only the latest is kept, so a worker that goes on to another operator
    drops the caches of the one before.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
