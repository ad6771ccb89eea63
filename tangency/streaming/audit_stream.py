"""Audit events and group runs as streams; each equals its batch query on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of Parquet files of events dropped into ``folder``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events, users and total per time slab and type; ``late`` is how far behind an event may come."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("slab"), "event_type").agg(
        F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total")
    )
    return out.select(F.col("slab.start").alias("t0"), F.col("slab.end").alias("t1"), "event_type", "events", "users", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of a user: events with gaps below ``gap``."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select(F.col("s.start").alias("t0"), F.col("s.end").alias("t1"), "user_id", "events")


_STATE = "calls long, hit boolean"
_OUTPUT = "query_id long, calls long, hit boolean"


def any_hit_stream(candidates: DataFrame) -> DataFrame:
    """Per group (query_id) the candidates seen until its first collision; later ones are not counted.

    State per group is two values. Within a batch rows are taken by
    (priority down, candidate_id); across batches in order of arrival.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        calls, hit = state.get if state.exists else (0, False)
        rows = pd.concat(list(parts))
        if not hit:
            rows = rows.sort_values(["priority", "candidate_id"], ascending=[False, True])
            hits = rows["collides"].to_numpy()
            first = hits.argmax() if hits.any() else len(hits) - 1
            calls, hit = calls + int(first) + 1, bool(hits.any())
        state.update((calls, hit))
        yield pd.DataFrame({"query_id": [key[0]], "calls": [calls], "hit": [hit]})

    rows = candidates.select("query_id", "candidate_id", "priority", "collides")
    return rows.groupBy("query_id").applyInPandasWithState(run, _OUTPUT, _STATE, "update", "NoTimeout")
