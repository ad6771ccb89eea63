"""Sweep-and-prune: boxes in order along an axis, each tested against those still open.

For a crowded key the axis is cut into strips of about equal numbers of
beginnings. A box is in the strip where it begins and, carried over, in all later ones that it
reaches; pairs are tested in the strip where the later of the two begins, so
each is tested once. A strip of a key is one run of sorted rows in Arrow
batches, in which only the boxes still open are held. Since these grow with
the scene's other extents, pairs of a crowded scene are found lane by lane of a
second axis.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BOX = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


class _Open:
    """Boxes still open, as growing arrays; ``ends`` are their maxima on the axis."""

    def __init__(self):
        self.number, self.box = np.zeros(0, np.int64), np.zeros((0, 6))

    def drop(self, axis: int, begin: float) -> int:
        """Closes the boxes that end before ``begin``; gives how many."""
        keep = self.box[:, 3 + axis] >= begin
        gone = int(len(keep) - keep.sum())
        if gone:
            self.number, self.box = self.number[keep], self.box[keep]
        return gone

    def add(self, number: int, box: np.ndarray) -> None:
        self.number, self.box = np.append(self.number, number), np.concatenate([self.box, box[None]])


@dataclass(frozen=True)
class Lanes:
    """Equal parts of an axis, from ``low``; what lies beyond is in the first or the last of them."""

    axis: str
    low: float
    width: float
    count: int

    def column(self, end: str) -> Column:
        return F.floor(F.least(F.greatest((F.col(f"{end}_{self.axis}") - self.low) / self.width, F.lit(0.0)), F.lit(self.count - 1.0)))

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.floor(np.minimum(np.maximum((values - self.low) / self.width, 0.0), self.count - 1.0))


def _sweep_batches(keys: Sequence[str], axis: int, schema: pa.Schema, lanes: Lanes | None = None):
    others, own_keys = [k for k in range(3) if k != axis], len(keys)
    keys = [*keys, "_lane"] if lanes else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_, tests, removed, begun, peak = None, _Open(), 0, 0, 0, 0
        out: list[tuple] = []

        def close() -> None:
            # Boxes that end in this strip and met no later beginning here: a later strip's first one closes them.
            if group is not None:
                *own, strip, until = group
                left = int((open_.box[:, 3 + axis] < until).sum())
                out.append((*own[:own_keys], None, None, strip, tests, removed, left, begun, peak))

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else ((),) * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            names = [*keys, "_strip", "_until"]
            group_columns = list(zip(*(batch.column(c).to_pylist() for c in names)))
            numbers, carried = batch.column("_number").to_numpy(), batch.column("_carried").to_numpy(zero_copy_only=False)
            boxes = np.stack([batch.column(c).to_numpy() for c in _BOX], 1) if batch.num_rows else np.zeros((0, 6))
            for i, own in enumerate(group_columns):
                if own != group:
                    close()
                    group, open_, tests, removed, begun, peak = own, _Open(), 0, 0, 0, 0
                box = boxes[i]
                if not carried[i]:
                    removed += open_.drop(axis, box[axis])
                    n = len(open_.number)
                    tests, begun, peak = tests + n, begun + 1, max(peak, n + 1)
                    if n:
                        met = np.ones(n, bool)
                        for k in others:
                            met &= (open_.box[:, k] <= box[3 + k]) & (open_.box[:, 3 + k] >= box[k])
                        if lanes:
                            # Once, in the first lane that both are in.
                            k = "xyz".index(lanes.axis)
                            met &= lanes.of(np.maximum(open_.box[:, k], box[k])) == own[own_keys]
                        for other in open_.number[met].tolist():
                            a, b = sorted((other, int(numbers[i])))
                            out.append((*own[:own_keys], a, b, None, None, None, None, None, None))
                open_.add(int(numbers[i]), box)
                if len(out) >= 10_000:
                    yield flush()
                    out.clear()
        close()
        yield flush()

    return run


def _strip_batches(cuts: np.ndarray, axis: str):
    """Rows at the strips that they reach, with the strip's end; rows that are not ``_big`` are in strip 0 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.append(cuts, np.inf)
        for batch in batches:
            big = batch.column("_big").to_numpy(zero_copy_only=False)
            first, last = (np.where(big, np.searchsorted(cuts, batch.column(f"{e}_{axis}").to_numpy(), "right"), 0) for e in ("min", "max"))
            size = np.maximum(last - first, 0) + 1
            at = np.repeat(np.arange(batch.num_rows), size)
            strip = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            until = np.where(big[at], ends[strip], np.inf)
            rows = batch.drop_columns(["_big"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(strip), pa.array(strip > first[at]), pa.array(until)], [*rows.schema.names, "_strip", "_carried", "_until"])

    return run


def swept(boxes: DataFrame, keys: Sequence[str] = ("query_id",), number: str = "body_id", axis: str = "x", strip_rows: int = 20_000, most_strips: int = 4096, lanes: Lanes | None = None) -> DataFrame:
    """Rows of the sweep: pairs (keys, a, b) and, with a and b null, counters of each strip of a key.

    Boxes with a null or a NaN end take no part; equal beginnings go by
    number. The axis is cut only for keys of more than ``strip_rows`` boxes,
    at approximate quantiles of their beginnings, into so many strips that
    one has about ``strip_rows`` of the largest key (at most ``most_strips``,
    then wider ones). With ``lanes`` a key's boxes are swept in each lane that
    they are in; pairs are the same, counters are those of the lanes.
    """
    own = list(keys)
    rows = boxes.select(*keys, F.col(number).cast("long").alias("_number"), *[F.col(c).cast("double").alias(c) for c in _BOX])
    whole = F.lit(True)
    for c in _BOX:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    rows = rows.where(whole)
    if lanes:
        rows = rows.withColumn("_lane", F.explode(F.sequence(lanes.column("min"), lanes.column("max"))))
        keys = [*own, "_lane"]
    big = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > strip_rows)
    largest = big.agg(F.max("_n")).first()[0]
    cuts = np.zeros(0)
    if largest is None:
        rows = rows.withColumn("_big", F.lit(False))
    else:
        flag = big.select(*keys, F.lit(True).alias("_big"))
        rows = rows.join(flag, list(keys), "left").withColumn("_big", F.coalesce("_big", F.lit(False))) if keys else rows.withColumn("_big", F.lit(True))
        strips = min(most_strips, -(-largest // strip_rows))
        cuts = np.array(sorted(set(rows.where("_big").approxQuantile(f"min_{axis}", [i / strips for i in range(1, strips)], 0.1 / strips))))
    extra = [T.StructField("_strip", T.LongType()), T.StructField("_carried", T.BooleanType()), T.StructField("_until", T.DoubleType())]
    rows = rows.mapInArrow(_strip_batches(cuts, axis), T.StructType([f for f in rows.schema if f.name != "_big"] + extra))
    rows = rows.repartition(*keys, "_strip").sortWithinPartitions(*keys, "_strip", F.col("_carried").desc(), f"min_{axis}", "_number")
    counters = ("strip", "tests", "removed", "left", "begun", "peak")
    schema = T.StructType([boxes.schema[k] for k in own] + [T.StructField(c, T.LongType()) for c in ("a", "b", *counters)])
    return rows.mapInArrow(_sweep_batches(tuple(own), "xyz".index(axis), to_arrow_schema(schema), lanes), schema)


def crowded_lanes(boxes: DataFrame, keys: Sequence[str], axis: str, most: int, each: int = 1024) -> Lanes | None:
    """Lanes of the other axis on which boxes lie widest apart for their size; none if no key has more than ``most`` boxes.

    A lane is eight mean boxes wide or more, so that the copies of boxes in
    several lanes are few, however unlike in size, and has about ``each`` boxes
    or more of the whole table.
    """
    largest = boxes.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return None
    wide = []
    for k in "xyz".replace(axis, ""):
        low, high = (F.col(f"{e}_{k}").cast("double") for e in ("min", "max"))
        finite = boxes.where((F.abs(low) < F.lit(float("inf"))) & (F.abs(high) < F.lit(float("inf"))))
        n, least, most_, mean = finite.agg(F.count("*"), F.min(low), F.max(high), F.avg(high - low)).first()
        if n and most_ > least:
            width = max(8.0 * mean, (most_ - least) * each / n)
            wide.append(Lanes(k, least, width, int((most_ - least) / width) + 1))
    best = max(wide, key=lambda x: x.count, default=None)
    return best if best is not None and best.count > 1 else None


def sweep_pairs(boxes: DataFrame, keys: Sequence[str] = ("query_id",), number: str = "body_id", axis: str = "x", strip_rows: int = 20_000) -> DataFrame:
    """All touching pairs (keys, a_number < b_number) of boxes of one key, each once.

    If a key has more than ``strip_rows`` boxes, a second axis is cut into
    lanes, so that a box is tested against those near it on both.
    """
    found = swept(boxes, keys, number, axis, strip_rows, lanes=crowded_lanes(boxes, keys, axis, strip_rows)).where("a is not null")
    kind = boxes.schema[number].dataType
    return found.select(*keys, F.col("a").cast(kind).alias(f"a_{number}"), F.col("b").cast(kind).alias(f"b_{number}"))


def sweep_counters(boxes: DataFrame, keys: Sequence[str] = ("query_id",), number: str = "body_id", axis: str = "x", strip_rows: int = 20_000) -> DataFrame:
    """Per key: boxes, tests made, removals from the active list and the most boxes open at once.

    A box is removed when one of its key begins after its end; however the
    axis is cut, the counts are those of one sweep along the whole of it.
    """
    rows = swept(boxes, keys, number, axis, strip_rows).where("a is null")
    totals = rows.groupBy(*keys).agg(F.sum("begun").alias("boxes"), F.sum("tests").alias("tests"), F.max("peak").alias("peak"), F.sum("removed").alias("removed"), F.max(F.when(F.col("begun") > 0, F.col("strip"))).alias("last"))
    late = rows.select(*keys, "strip", "left").join(totals.select(*keys, "last"), list(keys)).where(F.col("strip") < F.col("last"))
    late = late.groupBy(*keys).agg(F.sum("left").alias("late"))
    return totals.join(late, list(keys), "left").select(*keys, "boxes", "tests", (F.col("removed") + F.coalesce("late", F.lit(0))).alias("removals"), "peak")
