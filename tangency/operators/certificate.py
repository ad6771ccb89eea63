"""The interval certificate: collision, separation or undecided for moving primitives.

A primitive is four vertices in linear motion: a point and a triangle, or two
edges. An interval is a collision if its start, middle or end (in that order)
comes within eps_space; separate if the middle's distance less the largest
motion from it leaves more than eps_space; undecided at the greatest depth or
below eps_time; else it is halved, the left half first. The rows of an Arrow
batch are evaluated together, each at its own leftmost open interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLISION, SEPARATION, UNDECIDED = 0, 1, 2
_ZERO = 1.0e-14
VALUES = tuple(f"v{i}" for i in range(24))


@dataclass(frozen=True)
class Limits:
    eps_time: float = 1.0e-4
    eps_space: float = 1.0e-6
    depth: int = 24


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, b)


def _norm(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_dot(a, a))


def _share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom != 0)


def point_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ab = b - a
    long = _dot(ab, ab)
    t = np.where(long <= _ZERO, 0.0, np.clip(_share(_dot(p - a, ab), long), 0, 1))
    return _norm(p - a - ab * t[..., None])


def segment_segment(p1: np.ndarray, q1: np.ndarray, p2: np.ndarray, q2: np.ndarray) -> np.ndarray:
    d1, d2, r = q1 - p1, q2 - p2, p1 - p2
    a, e, f, b, c = _dot(d1, d1), _dot(d2, d2), _dot(d2, r), _dot(d1, d2), _dot(d1, r)
    point1, point2 = a <= _ZERO, e <= _ZERO
    bottom = a * e - b * b
    s = np.clip(np.divide(b * f - c * e, bottom, out=np.zeros_like(bottom), where=np.abs(bottom) > _ZERO), 0, 1)
    t = _share(b * s + f, e)
    s = np.where(t < 0, np.clip(_share(-c, a), 0, 1), np.where(t > 1, np.clip(_share(b - c, a), 0, 1), s))
    t = np.clip(t, 0, 1)
    s = np.where(point1, 0.0, np.where(point2, np.clip(_share(-c, a), 0, 1), s))
    t = np.where(point2, 0.0, np.where(point1, np.clip(_share(f, e), 0, 1), t))
    return _norm(p1 + d1 * s[..., None] - p2 - d2 * t[..., None])


def point_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance to the plane if the foot lies inside, else to the nearest edge."""
    edges = np.minimum(np.minimum(point_segment(p, a, b), point_segment(p, b, c)), point_segment(p, c, a))
    normal = np.cross(b - a, c - a)
    size = _norm(normal)
    inside = (_dot(np.cross(b - a, p - a), normal) >= 0) & (_dot(np.cross(c - b, p - b), normal) >= 0) & (_dot(np.cross(a - c, p - c), normal) >= 0) & (size > _ZERO)
    return np.where(inside, np.abs(_share(_dot(p - a, normal), size)), edges)


def distance(at: np.ndarray, faces: bool) -> np.ndarray:
    """Of vertices (rows x 4 x 3): point to triangle if ``faces``, else edge to edge."""
    v = [at[:, i] for i in range(4)]
    return point_triangle(*v) if faces else segment_segment(*v)


def certify(values: np.ndarray, faces: np.ndarray, t0: np.ndarray, t1: np.ndarray, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """status, toi_upper, margin and evaluations per row of ``values`` (rows x 24).

    Every row halves its own intervals, the left half first, and stops at its
    first collision; rows take their next interval together. A row holds at
    most one open interval per depth, so memory is bounded by the rows given.
    ``evaluations`` counts the intervals tested.
    """
    n = len(values)
    out = {"status": np.zeros(n, np.int32), "toi_upper": t1.astype(float).copy(), "margin": np.zeros(n), "evaluations": np.zeros(n, np.int64)}
    for kind in (True, False):
        own = np.flatnonzero(faces == kind)
        for name, found in zip(out, _certify(values[own], kind, t0[own], t1[own], limits)):
            out[name][own] = found
    return out


def _certify(values: np.ndarray, faces: bool, t0: np.ndarray, t1: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
    n = len(values)
    start = values[:, :12].reshape(n, 4, 3)
    move = values[:, 12:].reshape(n, 4, 3) - start
    speed = _norm(move)
    first, second = (speed[:, :1], speed[:, 1:]) if faces else (speed[:, :2], speed[:, 2:])
    reach = first.max(1, initial=0) + second.max(1, initial=0)
    at = lambda rows, t: distance(start[rows] + move[rows] * t[:, None, None], faces)

    toi, margin, evaluations = t1.astype(float).copy(), np.full(n, np.inf), np.zeros(n, np.int64)
    collided, unsure = np.zeros(n, bool), np.zeros(n, bool)
    # Open intervals of each row, the leftmost on top.
    low, high, level = np.zeros((n, limits.depth + 2)), np.zeros((n, limits.depth + 2)), np.zeros((n, limits.depth + 2), np.int16)
    low[:, 0], high[:, 0] = t0, t1
    top = np.zeros(n, np.int64)
    rows, begin = np.arange(n), True
    while len(rows):
        place = top[rows]
        a, b, depth = low[rows, place], high[rows, place], level[rows, place]
        mid = 0.5 * (a + b)
        gap = at(rows, mid)
        evaluations[rows] += 1
        hit, when = gap <= limits.eps_space, mid
        if begin:
            # Ends of later intervals were tested as ends or middles of those around them.
            ends = at(rows, a) <= limits.eps_space, at(rows, b) <= limits.eps_space
            when = np.where(ends[0], a, np.where(hit, mid, b))
            hit, begin = ends[0] | hit | ends[1], False
        bound = gap - reach[rows] * 0.5 * (b - a)
        free = ~hit & (bound > limits.eps_space)
        margin[rows[free]] = np.minimum(margin[rows[free]], bound[free] - limits.eps_space)
        rest = ~hit & ~free
        stuck = rest & ((depth >= limits.depth) | (b - a <= limits.eps_time))
        unsure[rows[stuck]] = True
        toi[rows[hit]], collided[rows[hit]] = when[hit], True
        go = rest & ~stuck
        r, k = rows[go], place[go]
        low[r, k], high[r, k], level[r, k] = mid[go], b[go], depth[go] + 1
        low[r, k + 1], high[r, k + 1], level[r, k + 1] = a[go], mid[go], depth[go] + 1
        top[rows] = np.where(hit, -1, place + np.where(go, 1, -1))
        rows = rows[top[rows] >= 0]
    status = np.where(collided, COLLISION, np.where(unsure, UNDECIDED, SEPARATION)).astype(np.int32)
    safe = np.where((status == SEPARATION) & np.isfinite(margin), np.maximum(margin, 0.0), 0.0)
    return status, np.where(collided, toi, t1), safe, evaluations


def certificates(queries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds status, toi_upper, margin, evaluations to rows of (family, v0..v23), over t0..t1 if there, else [0, 1]."""
    rows = queries if "t0" in queries.columns else queries.withColumns({"t0": F.lit(0.0), "t1": F.lit(1.0)})
    extra = [("status", T.IntegerType()), ("toi_upper", T.DoubleType()), ("margin", T.DoubleType()), ("evaluations", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, k) for c, k in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            values = np.stack([column(c) for c in VALUES], 1) if batch.num_rows else np.zeros((0, 24))
            found = certify(values.astype(float), column("family") == "vf", column("t0"), column("t1"), limits)
            new = [pa.array(found[c], t) for c, t in zip(found, (pa.int32(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *found])

    return rows.mapInArrow(run, schema)


def reduce_primitives(results: DataFrame, keys: list[str]) -> DataFrame:
    """One certificate per work item from its primitives (family, ord, status, toi_upper, margin, mask).

    The first collision wins, point-triangle primitives before edge pairs and
    each in order; else any undecided one makes it undecided; else it is
    separate by the least margin. Masks are or-ed.
    """
    place = F.struct((F.col("family") != "vf").alias("f"), "ord")
    hit = F.when(F.col("status") == COLLISION, place)
    rows = results.groupBy(*keys).agg(
        F.min_by(F.struct("family", "ord", "toi_upper"), hit).alias("w"), F.max(F.col("status") == COLLISION).alias("c"),
        F.max(F.col("status") == UNDECIDED).alias("u"), F.min("margin").alias("m"), F.bit_or("mask").alias("mask"), F.count("*").alias("primitives"),
    )
    status = F.when(F.col("c"), COLLISION).when(F.col("u"), UNDECIDED).otherwise(SEPARATION)
    return rows.select(
        *keys, status.cast("int").alias("status"), F.when(F.col("c"), F.col("w.toi_upper")).alias("toi_upper"), F.when(F.col("c"), F.col("w.ord")).alias("witness"),
        F.when(~F.col("c") & ~F.col("u"), F.col("m")).otherwise(F.lit(0.0)).alias("margin"), "mask", "primitives",
    )


def refined(items: DataFrame, deepest: int = 8, narrowest: float = 1.0e-6) -> DataFrame:
    """Children of work items (t0, t1, depth, status, toi_upper): [t0, toi] after a collision, both halves if undecided."""
    t0, t1 = F.col("t0"), F.col("t1")
    toi = F.least(F.greatest("toi_upper", t0), t1)
    mid = (t0 + t1) * 0.5
    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    parts = (
        F.when((F.col("status") == COLLISION) & (toi - t0 > narrowest), F.array(piece(t0, toi)))
        .when((F.col("status") == UNDECIDED) & (t1 - t0 > narrowest), F.array(piece(t0, mid), piece(mid, t1)))
    )
    rows = items.where(F.col("depth") < deepest).select("*", F.posexplode(parts).alias("child", "part"))
    return rows.withColumns({"t0": F.col("part.a"), "t1": F.col("part.b"), "depth": F.col("depth") + 1}).drop("part", "status", "toi_upper")


def audit(items: DataFrame, group: str, order: str) -> DataFrame:
    """Two events per work item, dequeue and certify, numbered per ``group`` in work order; the time is the number."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = items.withColumn("_rn", rn).withColumn("action", F.explode(F.array(F.lit("dequeue"), F.lit("certify"))))
    event = F.col("_rn") * 2 - F.when(F.col("action") == "dequeue", 1).otherwise(0)
    return rows.withColumns({"event_id": event.cast("long"), "timestamp_us": event.cast("long")}).drop("_rn")
