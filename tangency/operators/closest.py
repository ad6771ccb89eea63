"""The best-distance certificate: bisection that keeps the least distance it has sampled, and where.

An interval is sampled at its start, middle and end. The nearest sample, the
earliest of equals, decides a collision and is its time; else the middle's
distance less the motion within the half decides separation; else the halves
follow, the left first. Three evaluations are counted for every interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.operators.certificate import COLLISION, SEPARATION, UNDECIDED, VALUES, Limits, distance

#: Names of the samples of an interval, by number.
SAMPLES = ("start", "middle", "end")
_NEW = (("status", T.IntegerType()), ("toi", T.DoubleType()), ("margin", T.DoubleType()), ("evaluations", T.LongType()), ("depth", T.IntegerType()), ("least_distance", T.DoubleType()), ("least_time", T.DoubleType()), ("sample", T.StringType()))


def _reach(move: np.ndarray, faces: bool) -> np.ndarray:
    speed = np.sqrt((move * move).sum(2))
    first, second = (speed[:, :1], speed[:, 1:]) if faces else (speed[:, :2], speed[:, 2:])
    return first.max(1, initial=0) + second.max(1, initial=0)


def nearest(values: np.ndarray, faces: bool, t0: np.ndarray, t1: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, ...]:
    """The columns ``_NEW`` for rows of ``values`` (rows x 24) of one family, all rows an interval further at a time."""
    n = len(values)
    start = values[:, :12].reshape(n, 4, 3)
    move = values[:, 12:].reshape(n, 4, 3) - start
    reach = _reach(move, faces)
    at = lambda rows, t: distance(start[rows] + move[rows] * t[:, None, None], faces)
    low, high, level = np.zeros((n, limits.depth + 2)), np.zeros((n, limits.depth + 2)), np.zeros((n, limits.depth + 2), np.int32)
    low[:, 0], high[:, 0] = t0, t1
    top, rows = np.zeros(n, np.int64), np.arange(n)
    toi, margin, evaluations = t1.astype(float).copy(), np.full(n, np.inf), np.zeros(n, np.int64)
    deepest, collided, unsure = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)
    least, when, which = np.full(n, np.inf), t0.astype(float).copy(), np.zeros(n, np.int64)
    while len(rows):
        place = top[rows]
        a, b, depth = low[rows, place], high[rows, place], level[rows, place]
        times = np.stack([a, 0.5 * (a + b), b], 1)
        gaps = np.stack([at(rows, times[:, k]) for k in range(3)], 1)
        evaluations[rows] += 3
        deepest[rows] = np.maximum(deepest[rows], depth)
        best = gaps.argmin(1)
        gap, time = gaps[np.arange(len(rows)), best], times[np.arange(len(rows)), best]
        nearer = (gap < least[rows]) | ((gap == least[rows]) & (time < when[rows]))
        r = rows[nearer]
        least[r], when[r], which[r] = gap[nearer], time[nearer], best[nearer]
        hit = gap <= limits.eps_space
        # The sample that decides is the one told, whatever came closer before.
        toi[rows[hit]], collided[rows[hit]], which[rows[hit]] = time[hit], True, best[hit]
        bound = gaps[:, 1] - reach[rows] * 0.5 * (b - a)
        free = ~hit & (bound > limits.eps_space)
        margin[rows[free]] = np.minimum(margin[rows[free]], bound[free] - limits.eps_space)
        rest = ~hit & ~free
        stuck = rest & ((depth >= limits.depth) | (b - a <= limits.eps_time))
        unsure[rows[stuck]] = True
        go = rest & ~stuck
        r, k = rows[go], place[go]
        low[r, k], high[r, k], level[r, k] = times[go, 1], b[go], depth[go] + 1
        low[r, k + 1], high[r, k + 1], level[r, k + 1] = a[go], times[go, 1], depth[go] + 1
        top[rows] = np.where(hit, -1, place + np.where(go, 1, -1))
        rows = rows[top[rows] >= 0]
    status = np.where(collided, COLLISION, np.where(unsure, UNDECIDED, SEPARATION)).astype(np.int32)
    safe = np.where((status == SEPARATION) & np.isfinite(margin), np.maximum(margin, 0.0), 0.0)
    return status, np.where(collided, toi, t1), safe, evaluations, deepest, least, when, which


def best_certificates(queries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds status, toi, margin, evaluations, depth, least_distance, least_time and sample to rows of (family, v0..v23), over t0..t1 if there, else [0, 1].

    ``sample`` tells which of an interval's three samples was the nearest: the
    one that collided, else the one of the least distance of all.
    """
    rows = queries if "t0" in queries.columns else queries.withColumns({"t0": F.lit(0.0), "t1": F.lit(1.0)})
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, k) for c, k in _NEW]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int32, float, float, np.int64, np.int32, float, float, np.int64)
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            values = np.stack([column(c) for c in VALUES], 1).astype(float) if batch.num_rows else np.zeros((0, 24))
            faces, t0, t1 = column("family") == "vf", column("t0"), column("t1")
            out = [np.zeros(batch.num_rows, k) for k in kinds]
            for kind in (True, False):
                own = np.flatnonzero(faces == kind)
                for to, found in zip(out, nearest(values[own], kind, t0[own], t1[own], limits)):
                    to[own] = found
            new = [pa.array(x) for x in out[:-1]] + [pa.array([SAMPLES[k] for k in out[-1]], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[c for c, _ in _NEW]])

    return rows.mapInArrow(run, schema)


# Closest points


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1)


def on_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The point of a segment nearest to ``p``; a segment of no length is its first end."""
    ab = b - a
    long = _dot(ab, ab)
    t = np.divide(_dot(p - a, ab), long, out=np.zeros_like(long), where=long > 1e-14)
    return a + ab * np.clip(t, 0, 1)[..., None]


def on_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The point of a triangle nearest to ``p``: its foot if that lies inside, else on the nearest edge (the first of equals)."""
    edges = np.stack([on_segment(p, a, b), on_segment(p, b, c), on_segment(p, c, a)], 1)
    gaps = ((edges - p[:, None]) ** 2).sum(2)
    best = edges[np.arange(len(p)), gaps.argmin(1)]
    normal = np.cross(b - a, c - a)
    size = _dot(normal, normal)
    inside = (size > 1e-28) & (_dot(np.cross(b - a, p - a), normal) >= 0) & (_dot(np.cross(c - b, p - b), normal) >= 0) & (_dot(np.cross(a - c, p - c), normal) >= 0)
    share = np.divide(_dot(p - a, normal), size, out=np.zeros_like(size), where=inside)
    return np.where(inside[:, None], p - normal * share[:, None], best)


def between_segments(p1: np.ndarray, q1: np.ndarray, p2: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of two segments: where the lines are nearest if both are inside, else the best of an end and the other segment."""
    d1, d2, r = q1 - p1, q2 - p2, p1 - p2
    a, e, b, c, f = _dot(d1, d1), _dot(d2, d2), _dot(d1, d2), _dot(d1, r), _dot(d2, r)
    bottom = a * e - b * b
    skew = bottom > 1e-14
    s = np.divide(b * f - c * e, bottom, out=np.full_like(bottom, -1.0), where=skew)
    t = np.divide(a * f - b * c, bottom, out=np.full_like(bottom, -1.0), where=skew)
    inside = skew & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    ones = [p1, q1, on_segment(p2, p1, q1), on_segment(q2, p1, q1)]
    twos = [on_segment(p1, p2, q2), on_segment(q1, p2, q2), p2, q2]
    gaps = np.stack([((x - y) ** 2).sum(1) for x, y in zip(ones, twos)], 1)
    best, rows = gaps.argmin(1), np.arange(len(p1))
    one, two = np.stack(ones, 1)[rows, best], np.stack(twos, 1)[rows, best]
    return np.where(inside[:, None], p1 + d1 * s[:, None], one), np.where(inside[:, None], p2 + d2 * t[:, None], two)


def closest_points(queries: DataFrame, time: float = 0.0) -> DataFrame:
    """Adds a_x to b_z, the nearest points of the two primitives at ``time``, and gap, their distance, to rows of (family, v0..v23)."""
    names = [f"{s}_{k}" for s in "ab" for k in "xyz"]
    schema = T.StructType([*queries.schema.fields, *[T.StructField(c, T.DoubleType()) for c in (*names, "gap")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in VALUES], 1) if batch.num_rows else np.zeros((0, 24))
            faces = batch.column("family").to_numpy(zero_copy_only=False) == "vf"
            v = (values[:, :12] + (values[:, 12:] - values[:, :12]) * time).reshape(-1, 4, 3)
            one, two = between_segments(*(v[:, i] for i in range(4)))
            one = np.where(faces[:, None], v[:, 0], one)
            two = np.where(faces[:, None], on_triangle(*(v[:, i] for i in range(4))), two)
            gap = np.sqrt(((one - two) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in (*one.T, *two.T)], pa.array(gap)], [*batch.schema.names, *names, "gap"])

    return queries.mapInArrow(run, schema)
