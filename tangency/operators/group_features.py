"""Feature rows of primitive queries that stand in a group: a scene's time step, or the envelope of two objects.

The geometry of a row is worked out on Arrow batches; what is relative to the
group comes from aggregates joined back, so no group is held or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangency.operators.certificate import VALUES, distance
from tangency.operators.features import as_array

# The quantity in each slot of the projection of envelope candidates.
ENVELOPE = (
    "is_vf is_ee extent_x extent_y extent_z diagonal volume_log relative_motion top_speed spread_0 spread_1 least_spread middle_x middle_y middle_z drift"
    " farthest deviation speed_0 speed_1 speed_2 speed_3 from_1 from_2 from_3 nearness speed_share dot_03 cross_03 drift index_log one"
).split()
# The quantity in each slot of the projection of a scene's time step; the scenes of soft bodies; the
# scale of the logarithms of group size and box number; the times at which the distance is sampled.
GROUP = (
    "is_ee is_vf scene_0 scene_1 scene_2 scene_3 scene_4 scene_5 size_share time_share gap_log closest_time mean_speed_log top_speed_log diagonal_log volume_floor_log"
    " extent_x_log extent_y_log extent_z_log drift_log first_log second_log risk place a_box_log b_box_log low_z high_z soft degenerate bits_share one"
).split()
SOFT_SCENES = (1, 2, 5)
SIZE_SCALE, BOX_SCALE, BOX_MODULUS, BITS = 18.0, 12.0, 100_000, 64.0
SAMPLES = 9
#: Distances this close count as equal; the earliest time is taken.
TIE = 1.0e-9

_MEASURES = (
    "extent_x extent_y extent_z diagonal relative_motion top_speed mean_speed spread_0 spread_1 middle_x middle_y middle_z drift farthest deviation speed_0 speed_1 speed_2 speed_3"
    " from_1 from_2 from_3 dot_03 cross_03 first second degenerate low_z high_z gap closest_time"
).split()


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def measures(values: np.ndarray, faces: np.ndarray, samples: int = SAMPLES) -> dict[str, np.ndarray]:
    """The quantities ``_MEASURES`` of rows of four moving vertices (rows x 24); ``faces``: point and triangle, else two edges."""
    start, end = values[:, :12].reshape(-1, 4, 3), values[:, 12:].reshape(-1, 4, 3)
    move, every = end - start, np.concatenate([start, end], 1)
    low, high = every.min(1, initial=np.inf), every.max(1, initial=-np.inf)
    extent, speed = high - low, _norm(move)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    spread = [np.min([_norm(p[:, i] - p[:, j]) for i, j in pairs], axis=0) for p in (start, end)]
    middle = every.mean(1)
    area = 0.5 * _norm(np.cross(start[:, 2] - start[:, 1], start[:, 3] - start[:, 1]))
    lengths = _norm(start[:, 1] - start[:, 0]), _norm(start[:, 3] - start[:, 2])
    times = np.linspace(0.0, 1.0, samples)
    gaps = np.zeros((len(values), samples))
    for kind in (True, False):
        own = np.flatnonzero(faces == kind)
        for k, t in enumerate(times):
            gaps[own, k] = distance(start[own] + move[own] * t, kind)
    least = gaps.min(1, initial=np.inf)
    out = {f"extent_{k}": extent[:, i] for i, k in enumerate("xyz")} | {f"middle_{k}": middle[:, i] for i, k in enumerate("xyz")}
    out |= {f"speed_{i}": speed[:, i] for i in range(4)} | {f"from_{i}": _norm(start[:, i] - start[:, 0]) for i in (1, 2, 3)}
    return out | {
        "diagonal": _norm(extent), "relative_motion": _norm((move[:, 0] + move[:, 1]) * 0.5 - (move[:, 2] + move[:, 3]) * 0.5),
        "top_speed": speed.max(1, initial=0), "mean_speed": speed.mean(1), "spread_0": spread[0], "spread_1": spread[1],
        "drift": _norm(end.mean(1) - start.mean(1)), "farthest": np.abs(every).max((1, 2), initial=0), "deviation": np.sqrt(((every - middle[:, None]) ** 2).sum(2).mean(1)),
        "dot_03": (move[:, 0] * move[:, 3]).sum(1), "cross_03": _norm(np.cross(move[:, 0], move[:, 3])),
        "first": np.where(faces, _norm(start[:, 0] - start[:, 1:].mean(1)), lengths[0]), "second": np.where(faces, area, lengths[1]),
        "degenerate": np.where(faces, area < 1e-10, (lengths[0] < 1e-8) | (lengths[1] < 1e-8)).astype(float),
        "low_z": low[:, 2], "high_z": high[:, 2], "gap": least, "closest_time": times[(gaps <= least[:, None] + TIE).argmax(1)],
    }


def measured(queries: DataFrame) -> DataFrame:
    """``queries`` (family, v0..v23) with the quantities ``_MEASURES`` as columns; rows with a null value get nulls."""
    schema = T.StructType([*queries.schema.fields, *[T.StructField(c, T.DoubleType()) for c in _MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in VALUES], 1) if batch.num_rows else np.zeros((0, 24))
            found = measures(values, batch.column("family").to_numpy(zero_copy_only=False) == "vf")
            void = np.isnan(values).any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[c], mask=void) for c in _MEASURES]], [*batch.schema.names, *_MEASURES])

    return queries.mapInArrow(run, schema)


def _kinds() -> dict:
    return {"is_vf": (F.col("family") == "vf").cast("double"), "is_ee": (F.col("family") == "ee").cast("double")}


def envelope_features(queries: DataFrame, index: str = "place") -> DataFrame:
    """Adds ``features`` of candidates of an envelope pair; ``index`` is the candidate's number in it."""
    thick = [F.greatest(f"extent_{k}", F.lit(1.0e-9)) for k in "xyz"]
    least = F.least("spread_0", "spread_1")
    values = _kinds() | {
        "volume_log": F.log1p(thick[0] * thick[1] * thick[2]), "least_spread": least, "nearness": 1.0 / (least + 1.0),
        "speed_share": F.col("top_speed") / (F.col("diagonal") + 1.0), "index_log": F.log1p(F.col(index).cast("double")),
    }
    return as_array(measured(queries), ENVELOPE, values).drop(*_MEASURES)


def group_features(queries: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Adds ``features``, exact_cost and risk to queries of a scene's time steps.

    ``queries`` has, besides the vertices and ``keys``: scene (a number, null
    or over 5 for others), step, place (from 0 within the group), a_box, b_box
    and bits. Size of the group and the last step of the scene come from the
    rows themselves; a group or scene may be a third of all rows, as only
    counts go back to them.
    """
    sizes = queries.groupBy(*keys).agg(F.count("*").alias("_size"))
    last = queries.groupBy("scene").agg(F.max("step").alias("_last")).select(F.col("scene").alias("_scene"), "_last")
    rows = measured(queries).join(sizes, list(keys), "left").join(F.broadcast(last.where("_scene is null or _scene between 0 and 5")), F.col("scene").eqNullSafe(F.col("_scene")), "left")
    log = lambda c: F.log1p(F.abs(c) if isinstance(c, str) else c)
    thick = {k: F.greatest(f"extent_{k}", F.lit(1.0e-12)) for k in "xyz"}
    diagonal = F.sqrt(thick["x"] * thick["x"] + thick["y"] * thick["y"] + thick["z"] * thick["z"])
    reach = F.greatest(F.lit(1.0e-6), (F.col("first") + F.col("second")) * 0.25 + diagonal * 0.1)
    rows = rows.withColumns({"_diagonal": diagonal, "risk": F.exp(-F.col("gap") / reach)})
    box = lambda c: F.log1p((F.abs(c) % BOX_MODULUS).cast("double")) / BOX_SCALE
    values = _kinds() | {f"scene_{i}": F.coalesce((F.col("scene") == i).cast("double"), F.lit(0.0)) for i in range(6)}
    values |= {f"extent_{k}_log": F.log1p(v) for k, v in thick.items()} | {f"{a}_log": log(b) for a, b in (("gap", "gap"), ("mean_speed", "mean_speed"), ("top_speed", "top_speed"), ("drift", "drift"), ("first", "first"), ("second", "second"))}
    values |= {
        "size_share": F.log2(F.greatest("_size", F.lit(2)).cast("double")) / SIZE_SCALE, "time_share": F.col("step") / F.greatest(F.coalesce("_last", "step"), F.lit(1)),
        "diagonal_log": F.log1p("_diagonal"), "volume_floor_log": F.log1p(thick["x"] * thick["y"] * thick["z"]), "place": F.col("place") / F.greatest(F.col("_size") - 1, F.lit(1)),
        "a_box_log": box("a_box"), "b_box_log": box("b_box"), "soft": F.coalesce(F.col("scene").isin(*SOFT_SCENES).cast("double"), F.lit(0.0)), "bits_share": F.col("bits") / BITS,
    }
    cost = F.when(F.col("family") == "ee", 1.25).otherwise(1.0) * (F.col("degenerate") * 0.25 + 1.0) * (F.log1p("top_speed") * 0.15 + 1.0)
    return as_array(rows, GROUP, values).withColumn("exact_cost", cost).drop(*_MEASURES, "_size", "_scene", "_last", "_diagonal")
