"""Row generators over time and space: slabs, samples, patches, dense workloads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangency.functions import geometry as g


def uniform_slabs(df: DataFrame, count: int, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Adds slab_id, slab_t0, slab_t1: ``count`` equal parts of [t0, t1]; the last ends exactly at t1."""
    rows = df.withColumn("slab_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    step = (F.col(t1) - F.col(t0)) / count
    end = F.when(F.col("slab_id") == count - 1, F.col(t1)).otherwise(F.col(t0) + step * (F.col("slab_id") + 1))
    return rows.withColumns({"slab_t0": F.col(t0) + step * F.col("slab_id"), "slab_t1": end})


def slab_boxes(spheres: DataFrame, count: int, inflate: float = 0.0) -> DataFrame:
    """One swept box per sphere and time slab, with its volume."""
    rows = uniform_slabs(spheres.withColumns({"t0": F.lit(0.0), "t1": F.lit(1.0)}), count)
    out = {}
    for k in "xyz":
        ends = [F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * F.col(t) for t in ("slab_t0", "slab_t1")]
        out[f"min_{k}"] = F.least(*ends) - F.col("r") - inflate
        out[f"max_{k}"] = F.greatest(*ends) + F.col("r") + inflate
    rows = rows.withColumns(out)
    return rows.withColumn("volume", g.box_volume(g.vec("min_x", "min_y", "min_z"), g.vec("max_x", "max_y", "max_z")))


def proxy_table(segments: DataFrame, patches: DataFrame, count: int, inflate: float = 0.0) -> DataFrame:
    """One proxy per object, motion segment, time slab and patch.

    ``segments`` has object_id, segment_id (from 1), t0, t1, p?0, p?1;
    ``patches`` has object_id, patch_id and reach, the distance from the
    object's origin that no point of the patch exceeds, so that a box holds
    the patch however the object turns. slab_id is (segment - 1) * count + the
    slab's place in its segment; proxy_id numbers an object's proxies from 0.
    """
    rows = uniform_slabs(segments, count).withColumnRenamed("slab_id", "_local").join(patches, "object_id")
    share = lambda t: (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    slab = (F.col("segment_id") - 1) * count + F.col("_local")
    number = (F.row_number().over(Window.partitionBy("object_id").orderBy("slab_id", "patch_id")) - 1).cast("long")
    out = {"slab_id": slab}
    for k in "xyz":
        ends = [F.col(f"p{k}0") + (F.col(f"p{k}1") - F.col(f"p{k}0")) * share(t) for t in ("slab_t0", "slab_t1")]
        out |= {f"min_{k}": F.least(*ends) - F.col("reach") - inflate, f"max_{k}": F.greatest(*ends) + F.col("reach") + inflate}
    return rows.withColumns(out).withColumn("proxy_id", number).drop("_local")


def sampled_boxes(spheres: DataFrame, samples: int) -> DataFrame:
    """One box per sphere and sampled time (slab_id): what a discrete check sees."""
    rows = spheres.withColumn("slab_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("slab_id") / float(samples - 1)
    out = {}
    for k in "xyz":
        at = F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * t
        out |= {f"min_{k}": at - F.col("r"), f"max_{k}": at + F.col("r")}
    return rows.withColumns(out)


def patch_boxes(spheres: DataFrame, patches: int, spread: float = 0.5) -> DataFrame:
    """One swept box per sphere and patch; patch i is shifted along axis i mod 3 and has a share of the radius."""
    rows = spheres.withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(patches - 1))))
    offset = (F.col("patch_id") + 0.5) / float(patches) - 0.5
    radius = F.col("r") / float(patches)
    out = {}
    for i, k in enumerate("xyz"):
        shift = F.when(F.col("patch_id") % 3 == i, offset * F.col("r") * spread).otherwise(F.lit(0.0))
        out[f"min_{k}"] = F.least(f"{k}0", f"{k}1") + shift - radius
        out[f"max_{k}"] = F.greatest(f"{k}0", f"{k}1") + shift + radius
    return rows.withColumns(out)


def dense_workload(queries: DataFrame, slabs: int, patches_a: int, patches_b: int) -> DataFrame:
    """Slab x patch x patch candidates of every query, with deterministic hit counts and costs."""
    rows = queries.select("query_id")
    for name, n in (("slab_id", slabs), ("patch_a", patches_a), ("patch_b", patches_b)):
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    noise = F.pmod(F.col("query_id") * 31 + F.col("slab_id") * 17 + F.col("patch_a") * 7 + F.col("patch_b") * 3, F.lit(13))
    return rows.withColumns({"hits": (noise % 4 + 1).cast("long"), "full_cost": noise / 13.0 + 1.0, "narrow_cost": (noise / 13.0 + 1.0) * 0.25})


def touched_slabs(contacts: DataFrame, count: int) -> DataFrame:
    """One row per contact interval [contact_t0, contact_t1] and slab of ``count`` that it touches."""
    first, last = (F.least(F.floor(F.col(c) * count), F.lit(count - 1)) for c in ("contact_t0", "contact_t1"))
    return contacts.withColumn("slab_id", F.explode(F.sequence(first, last)))


def slab_faults(slabs: DataFrame, key: str, tolerance: float = 1.0e-12) -> DataFrame:
    """Rows whose slab begins before the one before it ends; empty: a proper partition."""
    before = F.lag("slab_t1").over(Window.partitionBy(key).orderBy("slab_id"))
    return slabs.withColumn("_end", before).where(F.col("_end") > F.col("slab_t0") + tolerance).drop("_end")


def patch_slab_boxes(spheres: DataFrame, slabs: int, patches: int, spread: float = 0.5) -> DataFrame:
    """One box per sphere, time slab and patch: patch i is shifted along axis i mod 3 and has a share of the radius.

    More patches mean smaller boxes, which may miss a contact that one whole
    box finds.
    """
    rows = uniform_slabs(spheres.withColumns({"t0": F.lit(0.0), "t1": F.lit(1.0)}), slabs).withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(patches - 1))))
    offset = (F.col("patch_id") + 0.5) / float(patches) - 0.5
    radius = F.col("r") / float(patches)
    out = {}
    for i, k in enumerate("xyz"):
        ends = [F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * F.col(t) for t in ("slab_t0", "slab_t1")]
        shift = F.when(F.col("patch_id") % 3 == i, offset * F.col("r") * spread).otherwise(F.lit(0.0))
        out |= {f"min_{k}": F.least(*ends) + shift - radius, f"max_{k}": F.greatest(*ends) + shift + radius}
    return rows.withColumns(out)


# Slabs of pairs: two spheres are brought together once, by their query, and cut into slabs side by side. Boxes that
# are cut first and joined by query and slab are dealt out once per slab and setting, and what is found once more.


def whole_boxes(spheres: DataFrame) -> DataFrame:
    """Adds one box per sphere that holds its boxes of all slabs and patches, with room for how their ends are rounded."""
    out = {}
    for k in "xyz":
        reach = F.col("r") + (F.abs(f"{k}0") + F.abs(f"{k}1") + F.col("r")) * 1.0e-12
        out |= {f"min_{k}": F.least(f"{k}0", f"{k}1") - reach, f"max_{k}": F.greatest(f"{k}0", f"{k}1") + reach}
    return spheres.withColumns(out)


def slab_times(count: int) -> list[tuple[float, float]]:
    """Start and end of each of ``count`` slabs of [0, 1], as ``uniform_slabs`` cuts it."""
    step = 1.0 / count
    return [(step * i, 1.0 if i == count - 1 else step * (i + 1)) for i in range(count)]


def pair_positions(pairs: DataFrame, times: Iterable[float]) -> tuple[DataFrame, Callable[[str, str, float], Column]]:
    """Pairs of spheres (a_*, b_*) with where both are at ``times``, and what gives the column of (side, axis, time)."""
    number = {t: i for i, t in enumerate(sorted(set(times)))}
    rows = pairs.withColumns({f"_{s}_{k}_{i}": pair_position(s, k, t) for s in "ab" for k in "xyz" for t, i in number.items()})
    return rows, lambda s, k, t: F.col(f"_{s}_{k}_{number[t]}")


def pair_position(side: str, axis: str, t: float | str) -> Column:
    """Where a sphere of a pair is at a time, given as a number or a column."""
    start = F.col(f"{side}_{axis}0")
    return start + (F.col(f"{side}_{axis}1") - start) * (F.col(t) if isinstance(t, str) else F.lit(t))


def pair_end(side: str, axis: str, t: int) -> Column:
    """Where a sphere of a pair is at its start (0) or its end (1), as given."""
    return F.col(f"{side}_{axis}{t}")


def pair_boxes_touch(at: Callable[..., Column], t0, t1, a: tuple[int, int] = (0, 1), b: tuple[int, int] = (0, 1), spread: float = 0.5) -> Column:
    """Whether the boxes of a pair touch in a slab; ``a`` and ``b`` are (patch, patches), the boxes those of ``patch_slab_boxes``."""
    out = F.lit(True)
    for i, k in enumerate("xyz"):
        low, high = [], []
        for s, (patch, patches) in zip("ab", (a, b)):
            ends, r = [at(s, k, t) for t in (t0, t1)], F.col(f"{s}_r")
            # Whole spheres have no shift, and nothing is divided.
            shift = F.lit((patch + 0.5) / float(patches) - 0.5) * r * spread if patches > 1 and patch % 3 == i else F.lit(0.0)
            radius = r / float(patches) if patches > 1 else r
            low.append(F.least(*ends) + shift - radius)
            high.append(F.greatest(*ends) + shift + radius)
        out = out & (low[0] <= high[1]) & (low[1] <= high[0])
    return out


def pairs_by_slab(pairs: DataFrame, count: int) -> DataFrame:
    """Pairs of spheres once per slab in which their boxes touch: adds slab_id, slab_t0 and slab_t1."""
    rows = uniform_slabs(pairs.withColumns({"t0": F.lit(0.0), "t1": F.lit(1.0)}), count).drop("t0", "t1")
    return rows.where(pair_boxes_touch(pair_position, "slab_t0", "slab_t1"))


def _setting_batches(settings: list[tuple[int, int]], spread: float):
    """Per Arrow batch of pairs one row for each setting: what the touching boxes of slabs and patches add up to."""

    def ends(values: dict, t0: float, t1: float) -> dict:
        out = {}
        for s in "ab":
            for k in "xyz":
                start, move = values[f"{s}_{k}0"], values[f"{s}_{k}1"] - values[f"{s}_{k}0"]
                one, two = start + move * t0, start + move * t1
                out[s, k] = np.minimum(one, two), np.maximum(one, two)
        return out

    def boxes(spans: dict, values: dict, side: str, patch: int, patches: int) -> list:
        radius, offset = values[f"{side}_r"] / float(patches), (patch + 0.5) / float(patches) - 0.5
        shifts = [values[f"{side}_r"] * offset * spread if patch % 3 == i else 0.0 for i in range(3)]
        return [(low + shift - radius, high + shift + radius) for shift, (low, high) in zip(shifts, (spans[side, k] for k in "xyz"))]

    # A NaN is greater than any number and equal to itself, as for Spark.
    within = lambda a, b: (a <= b) | np.isnan(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(c).to_numpy() for c in SPHERES_OF_PAIR}
            truth = batch.column("truth").to_numpy(zero_copy_only=False)
            out = []
            for n, p in settings:
                hits = np.zeros(batch.num_rows, np.int64)
                for t0, t1 in slab_times(n):
                    spans = ends(values, t0, t1)
                    a, b = ([boxes(spans, values, s, i, p) for i in range(p)] for s in "ab")
                    for one in a:
                        for two in b:
                            met = np.ones(batch.num_rows, bool)
                            for (low_a, high_a), (low_b, high_b) in zip(one, two):
                                met &= within(low_a, high_b) & within(low_b, high_a)
                            hits += met
                found = hits > 0
                out.append((n, p, int(hits.sum()), int(found.sum()), int((found & truth).sum()), int(truth.sum())))
            columns = list(zip(*out))
            kinds = [pa.int32()] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["slabs", "patches", "raw_hits", "candidates", "covered", "positives"])

    return run


#: The numbers of the two spheres of a pair.
SPHERES_OF_PAIR = [f"{s}_{c}" for s in "ab" for c in ("x0", "y0", "z0", "x1", "y1", "z1", "r")]


def setting_hits(pairs: DataFrame, truth: str, settings: list[tuple[int, int]], spread: float = 0.5) -> DataFrame:
    """Parts of sums per setting (slabs, patches) over pairs of spheres: raw_hits, candidates, covered and positives.

    raw_hits counts touching boxes of one slab, of any patch of a with any of
    b, as ``patch_slab_boxes`` makes them; a pair with any is a candidate, and
    covered if it is true as well. Whole spheres are one patch.
    """
    rows = pairs.select(*SPHERES_OF_PAIR, F.col(truth).alias("truth"))
    return rows.mapInArrow(_setting_batches(list(settings), spread), "slabs int, patches int, raw_hits long, candidates long, covered long, positives long")
