"""Rigid motion: pose lookup in segments and bounds on a patch's motion; response to impacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.functions import geometry as g


def pose_at(segments: DataFrame, times: DataFrame, width: float = 1.0) -> DataFrame:
    """Joins (object_id, t) to the segment t0 <= t < t1 and interpolates the pose there.

    The key is the object and a slot of time ``width`` wide, in which a time
    is and which a segment covers: about a segment's length is a good width.
    """
    slot = lambda c: F.floor(F.col(c) / width)
    covered = segments.withColumn("_slot", F.explode(F.sequence(slot("t0"), slot("t1"))))
    rows = covered.join(times.withColumn("_slot", slot("t")), ["object_id", "_slot"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    a = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    place = [F.col(f"p{k}0") * (1.0 - a) + F.col(f"p{k}1") * a for k in "xyz"]
    q0, q1 = (g.unit_quaternion(tuple(F.col(f"q{k}{e}") for k in "xyzw")) for e in "01")
    turn = g.slerp(q0, q1, a)
    out = {f"p{k}": v for k, v in zip("xyz", place)} | {f"q{k}": v for k, v in zip("xyzw", turn)}
    return rows.select("object_id", "segment_id", "t", *[v.alias(c) for c, v in out.items()])


def patch_bounds(segments: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """Per segment how far a patch (local centre and radius) can move: translation and rotation parts, conservative radius."""
    q0, q1 = (g.unit_quaternion(tuple(F.col(f"q{k}{e}") for k in "xyzw")) for e in "01")
    angle = g.rotation_angle(q0, q1)
    half = F.sin(angle * 0.5)
    p0, p1 = (g.vec(*[f"p{k}{e}" for k in "xyz"]) for e in "01")
    size = sum(c * c for c in center) ** 0.5
    shift, turn, skin = g.norm(g.sub(p0, p1)), half * (2.0 * size), half * (2.0 * radius)
    local = tuple(F.lit(c) for c in center)
    c0, c1 = (g.add(g.rotate(q, local), p) for q, p in ((q0, p0), (q1, p1)))
    return segments.select(
        "object_id", "segment_id", angle.alias("angle"), shift.alias("translation_bound"), turn.alias("rotation_bound"),
        (shift + turn + skin).alias("radial_bound"), (turn + radius).alias("conservative_radius"), g.norm(g.sub(c0, c1)).alias("center_shift"),
    )


def responses(pairs: DataFrame, restitution: float = 1.0) -> DataFrame:
    """Adds post-impact velocities, momentum and energy before and after to pairs with collided and toi."""
    a0, a1, b0, b1 = (g.vec(*[f"{s}_{k}{e}" for k in "xyz"]) for s in "ab" for e in "01")
    toi = F.col("toi")
    va, vb = g.sub(a1, a0), g.sub(b1, b0)
    gap = g.sub(g.lerp(b0, b1, toi), g.lerp(a0, a1, toi))
    size = g.norm(gap)
    normal = tuple(F.when(size <= 1.0e-12, F.lit(1.0 if i == 0 else 0.0)).otherwise(F.try_divide(x, size)) for i, x in enumerate(gap))
    ma, mb = g.sphere_mass(F.col("a_r")), g.sphere_mass(F.col("b_r"))
    wa, wb = g.elastic_impact(normal, va, vb, ma, mb, restitution, F.col("collided"))
    energy = lambda x, y: (ma * g.dot(x, x) + mb * g.dot(y, y)) * 0.5
    out = {f"va_{k}": v for k, v in zip("xyz", wa)} | {f"vb_{k}": v for k, v in zip("xyz", wb)}
    out |= {"energy_before": energy(va, vb), "energy_after": energy(wa, wb)}
    out |= {"momentum_x_before": ma * va[0] + mb * vb[0], "momentum_x_after": ma * wa[0] + mb * wb[0]}
    return pairs.withColumns(out)


def approach_motions(pairs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Adds a_x1 to b_z1 to pairs of assets (a_x0 to b_z0, their centres; a_diagonal, b_diagonal): the first moves towards the second, which stays.

    It moves by ``fraction`` of the larger diagonal, or of 1 if both are
    smaller; along x if the centres agree.
    """
    a, b = (g.vec(*[f"{s}_{k}0" for k in "xyz"]) for s in "ab")
    gap = g.sub(b, a)
    size = g.norm(gap)
    step = F.greatest("a_diagonal", "b_diagonal", F.lit(1.0)) * fraction
    unit = [F.when(size <= 1.0e-12, F.lit(1.0 if i == 0 else 0.0)).otherwise(F.try_divide(x, size)) for i, x in enumerate(gap)]
    out = {f"a_{k}1": F.col(f"a_{k}0") + u * step for k, u in zip("xyz", unit)}
    return pairs.withColumns(out | {f"b_{k}1": F.col(f"b_{k}0") for k in "xyz"})
