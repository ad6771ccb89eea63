"""Column expressions for 3-d geometry and motion; all stay in generated code.

A vector is a tuple of three columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
#: Squared lengths at or below this count as zero.
DEGENERATE = 1.0e-14


def vec(*columns: Column | str) -> Vec:
    return tuple(F.col(c) if isinstance(c, str) else c for c in columns)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(x * k for x in a)


def dot(a, b) -> Column:
    first, *rest = (x * y for x, y in zip(a, b))
    for x in rest:
        first = first + x
    return first


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Vec, b: Vec, t: Column | float) -> Vec:
    return tuple(x + (y - x) * t for x, y in zip(a, b))


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> tuple[Column, Vec]:
    """Where on the segment, from 0 to 1, the point nearest to ``p`` lies, and that point; 0 on a segment of no length."""
    ab = sub(b, a)
    t = F.coalesce(clamp(F.try_divide(dot(sub(p, a), ab), F.when(dot(ab, ab) > DEGENERATE, dot(ab, ab))), 0.0, 1.0), F.lit(0.0))
    return t, add(a, scale(ab, t))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column, limit: float = 1.0e6) -> Column:
    """``x`` within +-limit; NaN and infinities become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(clamp(x, -limit, limit))


def interval_bin(t0: Column, t1: Column, bins: int = 8) -> Column:
    """Bin of an interval's middle among ``bins`` equal parts of [0, 1]."""
    middle = clamp((t0 + t1) * 0.5, 0.0, 1.0)
    return F.least(F.floor(middle * bins), F.lit(bins - 1)).cast("int")


def boxes_touch(a: str = "a", b: str = "b", axes: str = "xyz") -> Column:
    """Closed overlap of columns ``{side}_min_{axis}`` and ``{side}_max_{axis}``: touching counts."""
    out = F.lit(True)
    for k in axes:
        out = out & (F.col(f"{a}_min_{k}") <= F.col(f"{b}_max_{k}")) & (F.col(f"{b}_min_{k}") <= F.col(f"{a}_max_{k}"))
    return out


def intervals_touch(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed: equal ends count."""
    return F.greatest(a0, b0) <= F.least(a1, b1)


def intervals_cross(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Open: touching slabs do not count."""
    return (a0 < b1) & (b0 < a1)


def pair_key(low: Column, high: Column) -> Column:
    return F.shiftleft(low.cast("long"), 32).bitwiseOR(high.cast("long"))


def swept_spheres(a0: Vec, a1: Vec, b0: Vec, b1: Vec, radii: Column) -> dict[str, Column]:
    """Contact of two spheres in linear motion over [0, 1]: the smallest root of |d + v t| = radii.

    Keys: collided, toi (1 if none; 0 if in touch at the start), closest_time,
    min_distance, safe_margin, contact_t0, contact_t1.
    """
    d0 = sub(a0, b0)
    v = sub(sub(a1, b1), d0)
    a, b, c = dot(v, v), dot(d0, v) * 2.0, dot(d0, d0) - radii * radii
    moving = a > DEGENERATE
    disc = b * b - a * c * 4.0
    real = moving & (disc >= 0)
    half = F.sqrt(F.greatest(disc, F.lit(0.0)))
    low, high = F.try_divide(-b - half, a * 2.0), F.try_divide(-b + half, a * 2.0)
    inside = c <= 0
    hits = [F.when(real & x.between(0.0, 1.0), x) for x in (low, high)]
    first = F.least(*hits)
    toi = F.when(inside, F.lit(0.0)).otherwise(F.coalesce(first, F.lit(1.0)))
    collided = inside | first.isNotNull()
    closest = F.when(moving, clamp(F.try_divide(-b, a * 2.0), 0.0, 1.0)).otherwise(F.lit(0.0))
    gap = norm(sub(lerp(a0, a1, closest), lerp(b0, b1, closest)))
    ends = [clamp(x, 0.0, 1.0) for x in (low, high)]
    still = F.when(collided, toi).otherwise(closest)
    return {
        "collided": collided,
        "toi": toi,
        "closest_time": closest,
        "min_distance": gap,
        "safe_margin": gap - radii,
        "contact_t0": F.when(collided & real, F.least(*ends)).otherwise(still),
        "contact_t1": F.when(collided & real, F.greatest(*ends)).otherwise(still),
    }


def sampled_margin(a0: Vec, a1: Vec, b0: Vec, b1: Vec, radii: Column, samples: int) -> Column:
    """Least distance over evenly spaced times minus the radii; can miss a passage between samples."""
    gaps = [norm(sub(lerp(a0, a1, i / (samples - 1)), lerp(b0, b1, i / (samples - 1)))) for i in range(samples)]
    return F.least(*gaps) - radii


def margin_score(margin: Column, radii: Column, temperature: float) -> Column:
    return 1.0 / (1.0 + F.exp(clamp(margin / F.greatest(radii * temperature, F.lit(1.0e-9)), -60.0, 60.0)))


def margin_uncertainty(margin: Column, radii: Column, width: float) -> Column:
    return F.exp(-F.abs(margin) / F.greatest(radii * width, F.lit(1.0e-9)))


def unit_quaternion(q: tuple) -> tuple:
    size = F.sqrt(dot(q, q))
    return tuple(F.try_divide(x, size) for x in q)


def slerp(q0: tuple, q1: tuple, t: Column) -> tuple:
    """Shortest-arc interpolation of unit quaternions (x, y, z, w); nearly parallel ones are blended and renormalised."""
    signed = dot(q0, q1)
    flip = F.when(signed < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    q1 = tuple(x * flip for x in q1)
    cosine = F.least(signed * flip, F.lit(1.0))
    blend = unit_quaternion(tuple(x * (1.0 - t) + y * t for x, y in zip(q0, q1)))
    whole = F.acos(cosine)
    k1 = F.try_divide(F.sin(whole * t), F.sin(whole))
    k0 = F.cos(whole * t) - cosine * k1
    return tuple(F.when(cosine > 0.9995, n).otherwise(x * k0 + y * k1) for n, x, y in zip(blend, q0, q1))


def rotate(q: tuple, v: Vec) -> Vec:
    u, s = q[:3], q[3]
    return add(add(scale(u, dot(u, v) * 2.0), scale(v, s * s - dot(u, u))), scale(cross(u, v), s * 2.0))


def rotation_angle(q0: tuple, q1: tuple) -> Column:
    return F.acos(F.least(F.abs(dot(q0, q1)), F.lit(1.0))) * 2.0


def box_volume(low: Vec, high: Vec) -> Column:
    x, y, z = (F.greatest(h - m, F.lit(0.0)) for m, h in zip(low, high))
    return x * y * z


def capsule_volume(length: Column, radius: Column) -> Column:
    return radius * radius * length * 3.141592653589793 + radius * radius * radius * (4.0 / 3.0 * 3.141592653589793)


def capsule_cost(length: Column, radius: Column) -> Column:
    return F.least(length / F.greatest(radius, F.lit(1.0e-9)), F.lit(20.0)) * 0.05 + 1.25


def elastic_impact(normal: Vec, va: Vec, vb: Vec, mass_a: Column, mass_b: Column, restitution: float, collided: Column) -> tuple[Vec, Vec]:
    """Velocities after an impact along ``normal`` (from a to b); unchanged if not closing."""
    closing = dot(sub(va, vb), normal)
    impulse = F.when(collided & (closing > 0), -(closing * (1.0 + restitution)) / (1.0 / mass_a + 1.0 / mass_b)).otherwise(F.lit(0.0))
    return add(va, scale(normal, impulse / mass_a)), sub(vb, scale(normal, impulse / mass_b))


def sphere_mass(radius: Column, density: float = 1.0) -> Column:
    r = F.greatest(radius, F.lit(1.0e-6))
    return F.greatest(r * r * r * (density * 4.0 / 3.0 * 3.141592653589793), F.lit(1.0e-6))
