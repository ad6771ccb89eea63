"""Feature rows of candidates for scoring: 32 numbers per row, as one array column.

Every projection names its quantities and says which stands in which slot, so
a slot is one entry of a tuple and all of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangency.functions import geometry as g
from tangency.sources.views import checkpointed

WIDTH = 32

# The quantity in each slot of the scene projection.
SCENE = (
    "t0 t1 width hit_count type_a type_b bound_0 bound_1 bound_2 bound_3"
    " a_extent_x a_extent_y a_extent_z b_extent_x b_extent_y b_extent_z a_volume b_volume overlap iou center_distance a_surface b_surface"
    " a_radius b_radius a_shift b_shift a_turn b_turn candidates_per_proxy overlap_ratio hits_per_candidate"
).split()
# Slots of the runtime projection; the others are zero.
RUNTIME = {
    1: "one", 2: "one", 3: "hit_count", 4: "type_a", 5: "type_b", 6: "bound_0", 7: "bound_1", 8: "bound_2", 9: "bound_3",
    19: "capped_overlap_ratio", 29: "candidates_per_proxy", 30: "overlap_ratio", 31: "hits_per_candidate",
}
# The quantity in each slot of the projection of sphere pairs with a known outcome.
OUTCOME = (
    "zero one one level type_a type_b a_speed b_speed radii hardness a_width a_width a_width b_width b_width b_width a_volume b_volume depth depth_share min_distance"
    " a_surface b_surface a_r b_r a_speed b_speed zero zero hardness near level"
).split()
# The quantity in each slot of the projection of primitive queries.
PRIMITIVE = (
    "is_vf is_ee scale denominator_bits numerator_bits extent_x extent_y extent_z diagonal volume_log mean_motion top_speed mean_speed relative_motion"
    " gap_0 gap_1 least_gap first_0 second_0 area_0 first_1 second_1 area_1 degeneracy proximity_0 proximity_1 least_speed overlap_0 overlap_1 case_hash handcrafted one"
).split()


def as_array(rows: DataFrame, slots: list[str] | dict[int, str], values: dict[str, Column]) -> DataFrame:
    """Adds ``features``; what is missing, infinite or not a number is 0 and what is huge is clamped."""
    names = slots if isinstance(slots, list) else [slots.get(i, "zero") for i in range(WIDTH)]
    known = {"zero": F.lit(0.0), "one": F.lit(1.0)} | values
    return rows.withColumn("features", F.array(*[g.finite(known[n].cast("double")) if n in known else g.finite(F.col(n).cast("double")) for n in names]))


def _bounds() -> dict[str, Column]:
    return {f"bound_{i}": F.col("motion_bound")[i] for i in range(4)}


def first_proxies(proxies: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per key the proxy of least ``number``: what a candidate's side is looked up in."""
    rest = [c for c in proxies.columns if c not in keys]
    return proxies.groupBy(*keys).agg(F.min_by(F.struct(*rest), number).alias("p")).select(*keys, "p.*")


#: A query of more proxies than this is not held in one row.
MOST_PROXIES = 4096


def with_proxies(candidates: DataFrame, proxies: DataFrame, number: str = "proxy_id", most: int = MOST_PROXIES) -> DataFrame:
    """Candidates with the first proxy of either side, as columns a_* and b_*.

    ``proxies`` has query_id, slab_id, object, patch, type and further columns;
    a candidate without one on a side is an error of its producer and drops out.
    The first proxies of a query are one map, in which a candidate looks up
    both, so that candidates are dealt out by query alone; a query of more than
    ``most`` proxies is joined by all keys instead.
    """
    big = proxies.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("query_id")
    if big.isEmpty():
        return _looked_up(candidates, proxies, number)
    big = checkpointed(big)
    split = lambda df, how: df.join(big, "query_id", how)
    large = _joined_proxies(split(candidates, "left_semi"), split(proxies, "left_semi"), number)
    return _looked_up(split(candidates, "left_anti"), split(proxies, "left_anti"), number).unionByName(large)


_PLACE = ("slab_id", "object", "patch", "type")


def _looked_up(candidates: DataFrame, proxies: DataFrame, number: str) -> DataFrame:
    known = F.lit(True)
    for c in _PLACE:
        known = known & F.col(c).isNotNull()
    own = first_proxies(proxies.where(known & F.col("query_id").isNotNull()), ["query_id", *_PLACE], number)
    rest = [c for c in own.columns if c not in ("query_id", *_PLACE)]
    entry = F.struct(F.struct(*[F.col(c).cast("long").alias(c) for c in _PLACE]).alias("key"), F.struct(*rest).alias("value"))
    maps = own.groupBy("query_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_own"))
    out = candidates.join(maps, "query_id")
    for s in "ab":
        place = ["slab_id", *[f"{c}_{s}" for c in _PLACE[1:]]]
        key = F.struct(*[F.col(c).cast("long").alias(k) for k, c in zip(_PLACE, place)])
        out = out.withColumn(f"_{s}", F.try_element_at("_own", key))
    out = out.where("_a is not null and _b is not null")
    return out.select(*candidates.columns, *[F.col(f"_{s}")[c].alias(f"{s}_{c}") for s in "ab" for c in rest])


def _joined_proxies(candidates: DataFrame, proxies: DataFrame, number: str) -> DataFrame:
    own = first_proxies(proxies, ["query_id", *_PLACE], number)
    rest = [c for c in own.columns if c not in ("query_id", *_PLACE)]
    out = candidates
    for s in "ab":
        side = own.select("query_id", "slab_id", *[F.col(k).alias(f"{k}_{s}") for k in _PLACE[1:]], *[F.col(c).alias(f"{s}_{c}") for c in rest])
        out = out.join(side, ["query_id", "slab_id", *[f"{k}_{s}" for k in _PLACE[1:]]])
    return out.select(*candidates.columns, *[f"{s}_{c}" for s in "ab" for c in rest])


def scene_features(rows: DataFrame) -> DataFrame:
    """Features and training targets of candidates with both proxies (a_*, b_*) and their query's density."""
    low = {s: g.vec(*[f"{s}_min_{k}" for k in "xyz"]) for s in "ab"}
    high = {s: g.vec(*[f"{s}_max_{k}" for k in "xyz"]) for s in "ab"}
    values = _bounds() | {"t0": F.col("a_t0"), "t1": F.col("a_t1"), "width": F.greatest(F.col("a_t1") - F.col("a_t0"), F.lit(0.0))}
    for s in "ab":
        spans = g.sub(high[s], low[s])
        values |= {f"{s}_extent_{k}": v for k, v in zip("xyz", spans)}
        values[f"{s}_volume"] = g.box_volume(low[s], high[s])
        values[f"{s}_surface"] = (spans[0] * spans[1] + spans[1] * spans[2] + spans[2] * spans[0]) * 2.0
    shared = g.box_volume(tuple(F.greatest(x, y) for x, y in zip(low["a"], low["b"])), tuple(F.least(x, y) for x, y in zip(high["a"], high["b"])))
    every = values["a_volume"] + values["b_volume"] - shared
    values |= {"overlap": shared, "iou": F.when(every > 0, shared / every).otherwise(F.lit(0.0))}
    middle = {s: g.scale(g.add(low[s], high[s]), 0.5) for s in "ab"}
    values["center_distance"] = g.norm(g.sub(middle["a"], middle["b"]))
    out = as_array(rows, SCENE, values)
    return out.withColumns(
        {
            "interval_target": g.interval_bin(F.col("a_t0"), F.col("a_t1")),
            "priority_target": g.finite(F.col("hit_count") * 0.5 + F.col("candidates_per_proxy") * 0.5),
            "cost_target": g.finite(F.col("motion_bound")[3] + 1.0),
            "uncertainty_target": 1.0 - F.least(F.lit(1.0), F.col("features")[19]),
        }
    )


def runtime_features(rows: DataFrame, family_mask: Column, conservative: int = 3) -> DataFrame:
    """Features and targets that are known at run time: the candidate and its query's density."""
    out = as_array(rows, RUNTIME, _bounds() | {"capped_overlap_ratio": F.least(F.lit(1.0), F.col("overlap_ratio"))})
    return out.withColumns(
        {
            "family_targets": F.array(*[(family_mask.bitwiseAND(1 << i) != 0).cast("double") for i in range(2)]),
            "priority_target": F.least(F.lit(1.0), F.col("hit_count") * 0.5 + F.col("candidates_per_proxy") * 0.5),
            "cost_target": F.greatest(F.lit(1.0), F.col("hit_count") + 1.0),
            "uncertainty_target": F.when(family_mask == conservative, F.lit(0.25)).otherwise(F.lit(0.0)),
        }
    )


def outcome_features(contacts: DataFrame) -> DataFrame:
    """Features and targets of sphere pairs with a known contact, hardness and out-of-range flag ``ood``."""
    radii = F.greatest(F.col("a_r") + F.col("b_r"), F.lit(1.0e-6))
    near = g.clamp(1.0 - F.greatest(F.col("safe_margin"), F.lit(0.0)) / radii, 0.0, 1.0)
    depth = F.greatest(F.col("a_r") + F.col("b_r") - F.col("min_distance"), F.lit(0.0))
    values = {"radii": F.col("a_r") + F.col("b_r"), "near": near, "depth": depth, "depth_share": g.clamp(depth / radii, 0.0, 1.0)}
    values["level"] = F.when(F.col("collided"), 2.0).when(near > 0.5, 1.0).otherwise(0.0)
    for s in "ab":
        r = F.col(f"{s}_r")
        values[f"{s}_speed"] = g.norm(g.sub(g.vec(*[f"{s}_{k}1" for k in "xyz"]), g.vec(*[f"{s}_{k}0" for k in "xyz"])))
        values |= {f"{s}_width": r * 2.0, f"{s}_volume": r * r * r * (4.0 / 3.0 * 3.141592653589793), f"{s}_surface": r * r * (4.0 * 3.141592653589793)}
    out = as_array(contacts, OUTCOME, values)
    when = F.when(F.col("collided"), F.col("toi")).otherwise(F.col("closest_time"))
    return out.withColumns(
        {
            "interval_target": F.floor(g.clamp(when, 0.0, 1.0 - 1.0e-12) * 8).cast("int"),
            "priority_target": g.clamp(near * 0.25 + F.col("collided").cast("double") * 0.55 + F.col("hardness") * 0.20, 0.0, 1.0),
            "uncertainty_target": F.when(F.col("ood"), F.lit(1.0)).otherwise(g.clamp(F.col("hardness") * 0.55 + near * 0.25 + 0.15, 0.0, 1.0)),
        }
    )


def _corner(i: int) -> g.Vec:
    return g.vec(*[f"v{3 * i + j}" for j in range(3)])


def _middle(points: list[g.Vec]) -> g.Vec:
    out = points[0]
    for p in points[1:]:
        out = g.add(out, p)
    return g.scale(out, 1.0 / len(points))


def primitive_features(queries: DataFrame) -> DataFrame:
    """Features of primitive queries (family, v0..v23) with columns denominator_bits, numerator_bits, case_hash and handcrafted."""
    vf = F.col("family") == "vf"
    either = lambda a, b: F.when(vf, a).otherwise(b)
    at = [[_corner(i) for i in range(4)], [_corner(i + 4) for i in range(4)]]
    every = at[0] + at[1]
    low = tuple(F.least(*[p[k] for p in every]) for k in range(3))
    high = tuple(F.greatest(*[p[k] for p in every]) for k in range(3))
    spans = g.sub(high, low)
    moves = [g.sub(b, a) for a, b in zip(*at)]
    speeds = [g.norm(m) for m in moves]
    values = {"is_vf": vf.cast("double"), "is_ee": (~vf).cast("double"), "scale": F.log1p(F.greatest(*[F.abs(c) for p in every for c in p]))}
    values |= {f"extent_{k}": v for k, v in zip("xyz", spans)} | {"diagonal": g.norm(spans)}
    values["volume_log"] = F.log1p((spans[0] + 1.0e-12) * (spans[1] + 1.0e-12) * (spans[2] + 1.0e-12))
    values |= {"mean_motion": g.norm(_middle(moves)), "top_speed": F.greatest(*speeds), "least_speed": F.least(*speeds), "mean_speed": (speeds[0] + speeds[1] + speeds[2] + speeds[3]) / 4.0}
    apart = [g.norm(g.sub(_middle(moves[:n]), _middle(moves[n:]))) for n in (1, 2)]
    values["relative_motion"] = either(*apart)
    for e, points in enumerate(at):
        gaps, nears, overlaps = [], [], []
        for n in (1, 2):
            sides = [points[:n], points[n:]]
            lows = [tuple(F.least(*[p[k] for p in s]) if len(s) > 1 else s[0][k] for k in range(3)) for s in sides]
            highs = [tuple(F.greatest(*[p[k] for p in s]) if len(s) > 1 else s[0][k] for k in range(3)) for s in sides]
            between = tuple(F.greatest(lows[0][k] - highs[1][k], lows[1][k] - highs[0][k], F.lit(0.0)) for k in range(3))
            gaps.append(g.norm(between))
            nears.append(F.least(*[g.norm(g.sub(p, q)) for p in sides[0] for q in sides[1]]))
            shared = [F.greatest(F.least(highs[0][k], highs[1][k]) - F.greatest(lows[0][k], lows[1][k]), F.lit(0.0)) for k in range(3)]
            room = [highs[0][k] - lows[0][k] + highs[1][k] - lows[1][k] + 1.0e-12 for k in range(3)]
            overlaps.append(g.clamp(shared[0] * shared[1] * shared[2] / F.greatest(room[0] * room[1] * room[2], F.lit(1.0e-12)), 0.0, 1.0))
        values |= {f"gap_{e}": either(*gaps), f"proximity_{e}": either(*nears), f"overlap_{e}": either(*overlaps)}
        length = lambda a, b: g.norm(g.sub(points[b], points[a]))  # noqa: E731, B023
        area = g.norm(g.cross(g.sub(points[2], points[1]), g.sub(points[3], points[1]))) * 0.5
        turn = g.norm(g.cross(g.sub(points[1], points[0]), g.sub(points[3], points[2])))
        first, second = either(length(1, 2), length(0, 1)), length(2, 3)
        thin = either(area, F.least(length(0, 1), second, turn))
        values |= {f"first_{e}": first, f"second_{e}": second, f"area_{e}": either(area, turn), f"thin_{e}": 1.0 / (thin * 1000.0 + 1.0)}
    values["least_gap"] = F.least(values["gap_0"], values["gap_1"])
    values["degeneracy"] = g.clamp(F.greatest(values["thin_0"], values["thin_1"]), 0.0, 1.0)
    return as_array(queries, PRIMITIVE, values)


def hard_negative(priority: Column, cost: Column, uncertainty: Column, features: str = "features") -> Column:
    """A row worth keeping as a negative: scored high, dear, unsure, or with some distance close to zero."""
    # The slots that hold distances.
    near = F.least(*[F.abs(F.col(features)[i]) for i in (14, 15, 16, 24, 25)])
    return (priority >= 0.30) | (uncertainty >= 0.35) | (cost >= 2.0) | (near < 1.0e-3)


def heuristic_scores(features: str = "features") -> dict[str, Column]:
    """Fixed orders that need no learning, by name."""
    f = F.col(features)
    energy = F.sqrt(F.aggregate(F.slice(f, 1, 16), F.lit(0.0), lambda a, x: a + x * x))
    # The slot that each order reads.
    return {"proximity": f[25], "small_gap": -f[11], "motion": f[8], "energy": energy, "low_extent": -f[5]}


def frontier_score(low_a: g.Vec, high_a: g.Vec, low_b: g.Vec, high_b: g.Vec, jitter: Column) -> Column:
    """A cheap order of box pairs: near centres, compact, alike in size, overlapping; ``jitter`` in [0, 1) parts ties."""
    sizes = [g.dot(s, s) for s in (g.sub(high_a, low_a), g.sub(high_b, low_b))]
    between = g.sub(g.scale(g.add(low_a, high_a), 0.5), g.scale(g.add(low_b, high_b), 0.5))
    gap, both = g.dot(between, between), sizes[0] + sizes[1]
    shared = g.box_volume(tuple(F.greatest(x, y) for x, y in zip(low_a, low_b)), tuple(F.least(x, y) for x, y in zip(high_a, high_b)))
    # The weights of the four signals and of the jitter.
    parts = ((1.75, 1.0 / (gap + 1.0)), (0.85, both / (both + gap + 1.0e-9)), (0.35, 1.0 / (F.abs(sizes[0] - sizes[1]) + 1.0)), (0.10, F.log1p(shared)), (1.0e-6, jitter))
    return sum((value * weight for weight, value in parts), F.lit(0.0))
