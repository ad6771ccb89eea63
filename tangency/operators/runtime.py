"""The exact run: queries to role boxes, candidates, work items, certificates and one row per query.

Ids are numbered within a query, so no step sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangency.functions import geometry as g
from tangency.functions.contracts import SOURCE, STATUS
from tangency.operators import slabs

#: Family bits: point against triangle, edge against edge.
POINT_TRIANGLE, EDGE_EDGE = 1, 2


def family_mask(family: Column) -> Column:
    return F.when(family == "vf", POINT_TRIANGLE).when(family == "ee", EDGE_EDGE).otherwise(POINT_TRIANGLE | EDGE_EDGE)


def has_family(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(bit) != 0


def scored_family_mask(scores: Column, threshold: float, always: int = 0) -> Column:
    """Bits of the families that score ``threshold`` or more, and those that are always tested."""
    bits = [F.when(scores[i] >= threshold, bit).otherwise(0) for i, bit in enumerate((POINT_TRIANGLE, EDGE_EDGE))]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(F.lit(always))


def role_boxes(queries: DataFrame) -> DataFrame:
    """Two boxes per primitive query (family, v0..v23), over start and end: its first primitive (role 0) and its second.

    vf: vertex 0 and triangle 1, 2, 3; ee: edges 0, 1 and 2, 3. box_id is 2 query_id + role.
    """
    def box(role: int, corners: tuple[int, ...]) -> Column:
        columns = [F.lit(role).alias("role")]
        for j, k in enumerate("xyz"):
            values = [F.col(f"v{3 * (i + e) + j}") for i in corners for e in (0, 4)]
            columns += [F.least(*values).alias(f"min_{k}"), F.greatest(*values).alias(f"max_{k}")]
        return F.struct(*columns)

    both = F.when(F.col("family") == "vf", F.array(box(0, (0,)), box(1, (1, 2, 3)))).otherwise(F.array(box(0, (0, 1)), box(1, (2, 3))))
    rows = queries.select("query_id", "family", F.explode(both).alias("b")).select("query_id", "family", "b.*")
    return rows.withColumn("box_id", F.col("query_id") * 2 + F.col("role"))


def role_pairs(boxes: DataFrame, same_query: bool = True) -> DataFrame:
    """Touching boxes of unlike roles and one family, of one query unless ``same_query`` is off; columns a_*, b_*.

    Across queries the family is the only equality key: give families that are scenes of bounded size.
    """
    keys = ["query_id", "family"] if same_query else ["family"]
    rest = [c for c in boxes.columns if c not in keys and c != "role"]
    a, b = (boxes.where(F.col("role") == r).select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in rest]) for r, s in ((0, "a"), (1, "b")))
    return a.join(b, keys).where(g.boxes_touch())


def work_items(candidates: DataFrame, source: str = "raw", mask: Column | None = None, priority: str = "hit_count", first: int = 1) -> DataFrame:
    """One work item per candidate, in candidate order within its query.

    The interval is the slab's (slab_t0, slab_t1) if the candidate has one,
    else [0, 1]. ``source`` tells who proposed it; with ``fallback`` nothing
    was learned and the order of candidates is kept.
    """
    has = "slab_t0" in candidates.columns
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("candidate_id")) + (first - 1)
    return candidates.withColumns(
        {
            "work_item_id": number.cast("long"),
            "t0": F.coalesce("slab_t0", F.lit(0.0)) if has else F.lit(0.0),
            "t1": F.coalesce("slab_t1", F.lit(1.0)) if has else F.lit(1.0),
            "family_mask": F.lit(POINT_TRIANGLE | EDGE_EDGE) if mask is None else mask,
            "depth": F.lit(0),
            "priority": F.col(priority).cast("float") if source != "fallback" else F.lit(0.0).cast("float"),
            "source": F.lit(SOURCE[source]).cast("short"),
        }
    )


def certificates(results: DataFrame, eps_time: float = 1.0e-4, eps_space: float = 1.0e-6) -> DataFrame:
    """Adds a certificate to work items with an exact result (status, toi_upper, margin).

    A collision's time stays within the item's interval; a separation keeps its
    margin and covers the item's families; anything else is to be refined.
    """
    hit, free = F.col("status") == STATUS["collision"], F.col("status") == STATUS["separation"]
    bit = F.when(has_family(F.col("family_mask"), POINT_TRIANGLE), POINT_TRIANGLE).otherwise(EDGE_EDGE)
    return results.withColumns(
        {
            "toi_upper": F.when(hit, F.least(F.col("t1"), F.greatest(F.col("t0"), F.col("toi_upper")))).otherwise(F.col("t1")),
            "safe_margin": F.when(free, F.greatest(F.col("margin"), F.lit(0.0))).otherwise(F.lit(0.0)),
            "witness_family": F.when(hit, bit).otherwise(0),
            "covered_mask": F.when(free, F.col("family_mask")).otherwise(0),
            "refine": ~hit & ~free,
            "eps_time": F.lit(eps_time),
            "eps_space": F.lit(eps_space),
        }
    )


def sphere_results(items: DataFrame) -> DataFrame:
    """Adds status, toi_upper and margin to work items with the spheres a_* and b_* (x0 to z1, r): their contact within the item's own interval."""
    # Columns of their own, so that the contact's many uses of them do not repeat the arithmetic.
    at = lambda s, k, t: F.col(f"{s}_{k}0") + (F.col(f"{s}_{k}1") - F.col(f"{s}_{k}0")) * F.col(t)
    items = items.withColumns({f"_{s}{k}{i}": at(s, k, t) for s in "ab" for k in "xyz" for i, t in enumerate(("t0", "t1"))})
    ends = tuple(tuple(F.col(f"_{s}{k}{i}") for k in "xyz") for s in "ab" for i in (0, 1))
    met = g.swept_spheres(*ends, F.col("a_r") + F.col("b_r"))
    rows = items.withColumn("_met", F.struct(met["collided"].alias("c"), met["toi"].alias("t"), met["safe_margin"].alias("m")))
    status = F.when(F.col("_met.c"), STATUS["collision"]).otherwise(STATUS["separation"])
    return rows.withColumns({"status": status, "toi_upper": F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("_met.t"), "margin": F.col("_met.m")}).drop("_met", *[f"_{s}{k}{i}" for s in "ab" for k in "xyz" for i in (0, 1)])


def query_outcomes(certified: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per query (``keys``) from its certificates: predicted, toi_upper, margin, items and calls.

    Items of a query are worked on in ``order`` until one collides; those
    after it are not called. A query's items are aggregated, never sorted: the
    first collision goes back to them by a join.
    """
    hit = F.col("status") == STATUS["collision"]
    first = certified.groupBy(*keys).agg(F.min(F.when(hit, F.col(order))).alias("_first"))
    rows = certified.join(first, keys)
    called = F.col("_first").isNull() | (F.col(order) <= F.col("_first"))
    out = rows.groupBy(*keys).agg(
        F.max(hit).alias("predicted"), F.min(F.when(hit, F.col("toi_upper"))).alias("toi_upper"), F.min(F.when(called, F.col("safe_margin"))).alias("margin"),
        F.count("*").alias("items"), F.count_if(called).alias("calls"),
    )
    return out.withColumns({"toi_upper": F.coalesce("toi_upper", F.lit(1.0)), "margin": F.when(F.col("predicted"), F.lit(0.0)).otherwise(F.col("margin"))})


def pair_outcomes(pairs: DataFrame, keys: list[str], count: int = 4) -> DataFrame:
    """One row per pair of spheres (``keys``; a_*, b_*: x0 to z1, r): truth, predicted, toi_upper, items and calls.

    A pair is one work item for each of ``count`` slabs in which its boxes
    touch, worked on from the earliest until one collides; truth is its contact
    over the whole motion. All of that is rows of one pair that are made from
    it and added up again, with slabs as bits, so that pairs which are dealt
    out by a part of their keys stay where they are. toi_upper is null without
    a collision.
    """
    if count > 62:
        raise ValueError("slabs are bits of one number")
    step, slab, whole = 1.0 / count, F.col("_slab"), F.col("_slab") < 0
    rows = pairs.withColumn("_slab", F.explode(F.sequence(F.lit(-1), F.lit(count - 1))))
    rows = rows.withColumns({"_t0": F.when(whole, 0.0).otherwise(slab * step), "_t1": F.when(whole | (slab == count - 1), 1.0).otherwise((slab + 1) * step)})
    ends = {(s, k, e): F.when(whole, F.col(f"{s}_{k}{e}")).otherwise(slabs.pair_position(s, k, f"_t{e}")) for s in "ab" for k in "xyz" for e in (0, 1)}
    rows = rows.withColumns({f"_{s}{k}{e}": v for (s, k, e), v in ends.items()})
    at = lambda s, k, e: F.col(f"_{s}{k}{e}")
    rows = rows.where(whole | slabs.pair_boxes_touch(at, 0, 1))
    met = g.swept_spheres(*[tuple(at(s, k, e) for k in "xyz") for s in "ab" for e in (0, 1)], F.col("a_r") + F.col("b_r"))
    rows = rows.select(*keys, "_slab", "_t0", "_t1", F.struct(met["collided"].alias("hit"), met["toi"].alias("toi")).alias("_met"))
    hit, toi = F.col("_met.hit") & ~whole, F.col("_t0") + F.col("_met.toi") * (F.col("_t1") - F.col("_t0"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slab)
    out = rows.groupBy(*keys).agg(
        F.max(F.when(whole, F.col("_met.hit"))).alias("truth"), F.coalesce(F.sum(F.when(~whole, bit)), F.lit(0)).alias("_items"), F.coalesce(F.sum(F.when(hit, bit)), F.lit(0)).alias("_hits"),
        F.min(F.when(hit, F.least(F.greatest(toi, F.col("_t0")), F.col("_t1")))).alias("toi_upper"),
    )
    # The lowest bit of the hits and those under it.
    called = F.col("_hits").bitwiseAND(-F.col("_hits")) * 2 - 1
    calls = F.when(F.col("_hits") == 0, F.col("_items")).otherwise(F.col("_items").bitwiseAND(called))
    return out.withColumns({"predicted": F.col("_hits") > 0, "items": F.bit_count("_items").cast("long"), "calls": F.bit_count(calls).cast("long")}).drop("_items", "_hits")


def with_culled(queries: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every query with its certificate; one without a candidate is separate over its whole interval and was not evaluated."""
    rest = [c for c in found.columns if c not in keys]
    rows = queries.join(found.select(*keys, *rest, F.lit(True).alias("evaluated")), keys, "left")
    return rows.withColumns({"evaluated": F.coalesce("evaluated", F.lit(False)), "status": F.coalesce("status", F.lit(STATUS["separation"]))})


def runtime_ids(queries: DataFrame, index: str = "query_index") -> DataFrame:
    """Adds runtime_id: the positive query_id itself, else its place plus one; clashes are an error of the ids."""
    return queries.withColumn("runtime_id", F.when(F.col("query_id") > 0, F.col("query_id")).otherwise(F.col(index) + 1))


def candidate_number(runtime_id: Column, ordinal: Column) -> Column:
    # Fixed value: the stride between the candidates of one query and those of the next.
    return runtime_id * 1_000_003 + ordinal + 1


def not_adjacent(vertex_faces: DataFrame) -> DataFrame:
    """Pairs of a vertex and a face (v0, v1, v2) of which the vertex is no corner."""
    return vertex_faces.where(~F.col("vertex").isin(F.col("v0"), F.col("v1"), F.col("v2")))


def no_shared_vertex(edge_pairs: DataFrame) -> DataFrame:
    """Pairs of edges (a_a, a_b) and (b_a, b_b) that have no vertex in common."""
    return edge_pairs.where(~F.col("a_a").isin(F.col("b_a"), F.col("b_b")) & ~F.col("a_b").isin(F.col("b_a"), F.col("b_b")))


def selected(rows: DataFrame, threshold: float, weight: float) -> DataFrame:
    """Rows whose priority plus ``weight`` times uncertainty reaches ``threshold``."""
    return rows.where(F.col("priority") + F.col("uncertainty") * weight >= threshold)


def feasible(recall: Column, misses: Column, false_alarms: Column, least: float = 1.0) -> Column:
    return (misses == 0) & (false_alarms == 0) & (recall + 1.0e-12 >= least)


def negatives_kept(collides: Column, key: Column, stride: int) -> Column:
    """All positives and, by a hash of the key, one negative in ``stride``; none if it is 0."""
    return collides | ((F.lit(stride) > 0) & (F.pmod(F.xxhash64(key), F.lit(max(1, stride))) == 0))


def scene_run(pairs: DataFrame, slabs: int = 4) -> DataFrame:
    """One row per pair of bodies of a scene: predicted, toi_upper, margin, items, calls and evaluated.

    ``pairs`` (file, a_*, b_*: body_id, x0 to z1, r) are the bodies to test,
    as ``rigid.scene_pairs`` gives them. A pair is one work item for each of
    ``slabs`` time slabs in which the swept boxes touch, worked on from the
    earliest until it collides; without one it is separate and not evaluated.
    Times are shares of the scene's own.
    """
    keys = ["file", "a_body_id", "b_body_id"]
    rows = pairs.withColumn("slab_id", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    rows = rows.withColumns({"slab_t0": F.col("slab_id") / float(slabs), "slab_t1": F.when(F.col("slab_id") == slabs - 1, F.lit(1.0)).otherwise((F.col("slab_id") + 1) / float(slabs))})
    boxes = {}
    for s in "ab":
        for k in "xyz":
            ends = [F.col(f"{s}_{k}0") + (F.col(f"{s}_{k}1") - F.col(f"{s}_{k}0")) * F.col(t) for t in ("slab_t0", "slab_t1")]
            boxes |= {f"{s}_min_{k}": F.least(*ends) - F.col(f"{s}_r"), f"{s}_max_{k}": F.greatest(*ends) + F.col(f"{s}_r")}
    found = rows.withColumns(boxes).where(g.boxes_touch()).drop(*boxes)
    found = found.withColumns({"query_id": F.col("file"), "candidate_id": (F.col("a_body_id") * 1_000_003 + F.col("b_body_id")) * slabs + F.col("slab_id"), "urgency": -F.col("slab_t0")})
    items = work_items(found, "raw", F.lit(POINT_TRIANGLE), "urgency")
    done = query_outcomes(certificates(sphere_results(items)), keys, "slab_id")
    out = pairs.select(*keys).join(done, keys, "left").withColumn("evaluated", F.col("items").isNotNull())
    none = {"predicted": F.lit(False), "toi_upper": F.lit(1.0), "margin": F.lit(0.0), "items": F.lit(0).cast("long"), "calls": F.lit(0).cast("long")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
