"""Pairs of moving boxes that may meet: range joins with an equality key.

Within a query the key is the query (and slab). Across a whole scene boxes
are written to the cells of a grid that they cover, pairs are found within a
cell, and a pair counts only in the first cell that both cover, so no
distinct is needed. Neither needs a nested loop over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangency.functions import geometry as g
from tangency.sources.views import checkpointed


def _side(boxes: DataFrame, side: str, keys: tuple[str, ...]) -> DataFrame:
    return boxes.select(*[F.col(c) if c in keys else F.col(c).alias(f"{side}_{c}") for c in boxes.columns])


#: A key of more boxes than this is not joined with itself but cut into grid cells.
MOST_BOXES = 4096


def query_pairs(boxes: DataFrame, keys: tuple[str, ...] = ("query_id",), number: str = "body_id", most: int = MOST_BOXES, counted: DataFrame | None = None) -> DataFrame:
    """Pairs a < b by ``number`` with equal ``keys`` whose boxes touch; columns a_*, b_*.

    Boxes of a key are joined by it and tested; a key of more than ``most``
    boxes goes through ``grid_pairs``, in cells twice as wide as such boxes are
    on average. Both give all pairs. Rows of a null key meet none. ``counted``
    may give rows with some of the ``keys`` that are no fewer than a key's
    boxes, such as what was cut into slabs; they are then counted first.
    """
    if counted is not None:
        own = [k for k in keys if k in counted.columns]
        if counted.groupBy(*own).agg(F.count("*").alias("_n")).where(F.col("_n") > most).isEmpty():
            return _joined(boxes, keys, number)
    big = boxes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)
    if big.isEmpty():
        return _joined(boxes, keys, number)
    big = checkpointed(big)
    large = boxes.join(big, list(keys), "left_semi")
    extent = F.greatest(*[F.col(f"max_{k}") - F.col(f"min_{k}") for k in "xyz"])
    cell = 2.0 * (large.agg(F.avg(extent)).first()[0] or 0.0) or 1.0
    small = _joined(boxes.join(big, list(keys), "left_anti"), keys, number)
    return small.unionByName(grid_pairs(large, cell, number, keys=keys))


def _joined(boxes: DataFrame, keys: tuple[str, ...], number: str) -> DataFrame:
    a, b = _side(boxes, "a", keys), _side(boxes, "b", keys)
    return a.join(b, list(keys)).where((F.col(f"a_{number}") < F.col(f"b_{number}")) & g.boxes_touch())


def all_pairs(rows: DataFrame, keys: tuple[str, ...] = ("query_id",), number: str = "body_id", most: int = MOST_BOXES, blocks: int = 64) -> DataFrame:
    """All pairs a < b by ``number`` with equal ``keys``, without a test; columns a_*, b_*.

    The pairs of a key are as many as the square of its rows; a key of more
    than ``most`` rows is dealt out in ``blocks`` of one side, to each of which
    the other side comes whole, so that no task makes all of them.
    """
    def met(df: DataFrame) -> DataFrame:
        return _side(df, "a", keys).join(_side(df, "b", keys), list(keys)).where(F.col(f"a_{number}") < F.col(f"b_{number}"))

    big = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)
    if big.isEmpty():
        return met(rows)
    big = checkpointed(big)
    large = rows.join(big, list(keys), "left_semi")
    a = _side(large, "a", keys).withColumn("_block", F.pmod(F.xxhash64(f"a_{number}"), F.lit(blocks)))
    b = _side(large, "b", keys).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = a.join(b, [*keys, "_block"]).where(F.col(f"a_{number}") < F.col(f"b_{number}")).drop("_block")
    return met(rows.join(big, list(keys), "left_anti")).unionByName(dealt)


def bipartite_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Touching pairs of one row of ``left`` (a_*) and one of ``right`` (b_*) with equal keys."""
    return _side(left, "a", keys).join(_side(right, "b", keys), list(keys)).where(g.boxes_touch())


def _levelled(boxes: DataFrame, cell: float, axes: str) -> DataFrame:
    """Adds _own: how often ``cell`` is doubled until a cell is as wide as the box."""
    extent = F.greatest(*[F.col(f"max_{k}") - F.col(f"min_{k}") for k in axes]) if len(axes) > 1 else F.col(f"max_{axes}") - F.col(f"min_{axes}")
    return boxes.withColumn("_own", F.when(extent > cell, F.ceil(F.log2(extent / cell))).otherwise(0).cast("int"))


def _cells(boxes: DataFrame, level: Column, cell: float, axes: str) -> DataFrame:
    """Boxes at the cells of ``level`` that they cover; at a box's own level or above, at most two along an axis."""
    boxes = boxes.withColumn("_level", level)
    for k in axes:
        low, high = (F.floor(F.col(f"{end}_{k}") / _width(cell)) for end in ("min", "max"))
        boxes = boxes.withColumn(f"cell_{k}", F.explode(F.sequence(low, high)))
    return boxes


def _width(cell: float) -> Column:
    return F.pow(F.lit(2.0), F.col("_level")) * cell


def _grid(large: DataFrame, small: DataFrame, cell: float, keys: tuple[str, ...], axes: str, above: int, few: str | None = None) -> DataFrame:
    """Touching pairs of a box (a_*) and one (b_*) whose level is lower by ``above`` or more, each in the first cell of the larger one's level that both cover.

    Sizes differ by levels, so a large box is in few cells however small the
    others are, and a small one looks into a few cells of each level over it.
    The rows of side ``few``, "a" or "b", are sent to all tasks.
    """
    top = large.agg(F.max("_own")).first()[0]
    if top is None:
        top = 0
    on = [*keys, "_level", *[f"cell_{k}" for k in axes]]
    a = _cells(large, F.col("_own"), cell, axes)
    b = _cells(small, F.explode(F.sequence(F.col("_own") + above, F.greatest(F.col("_own") + above, F.lit(top)))), cell, axes)
    first = F.lit(True)
    for k in axes:
        first = first & (F.floor(F.greatest(f"a_min_{k}", f"b_min_{k}") / _width(cell)) == F.col(f"cell_{k}"))
    sides = {"a": _side(a, "a", tuple(on)), "b": _side(b, "b", tuple(on))}
    if few is not None:
        sides[few] = F.broadcast(sides[few])
    met = sides["a"].join(sides["b"], on).where(g.boxes_touch(axes=axes) & first)
    return met.drop("_level", *[f"cell_{k}" for k in axes])


def _in_order(pairs: DataFrame, number: str) -> DataFrame:
    """Pairs with the lower number as a_*."""
    swap = F.col(f"a_{number}") > F.col(f"b_{number}")
    rest = [c[2:] for c in pairs.columns if c.startswith("a_")]
    keys = [c for c in pairs.columns if c not in {f"{s}_{c}" for s in "ab" for c in rest}]
    out = [F.when(swap, F.col(f"{t}_{c}")).otherwise(F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s, t in (("a", "b"), ("b", "a")) for c in rest]
    return pairs.select(*keys, *out)


def grid_pairs(boxes: DataFrame, cell: float, number: str = "body_id", axes: str = "xyz", keys: tuple[str, ...] = ()) -> DataFrame:
    """All touching pairs a < b of a scene, each once, by grids of ``cell`` wide cells and doubles of that for larger boxes.

    A crowded cell is a skewed key of an ordinary equality join, which
    adaptive execution splits; smaller cells thin it out.
    """
    rows = _levelled(boxes, cell, axes)
    met = _grid(rows, rows, cell, keys, axes, 0)
    met = met.where((F.col("a__own") > F.col("b__own")) | (F.col(f"a_{number}") < F.col(f"b_{number}"))).drop("a__own", "b__own")
    return _in_order(met, number)


def grid_bipartite(left: DataFrame, right: DataFrame, cell: float, keys: tuple[str, ...] = (), axes: str = "xyz", few: bool = False) -> DataFrame:
    """All touching pairs of one row of ``left`` (a_*) and one of ``right`` (b_*) with equal keys, each once, by such grids; a ``left`` of few rows is sent to all tasks."""
    one, two = _levelled(left, cell, axes), _levelled(right, cell, axes)
    met = _grid(one, two, cell, keys, axes, 0, "a" if few else None).drop("a__own", "b__own")
    other = _grid(two, one, cell, keys, axes, 1, "b" if few else None).drop("a__own", "b__own")
    turned = other.select(*[F.col(c).alias(("b" if c[0] == "a" else "a") + c[1:]) if c[:2] in ("a_", "b_") and c not in keys else F.col(c) for c in other.columns])
    return met.unionByName(turned)


def envelopes(boxes: DataFrame, keys: tuple[str, ...] = ("query_id", "object_id")) -> DataFrame:
    """One box around all boxes of a key, and how many they are."""
    ends = [f(f"{e}_{k}").alias(f"{e}_{k}") for e, f in (("min", F.min), ("max", F.max)) for k in "xyz"]
    return boxes.groupBy(*keys).agg(F.count("*").alias("parts"), *ends)


def radius_pairs(points: DataFrame, radius: float, number: str = "body_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of points (x, y, z) at ``radius`` or less, each in the first cell that both reach.

    A point is written to the cells that it reaches with half the radius, of
    cells three radii wide two or three; both sides are these same rows, dealt
    out once. They are never sent whole to every task, for which their size
    would be guessed from the table before it is copied. Points with a null, a
    NaN or an infinity are near nothing.
    """
    width = 3.0 * radius
    # A hair more than half the radius, so that rounding loses no pair.
    reach = lambda c: F.abs(c) * 1.0e-15 + radius * (0.5 + 1.0e-9)
    rows = points
    for k in "xyz":
        rows = rows.where(F.abs(k) < F.lit(float("inf")))
    for k in "xyz":
        at = F.col(k)
        rows = rows.withColumn(f"cell_{k}", F.explode(F.sequence(F.floor((at - reach(at)) / width), F.floor((at + reach(at)) / width))))
    on = [*keys, *[f"cell_{k}" for k in "xyz"]]
    a, b = _side(rows, "a", tuple(on)), _side(rows, "b", tuple(on))
    gap = g.sub(g.vec("a_x", "a_y", "a_z"), g.vec("b_x", "b_y", "b_z"))
    near = (F.col(f"a_{number}") < F.col(f"b_{number}")) & (g.dot(gap, gap) <= radius * radius)
    for k in "xyz":
        begins = [F.col(f"{s}_{k}") - reach(F.col(f"{s}_{k}")) for s in "ab"]
        near = near & (F.floor(F.greatest(*begins) / width) == F.col(f"cell_{k}"))
    return a.hint("merge").join(b, on).where(near).drop(*[f"cell_{k}" for k in "xyz"])


def axis_tests(boxes: DataFrame, keys: tuple[str, ...] = ("query_id",), number: str = "body_id", axis: str = "x") -> DataFrame:
    """Per key the number of pairs that overlap on one axis, which is what a sweep along it has to test."""
    a, b = _side(boxes, "a", keys), _side(boxes, "b", keys)
    met = (F.col(f"a_{number}") < F.col(f"b_{number}")) & g.boxes_touch(axes=axis)
    return a.join(b, list(keys)).where(met).groupBy(*keys).agg(F.count("*").alias("tests"))


def rigid_pairs(bodies: DataFrame, keys: tuple[str, ...], number: str = "body_id", fixed: str = "fixed") -> DataFrame:
    """Combinations a < b of the bodies of a scene, without pairs of two fixed ones."""
    a, b = _side(bodies, "a", keys), _side(bodies, "b", keys)
    return a.join(b, list(keys)).where((F.col(f"a_{number}") < F.col(f"b_{number}")) & ~(F.col(f"a_{fixed}") & F.col(f"b_{fixed}")))


def sorted_pairs(boxes: DataFrame, width: float, number: str = "body_id", keys: tuple[str, ...] = ("query_id",), axis: str = "x") -> DataFrame:
    """Touching pairs of a key, found along one axis as a sort and forward scan finds them.

    The axis is cut into strips of ``width``; the box that begins later is
    looked up in the strips of the other, so a scan reads only boxes that begin
    within it, and strips are tasks of their own. No box meets itself.
    """
    low, high = f"min_{axis}", f"max_{axis}"
    strip = lambda c: F.floor(F.col(c) / width)
    begins = boxes.withColumn("strip", strip(low))
    spans = boxes.withColumn("strip", F.explode(F.sequence(strip(low), strip(high))))
    a, b = _side(spans, "a", (*keys, "strip")), _side(begins, "b", (*keys, "strip"))
    later = (F.col(f"b_{low}") > F.col(f"a_{low}")) | ((F.col(f"b_{low}") == F.col(f"a_{low}")) & (F.col(f"b_{number}") > F.col(f"a_{number}")))
    met = a.join(b, [*keys, "strip"]).where(later & g.boxes_touch()).drop("strip")
    return _in_order(met, number)
