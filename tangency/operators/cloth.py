"""Self-collision of a mesh that moves from frame to frame: certificates per segment of two frames.

Frames share their triangles; a segment is one frame's vertices on their way
to the next one's. Vertices against faces and edges against edges that have no
vertex in common are tested where their swept boxes touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.operators.broadphase import grid_bipartite, grid_pairs
from tangency.operators.certificate import SEPARATION, Limits, certificates, reduce_primitives
from tangency.operators.mesh import unique_edges


def frame_segments(vertices: DataFrame) -> DataFrame:
    """(scene, vertex_id, p, q): every vertex (mesh, vertex_id, x, y, z) at the start and end of each pair of frames.

    Frames are meshes in the order of their names; scene numbers the pairs
    from 1. A vertex that one of the two frames lacks is not in the pair.
    """
    frames = vertices.select("mesh").distinct().withColumn("scene", F.row_number().over(Window.orderBy("mesh")))
    at = vertices.join(frames, "mesh").select("scene", "vertex_id", F.array("x", "y", "z").alias("p"))
    after = at.select((F.col("scene") - 1).alias("scene"), "vertex_id", F.col("p").alias("q"))
    return at.join(after, ["scene", "vertex_id"])


def _shape(segments: DataFrame, rows: DataFrame, corners: list[str], margin: float) -> DataFrame:
    """``rows`` of vertex numbers in every segment, with start, end (coordinates) and swept boxes."""
    out = rows
    for i, c in enumerate(corners):
        at = segments.select(*(["scene"] if i else [F.col("scene")]), F.col("vertex_id").alias(c), F.col("p").alias(f"_p{i}"), F.col("q").alias(f"_q{i}"))
        out = out.join(at, ["scene", c] if i else [c])
    ends = {name: F.concat(*[F.col(f"_{e}{i}") for i in range(len(corners))]) for e, name in (("p", "start"), ("q", "end"))}
    for k, axis in enumerate("xyz"):
        values = [F.col(f"_{e}{i}")[k] for e in "pq" for i in range(len(corners))]
        ends |= {f"min_{axis}": F.least(*values) - margin, f"max_{axis}": F.greatest(*values) + margin}
    return out.withColumns(ends).drop(*[f"_{e}{i}" for e in "pq" for i in range(len(corners))])


def self_queries(segments: DataFrame, triangles: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """Primitive queries (scene, family, a_number, b_number, v0..v23) of a mesh against itself.

    ``triangles`` (mesh, tri_id, v0, v1, v2) of one frame are those of all. A
    pair is given once: vertex and face, or two edges, the lower first.
    Degenerate triangles are tested as they are.
    """
    faces = triangles.select(F.col("tri_id").alias("number"), "v0", "v1", "v2")
    edges = unique_edges(triangles).select("a", "b").distinct().select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("number"), "a", "b")
    points = _shape(segments, triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("number")).distinct(), ["number"], margin)
    points = points.select("scene", "number", "start", "end", *[f"{e}_{k}" for e in ("min", "max") for k in "xyz"])
    met = grid_bipartite(points, _shape(segments, faces, ["v0", "v1", "v2"], margin), cell, ("scene",))
    apart = ~F.col("a_number").isin(F.col("b_v0"), F.col("b_v1"), F.col("b_v2"))
    vf = met.where(apart).select("scene", F.lit("vf").alias("family"), "a_number", "b_number", F.concat("a_start", "b_start", "a_end", "b_end").alias("v"))
    met = grid_pairs(_shape(segments, edges, ["a", "b"], margin), cell, "number", keys=("scene",))
    apart = ~F.col("a_a").isin(F.col("b_a"), F.col("b_b")) & ~F.col("a_b").isin(F.col("b_a"), F.col("b_b"))
    ee = met.where(apart).select("scene", F.lit("ee").alias("family"), "a_number", "b_number", F.concat("a_start", "b_start", "a_end", "b_end").alias("v"))
    return vf.union(ee).select("scene", "family", "a_number", "b_number", *[F.col("v")[i].alias(f"v{i}") for i in range(24)])


def self_collisions(vertices: DataFrame, triangles: DataFrame, cell: float, margin: float = 0.0, limits: Limits = Limits()) -> DataFrame:
    """One row per segment: status, toi_upper (in the segment), margin, witness (a_number, b_number), primitives and calls by family.

    ``vertices`` and ``triangles`` are those of all frames; the triangles of
    the first are taken. A segment none of whose primitives come near is
    separate with no primitives. One frame or none has no segment.
    """
    segments = frame_segments(vertices)
    first = triangles.agg(F.min("mesh").alias("_first"))
    own = triangles.join(F.broadcast(first), F.col("mesh") == F.col("_first"), "left_semi")
    done = certificates(self_queries(segments, own, cell, margin), limits)
    done = done.withColumns({"ord": F.struct("a_number", "b_number"), "mask": F.when(F.col("family") == "vf", 1).otherwise(2)})
    found = reduce_primitives(done, ["scene"])
    calls = done.groupBy("scene").agg(F.count_if(F.col("family") == "vf").alias("vertex_face"), F.count_if(F.col("family") == "ee").alias("edge_edge"))
    rows = segments.select("scene").distinct().join(found, "scene", "left").join(calls, "scene", "left")
    none = {"status": F.lit(SEPARATION), "margin": F.lit(0.0), "mask": F.lit(0), **{c: F.lit(0).cast("long") for c in ("primitives", "vertex_face", "edge_edge")}}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
