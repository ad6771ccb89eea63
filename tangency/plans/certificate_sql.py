"""DuckDB text of the interval certificate: a recursion over halved intervals, all queries a level at a time."""

from __future__ import annotations

_K = "xyz"


def _minus(a: str, b: str) -> dict[str, str]:
    return {k: f"{a}{k} - {b}{k}" for k in _K}


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in _K) + ")"


def _cross(a: str, b: str) -> dict[str, str]:
    return {"x": f"({a}y * {b}z - {a}z * {b}y)", "y": f"({a}z * {b}x - {a}x * {b}z)", "z": f"({a}x * {b}y - {a}y * {b}x)"}


def _named(name: str, parts: dict[str, str]) -> list[str]:
    return [f"{value} AS {name}{k}" for k, value in parts.items()]


def _clip(x: str) -> str:
    return f"least(1e0, greatest(0e0, {x}))"


def _share(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} <> 0 THEN ({top}) / {bottom} ELSE 0e0 END)"


def gap(source: str, time: str, name: str = "gap") -> str:
    """``source`` (family, x0 to z7) with the distance of its primitives at ``time``: point to triangle for vf, else edge to edge."""
    layers = [
        [f"{k}{i} + ({k}{i + 4} - {k}{i}) * {time} AS p{i}{k}" for i in range(4) for k in _K],
        [
            part
            for n, a, b in (("ea", "p2", "p1"), ("eb", "p3", "p2"), ("ec", "p1", "p3"), ("ac", "p3", "p1"), ("wa", "p0", "p1"), ("wb", "p0", "p2"), ("wc", "p0", "p3"), ("da", "p1", "p0"), ("db", "p3", "p2"), ("r", "p0", "p2"))
            for part in _named(n, _minus(a, b))
        ],
        [
            *[f"CASE WHEN {_dot(f'e{s}', f'e{s}')} <= 1e-14 THEN 0e0 ELSE {_clip(f'{_dot(f"w{s}", f"e{s}")} / {_dot(f"e{s}", f"e{s}")}')} END AS t{s}" for s in "abc"],
            *_named("n", _cross("ea", "ac")),
            *[part for s in "abc" for part in _named(f"c{s}", _cross(f"e{s}", f"w{s}"))],
            f"{_dot('da', 'da')} AS qa", f"{_dot('db', 'db')} AS qe", f"{_dot('db', 'r')} AS qf", f"{_dot('da', 'db')} AS qb", f"{_dot('da', 'r')} AS qc",
        ],
        [
            *[f"sqrt({' + '.join(f'(w{s}{k} - e{s}{k} * t{s}) * (w{s}{k} - e{s}{k} * t{s})' for k in _K)}) AS g{s}" for s in "abc"],
            f"sqrt({_dot('n', 'n')}) AS size",
            f"CASE WHEN abs(qa * qe - qb * qb) > 1e-14 THEN {_clip('(qb * qf - qc * qe) / (qa * qe - qb * qb)')} ELSE 0e0 END AS s0",
        ],
        [
            f"CASE WHEN {_dot('ca', 'n')} >= 0 AND {_dot('cb', 'n')} >= 0 AND {_dot('cc', 'n')} >= 0 AND size > 1e-14 THEN abs({_share(_dot('wa', 'n'), 'size')}) ELSE least(ga, gb, gc) END AS face",
            f"{_share('qb * s0 + qf', 'qe')} AS t0",
        ],
        [
            f"CASE WHEN qa <= 1e-14 THEN 0e0 WHEN qe <= 1e-14 THEN {_clip(_share('-qc', 'qa'))} WHEN t0 < 0 THEN {_clip(_share('-qc', 'qa'))} WHEN t0 > 1 THEN {_clip(_share('qb - qc', 'qa'))} ELSE s0 END AS s1",
            f"CASE WHEN qe <= 1e-14 THEN 0e0 WHEN qa <= 1e-14 THEN {_clip(_share('qf', 'qe'))} ELSE {_clip('t0')} END AS t1",
        ],
        [f"CASE WHEN family = 'vf' THEN face ELSE sqrt({' + '.join(f'(p0{k} + da{k} * s1 - p2{k} - db{k} * t1) * (p0{k} + da{k} * s1 - p2{k} - db{k} * t1)' for k in _K)}) END AS {name}"],
    ]
    out, made = source, []
    for layer in layers:
        out = f"(SELECT *, {', '.join(layer)} FROM {out})"
        made += [part.rsplit(" AS ", 1)[1] for part in layer]
    return f"(SELECT * EXCLUDE ({', '.join(made[:-1])}) FROM {out})"


def certificates(wide: str, eps_time: float = 1.0e-4, eps_space: float = 1.0e-6, depth: int = 24) -> str:
    """CTEs after ``WITH RECURSIVE``: ``found`` (query_id, family, status, toi_upper, margin, evaluations) of the queries ``wide``.

    Every interval that is not decided is halved, also beyond a collision; the
    collision that counts is the leftmost, as its interval was never halved
    and all before it were tried first. Intervals that begin after it are not
    counted as evaluated.
    """
    speed = [f"sqrt({' + '.join(f'({k}{i + 4} - {k}{i}) * ({k}{i + 4} - {k}{i})' for k in _K)})" for i in range(4)]
    reach = f"CASE WHEN family = 'vf' THEN {speed[0]} + greatest({', '.join(speed[1:])}) ELSE greatest({speed[0]}, {speed[1]}) + greatest({speed[2]}, {speed[3]}) END"
    start = gap(gap(f"(SELECT *, {reach} AS reach FROM ({wide}))", "0e0", "gap0"), "1e0", "gap1")
    outcome = f"""CASE WHEN gap <= {eps_space} OR (depth = 0 AND (gap0 <= {eps_space} OR gap1 <= {eps_space})) THEN 'hit'
    WHEN gap - reach * 0.5e0 * (b - a) > {eps_space} THEN 'free' WHEN depth >= {depth} OR b - a <= {eps_time} THEN 'stuck' ELSE 'split' END"""
    level = gap("(SELECT q.*, a, b, depth, 0.5e0 * (a + b) AS mid FROM node JOIN q USING (query_id) WHERE state = 'todo')", "mid")
    return f"""q AS MATERIALIZED (SELECT * FROM {start}),
node(query_id, a, b, depth, state, toi, margin) AS (
  SELECT query_id, 0e0, 1e0, 0, 'todo', 1e0, 0e0 FROM q
  UNION ALL
  SELECT query_id, CASE WHEN k = 2 THEN mid ELSE a END, CASE WHEN k = 1 THEN mid ELSE b END, CASE WHEN k = 0 THEN depth ELSE depth + 1 END, CASE WHEN k = 0 THEN outcome ELSE 'todo' END,
    CASE WHEN depth = 0 AND gap0 <= {eps_space} THEN a WHEN gap <= {eps_space} THEN mid ELSE b END, gap - reach * 0.5e0 * (b - a) - {eps_space}
  FROM (SELECT *, {outcome} AS outcome FROM {level}), (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR outcome = 'split'
),
tried AS MATERIALIZED (SELECT * FROM node WHERE state <> 'todo'),
hit AS (SELECT query_id, min(a) AS a, min_by(toi, a) AS toi FROM tried WHERE state = 'hit' GROUP BY query_id),
found AS (
  SELECT query_id, family, CAST(CASE WHEN max(hit.a) IS NOT NULL THEN 0 WHEN bool_or(state = 'stuck') THEN 2 ELSE 1 END AS INTEGER) AS status, coalesce(max(hit.toi), 1e0) AS toi_upper,
    CASE WHEN max(hit.a) IS NULL AND NOT bool_or(state = 'stuck') THEN greatest(0e0, min(CASE WHEN state = 'free' THEN margin END)) ELSE 0e0 END AS margin,
    count(*) FILTER (WHERE hit.a IS NULL OR tried.a <= hit.a) AS evaluations
  FROM tried JOIN (SELECT query_id, family FROM q) USING (query_id) LEFT JOIN hit USING (query_id) GROUP BY query_id, family
)"""


def best_distances(wide: str, eps_time: float = 1.0e-4, eps_space: float = 1.0e-6, depth: int = 24) -> str:
    """CTEs after ``WITH RECURSIVE``: ``found`` (query_id, family, status, toi, margin, evaluations, depth, least_distance) of the certificate that keeps the nearest sample.

    As in ``certificates``, an interval that is halved has no collision, so
    the leftmost collision ends what was tried.
    """
    speed = [f"sqrt({' + '.join(f'({k}{i + 4} - {k}{i}) * ({k}{i + 4} - {k}{i})' for k in _K)})" for i in range(4)]
    reach = f"CASE WHEN family = 'vf' THEN {speed[0]} + greatest({', '.join(speed[1:])}) ELSE greatest({speed[0]}, {speed[1]}) + greatest({speed[2]}, {speed[3]}) END"
    level = "(SELECT q.*, a, b, depth, 0.5e0 * (a + b) AS mid FROM node JOIN q USING (query_id) WHERE state = 'todo')"
    for time, name in (("a", "gap_a"), ("mid", "gap_m"), ("b", "gap_b")):
        level = gap(level, time, name)
    least = "least(gap_a, gap_m, gap_b)"
    outcome = f"""CASE WHEN {least} <= {eps_space} THEN 'hit' WHEN gap_m - reach * 0.5e0 * (b - a) > {eps_space} THEN 'free' WHEN depth >= {depth} OR b - a <= {eps_time} THEN 'stuck' ELSE 'split' END"""
    return f"""q AS MATERIALIZED (SELECT *, {reach} AS reach FROM ({wide})),
node(query_id, a, b, depth, state, toi, margin, least) AS (
  SELECT query_id, 0e0, 1e0, 0, 'todo', 1e0, 0e0, 0e0 FROM q
  UNION ALL
  SELECT query_id, CASE WHEN k = 2 THEN mid ELSE a END, CASE WHEN k = 1 THEN mid ELSE b END, CASE WHEN k = 0 THEN depth ELSE depth + 1 END, CASE WHEN k = 0 THEN outcome ELSE 'todo' END,
    CASE WHEN gap_a <= {least} THEN a WHEN gap_m <= {least} THEN mid ELSE b END, gap_m - reach * 0.5e0 * (b - a) - {eps_space}, {least}
  FROM (SELECT *, {outcome} AS outcome FROM {level}), (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR outcome = 'split'
),
tried AS MATERIALIZED (SELECT * FROM node WHERE state <> 'todo'),
hit AS (SELECT query_id, min(a) AS a, min_by(toi, a) AS toi FROM tried WHERE state = 'hit' GROUP BY query_id),
found AS (
  SELECT query_id, family, CAST(CASE WHEN max(hit.a) IS NOT NULL THEN 0 WHEN bool_or(state = 'stuck') THEN 2 ELSE 1 END AS INTEGER) AS status, coalesce(max(hit.toi), 1e0) AS toi,
    CASE WHEN max(hit.a) IS NULL AND NOT bool_or(state = 'stuck') THEN greatest(0e0, min(CASE WHEN state = 'free' THEN margin END)) ELSE 0e0 END AS margin,
    3 * count(*) AS evaluations, CAST(max(depth) AS INTEGER) AS depth, min(least) AS least_distance
  FROM tried JOIN (SELECT query_id, family FROM q) USING (query_id) LEFT JOIN hit USING (query_id) WHERE hit.a IS NULL OR tried.a <= hit.a GROUP BY query_id, family
)"""


def mesh_queries(triangles: str, touch: str) -> str:
    """CTEs that give ``wide`` (query_id, scene, family, a_number, b_number, turned, x0 to z7) of the triangles ``t`` (scene, side, tri_id, p0 to q8) of CTEs before them.

    ``touch`` tests the boxes of a and b.
    """

    def part(shape: str, number: str, corners: tuple[int, ...]) -> str:
        ends = {e: "[" + ", ".join(f"{e}{3 * i + j}" for i in corners for j in range(3)) + "]" for e in "pq"}
        boxes = ", ".join(f"least({v}) AS min_{k}, greatest({v}) AS max_{k}" for j, k in enumerate(_K) for v in [", ".join(f"{e}{3 * i + j}" for e in "pq" for i in corners)])
        return f"SELECT scene, side, '{shape}' AS shape, {number} AS number, {ends['p']} AS p, {ends['q']} AS q, {boxes} FROM t"

    parts = [part(s, f"tri_id * 3 + {i}", (i,) if s == "v" else (i, (i + 1) % 3)) for s in "ve" for i in range(3)] + [part("f", "tri_id", (0, 1, 2))]
    places = ", ".join(f"v[{3 * i + j + 1}] AS {k}{i}" for i in range(8) for j, k in enumerate(_K))
    return f"""{triangles}, parts AS MATERIALIZED ({" UNION ALL ".join(parts)}),
met AS MATERIALIZED (SELECT a.scene, a.shape AS a_shape, a.number AS a_number, b.number AS b_number, a.p AS ap, a.q AS aq, b.p AS bp, b.q AS bq
  FROM parts a JOIN parts b ON a.scene = b.scene AND a.side = 0 AND b.side = 1 AND ((a.shape = 'v' AND b.shape = 'f') OR (a.shape = 'f' AND b.shape = 'v') OR (a.shape = 'e' AND b.shape = 'e')) AND {touch}),
wide AS MATERIALIZED (SELECT query_id, scene, family, a_number, b_number, turned, {places} FROM (
  SELECT row_number() OVER () AS query_id, scene, CASE WHEN a_shape = 'e' THEN 'ee' ELSE 'vf' END AS family, a_number, b_number, a_shape = 'f' AS turned,
    CASE WHEN a_shape = 'f' THEN bp || ap || bq || aq ELSE ap || bp || aq || bq END AS v FROM met))"""
