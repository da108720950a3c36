"""SQL of the queries that need iteration: recursive relaxation, pointer chasing, greedy choice, unrolled rounds."""

from __future__ import annotations

#: Rounds of relaxation: more than steps of any shortest path in the images of the queries.
ROUNDS = 80


def grown(name: str, init: str, where: str) -> str:
    """Label and geodesic distance of each voxel of where, from init (x, y, z, label), by relaxation; ties to the
    smaller label. Needs off and WITH RECURSIVE."""
    return f"""{name}_r(k, x, y, z, s) AS (
SELECT 0, x, y, z, {{'d': 0.0::DOUBLE, 'l': label}} FROM {init}
UNION ALL
SELECT g.k + 1, t.x, t.y, t.z, MIN({{'d': CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN g.s.d ELSE ROUND(g.s.d + sqrt(dx * dx + dy * dy + dz * dz), 9) END, 'l': g.s.l}})
FROM {name}_r g CROSS JOIN off JOIN {where} t ON t.x = g.x + dx AND t.y = g.y + dy AND t.z = g.z + dz WHERE g.k < {ROUNDS} GROUP BY g.k + 1, t.x, t.y, t.z),
{name} AS (SELECT x, y, z, s.l AS label, s.d AS dist FROM {name}_r WHERE k = {ROUNDS})"""


def morphology(out: str, source: str, near: str, grow: bool) -> str:
    """Dilation or erosion of a dense boolean image; near joins a and b as kernel neighbours, the voxel itself included."""
    v = "a.v OR bool_or(b.v)" if grow else "a.v AND bool_and(b.v)"
    return f"{out} AS (SELECT a.x, a.y, a.z, {v} AS v FROM {source} a JOIN {source} b ON {near} GROUP BY a.x, a.y, a.z, a.v)"


def largest_eigenvalue(xx: str, yy: str, zz: str, xy: str, xz: str, yz: str, which: int = 0) -> str:
    """Eigenvalue of a symmetric 3 x 3 matrix, largest first, by the trigonometric cubic."""
    q = f"(({xx}) + ({yy}) + ({zz})) / 3"
    p = f"sqrt((pow(({xx}) - {q}, 2) + pow(({yy}) - {q}, 2) + pow(({zz}) - {q}, 2) + 2 * (pow({xy}, 2) + pow({xz}, 2) + pow({yz}, 2))) / 6)"
    a, b, d = (f"(({c}) - {q})" for c in (xx, yy, zz))
    det = f"({a} * ({b} * {d} - pow({yz}, 2)) - ({xy}) * (({xy}) * {d} - ({yz}) * ({xz})) + ({xz}) * (({xy}) * ({yz}) - {b} * ({xz})))"
    r = f"CASE WHEN {p} > 1e-12 THEN GREATEST(LEAST({det} / (2 * pow({p}, 3)), 1), -1) ELSE 0 END"
    turn = {0: "0", 1: "4 * pi() / 3", 2: "2 * pi() / 3"}[which]
    return f"({q} + 2 * {p} * cos(acos({r}) / 3 + {turn}))"


def lloyd(points: str, first: str, rounds: int, features: list[str], k: int) -> str:
    """CTEs of rounds of k-means over (id, features) from c0 (cluster, features)."""
    parts = [f"c0 AS ({first})"]
    d = " + ".join(f"pow(p.{f} - c.{f}, 2)" for f in features)
    for i in range(1, rounds + 1):
        parts.append(f"a{i} AS (SELECT p.id, arg_min(c.cluster, {{'d': {d}, 'i': c.cluster}}) AS cluster FROM {points} p CROSS JOIN c{i - 1} c GROUP BY p.id)")
        means = ", ".join(f"COALESCE(AVG(p.{f}), ANY_VALUE(c.{f})) AS {f}" for f in features)
        parts.append(f"c{i} AS (SELECT c.cluster, {means} FROM c{i - 1} c LEFT JOIN a{i} a USING (cluster) LEFT JOIN {points} p ON p.id = a.id GROUP BY c.cluster)")
    return ", ".join(parts)


def t_pvalue(t: str, n: str, steps: int = 2000) -> str:
    """Two-sided p of Student's t by Simpson's rule on its density."""
    f = f"exp(lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0) - 0.5 * ln({n} * pi()) - ({n} + 1) / 2.0 * ln(1 + pow(i * abs({t}) / {steps}, 2) / {n}))"
    return f"1 - 2 * abs({t}) / {steps} / 3 * (SELECT SUM(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f}) FROM range({steps + 1}) r(i))"
