"""Registered queries over voxels, circular patterns and Laplacian profiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import r6
from lattica.operators import spatial
from lattica.sources import views
from lattica.sources.views import GRIDS

I = "image_id"
VOXELS = """g0 AS (SELECT vec_id AS image_id, CAST(unnest(range(64)) AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings),
voxels AS (SELECT image_id, p // 16 AS z, p // 4 % 4 AS y, p % 4 AS x, (w - min(w) OVER u) / (max(w) OVER u - min(w) OVER u) AS v FROM g0 WINDOW u AS (PARTITION BY image_id)), fg AS MATERIALIZED (SELECT * FROM voxels WHERE v > 0.5)"""
D, N = 6, 9
WAYS = "ways(d, dx, dy, dz) AS (VALUES " + ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in enumerate(spatial.spiral(D))) + ")"
# a cell is a box of 1, 2, 4 or 8 voxels, complete, and enters with its highest voxel
TRANSFORM = f"""WITH {VOXELS}, {WAYS}, h AS (SELECT f.*, d, dx * (x - 2) + dy * (y - 2) + dz * (z - 2) AS h FROM fg f, ways),
box AS (SELECT p.image_id, p.d, p.z, p.y, p.x, a, b, c, max(q.h) AS entry, count(*) AS n, any_value(p.v) AS v FROM h p, (VALUES (0), (1)) i(a), (VALUES (0), (1)) j(b), (VALUES (0), (1)) k(c)
 JOIN h q ON q.image_id = p.image_id AND q.d = p.d AND q.z - p.z BETWEEN 0 AND a AND q.y - p.y BETWEEN 0 AND b AND q.x - p.x BETWEEN 0 AND c GROUP BY p.image_id, p.d, p.z, p.y, p.x, a, b, c HAVING count(*) = power(2, a + b + c)),
st AS (SELECT image_id, d, greatest(0, ceil(round((entry / sqrt(48.0::DOUBLE) + 1) / 2 * {N - 1}, 9))) AS step, 1 - 2 * ((a + b + c) % 2) AS sign, CASE WHEN a + b + c = 0 THEN v END AS v FROM box),
ect AS (SELECT i.image_id, w.d, k, coalesce(sum(sign) FILTER (WHERE step <= k) * avg(v) FILTER (WHERE step <= k), 0) AS chi FROM (SELECT DISTINCT image_id FROM voxels) i CROSS JOIN ways w CROSS JOIN (SELECT CAST(unnest(range({N})) AS INTEGER) AS k) LEFT JOIN st ON st.image_id = i.image_id AND st.d = w.d GROUP BY ALL)"""
STEPS = ", ".join(f"({k}, {z}, {y}, {x})" for k, (z, y, x) in enumerate(spatial.HALF))
ANISOTROPY = f"""WITH {VOXELS}, ways(d, dz, dy, dx) AS (VALUES {STEPS}), n AS (SELECT i.image_id, count(fg.image_id) AS n FROM (SELECT DISTINCT image_id FROM voxels) i LEFT JOIN fg USING (image_id) GROUP BY 1),
surf AS (SELECT n.image_id, n, d, dz, dy, dx, n - (SELECT count(*) FROM fg a JOIN fg b ON b.image_id = a.image_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.image_id = n.image_id) AS s FROM n, ways),
q AS (SELECT image_id, n, dz, dy, dx, power(2 * n / greatest(s, 1), 2) / (dz * dz + dy * dy + dx * dx) / 13 AS w FROM surf),
t AS (SELECT image_id, max(n) AS volume, sum(w * dz * dz) AS a, sum(w * dy * dy) AS b, sum(w * dx * dx) AS c, sum(w * dz * dy) AS d, sum(w * dz * dx) AS e, sum(w * dy * dx) AS f FROM q GROUP BY 1),
p AS (SELECT *, (a + b + c) / 3 AS m FROM t), p2 AS (SELECT *, sqrt((power(a - m, 2) + power(b - m, 2) + power(c - m, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM p),
p3 AS (SELECT *, acos(greatest(-1, least(1, coalesce(((a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - e * f) + e * (d * f - e * (b - m))) / nullif(2 * p * p * p, 0), 1)))) / 3 AS th FROM p2),
ev AS (SELECT image_id, volume, m + 2 * p * cos(th) AS e1, m + 2 * p * cos(th - 2 * pi() / 3) AS e2, m + 2 * p * cos(th + 2 * pi() / 3) AS e3 FROM p3)
SELECT image_id, volume, round(1 - e3 / greatest(e1, 1e-10), 5) AS degree, round(sqrt(1.5) * sqrt((power(e1 - (e1 + e2 + e3) / 3, 2) + power(e2 - (e1 + e2 + e3) / 3, 2) + power(e3 - (e1 + e2 + e3) / 3, 2)) / (e1 * e1 + e2 * e2 + e3 * e3)), 5) AS fractional, round(e1, 5) AS e1, round(e2, 5) AS e2, round(e3, 5) AS e3, round(e1 / greatest(e3, 1e-10), 5) AS ratio FROM ev"""


def _circle(points: int, radius: float) -> str:
    """Histogram of uniform patterns of one circle."""
    rows = ", ".join(f"({k}, {dr}, {dc}, {w!r}::DOUBLE)" for k, p in enumerate(spatial.circle(points, radius)) for dr, dc, w in p)
    return f"""SELECT image_id, bin, count(*) AS n FROM (SELECT image_id, r, c, CASE WHEN list_sum(list_transform(range(1, {points}), lambda i: CAST(bits[i] <> bits[i + 1] AS INTEGER))) <= 2 THEN CAST(list_sum(bits) AS INTEGER) ELSE {points + 1} END AS bin
 FROM (SELECT image_id, r, c, list(CAST(u >= round(v, 9) AS INTEGER) ORDER BY k) AS bits FROM (SELECT g.image_id, g.r, g.c, any_value(g.v) AS v, k, round(sum(coalesce(h.v, 0) * w), 9) AS u FROM grids g CROSS JOIN (VALUES {rows}) s(k, dr, dc, w) LEFT JOIN grids h ON h.image_id = g.image_id AND h.r = g.r + dr AND h.c = g.c + dc GROUP BY g.image_id, g.r, g.c, k) GROUP BY image_id, r, c)) GROUP BY image_id, bin"""


SCALES = f"WITH {GRIDS}, s0 AS ({_circle(8, 1.0)}), s1 AS ({_circle(16, 2.0)}), every AS (SELECT image_id, 0 AS scale, bin, n FROM s0 UNION ALL SELECT image_id, 1, bin, n FROM s1)"
VALUES = [0.25, 0.5, 0.75]
PROFILE = f"""WITH RECURSIVE {GRIDS}, lv AS MATERIALIZED (SELECT image_id, k, r, c, r * 8 + c AS id FROM grids, (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 0.75)) t(k, t) WHERE v <= t),
ed AS MATERIALIZED (SELECT a.image_id, a.k, a.id AS a, b.id AS b FROM lv a JOIN lv b ON b.image_id = a.image_id AND b.k = a.k AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach AS (SELECT image_id, k, id, id AS start FROM lv UNION SELECT e.image_id, e.k, e.b, q.start FROM reach q JOIN ed e ON e.image_id = q.image_id AND e.k = q.k AND e.a = q.id),
n AS (SELECT image_id, k, count(*) AS vertices, count(DISTINCT label) AS components FROM (SELECT image_id, k, id, min(start) AS label FROM reach GROUP BY ALL) GROUP BY ALL),
dg AS (SELECT image_id, k, CAST(sum(d) AS BIGINT) AS trace, CAST(sum(d * d + d) AS BIGINT) AS trace2 FROM (SELECT image_id, k, a, count(*) AS d FROM ed GROUP BY ALL) GROUP BY ALL)
SELECT i.image_id, k.k, coalesce(vertices, 0) AS vertices, coalesce(trace, 0) // 2 AS edges, coalesce(trace, 0) AS trace, coalesce(trace2, 0) AS trace2, coalesce(components, 0) AS components FROM (SELECT DISTINCT image_id FROM grids) i CROSS JOIN (VALUES (0), (1), (2)) k(k) LEFT JOIN n ON n.image_id = i.image_id AND n.k = k.k LEFT JOIN dg ON dg.image_id = i.image_id AND dg.k = k.k"""


def _transform(s, d):
    return spatial.weighted_euler_transform_3d(views.voxels(s, d), D, N)


def _scales(s, d):
    return spatial.lbp_multi_scale(views.grids(s, d), 2)


def _anisotropy(s, d):
    got = spatial.anisotropy_3d(views.voxels(s, d))
    return got.select(I, "volume", *[F.round(c, 5).alias(c) for c in ("degree", "fractional", "e1", "e2", "e3", "ratio")])


QUERIES = {
    "g9_weighted_euler": (lambda s, d: _transform(s, d).select(I, "d", "k", r6("chi", "chi")), f"{TRANSFORM} SELECT image_id, d, k, round(chi, 6) AS chi FROM ect"),
    "g9_summary": (lambda s, d: spatial.transform_summary(_transform(s, d)).select(I, *[r6(c, c) for c in ("mean", "std", "max", "min", "variation")], r6(F.aggregate("signature", F.lit(0.0), lambda a, x: a + x), "signature_total")), f"{TRANSFORM}, st2 AS (SELECT *, abs(chi - lag(chi) OVER (PARTITION BY image_id, d ORDER BY k)) AS step FROM ect) SELECT image_id, round(avg(chi), 6) AS mean, round(stddev_pop(chi), 6) AS std, round(max(chi), 6) AS max, round(min(chi), 6) AS min, round(sum(step), 6) AS variation, round(sum(chi) / {D}, 6) AS signature_total FROM st2 GROUP BY 1"),
    "g11_anisotropy": (_anisotropy, ANISOTROPY),
    "g14_lbp_scales": (lambda s, d: _scales(s, d).select(I, "scale", "bin", "n", r6("density", "density")), f"{SCALES} SELECT image_id, scale, bin, n, round(n / 64, 6) AS density FROM every"),
    "g14_lbp_summary": (lambda s, d: spatial.lbp_summary(_scales(s, d)).select(I, r6("entropy", "entropy"), r6("uniformity", "uniformity"), "n_nonzero"), f"{SCALES} SELECT image_id, round(-sum(n / 64 * ln(n / 64 + 1e-10)), 6) AS entropy, round(sum(power(n / 64, 2)), 6) AS uniformity, count(*) FILTER (WHERE n / 64 > 0.001) AS n_nonzero FROM every GROUP BY 1"),
    "g20_laplacian_moments": (lambda s, d: spatial.laplacian_profile(views.grids(s, d), VALUES, second=False), PROFILE),
    "g20_laplacian_profile": (lambda s, d: spatial.laplacian_profile(views.grids(s, d), VALUES).select(I, "k", r6("second", "second")), None),
}
