"""Registered queries over pixels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import r6, read
from lattica.operators import components, features, grid, pixels
from lattica.sources import views
from lattica.sources.views import GRIDS

I = "image_id"
V6 = [I, "r", "c"]
RGB = """pos AS (SELECT vec_id AS image_id, embedding, CAST(unnest(range(64)) AS INTEGER) AS p FROM embeddings),
rgb AS (SELECT image_id, p // 8 AS r, p % 8 AS c, CAST(embedding[p + 1] AS DOUBLE) AS of_r, CAST(embedding[(p + 21) % 64 + 1] AS DOUBLE) AS of_g, CAST(embedding[(p + 42) % 64 + 1] AS DOUBLE) AS of_b FROM pos)"""
OTSU = """q AS (SELECT image_id, least(greatest(CAST(floor(v * 256) AS INTEGER), 0), 255) AS q, count(*) AS n FROM grids GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER u AS wb, sum(n * (q + 0.5) / 256) OVER u AS sb, sum(n) OVER a AS w, sum(n * (q + 0.5) / 256) OVER a AS s FROM q WINDOW u AS (PARTITION BY image_id ORDER BY q), a AS (PARTITION BY image_id)),
gain AS (SELECT image_id, q, round(wb * (w - wb) * power(sb / wb - (s - sb) / nullif(w - wb, 0), 2), 6) AS gain FROM cum),
otsu AS (SELECT image_id, (q + 0.5) / 256 AS threshold FROM gain WHERE gain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY gain DESC, q) = 1),
mask AS (SELECT g.image_id, r, c, v, CAST(v > threshold AS INTEGER) AS fg, threshold FROM grids g JOIN otsu USING (image_id))"""


def _near(kernel: list[tuple[int, int, float]]) -> str:
    rows = ", ".join(f"({a}, {b}, CAST({w!r} AS DOUBLE))" for a, b, w in kernel)
    flip = lambda x: f"CASE WHEN {x} < 0 THEN -{x} - 1 WHEN {x} > 7 THEN 15 - ({x}) ELSE {x} END"
    return f"(SELECT g.image_id, g.r, g.c, g.v, h.v AS u, k.w FROM grids g CROSS JOIN (VALUES {rows}) k(dr, dc, w) JOIN grids h ON h.image_id = g.image_id AND h.r = {flip('(g.r + k.dr)')} AND h.c = {flip('(g.c + k.dc)')})"


def _conv(kernel) -> str:
    return f"SELECT image_id, r, c, sum(u * w) AS v FROM {_near(kernel)} GROUP BY ALL"


GRAD = """grad AS (SELECT image_id, r, c, v,
 coalesce((lead(v) OVER d - lag(v) OVER d) / 2, lead(v) OVER d - v, v - lag(v) OVER d, 0) AS gy, coalesce((lead(v) OVER a - lag(v) OVER a) / 2, lead(v) OVER a - v, v - lag(v) OVER a, 0) AS gx
 FROM grids WINDOW d AS (PARTITION BY image_id, c ORDER BY r), a AS (PARTITION BY image_id, r ORDER BY c))"""
CELLS = """parts AS (SELECT image_id, r * 2 + a AS y, c * 2 + b AS x, 1 - 2 * ((a + b) % 2) AS sign, v FROM grids, (VALUES (0), (1), (2)) p(a), (VALUES (0), (1), (2)) q(b)),
cells AS (SELECT image_id, y, x, sign, min(v) AS entry FROM parts GROUP BY ALL)"""


def _mask(s, d):
    return pixels.binarize(views.grids(s, d), "otsu")


def _gray(mode, sql):
    def run(s, d):
        return pixels.to_gray(views.rgb_grids(s, d), mode).select(*V6, (F.round("v", 6) + F.lit(0.0)).alias("v"))  # no negative zero

    return run, f"WITH {RGB} SELECT image_id, r, c, round({sql}, 6) + 0.0 AS v FROM rgb"


def _stats_sql() -> str:
    share = lambda x: f"round(avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END), 4)"
    return f"""WITH {GRIDS}, {GRAD}, smooth AS ({_conv(pixels.uniform(3))}), j AS (SELECT g.*, s.v AS s, sqrt(gx * gx + gy * gy) AS m, max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY g.image_id) AS top FROM grad g JOIN smooth s USING (image_id, r, c))
SELECT image_id, {share('v > 0.7')} AS bright_ratio, {share('v < 0.3')} AS dark_ratio, {share('v >= 0.3 AND v <= 0.7')} AS mid_ratio, round(var_pop(s) / nullif(var_pop(v - s), 0), 2) AS snr,
 round((max(v) - min(v)) / (max(v) + min(v)), 4) AS contrast, round(var_pop(v), 6) AS variance, {share('top > 0 AND m / top > 0.2')} AS edge_density, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM j GROUP BY image_id"""


def _quality(s, d):
    got = features.feature_quality(read(s, d, "embeddings").select(F.col("vec_id").alias(I), F.col("embedding").cast("array<double>").alias("vec")))
    return got.select(I, "n", *[r6(c, c) for c in got.columns if c not in (I, "n", "n_informative", "n_constant")], "n_informative", "n_constant")


QUALITY = """WITH x AS (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT *, x - avg(x) OVER w AS e, count(*) OVER w AS k FROM x WINDOW w AS (PARTITION BY image_id)), y AS (SELECT *, sum(e * e) OVER (PARTITION BY image_id) AS t FROM m)
SELECT image_id, count(*) AS n, round(100 * avg(CAST(abs(x) < 1e-10 AS INTEGER)), 6) AS sparsity, round(var_pop(x), 6) AS variance, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max,
 round(avg(e ** 4) / power(avg(e ** 2), 2) - 3, 6) AS kurtosis, round(avg(e ** 3) / power(avg(e ** 2), 1.5), 6) AS skew, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr,
 count(*) FILTER (WHERE e * e > 0.01 * t / k) AS n_informative, count(*) FILTER (WHERE abs(e) < 1e-12) AS n_constant FROM y GROUP BY image_id"""


def _labelled(fg: int, near: str) -> str:
    """SQL of lab(image_id, r, c, label): components of the pixels of a kind, by which pixels reach which."""
    return f"""WITH RECURSIVE {GRIDS}, {OTSU}, px AS MATERIALIZED (SELECT image_id, r, c FROM mask WHERE fg = {fg}),
reach AS (SELECT image_id, r, c, r * 8 + c AS start FROM px UNION SELECT p.image_id, p.r, p.c, reach.start FROM reach JOIN px p ON p.image_id = reach.image_id AND {near}),
lab AS (SELECT image_id, r, c, min(start) AS label FROM reach GROUP BY ALL)"""


NEAR8 = "abs(p.r - reach.r) <= 1 AND abs(p.c - reach.c) <= 1"
NEAR4 = "abs(p.r - reach.r) + abs(p.c - reach.c) <= 1"
SIZES = f"{_labelled(1, NEAR8)}, sizes AS (SELECT image_id, label, count(*) AS size FROM lab GROUP BY ALL)"
EULER_TRANSFORM = f"""WITH {GRIDS}, {OTSU}, proj AS (SELECT image_id, d, r, c, round(cos(d * pi() / 4) * r + sin(d * pi() / 4) * c, 9) AS p FROM mask, (SELECT CAST(unnest(range(4)) AS INTEGER) AS d) WHERE fg = 1),
steps AS (SELECT *, ceil(round((p - min(p) OVER w) / nullif(max(p) OVER w - min(p) OVER w, 0) * 7, 6)) AS step FROM proj WINDOW w AS (PARTITION BY image_id, d)),
cells AS (SELECT image_id, d, r * 2 + a AS y, c * 2 + b AS x, 1 - 2 * ((a + b) % 2) AS sign, min(step) AS entry FROM steps, (VALUES (0), (1), (2)) p(a), (VALUES (0), (1), (2)) q(b) WHERE step IS NOT NULL GROUP BY ALL),
spine AS (SELECT image_id, d, k FROM (SELECT DISTINCT image_id FROM mask), (SELECT CAST(unnest(range(4)) AS INTEGER) AS d), (SELECT CAST(unnest(range(8)) AS INTEGER) AS k))
SELECT s.image_id, s.d, k, CAST(coalesce(sum(sign) FILTER (WHERE entry <= k), 0) AS BIGINT) AS chi FROM spine s LEFT JOIN cells c ON c.image_id = s.image_id AND c.d = s.d GROUP BY ALL"""

QUERIES = {
    "s4_grid_from_array": (lambda s, d: views.grid_from_array(read(s, d, "embeddings"), 8).select(*V6, r6("v", "v")), "SELECT vec_id AS image_id, p // 8 AS r, p % 8 AS c, round(CAST(embedding[p + 1] AS DOUBLE), 6) AS v FROM (SELECT *, CAST(unnest(range(64)) AS INTEGER) AS p FROM embeddings)"),
    "p1_gray_mean": _gray("mean", "(of_r + of_g + of_b) / 3"),
    "p1_gray_luma": _gray("luma", "0.299 * of_r + 0.587 * of_g + 0.114 * of_b"),
    "p1_gray_hsv_value": _gray("hsv_value", "greatest(of_r, of_g, of_b)"),
    "p1_gray_hsv_saturation": _gray("hsv_saturation", "CASE WHEN greatest(of_r, of_g, of_b) <> 0 THEN (greatest(of_r, of_g, of_b) - least(of_r, of_g, of_b)) / greatest(of_r, of_g, of_b) ELSE 0 END"),
    "p2_minmax": (lambda s, d: views.grids(s, d).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(v, 6) AS v FROM grids"),
    "p3_scale_255": (lambda s, d: pixels.scale_255(views.grids(s, d).withColumn("v", F.col("v") * 255)).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(v * 255 / 255, 6) AS v FROM grids"),
    "p5_block_downsample": (lambda s, d: pixels.block_downsample(views.grids(s, d), 4).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r // 2 AS r, c // 2 AS c, round(avg(v), 6) AS v FROM grids GROUP BY ALL"),
    "p7_binarize_otsu": (lambda s, d: _mask(s, d).groupBy(I).agg(r6(F.max("threshold"), "threshold"), r6(F.avg("fg"), "fg_ratio")), f"WITH {GRIDS}, {OTSU} SELECT image_id, round(max(threshold), 6) AS threshold, round(avg(fg), 6) AS fg_ratio FROM mask GROUP BY image_id"),
    "p7_binarize_midrange": (lambda s, d: pixels.binarize(views.grid_from_array(read(s, d, "embeddings"), 8), "midrange").groupBy(I).agg(r6(F.max("threshold"), "threshold"), F.sum("fg").alias("fg")), """WITH x AS (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), t AS (SELECT image_id, CASE WHEN min(v) < 0 OR max(v) > 1 THEN (min(v) + max(v)) / 2 ELSE 0.5 END AS t FROM x GROUP BY 1)
SELECT image_id, round(max(t), 6) AS threshold, count(*) FILTER (WHERE v > t) AS fg FROM x JOIN t USING (image_id) GROUP BY 1"""),
    "p8_otsu_threshold": (lambda s, d: pixels.otsu_threshold(views.grids(s, d)), f"WITH {GRIDS}, {OTSU} SELECT image_id, threshold FROM otsu"),
    "p9_gaussian": (lambda s, d: pixels.convolve(views.grids(s, d), pixels.gaussian(0.5)).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(v, 6) AS v FROM ({_conv(pixels.gaussian(0.5))})"),
    "p9_laplace": (lambda s, d: pixels.convolve(views.grids(s, d), pixels.LAPLACE).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(v, 6) AS v FROM ({_conv(pixels.LAPLACE)})"),
    "p10_median": (lambda s, d: pixels.median_filter(views.grids(s, d)).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(median(u), 6) AS v FROM {_near(pixels.uniform(3))} GROUP BY ALL"),
    "p11_bilateral": (lambda s, d: pixels.bilateral_filter(views.grids(s, d), 1.0, 0.1, 3).select(*V6, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(sum(w * exp(-power(u - v, 2) / 0.02) * u) / sum(w * exp(-power(u - v, 2) / 0.02)), 6) AS v FROM {_near([(a, b, __import__('math').exp(-(a * a + b * b) / 2)) for a in (-1, 0, 1) for b in (-1, 0, 1)])} GROUP BY image_id, r, c"),
    "p12_filter_report": (lambda s, d: (lambda g: pixels.filter_report(g, pixels.convolve(g, pixels.uniform(3))))(views.grids(s, d)).select(I, *[r6(c, c) for c in ("original_std", "filtered_std", "reduction", "low", "high")]), f"WITH {GRIDS}, f AS ({_conv(pixels.uniform(3))}) SELECT image_id, round(stddev_pop(g.v), 6) AS original_std, round(stddev_pop(f.v), 6) AS filtered_std, round((stddev_pop(g.v) - stddev_pop(f.v)) / stddev_pop(g.v), 6) AS reduction, round(min(f.v), 6) AS low, round(max(f.v), 6) AS high FROM grids g JOIN f USING (image_id, r, c) GROUP BY image_id"),
    "p13_gradient": (lambda s, d: pixels.gradient(views.grids(s, d)).select(*V6, r6("gy", "gy"), r6("gx", "gx"), r6("magnitude", "magnitude")), f"WITH {GRIDS}, {GRAD} SELECT image_id, r, c, round(gy, 6) AS gy, round(gx, 6) AS gx, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM grad"),
    "p14_image_stats": (lambda s, d: pixels.image_stats(views.grids(s, d)), _stats_sql()),
    "p15_recommend": (lambda s, d: pixels.recommend_preprocessing(pixels.image_stats(views.grids(s, d))), f"""SELECT image_id, CASE WHEN dark_ratio > bright_ratio + 0.1 THEN 'superlevel' ELSE 'sublevel' END AS filtration, CASE WHEN snr < 5 THEN 'median' WHEN snr < 10 THEN 'gaussian' ELSE 'none' END AS noise_filter,
 CASE WHEN snr < 5 THEN 0.2 WHEN snr < 15 THEN 0.1 ELSE 0.05 END AS sigma, CASE WHEN edge_density > 0.3 THEN 'high' WHEN edge_density > 0.1 THEN 'medium' ELSE 'low' END AS complexity FROM ({_stats_sql()})"""),
    "p16_quantize": (lambda s, d: pixels.quantize(views.grids(s, d), 8).groupBy(I, "q").agg(F.count("*").alias("n")), f"WITH {GRIDS} SELECT image_id, least(greatest(CAST(floor(v * 8) AS INTEGER), 0), 7) AS q, count(*) AS n FROM grids GROUP BY ALL"),
    "g1_grid_edges": (lambda s, d: grid.grid_edges(views.grids(s, d)).groupBy(I).agg(F.count("*").alias("n"), r6(F.sum(F.abs(F.col("v") - F.col("v2"))), "total")), f"WITH {GRIDS} SELECT a.image_id, count(*) AS n, round(sum(abs(a.v - b.v)), 6) AS total FROM grids a JOIN grids b ON a.image_id = b.image_id AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND abs(b.c - a.c) <= 1)) GROUP BY a.image_id"),
    "g2_components": (lambda s, d: components.mask_components(_mask(s, d)).groupBy(I, "label").agg(F.count("*").alias("size")), f"""WITH RECURSIVE {GRIDS}, {OTSU}, p AS (SELECT image_id, r * 8 + c AS id, r, c FROM mask WHERE fg = 1),
e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
t(image_id, id, reach) AS (SELECT image_id, id, id FROM p UNION SELECT t.image_id, t.id, e.b FROM t JOIN e ON e.image_id = t.image_id AND e.a = t.reach),
l AS (SELECT image_id, id, min(reach) AS label FROM t GROUP BY ALL) SELECT image_id, label, count(*) AS size FROM l GROUP BY ALL"""),
    "g3_component_stats": (lambda s, d: components.component_stats(_mask(s, d)).select(I, "n", *[r6(c, c) for c in ("mean", "cv", "largest")]), f"{SIZES}, g AS (SELECT image_id, count(*) AS n, avg(size) AS mean, stddev_pop(size) / avg(size) AS cv, max(size) / sum(size) AS largest FROM sizes GROUP BY 1) SELECT image_id, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean, round(coalesce(cv, 0), 6) AS cv, round(coalesce(largest, 0), 6) AS largest FROM (SELECT DISTINCT image_id FROM mask) LEFT JOIN g USING (image_id)"),
    "g4_holes_fill": (lambda s, d: components.holes_and_fill(_mask(s, d)).select(I, "holes", r6("fill_ratio", "fill_ratio")), f"""{_labelled(0, NEAR4)}, inner_ AS (SELECT image_id, label, count(*) AS size FROM lab GROUP BY ALL HAVING count(*) FILTER (WHERE r IN (0, 7) OR c IN (0, 7)) = 0), h AS (SELECT image_id, count(*) AS holes, sum(size) AS inside FROM inner_ GROUP BY 1), f AS (SELECT image_id, sum(fg) AS fg FROM mask GROUP BY 1)
SELECT image_id, coalesce(holes, 0) AS holes, round(CASE WHEN fg > 0 THEN (fg + coalesce(inside, 0)) / fg ELSE 0 END, 6) AS fill_ratio FROM f LEFT JOIN h USING (image_id)"""),
    "g5_euler_4": (lambda s, d: grid.euler_number(_mask(s, d), 4), f"""WITH {GRIDS}, {OTSU}, w AS (SELECT image_id, fg, coalesce(lead(fg) OVER a, 0) AS x, coalesce(lead(fg) OVER b, 0) AS y, r, c FROM mask WINDOW a AS (PARTITION BY image_id, r ORDER BY c), b AS (PARTITION BY image_id, c ORDER BY r)),
z AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY image_id, r ORDER BY c), 0) AS xy FROM w) SELECT image_id, CAST(sum(fg - fg * x - fg * y + fg * x * y * xy) AS BIGINT) AS chi FROM z GROUP BY image_id"""),
    "g5_euler_8": (lambda s, d: grid.euler_number(_mask(s, d), 8), f"""WITH {GRIDS}, {OTSU}, u AS (SELECT DISTINCT image_id, r * 2 + a AS y, c * 2 + b AS x, 1 - 2 * ((a + b) % 2) AS sign FROM mask, (VALUES (0), (1), (2)) p(a), (VALUES (0), (1), (2)) q(b) WHERE fg = 1)
SELECT image_id, CAST(sum(sign) AS BIGINT) AS chi FROM u GROUP BY image_id"""),
    "g6_betti": (lambda s, d: (lambda m: components.betti_estimate(components.component_stats(m), grid.euler_number(m, 8)))(_mask(s, d)), f"""{SIZES}, u AS (SELECT DISTINCT image_id, r * 2 + a AS y, c * 2 + b AS x, 1 - 2 * ((a + b) % 2) AS sign FROM mask, (VALUES (0), (1), (2)) p(a), (VALUES (0), (1), (2)) q(b) WHERE fg = 1), e AS (SELECT image_id, CAST(sum(sign) AS BIGINT) AS chi FROM u GROUP BY 1), n AS (SELECT image_id, count(*) AS b0 FROM sizes GROUP BY 1)
SELECT image_id, b0, greatest(0, b0 - chi) AS b1, chi FROM n JOIN e USING (image_id)"""),
    "g7_euler_curve": (lambda s, d: grid.euler_curve(views.grids(s, d)).select(I, "k", r6("t", "t"), "chi"), f"WITH {GRIDS}, {CELLS}, k AS (SELECT CAST(unnest(range(32)) AS INTEGER) AS k) SELECT i.image_id, k.k, round(k.k / 31, 6) AS t, CAST(coalesce(sum(sign) FILTER (WHERE floor(entry * 31) + 1 <= k.k), 0) AS BIGINT) AS chi FROM (SELECT DISTINCT image_id FROM grids) i CROSS JOIN k JOIN cells c ON c.image_id = i.image_id GROUP BY ALL"),
    "g8_euler_transform": (lambda s, d: grid.euler_transform(_mask(s, d), 4, 8), EULER_TRANSFORM),
    "g9_voxel_euler": (lambda s, d: grid.anisotropy_faces(views.voxels(s, d)), """WITH g0 AS (SELECT vec_id AS image_id, CAST(unnest(range(64)) AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
o AS (SELECT image_id, p // 16 AS z, p // 4 % 4 AS y, p % 4 AS x, CAST((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) > 0.5 AS INTEGER) AS o FROM g0 WINDOW w AS (PARTITION BY image_id)),
f AS (SELECT * FROM o WHERE o = 1), n AS (SELECT f.image_id, f.z, f.y, f.x, list(struct_pack(a := q.z - f.z, b := q.y - f.y, c := q.x - f.x)) AS n FROM f JOIN f q ON q.image_id = f.image_id AND q.z - f.z IN (0, 1) AND q.y - f.y IN (0, 1) AND q.x - f.x IN (0, 1) GROUP BY ALL),
h AS (SELECT image_id, list_contains(n, struct_pack(a := 0, b := 0, c := 1))::INT AS x1, list_contains(n, struct_pack(a := 0, b := 1, c := 0))::INT AS y1, list_contains(n, struct_pack(a := 1, b := 0, c := 0))::INT AS z1, list_contains(n, struct_pack(a := 0, b := 1, c := 1))::INT AS xy, list_contains(n, struct_pack(a := 1, b := 0, c := 1))::INT AS xz, list_contains(n, struct_pack(a := 1, b := 1, c := 0))::INT AS yz, (len(n) = 8)::INT AS xyz FROM n)
SELECT image_id, count(*) AS volume, CAST(sum(6 - 2 * (x1 + y1 + z1)) AS BIGINT) AS faces, CAST(sum(1 - x1 - y1 - z1 + x1 * y1 * xy + x1 * z1 * xz + y1 * z1 * yz - xyz) AS BIGINT) AS chi FROM h GROUP BY image_id"""),
    "g10_minkowski": (lambda s, d: grid.minkowski(views.grids(s, d), [0.25, 0.5, 0.75]).select(I, "t", r6("volume", "volume"), r6("surface", "surface"), "chi"), f"""WITH {GRIDS}, m AS (SELECT image_id, t, r, c, CAST(v > t AS INTEGER) AS o FROM grids, (VALUES (0.25::DOUBLE), (0.5), (0.75)) q(t)),
w AS (SELECT *, coalesce(lead(o) OVER a, 0) AS x, coalesce(lag(o) OVER a, 0) AS l, coalesce(lead(o) OVER b, 0) AS y, coalesce(lag(o) OVER b, 0) AS u FROM m WINDOW a AS (PARTITION BY image_id, t, r ORDER BY c), b AS (PARTITION BY image_id, t, c ORDER BY r)),
z AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY image_id, t, r ORDER BY c), 0) AS xy FROM w)
SELECT image_id, t, round(avg(o), 6) AS volume, round(avg(o * (1 - x * l * y * u)), 6) AS surface, CAST(sum(o - o * x - o * y + o * x * y * xy) AS BIGINT) AS chi FROM z GROUP BY image_id, t"""),
    "g12_box_count": (lambda s, d: grid.box_count_dimension(_mask(s, d), [1, 2, 4]).select(I, r6("dimension", "dimension"), r6("r2", "r2"), "finest", "coarsest"), f"WITH {GRIDS}, {OTSU}, b AS (SELECT image_id, s, count(DISTINCT (r // s) * 100 + c // s) AS n FROM mask, (VALUES (1), (2), (4)) q(s) WHERE fg = 1 GROUP BY ALL) SELECT image_id, round(-regr_slope(ln(n), ln(s)), 6) AS dimension, round(regr_r2(ln(n), ln(s)), 6) AS r2, max(n) AS finest, min(n) AS coarsest FROM b GROUP BY image_id"),
    "g13_lacunarity": (lambda s, d: grid.lacunarity(_mask(s, d)).select(I, r6("lacunarity", "lacunarity")), f"WITH {GRIDS}, {OTSU}, b AS (SELECT a.image_id, a.r, a.c, sum(b.fg) AS m FROM mask a JOIN mask b ON b.image_id = a.image_id AND b.r - a.r IN (0, 1) AND b.c - a.c IN (0, 1) WHERE a.r < 7 AND a.c < 7 GROUP BY ALL) SELECT image_id, round(CASE WHEN avg(m) > 0 THEN var_pop(m) / power(avg(m), 2) + 1 ELSE 1 END, 6) AS lacunarity FROM b GROUP BY image_id"),
    "g14_lbp": (lambda s, d: grid.lbp_histogram(views.grids(s, d), False).select(I, "bin", "n", r6("density", "density")), f"""WITH {GRIDS}, k AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {2**i})" for i, (a, b) in enumerate(grid.RING))}) t(dr, dc, w)), z AS (SELECT g.image_id, g.r, g.c, count(*) AS n, CAST(sum(CASE WHEN h.v >= g.v THEN w ELSE 0 END) AS INTEGER) AS code FROM grids g CROSS JOIN k JOIN grids h ON h.image_id = g.image_id AND h.r = g.r + k.dr AND h.c = g.c + k.dc GROUP BY ALL),
b AS (SELECT image_id, CASE WHEN n = 8 THEN code ELSE 0 END AS bin, count(*) AS n FROM z GROUP BY ALL) SELECT image_id, bin, n, round(n / 64, 6) AS density FROM b"""),
    "g14_lbp_uniform": (lambda s, d: grid.lbp_histogram(views.grids(s, d)).select(I, "bin", "n", r6("density", "density")), f"""WITH {GRIDS}, k AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {2**i})" for i, (a, b) in enumerate(grid.RING))}) t(dr, dc, w)), z AS (SELECT g.image_id, g.r, g.c, count(*) AS n, CAST(sum(CASE WHEN h.v >= g.v THEN w ELSE 0 END) AS INTEGER) AS code FROM grids g CROSS JOIN k JOIN grids h ON h.image_id = g.image_id AND h.r = g.r + k.dr AND h.c = g.c + k.dc GROUP BY ALL),
u AS (SELECT image_id, CASE WHEN bit_count(xor(code, (code % 128) * 2 + code // 128)) <= 2 THEN CAST(bit_count(code) AS INTEGER) ELSE 9 END AS bin FROM (SELECT image_id, CASE WHEN n = 8 THEN code ELSE 0 END AS code FROM z)), b AS (SELECT image_id, bin, count(*) AS n FROM u GROUP BY ALL) SELECT image_id, bin, n, round(n / 64, 6) AS density FROM b"""),
    "g15_edge_histogram": (lambda s, d: grid.edge_histogram(views.grids(s, d)).select(I, "cell", "bin", "n", r6("density", "density")), f"""WITH {GRIDS}, x AS ({_conv(pixels.SOBEL_X)}), y AS ({_conv(pixels.SOBEL_Y)}), g AS (SELECT image_id, r, c, x.v AS gx, y.v AS gy, round(sqrt(x.v * x.v + y.v * y.v), 9) AS m FROM x JOIN y USING (image_id, r, c)), t AS (SELECT image_id, quantile_cont(m, 0.7) AS cut FROM g WHERE m > 0 GROUP BY 1),
a AS (SELECT image_id, least(r // 4, 1) * 2 + least(c // 4, 1) AS cell, round(atan2(gy, gx), 9) AS th FROM g JOIN t USING (image_id) WHERE m > cut), b AS (SELECT image_id, CAST(cell AS INTEGER) AS cell, CAST(least(floor((CASE WHEN th < 0 THEN th + pi() WHEN th >= pi() THEN th - pi() ELSE th END) / pi() * 8), 7) AS INTEGER) AS bin, count(*) AS n FROM a GROUP BY ALL)
SELECT *, round(n / (sum(n) OVER (PARTITION BY image_id, cell) * pi() / 8), 6) AS density FROM b"""),
    "g16_glcm": (lambda s, d: grid.glcm(views.grids(s, d)).select(I, r6("contrast", "contrast"), r6("homogeneity", "homogeneity")), f"WITH {GRIDS}, q AS (SELECT image_id, r, c, least(CAST(floor(v * 8) AS INTEGER), 7) AS q FROM grids) SELECT a.image_id, round(avg(power(a.q - b.q, 2)), 6) AS contrast, round(avg(1 / (1 + abs(a.q - b.q))), 6) AS homogeneity FROM q a JOIN q b ON a.image_id = b.image_id AND a.r = b.r AND b.c = a.c + 1 GROUP BY 1"),
    "g17_low_frequency": (lambda s, d: grid.low_frequency_ratio(views.grids(s, d)).select(I, r6("ratio", "ratio")), f"""WITH {GRIDS}, k AS (SELECT a.k AS i, b.k AS j FROM (SELECT unnest(range(8)) AS k) a, (SELECT unnest(range(8)) AS k) b), f AS (SELECT image_id, i, j, sqrt(power(sum(v * cos(-2 * pi() * (r * i + c * j) / 8)), 2) + power(sum(v * sin(-2 * pi() * (r * i + c * j) / 8)), 2)) AS a FROM grids, k GROUP BY ALL)
SELECT image_id, round(sum(a) FILTER (WHERE power(CASE WHEN i > 3 THEN i - 8 ELSE i END, 2) + power(CASE WHEN j > 3 THEN j - 8 ELSE j END, 2) <= 1) / sum(a), 6) AS ratio FROM f GROUP BY image_id"""),
    "g18_level_set_growth": (lambda s, d: grid.level_set_growth(views.grids(s, d)).select(I, "k", r6("sublevel", "sublevel"), r6("superlevel", "superlevel")), f"WITH {GRIDS} SELECT image_id, CAST(k AS INTEGER) AS k, round(avg(CAST(v <= k / 49 AS INTEGER)), 6) AS sublevel, round(avg(CAST(v >= k / 49 AS INTEGER)), 6) AS superlevel FROM grids, (SELECT unnest(range(0, 50, 10)) AS k) GROUP BY ALL"),
    "f1_feature_quality": (_quality, QUALITY),
    "f3_sanitize_fit": (lambda s, d: read(s, d, "embeddings").select(F.col("vec_id").alias(I), features.fit_length(features.sanitize(F.col("embedding").cast("array<double>")), 66).alias("vec")).select(I, F.size("vec").alias("n"), r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), "total")), "SELECT vec_id AS image_id, 66 AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"),
    "f10_cosine": (lambda s, d: (lambda e: e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", r6(features.cosine_similarity(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")), "cosine")))(read(s, d, "embeddings")), "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "f13_vector_summary": (lambda s, d: features.vector_summary(read(s, d, "embeddings").select(F.col("vec_id").alias(I), F.col("embedding").cast("array<double>").alias("vec"))).select(I, "length", *[r6(c, c) for c in ("mean", "std", "max", "min")]), "SELECT vec_id AS image_id, len(embedding) AS length, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS std, round(list_max(embedding::DOUBLE[]), 6) AS max, round(list_min(embedding::DOUBLE[]), 6) AS min FROM embeddings"),
}
