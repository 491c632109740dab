"""Registered queries over persistence diagrams. Their SQL starts from bars that need no solver: for each image and row of
pixels the run from its least to its greatest value, so that statistics and vectors are compared on equal input; the
diagrams themselves are tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import r6, save
from lattica.operators import diagram, matrix, persistence, selection
from lattica.sources import views
from lattica.sources.views import GRIDS

I = "image_id"
K = [I, "hdim"]


def bars(s, d):
    g = views.grids(s, d)
    return g.groupBy(I, "r").agg(F.min("v").alias("birth"), F.max("v").alias("death")).select(I, (F.col("r") % 2).alias("hdim"), "birth", "death")


def real(s, d):
    g = views.grids(s, d)
    return persistence.valid_pairs(persistence.cap_infinite(persistence.persistence(g), g)), g


BARS = f"{GRIDS}, bars AS (SELECT image_id, r % 2 AS hdim, min(v) AS birth, max(v) AS death, max(v) - min(v) AS p FROM grids GROUP BY image_id, r)"
T = """lim AS (SELECT image_id, min(birth) - (max(death) - min(birth)) * 0.01 AS lo, max(death) + (max(death) - min(birth)) * 0.01 AS hi FROM bars GROUP BY 1),
ts AS (SELECT image_id, CAST(k AS INTEGER) AS k, lo + k * (hi - lo) / 19 AS t FROM lim, (SELECT unnest(range(20)) AS k)), spine AS (SELECT * FROM ts, (VALUES (0), (1)) h(hdim))"""


def _round(df, keys, ints=()):
    return df.select(*keys, *[F.col(c) if c in ints else r6(c, c) for c in df.columns if c not in keys])


def _on(f, keys=K, ints=(), **more):
    def run(s, d):
        b = bars(s, d)
        return _round(f(b, views.image_labels(s, d), **more), keys, ints)

    return run


def _r(x: str) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in (y.split("=", 1) for y in x.split(";")))


Q = "quantile_cont(p, {})"
_corr = lambda a, b: f"CASE WHEN stddev_pop({a}) >= 1e-10 AND stddev_pop({b}) >= 1e-10 THEN corr({a}, {b}) ELSE 0 END"
D3 = f"""WITH {BARS}, m AS (SELECT *, p - avg(p) OVER k AS e, min(p) OVER k AS lo, (max(p) OVER k - min(p) OVER k) / 20 AS width, count(*) OVER k AS n FROM bars WINDOW k AS (PARTITION BY image_id, hdim)),
 c AS (SELECT image_id, hdim, width, n, least(floor((p - lo) / width), 19) AS bin, count(*) AS k FROM m GROUP BY ALL), b AS (SELECT *, k / (n * width) AS h FROM c), x AS (SELECT image_id, hdim, -sum(h * ln(h + 1e-10)) AS entropy FROM b GROUP BY ALL),
 g AS (SELECT image_id, hdim, {_r("count=count(*);mean=avg(p);std=stddev_pop(p);median=quantile_cont(p, 0.5);min=min(p);max=max(p);iqr=quantile_cont(p, 0.75) - quantile_cont(p, 0.25);q25=quantile_cont(p, 0.25);q75=quantile_cont(p, 0.75);sum=sum(p);range=max(p) - min(p)")},
 round(avg(e ** 3) / power(avg(e ** 2), 1.5) * 16 / 6.0, 6) AS skewness, round(avg(e ** 4) / power(avg(e ** 2), 2) - 3, 6) AS kurtosis,
 {_r("birth_mean=avg(birth);birth_std=stddev_pop(birth);death_mean=avg(death);death_std=stddev_pop(death);midlife_mean=avg((birth + death) / 2);midlife_std=stddev_pop((birth + death) / 2);amplitude=max(death) - min(birth);weighted_birth=sum(birth * p) / sum(p);weighted_death=sum(death * p) / sum(p);sum_squares=sum(p * p);sum_cubes=sum(p * p * p);sum_logs=sum(ln(p + 1e-10))")},
 round({_corr("birth", "death")}, 6) AS birth_death_corr, round({_corr("birth", "p")}, 6) AS birth_p_corr, round({_corr("death", "p")}, 6) AS death_p_corr FROM m GROUP BY ALL)
 SELECT g.*, round(x.entropy, 6) AS entropy FROM g JOIN x USING (image_id, hdim)"""
K7 = f"""WITH {BARS}, f AS (SELECT image_id, ln(1 + count(*) FILTER (WHERE hdim = 0)) AS a, ln(1 + count(*) FILTER (WHERE hdim = 1)) AS b, 100 * avg(p) FILTER (WHERE hdim = 0) AS c, 100 * avg(p) FILTER (WHERE hdim = 1) AS d FROM bars GROUP BY 1),
 e AS (SELECT f.*, label FROM f JOIN embeddings ON vec_id = image_id), q AS (SELECT image_id AS query_id, a, b, c, d, CASE WHEN image_id % 100 = 0 THEN 99 ELSE label END AS own FROM e WHERE image_id % 20 = 0),
 s AS (SELECT query_id, image_id AS id, round((q.a * e.a + q.b * e.b + q.c * e.c + q.d * e.d + 1) / (sqrt(q.a ** 2 + q.b ** 2 + q.c ** 2 + q.d ** 2 + 1) * sqrt(e.a ** 2 + e.b ** 2 + e.c ** 2 + e.d ** 2 + 1)), 6) AS similarity FROM q JOIN e ON own = label OR own = 99)
 SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""

_place = "cos(q * pi() / 8 - pi() / 2) * x + sin(q * pi() / 8 - pi() / 2) * y"
_side = lambda own, other: f"SELECT a, b, hdim, birth AS x, death AS y, '{own}' AS side FROM pairs JOIN bars ON image_id = {own} UNION ALL SELECT a, b, hdim, (birth + death) / 2, (birth + death) / 2, '{own}' FROM pairs JOIN bars ON image_id = {other}"
D19 = f"""WITH {BARS}, pairs AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings), pts AS ({_side("a", "b")} UNION ALL {_side("b", "a")}), pr AS (SELECT a, b, hdim, q, side, {_place} AS p FROM pts, (SELECT unnest(range(8)) AS q)),
 n AS (SELECT *, row_number() OVER (PARTITION BY a, b, hdim, q, side ORDER BY p) AS k FROM pr), g AS (SELECT a, b, hdim, q, k, max(p) FILTER (WHERE side = 'a') - max(p) FILTER (WHERE side = 'b') AS gap FROM n GROUP BY ALL)
 SELECT a, b, hdim, round(sum(abs(gap)) / 8, 6) AS distance FROM g GROUP BY ALL"""


def _similar(s, d):
    x = diagram.ph_profile(bars(s, d), views.image_labels(s, d)).join(views.image_labels(s, d), I)
    own = F.when(F.col(I) % 100 == 0, 99).otherwise(F.col("label"))
    x = x.select(I, own.alias("asked"), F.col("label").alias("object_type"), F.col("h0_count").alias("h0"), F.col("h1_count").alias("h1"), F.col("h0_avg").alias("a0"), F.col("h1_avg").alias("a1"), F.lit(None).cast("double").alias("ratio"))
    x = save(x, "experiences")
    asked = x.where(F.col(I) % 20 == 0).drop("object_type").withColumnsRenamed({I: "query_id", "asked": "object_type"})
    return selection.similar_experiences(asked, x.drop("asked").withColumnRenamed(I, "id"))


QUERIES = {
    "h1_persistence": (lambda s, d: _round(real(s, d)[0], K), None),
    "h3_superlevel": (lambda s, d: _round(persistence.persistence(views.grids(s, d), "superlevel"), K), None),
    "d1_topological_features": (_on(diagram.topological_features, ints=("n",)), f"""WITH {BARS}, s AS (SELECT *, p / sum(p) OVER (PARTITION BY image_id, hdim) AS q FROM bars) SELECT image_id, hdim, count(*) AS n,
 {_r("total=sum(p);mean=avg(p);std=stddev_pop(p);max=max(p);min=min(p);median=quantile_cont(p, 0.5);p25=quantile_cont(p, 0.25);p75=quantile_cont(p, 0.75);iqr=quantile_cont(p, 0.75) - quantile_cont(p, 0.25);p90=quantile_cont(p, 0.9);l2=sqrt(sum(p * p));range=max(p) - min(p);entropy=-sum(q * ln(q + 1e-10));entropy_norm=-sum(q * ln(q + 1e-10)) / ln(count(*));amplitude=max(p) / (max(birth) - min(birth));birth_mean=avg(birth);death_mean=avg(death);mid_mean=avg((birth + death) / 2)")} FROM s GROUP BY image_id, hdim"""),
    "d2_total_persistence": (_on(diagram.total_persistence_stats), f"""WITH {BARS}, m AS (SELECT *, p - avg(p) OVER (PARTITION BY image_id, hdim) AS e FROM bars) SELECT image_id, hdim, {_r("l1=sum(p);l2=sqrt(sum(p * p));lp=power(sum(power(p, 3)), 1 / 3.0::DOUBLE);linf=max(p);skew=avg(e ** 3) / power(avg(e ** 2), 1.5) * 16 / 6.0;kurtosis=avg(e ** 4) / power(avg(e ** 2), 2) - 3")} FROM m GROUP BY image_id, hdim"""),
    "d3_persistence_statistics": (_on(diagram.persistence_statistics), D3),
    "k7_similar_experiences": (lambda s, d: _similar(s, d), K7),
    "d4_carlsson": (_on(diagram.carlsson_coordinates), f"WITH {BARS} SELECT image_id, hdim, {_r('f1=sum(p);f2=sum(p * p);f3=max(p);f4=sum(birth * p)')} FROM bars GROUP BY image_id, hdim"),
    "d5_tropical": (_on(diagram.tropical_coordinates, keys=[*K, "rank"], k=3), f"WITH {BARS} SELECT image_id, hdim, CAST(row_number() OVER (PARTITION BY image_id, hdim ORDER BY p DESC, birth) AS INTEGER) AS rank, {_r('birth=birth;death=death;pers=p;mid=(birth + death) / 2')} FROM bars QUALIFY rank <= 3"),
    "d7_entropy_curve": (_on(diagram.persistence_entropy, keys=[*K, "k"]), f"WITH {BARS}, {T}, a AS (SELECT b.*, k, p / sum(p) OVER (PARTITION BY b.image_id, b.hdim, k) AS q FROM bars b JOIN ts ON ts.image_id = b.image_id AND birth <= t AND t <= death) SELECT s.image_id, s.hdim, s.k, round(coalesce(0 - sum(q * ln(q)), 0), 6) AS entropy FROM spine s LEFT JOIN a ON a.image_id = s.image_id AND a.hdim = s.hdim AND a.k = s.k GROUP BY ALL"),
    "d8_betti_curves": (_on(diagram.betti_curves, keys=[*K, "k"], ints=("betti",)), f"WITH {BARS}, {T} SELECT s.image_id, s.hdim, s.k, count(b.p) AS betti FROM spine s LEFT JOIN bars b ON b.image_id = s.image_id AND b.hdim = s.hdim AND birth <= t AND t < death GROUP BY ALL"),
    "d9_landscapes": (_on(diagram.persistence_landscapes, keys=[*K, "layer", "k"], layers=2), f"WITH {BARS}, {T}, a AS (SELECT b.image_id, b.hdim, k, least(t - birth, death - t) AS x, row_number() OVER (PARTITION BY b.image_id, b.hdim, k ORDER BY least(t - birth, death - t) DESC) AS layer FROM bars b JOIN ts ON ts.image_id = b.image_id AND birth <= t AND t <= death) SELECT s.image_id, s.hdim, CAST(l AS INTEGER) AS layer, s.k, round(coalesce(max(x), 0), 6) AS value FROM spine s CROSS JOIN (VALUES (1), (2)) q(l) LEFT JOIN a ON a.image_id = s.image_id AND a.hdim = s.hdim AND a.k = s.k AND a.layer = l AND x > 0 GROUP BY ALL"),
    "d10_silhouette": (_on(diagram.persistence_silhouette, keys=[*K, "k"]), f"WITH {BARS}, {T}, w AS (SELECT image_id, hdim, sum(p) AS w FROM bars GROUP BY ALL) SELECT s.image_id, s.hdim, s.k, round(coalesce(sum(greatest(least(t - birth, death - t), 0) * p) / max(w), 0), 6) AS value FROM spine s JOIN w USING (image_id, hdim) LEFT JOIN bars b ON b.image_id = s.image_id AND b.hdim = s.hdim AND birth <= t AND t <= death GROUP BY ALL"),
    "d11_persistence_image": (lambda s, d: _round(diagram.persistence_image(bars(s, d)), [*K, "i", "j"]), f"""WITH {BARS}, b AS (SELECT image_id, hdim, min(birth) - greatest((max(birth) - min(birth)) * 0.1, 1e-6) AS b0, max(birth) + greatest((max(birth) - min(birth)) * 0.1, 1e-6) AS b1, max(p) * 1.1 AS p1 FROM bars GROUP BY ALL),
 f AS (SELECT d.image_id, d.hdim, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(p * exp(-(power(birth - (b0 + i * (b1 - b0) / 4), 2) + power(p - j * p1 / 4, 2)) / (2 * 0.1::DOUBLE * 0.1))) AS x FROM bars d JOIN b USING (image_id, hdim), (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j) GROUP BY ALL)
 SELECT image_id, hdim, i, j, round(x / max(x) OVER (PARTITION BY image_id, hdim), 6) AS value FROM f"""),
    "d13_template_functions": (lambda s, d: _round(diagram.template_functions(bars(s, d), 9), [*K, "k"]), f"""WITH {BARS}, b AS (SELECT image_id, hdim, min(birth) - greatest((max(birth) - min(birth)) * 0.1, 1e-6) AS b0, max(birth) + greatest((max(birth) - min(birth)) * 0.1, 1e-6) AS b1, max(p) * 1.1 AS p1 FROM bars GROUP BY ALL)
 SELECT d.image_id, d.hdim, CAST(j * 3 + i AS INTEGER) AS k, round(sum(greatest(0, 1 - greatest(abs(birth - (b0 + i * (b1 - b0) / 2)), abs(p - j * p1 / 2)) / greatest((b1 - b0) / 2, p1 / 2))), 6) AS value FROM bars d JOIN b USING (image_id, hdim), (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j) GROUP BY ALL"""),
    "d14_atol_fixed_centers": (lambda s, d: _round(diagram.atol_transform(bars(s, d), s.createDataFrame([(h, k, 0.2 * k, 0.5 + 0.1 * k, 0.3) for h in (0, 1) for k in range(3)], "hdim int, k int, cx double, cy double, sigma double")), [*K, "k"]), f"WITH {BARS} SELECT image_id, hdim, CAST(k AS INTEGER) AS k, round(sum(p * exp(-(power(birth - 0.2::DOUBLE * k, 2) + power(p - (0.5::DOUBLE + 0.1::DOUBLE * k), 2)) / (2 * 0.3::DOUBLE * 0.3::DOUBLE))), 6) AS value FROM bars, (SELECT unnest(range(3)) AS k) GROUP BY ALL"),
    "d14_atol_fitted": (lambda s, d: (lambda b: _round(diagram.atol_transform(b, diagram.atol_fit(b)), [*K, "k"]))(bars(s, d)), None),
    "d16_betti_ratios": (lambda s, d: (lambda x: x.select(*[r6(c, c) if c == "ratio" else c for c in x.columns]))(diagram.betti_ratios(bars(s, d), views.image_labels(s, d), 0.9, 0.5)), f"""WITH {BARS}, c AS (SELECT image_id, count(*) FILTER (WHERE hdim = 0) AS b0, count(*) FILTER (WHERE hdim = 0 AND p >= 0.9) AS b0_long, count(*) FILTER (WHERE hdim = 0 AND birth <= 0.5 AND death > 0.5) AS b0_alive,
 count(*) FILTER (WHERE hdim = 1) AS b1, count(*) FILTER (WHERE hdim = 1 AND p >= 0.9) AS b1_long, count(*) FILTER (WHERE hdim = 1 AND birth <= 0.5 AND death > 0.5) AS b1_alive FROM bars GROUP BY 1) SELECT *, round(b1 / greatest(b0, 1), 6) AS ratio, b0 - b1 AS chi, b0_long - b1_long AS chi_long FROM c"""),
    "d17_significant": (lambda s, d: diagram.significant(bars(s, d)).select(*K, "n_significant", F.transform("top", lambda x: F.round(x, 5)).alias("top")), f"WITH {BARS}, c AS (SELECT image_id, hdim, quantile_cont(p, 0.5) + stddev_pop(p) AS cut FROM bars GROUP BY ALL) SELECT image_id, hdim, count(*) FILTER (WHERE p > cut) AS n_significant, list_transform((list_sort(list(p), 'DESC'))[1:5], lambda x: round(x, 5)) AS top FROM bars JOIN c USING (image_id, hdim) GROUP BY ALL"),
    "d18_diagonal_distance": (_on(diagram.diagonal_distance), f"WITH {BARS} SELECT image_id, hdim, {_r('wasserstein=sqrt(sum(p * p / 2));bottleneck=max(p) / 2')} FROM bars GROUP BY ALL"),
    "d19_sliced_distance": (lambda s, d: _round(diagram.sliced_distance(views.image_labels(s, d).select(F.col(I).alias("a"), (F.col(I) + 1).alias("b")), bars(s, d)), ["a", "b", "hdim"]), D19),
    "d20_ph_profile": (lambda s, d: _round(diagram.ph_profile(bars(s, d), views.image_labels(s, d)), [I], ("h0_count", "h1_count")), f"WITH {BARS} SELECT image_id, " + ", ".join(f"count(*) FILTER (WHERE hdim = {h}) AS h{h}_count, round(max(p) FILTER (WHERE hdim = {h}), 6) AS h{h}_max, round(avg(p) FILTER (WHERE hdim = {h}), 6) AS h{h}_avg" for h in (0, 1)) + " FROM bars GROUP BY 1"),
    "k1_ph_signals": (lambda s, d: (lambda x: matrix.ph_signals(diagram.ph_profile(x[0], x[1])))(real(s, d)), None),
}


def flagship(s, d):
    """Grids to H0 and H1, their profile, and averages of each label."""
    pairs, g = real(s, d)
    p = diagram.ph_profile(pairs, g).join(views.image_labels(s, d), I)
    return p.groupBy("label").agg(F.count("*").alias("n"), *[r6(F.avg(c), c) for c in p.columns if c.startswith("h")])
