"""Registered queries over paths, logs, resampled pixels, scaled vectors and rules, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lattica.functions import descriptors
from lattica.functions.tables import r6, read
from lattica.operators import features, resample, rules, vectors
from lattica.operators import selection as sel
from lattica.plans.diagram_queries import BARS, bars
from lattica.plans.pixel_queries import QUERIES as PIXELS
from lattica.plans.result_queries import BEST, best
from lattica.sources import labels, views
from lattica.sources.views import GRIDS

I = "image_id"
V = [I, "r", "c"]
KNOWN = {"src3": "per_channel", "src1": "grayscale", "src7": "per_channel"}
ALWAYS = {"tabpfn": ["click"], "forest": ["error", "view"]}


def _files(s, d):
    name = F.concat(F.coalesce(F.nullif("source", F.lit("")), F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"))
    return read(s, d, "documents").select(F.concat(name, F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".png")).alias("path"))


FILES = "files AS (SELECT doc_id, coalesce(nullif(source, ''), 'none') || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.png' END AS path FROM documents)"


def _manifest(s, d):
    x = read(s, d, "labels").select("doc_id", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 0, "n/a").otherwise(F.col("quality").cast("string")).alias("label"))
    return labels.labels_from_manifest(_files(s, d), x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"))


def _merged(s, d):
    e = read(s, d, "events").select("event_id", F.concat(F.lit("d"), (F.col("user_id") % 26).cast("string")).alias("dataset"), F.col("event_type").alias("descriptor"), "value", "user_id")
    sweep = e.where("event_id % 3 = 0").select("dataset", "descriptor", "value")
    color = e.where("event_id % 3 <> 0").select("dataset", "descriptor", "value", F.when(F.col("event_id") % 2 == 0, "rgb").alias("mode"))
    known = e.where("user_id % 26 % 4 <> 0").select("dataset").distinct()
    return labels.merge_logs({"sweep": sweep, "color": color}, known).groupBy("dataset", "descriptor", "experiment").agg(F.count("*").alias("n"), F.sum(F.size("fields")).alias("n_fields"))


def _lines(s, d):
    header = F.concat(F.lit("=== s"), (F.col("event_id") % 3).cast("string"), F.lit(" ==="))
    record = F.concat("event_type", F.lit(": sigma="), (F.col("user_id") % 3).cast("string"), F.lit(" bins="), (F.col("event_id") % 4).cast("string"), F.lit(" accuracy=0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    line = F.when(F.col("event_id") % 5 == 0, header).when(F.col("event_id") % 7 == 0, "done").otherwise(record)
    return read(s, d, "events").select((F.col("user_id") % 26).alias("log_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def _parsed(s, d):
    return labels.parse_text_logs(_lines(s, d)).select("log_id", "line_no", "section", "descriptor", F.element_at("params", "sigma").alias("sigma"), F.element_at("params", "bins").alias("bins"), r6("accuracy", "accuracy"))


def _vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias(I), "label", F.col("embedding").cast("array<double>").alias("vec"))


def _scaled(s, d):
    x = _vectors(s, d).select(I, F.posexplode("vec").alias("pos", "x"))
    return vectors.impute_scale_clip(x.select(I, "pos", F.when((F.col(I) + F.col("pos")) % 10 != 0, F.col("x")).alias("x"), (F.col(I) % 5 != 0).alias("train")))


def _fused(s, d):
    v = _vectors(s, d)
    got = vectors.fuse(v.select(I, F.slice("vec", 1, 8).alias("vec")), v.where("image_id % 3 <> 0").select(I, F.slice("vec", 33, 32).alias("vec")))
    return got.select(I, F.size("vec").alias("n"), r6(F.element_at("vec", 9), "ninth"), r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), "total"))


def _halves(s, d):
    x = _vectors(s, d).select(I, F.posexplode("vec").alias("pos", "x"))
    return x.select(I, F.when(F.col("pos") < 32, "low").otherwise("high").alias("descriptor"), (F.col("pos") % 32).alias("pos"), "x")


def _groups(s, d):
    b = best(s, d)
    return vectors.group_correlations(sel.pair_correlation(b), b.select("descriptor", (F.ascii("descriptor") % 2).alias("grp")).distinct()).select(*[F.round(c, 4).alias(c) if not c.endswith("_n") else F.col(c) for c in ("within_mean", "within_std", "within_n", "between_mean", "between_std", "between_n", "separation")])


def _importance(s, d):
    x = _vectors(s, d).select((F.col(I) % 5).alias("run"), F.posexplode("vec").alias("feature", "x"), F.col("label").cast("double").alias("y"))
    runs = x.groupBy("run", "feature").agg(F.abs(F.corr("x", "y")).alias("importance"))
    got = vectors.importance_summary(runs, runs.select("feature", F.floor(F.col("feature") / 16).cast("int").alias("category")).distinct())
    return got.select("feature", "category", "mean", *[F.round(c, 5).alias(c) for c in ("std", "share", "category_share")], "rank")


def _profile(s, d):
    g = views.image_labels(s, d).select(I, F.col("label").alias("dataset"), (F.col("label") % 3).alias("object_type"))
    got = vectors.diagram_profile(bars(s, d).where("death - birth > 0.75"), g)
    return got.select("object_type", *[r6(c, c) for c in ("h0_mean", "h0_std", "h1_mean", "h1_std", "ratio")], "n_images", "h0_dominant")


def _params(s, d):
    e = read(s, d, "events").select(F.col("event_type").alias("descriptor"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("object_type"), "user_id", "event_id")
    asked = e.select("descriptor", "object_type", (F.col("user_id") % 2 == 0).alias("per_channel")).distinct()
    rule = lambda x, *p: x.agg(F.count("*").alias("k")).withColumns({"dim": F.col("k") % 100 + 10, "params": F.create_map(*[y for a, b in p for y in (F.lit(a), b.cast("string"))])})
    cols = ["descriptor", "object_type", "dim", "params"]
    typed = rule(e.where("object_type <> 't4'").groupBy("descriptor", "object_type"), ("bins", F.col("k") % 7), ("sigma", F.col("k") % 3)).select(cols)
    default = rule(e.groupBy("descriptor"), ("bins", F.col("k") % 5)).withColumn("object_type", F.lit(None).cast("string")).select(cols)
    tuned = rule(e.where("descriptor in ('click', 'view') and event_id % 2 = 0").groupBy("descriptor", "object_type"), ("sigma", F.col("k") % 11)).select(cols)
    return rules.params_for(asked, typed.unionByName(default), tuned).select("descriptor", "object_type", "per_channel", "dim", F.try_element_at("params", F.lit("bins")).alias("bins"), F.try_element_at("params", F.lit("sigma")).alias("sigma"))


def _mode(s, d):
    x = read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).alias("name"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 * 2 - 1).alias("channels"), F.concat(F.lit("/x/"), F.coalesce("source", F.lit("")), F.lit("/y")).alias("path"))
    return x.select("doc_id", rules.color_mode_rule(F.col("name"), F.col("channels"), F.col("path"), KNOWN).alias("mode"))


def _normal(seed: str) -> str:
    text = f"md5({seed} || ':' || image_id || ':' || r || ':' || c)"
    part = lambda k: f"CAST(CAST('0x' || substr({text}, {k}, 8) AS BIGINT) AS DOUBLE)"
    return f"(sqrt(-2 * ln(({part(1)} + 1) / 4294967297)) * cos(2 * pi() * {part(9)} / 4294967296))"


_cos, _sin = math.cos(math.radians(15)), math.sin(math.radians(15))
_case = lambda c: " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in KNOWN.items())
_inside = " ".join(f"WHEN contains(lower('/x/' || coalesce(source, '') || '/y'), '{k}') THEN '{v}'" for k, v in KNOWN.items())
_pixel = {k: PIXELS[k][1] for k in ("g7_euler_curve", "g14_lbp", "g16_glcm")}

QUERIES = {
    "s2_labels_from_path": (lambda s, d: labels.labels_from_path(_files(s, d)), f"WITH {FILES} SELECT path, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS class, CAST(dense_rank() OVER (ORDER BY regexp_extract(path, '([^/]+)/[^/]+$', 1)) - 1 AS INTEGER) AS label FROM files WHERE path LIKE '%.png'"),
    "s3_labels_from_manifest": (_manifest, f"WITH {FILES} SELECT path, CAST(quality AS INTEGER) AS label FROM files JOIN labels USING (doc_id) WHERE doc_id % 11 <> 0 AND quality IS NOT NULL"),
    "s10_merge_logs": (_merged, "SELECT 'd' || (user_id % 26) AS dataset, event_type AS descriptor, CASE WHEN event_id % 3 = 0 THEN 'sweep' ELSE 'color' END AS experiment, count(*) AS n, CAST(sum((value IS NOT NULL)::INT + (event_id % 3 <> 0 AND event_id % 2 = 0)::INT) AS BIGINT) AS n_fields FROM events WHERE user_id % 26 % 4 <> 0 GROUP BY ALL"),
    "s11_parse_text_logs": (_parsed, """WITH l AS (SELECT user_id % 26 AS log_id, event_id AS line_no, event_type AS descriptor, user_id, last_value(CASE WHEN event_id % 5 = 0 THEN 's' || (event_id % 3) END IGNORE NULLS) OVER (PARTITION BY user_id % 26 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events)
SELECT log_id, line_no, section, descriptor, CAST(user_id % 3 AS VARCHAR) AS sigma, CAST(line_no % 4 AS VARCHAR) AS bins, round((line_no % 1000) / 1000, 6) AS accuracy FROM l WHERE line_no % 5 <> 0 AND line_no % 7 <> 0"""),
    "p6_area_resize": (lambda s, d: resample.area_resize(views.grids(s, d), 3).select(*V, r6("v", "v")), f"""WITH {GRIDS}, k AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS k), w AS (SELECT image_id, i.k AS i, j.k AS j, v, greatest(0, least((r + 1) * 3, (i.k + 1) * 8) - greatest(r * 3, i.k * 8)) * greatest(0, least((c + 1) * 3, (j.k + 1) * 8) - greatest(c * 3, j.k * 8)) AS w FROM grids, k i, k j)
SELECT image_id, i AS r, j AS c, round(sum(w * v) / sum(w), 6) AS v FROM w WHERE w > 0 GROUP BY ALL"""),
    "p17_noise": (lambda s, d: resample.add_noise(views.grids(s, d), 0.1).select(*V, r6("v", "v")), f"WITH {GRIDS} SELECT image_id, r, c, round(least(greatest(v + 0.1::DOUBLE * {_normal('42')}, 0), 1), 6) AS v FROM grids"),
    "p17_rotate": (lambda s, d: resample.rotate(views.grids(s, d), 15.0).select(*V, r6("v", "v")), f"""WITH {GRIDS}, p AS (SELECT image_id, r, c, (r - 3.5::DOUBLE) * {_cos!r}::DOUBLE + (c - 3.5::DOUBLE) * {_sin!r}::DOUBLE + 3.5 AS y, (c - 3.5::DOUBLE) * {_cos!r}::DOUBLE - (r - 3.5::DOUBLE) * {_sin!r}::DOUBLE + 3.5 AS x FROM grids)
SELECT p.image_id, p.r, p.c, round(sum((1 - abs(floor(y) + a - y)) * (1 - abs(floor(x) + b - x)) * coalesce(g.v, 0)), 6) AS v FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b) LEFT JOIN grids g ON g.image_id = p.image_id AND g.r = CAST(floor(y) + a AS INTEGER) AND g.c = CAST(floor(x) + b AS INTEGER) GROUP BY ALL"""),
    "f11_stability": (lambda s, d: resample.stability_report(views.grids(s, d), [0.05, 0.1, 0.2]).select("level", r6("mean", "mean"), r6("std", "std"), r6("score", "score"), "passed"), f"""WITH {GRIDS}, n AS (SELECT image_id, level, trial, v, least(greatest(v + level * {_normal('trial')}, 0), 1) AS u FROM grids, (VALUES (0.05::DOUBLE), (0.1), (0.2)) l(level), (SELECT unnest(range(1, 6)) AS trial)),
q AS (SELECT image_id, level, trial, sum(u * v) / (sqrt(sum(u * u)) * sqrt(sum(v * v))) AS cosine FROM n GROUP BY ALL), m AS (SELECT level, avg(cosine) AS mean, stddev_pop(cosine) AS std FROM q GROUP BY 1) SELECT level, round(mean, 6) AS mean, round(std, 6) AS std, round(avg(mean) OVER (), 6) AS score, avg(mean) OVER () > 0.7 AS passed FROM m"""),
    "f4_impute_scale_clip": (lambda s, d: _scaled(s, d).select(I, "pos", r6("x", "x")), """WITH l AS (SELECT vec_id AS image_id, p AS pos, CASE WHEN (vec_id + p) % 10 <> 0 THEN CAST(embedding[p + 1] AS DOUBLE) END AS x FROM (SELECT *, CAST(unnest(range(64)) AS INTEGER) AS p FROM embeddings)),
m AS (SELECT pos, median(x) AS mid FROM l WHERE image_id % 5 <> 0 GROUP BY 1), f AS (SELECT image_id, pos, coalesce(x, mid) AS x FROM l JOIN m USING (pos)), t AS (SELECT pos, avg(x) AS mu, stddev_pop(x) AS sd FROM f WHERE image_id % 5 <> 0 GROUP BY 1)
SELECT image_id, pos, round((x - mu) / sd, 6) AS x FROM f JOIN t USING (pos)"""),
    "f5_fuse": (_fused, "SELECT vec_id AS image_id, 40 AS n, round(embedding[33]::DOUBLE, 6) AS ninth, round(list_sum(embedding[1:8]::DOUBLE[]) + list_sum(embedding[33:64]::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id % 3 <> 0"),
    "f6_linear_cka": (lambda s, d: features.linear_cka(_halves(s, d)).select("a", "b", r6("cka", "cka")), """WITH x AS (SELECT vec_id AS image_id, CAST(unnest(range(64)) AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), z AS (SELECT image_id, CASE WHEN p < 32 THEN 'low' ELSE 'high' END AS d, p, (x - avg(x) OVER (PARTITION BY p)) / stddev_pop(x) OVER (PARTITION BY p) AS z FROM x),
q AS (SELECT u.d AS a, v.d AS b, u.p AS i, v.p AS j, sum(u.z * v.z) AS q FROM z u JOIN z v USING (image_id) GROUP BY ALL), h AS (SELECT a, b, sum(q * q) AS h FROM q GROUP BY ALL)
SELECT h.a, h.b, round(h.h / sqrt(k.h * l.h), 6) AS cka FROM h JOIN h k ON k.a = h.a AND k.b = h.a JOIN h l ON l.a = h.b AND l.b = h.b"""),
    "f8_group_correlations": (_groups, f"""WITH {BEST}, c AS (SELECT x.descriptor AS a, y.descriptor AS b, round(corr(x.acc, y.acc), 6) AS rho FROM best x JOIN best y ON x.dataset = y.dataset AND x.descriptor < y.descriptor GROUP BY ALL), s AS (SELECT rho, ascii(a) % 2 = ascii(b) % 2 AS same FROM c)
SELECT round(avg(rho) FILTER (WHERE same), 4) AS within_mean, round(stddev_pop(rho) FILTER (WHERE same), 4) AS within_std, count(*) FILTER (WHERE same) AS within_n, round(avg(rho) FILTER (WHERE NOT same), 4) AS between_mean, round(stddev_pop(rho) FILTER (WHERE NOT same), 4) AS between_std, count(*) FILTER (WHERE NOT same) AS between_n, round(avg(rho) FILTER (WHERE same) - avg(rho) FILTER (WHERE NOT same), 4) AS separation FROM s"""),
    "r41_importance_summary": (_importance, """WITH x AS (SELECT vec_id % 5 AS run, CAST(unnest(range(64)) AS INTEGER) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x, label FROM embeddings), i AS (SELECT run, feature, abs(corr(x, label)) AS i FROM x GROUP BY ALL), m AS (SELECT feature, feature // 16 AS category, round(avg(i), 6) AS mean, stddev_pop(i) AS std FROM i GROUP BY ALL),
s AS (SELECT *, mean / sum(mean) OVER () AS share, CAST(row_number() OVER (ORDER BY mean DESC, feature) AS INTEGER) AS rank FROM m) SELECT feature, category, mean, round(std, 5) AS std, round(share, 5) AS share, round(sum(share) OVER (PARTITION BY category), 5) AS category_share, rank FROM s"""),
    "r54_cross_dataset_average": (lambda s, d: vectors.cross_dataset_average(best(s, d), "descriptor").select("descriptor", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n"), f"WITH {BEST} SELECT descriptor, round(avg(acc), 4) AS mean, round(stddev_pop(acc), 4) AS std, count(DISTINCT dataset) AS n FROM best GROUP BY 1"),
    "d21_ph_profile": (_profile, f"""WITH {BARS}, n AS (SELECT image_id, count(*) FILTER (WHERE hdim = 0) AS h0, count(*) FILTER (WHERE hdim = 1) AS h1 FROM bars WHERE death - birth > 0.75 GROUP BY 1), q AS (SELECT label % 3 AS object_type, label, avg(coalesce(h0, 0)) AS h0, avg(coalesce(h1, 0)) AS h1, count(*) AS n FROM embeddings e LEFT JOIN n ON n.image_id = e.vec_id GROUP BY ALL)
SELECT object_type, round(avg(h0), 6) AS h0_mean, round(stddev_pop(h0), 6) AS h0_std, round(avg(h1), 6) AS h1_mean, round(stddev_pop(h1), 6) AS h1_std, round(avg(h0 / h1) FILTER (WHERE h1 > 0), 6) AS ratio, CAST(sum(n) AS BIGINT) AS n_images, coalesce(avg(h0 / h1) FILTER (WHERE h1 > 0) > 5, false) AS h0_dominant FROM q GROUP BY 1"""),
    "d24_extract": (lambda s, d: descriptors.extract_all(views.grids(s, d), {"euler_curve": {"n": 32}, "lbp": {"uniform": False}, "glcm": {}}).select(I, "descriptor", "pos", r6("x", "x")), f"SELECT image_id, 'euler_curve' AS descriptor, k AS pos, CAST(chi AS DOUBLE) AS x FROM ({_pixel['g7_euler_curve']}) UNION ALL SELECT image_id, 'lbp', bin, density FROM ({_pixel['g14_lbp']}) UNION ALL SELECT image_id, 'glcm', CAST(k AS INTEGER), CASE WHEN k = 0 THEN contrast ELSE homogeneity END FROM ({_pixel['g16_glcm']}), (VALUES (0), (1)) q(k)"),
    "k2_params_for": (_params, """WITH e AS (SELECT event_type AS descriptor, 't' || (user_id % 5) AS object_type, user_id, event_id FROM events), a AS (SELECT DISTINCT descriptor, object_type, user_id % 2 = 0 AS per_channel FROM e), r AS (SELECT descriptor, object_type, count(*) AS k FROM e WHERE object_type <> 't4' GROUP BY ALL), z AS (SELECT descriptor, count(*) AS k FROM e GROUP BY 1), t AS (SELECT descriptor, object_type, count(*) AS k FROM e WHERE descriptor IN ('click', 'view') AND event_id % 2 = 0 GROUP BY ALL)
SELECT a.descriptor, a.object_type, per_channel, (coalesce(t.k, r.k, z.k) % 100 + 10) * CASE WHEN per_channel THEN 3 ELSE 1 END AS dim, CAST(coalesce(r.k % 7, z.k % 5) AS VARCHAR) AS bins, CAST(coalesce(t.k % 11, r.k % 3) AS VARCHAR) AS sigma FROM a LEFT JOIN r USING (descriptor, object_type) LEFT JOIN t USING (descriptor, object_type) JOIN z ON z.descriptor = a.descriptor"""),
    "k3_classifier_rule": (lambda s, d: read(s, d, "events").select("event_id", rules.classifier_rule(F.col("event_type"), F.col("user_id"), ALWAYS, 100, "boosted", "linear").alias("classifier")), "SELECT event_id, CASE WHEN event_type = 'click' THEN 'tabpfn' WHEN event_type IN ('error', 'view') THEN 'forest' WHEN user_id > 100 THEN 'boosted' ELSE 'linear' END AS classifier FROM events"),
    "k4_color_mode": (_mode, f"SELECT doc_id, CASE {_case('CASE WHEN doc_id % 2 = 0 THEN lower(source) END')} WHEN doc_id % 3 = 2 THEN 'per_channel' WHEN doc_id % 3 = 1 THEN 'grayscale' {_inside} ELSE 'grayscale' END AS mode FROM documents"),
    "k12_reflect_gate": (lambda s, d: read(s, d, "conversations").select("conv_id", "turn", rules.reflect_gate(F.coalesce(F.col("text").contains("a"), F.lit(False)), F.col("turn"), 4 - F.col("turn")).alias("gate")), "SELECT conv_id, turn, CASE WHEN coalesce(contains(text, 'a'), false) AND turn < 2 AND 4 - turn > 0 THEN 'retry' ELSE 'complete' END AS gate FROM conversations"),
}
