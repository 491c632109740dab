"""Registered queries over learned rules, dataset characteristics and meta-learners, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import descriptors, pipelines
from lattica.functions.tables import r6, read
from lattica.operators import characteristics, correlation, evaluation, meta, persistence, rule_fit
from lattica.operators.pixels import LAPLACE, convolve, gaussian
from lattica.plans.homology_queries import alive_sql
from lattica.plans.pixel_queries import GRAD, OTSU, RGB, _conv
from lattica.plans.result_queries import B, best
from lattica.sources import views
from lattica.sources.diagrams import STORED, content_key
from lattica.sources.views import GRIDS, minmax_normalize
from lattica.streaming.diagrams import image_stream, stream_diagrams

TARGETS, DEFAULT = ["click", "view", "error"], "purchase"
#: The hybrid mode: features that a target's rule may use.
DOMAINS = {"click": ["clicks", "mean_value", "users"], "view": ["n", "night", "top_value"], "error": ["mean_value", "night", "users"]}


def features(s, d):
    """features(dataset, feature, x): whole numbers about the events of each dataset."""
    e = read(s, d, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 26).cast("string")).alias("dataset"), "user_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("h"))
    count = lambda c: F.sum(c.cast("int")).cast("double")
    wide = e.groupBy("dataset").agg(
        F.expr("(sum(h) * 10000) div count(h)").cast("double").alias("mean_value"),
        F.count("*").cast("double").alias("n"),
        F.countDistinct("user_id").cast("double").alias("users"),
        F.max("h").cast("double").alias("top_value"),
        count(F.hour("ts") < 6).alias("night"),
        count(F.col("event_type") == "click").alias("clicks"),
    )
    names = [c for c in wide.columns if c != "dataset"]
    return wide.unpivot("dataset", names, "feature", "x")


FEATURES = """ev AS (SELECT 'd' || (user_id % 26) AS dataset, user_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS h FROM events),
wide AS (SELECT dataset, CAST(sum(h) * 10000 // count(h) AS DOUBLE) AS mean_value, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, CAST(max(h) AS DOUBLE) AS top_value,
 CAST(count(*) FILTER (WHERE hour(ts) < 6) AS DOUBLE) AS night, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS clicks FROM ev GROUP BY 1),
long AS (UNPIVOT wide ON mean_value, n, users, top_value, night, clicks INTO NAME feature VALUE x),
won AS (SELECT dataset, descriptor AS winner, acc AS winner_acc FROM best QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, descriptor) = 1)"""


def rules_sql(domains: dict[str, list[str]] | None) -> str:
    """CTEs rules(g, rule, target, f1, s1, t1, f2, s2, t2, accuracy) from fe(g, dataset, feature, x) and wi(g, dataset, winner)."""
    out = []
    holds = lambda x, s, t: f"CASE WHEN {s} = '>=' THEN {x} >= {t} ELSE {x} < {t} END"
    for k, target in enumerate(TARGETS, 1):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM in{j} c WHERE c.g = wi.g AND c.dataset = wi.dataset)" for j in range(1, k))
        may = " WHERE feature IN (" + ", ".join(f"'{f}'" for f in domains[target]) + ")" if domains else ""
        hits = "sum(y) + any_value(n) - any_value(targets) - (count(*) - sum(y))"
        out.append(f"""free{k} AS MATERIALIZED (SELECT g, dataset, CAST(winner = '{target}' AS INTEGER) AS y FROM wi WHERE true{free}),
size{k} AS MATERIALIZED (SELECT g, count(*) AS n, sum(y) AS targets FROM free{k} GROUP BY 1 HAVING sum(y) > 0),
rows{k} AS MATERIALIZED (SELECT g, dataset, feature, x, y FROM fe JOIN free{k} USING (g, dataset){may}),
mid{k} AS (SELECT g, feature, (x + lead(x) OVER (PARTITION BY g, feature ORDER BY x)) / 2 AS t FROM (SELECT DISTINCT g, feature, x FROM rows{k})),
taken{k} AS MATERIALIZED (SELECT r.g, r.dataset, r.y, m.feature AS f, side AS s, t, n, targets FROM mid{k} m JOIN size{k} USING (g) JOIN rows{k} r ON r.g = m.g AND r.feature = m.feature, (VALUES ('>='), ('<')) v(side) WHERE t IS NOT NULL AND {holds("r.x", "side", "t")}),
one{k} AS MATERIALIZED (SELECT g, f, s, t, {hits} AS hits, any_value(n) AS n FROM taken{k} GROUP BY g, f, s, t QUALIFY row_number() OVER (PARTITION BY g ORDER BY hits DESC, f, t, s DESC) = 1),
two{k} AS MATERIALIZED (SELECT g, f1, s1, t1, f2, s2, t2, {hits} AS hits FROM (SELECT a.g, a.f AS f1, a.s AS s1, a.t AS t1, b.f AS f2, b.s AS s2, b.t AS t2, a.y, a.n, a.targets FROM taken{k} a JOIN taken{k} b ON a.g = b.g AND a.dataset = b.dataset AND a.f < b.f WHERE a.targets >= 2) GROUP BY g, f1, s1, t1, f2, s2, t2
 QUALIFY row_number() OVER (PARTITION BY g ORDER BY hits DESC, f1, t1, s1 DESC, f2, t2, s2 DESC) = 1),
rule{k} AS MATERIALIZED (SELECT o.g, {k} AS rule, '{target}' AS target, CASE WHEN w.hits > o.hits THEN f1 ELSE o.f END AS f1, CASE WHEN w.hits > o.hits THEN s1 ELSE o.s END AS s1, CASE WHEN w.hits > o.hits THEN t1 ELSE o.t END AS t1,
 CASE WHEN w.hits > o.hits THEN f2 END AS f2, CASE WHEN w.hits > o.hits THEN s2 END AS s2, CASE WHEN w.hits > o.hits THEN t2 END AS t2, greatest(o.hits, coalesce(w.hits, 0)) / n AS accuracy FROM one{k} o LEFT JOIN two{k} w USING (g) WHERE 2 * greatest(o.hits, coalesce(w.hits, 0)) > n),
in{k} AS MATERIALIZED (SELECT r.g, a.dataset FROM rule{k} r JOIN fa a ON a.g = r.g AND a.feature = r.f1 LEFT JOIN fa b ON b.g = a.g AND b.dataset = a.dataset AND b.feature = r.f2 WHERE {holds("a.x", "s1", "t1")} AND (f2 IS NULL OR {holds("b.x", "s2", "t2")}))""")
    return ",\n".join(out) + ",\nrules AS (" + " UNION ALL ".join(f"SELECT * FROM rule{k}" for k in range(1, len(TARGETS) + 1)) + ")"


def _fit(domains):
    def run(s, d):
        f, w = features(s, d), best(s, d)
        w = w.withColumn("k", F.row_number().over(rule_fit.Window.partitionBy("dataset").orderBy(F.desc("acc"), "descriptor"))).where("k = 1")
        one = F.lit("all").alias("g")
        rules = rule_fit.fit_rules(f.select(one, "*"), w.select(one, "dataset", F.col("descriptor").alias("winner")), TARGETS, domains)
        at = lambda k, c: F.get(F.col("conditions"), k)[c].alias(f"{c[0]}{k + 1}")
        return rules.select("rule", "target", *[at(k, c) for k in (0, 1) for c in ("feature", "side", "threshold")], F.round("accuracy", 6).alias("accuracy"))

    sql = f"""{B}, {FEATURES}, fe AS MATERIALIZED (SELECT 'all' AS g, * FROM long), fa AS (SELECT * FROM fe), wi AS MATERIALIZED (SELECT 'all' AS g, dataset, winner FROM won),
{rules_sql(domains)}
SELECT rule, target, f1, s1, t1, f2, s2, t2, round(accuracy, 6) AS accuracy FROM rules"""
    return run, sql


def _lodo(domains):
    def run(s, d):
        return rule_fit.lodo_rules(features(s, d), best(s, d).select("dataset", "descriptor", "acc"), TARGETS, DEFAULT, domains)

    sql = f"""{B}, {FEATURES}, fa AS MATERIALIZED (SELECT o.dataset AS g, f.* FROM won o, long f), fe AS MATERIALIZED (SELECT * FROM fa WHERE g <> dataset), wi AS MATERIALIZED (SELECT o.dataset AS g, w.dataset, w.winner FROM won o JOIN won w ON o.dataset <> w.dataset),
{rules_sql(domains)},
hit AS (SELECT g, min_by(target, rule) AS target FROM (SELECT g, dataset, 1 AS rule, '{TARGETS[0]}' AS target FROM in1 UNION ALL SELECT g, dataset, 2, '{TARGETS[1]}' FROM in2 UNION ALL SELECT g, dataset, 3, '{TARGETS[2]}' FROM in3) WHERE g = dataset GROUP BY 1),
ch AS (SELECT dataset, coalesce(target, '{DEFAULT}') AS choice, winner, winner_acc FROM won LEFT JOIN hit ON hit.g = won.dataset),
mean AS (SELECT dataset, floor(sum(CAST(round(acc * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS mean FROM best GROUP BY 1)
SELECT ch.dataset, choice, winner, coalesce(b.acc, mean) AS choice_acc, winner_acc, round(winner_acc - coalesce(b.acc, mean), 6) AS regret, choice = winner AS hit FROM ch JOIN mean USING (dataset) LEFT JOIN best b ON b.dataset = ch.dataset AND b.descriptor = choice"""
    return run, sql


def _members(s, d):
    """Five datasets of images, their labels as classes."""
    return read(s, d, "embeddings").select(F.concat(F.lit("d"), (F.col("vec_id") % 5).cast("string")).alias("dataset"), F.col("vec_id").alias("image_id"), "label")


def _rounded(df):
    return df.select("dataset", *[r6(c, c) for c in characteristics.NAMES])


NEAR = "abs(p.r - q.r) + abs(p.c - q.c) = 1"
IMAGES = f"""{GRIDS}, {OTSU}, {GRAD}, maskm AS MATERIALIZED (SELECT * FROM mask),
reach AS (SELECT image_id, fg, r, c, r * 8 + c AS start FROM maskm UNION SELECT p.image_id, p.fg, p.r, p.c, q.start FROM reach q JOIN maskm p ON p.image_id = q.image_id AND p.fg = q.fg AND {NEAR}),
lab AS (SELECT image_id, fg, r, c, min(start) AS label FROM reach GROUP BY ALL),
parts AS (SELECT image_id, fg, label, count(*) AS size, max(CAST(r IN (0, 7) OR c IN (0, 7) AS INTEGER)) AS edge FROM lab GROUP BY ALL),
comp AS (SELECT image_id, count(*) FILTER (WHERE fg = 1) AS n_comp, greatest(0, count(*) FILTER (WHERE fg = 0) - 1) AS holes, coalesce(sum(size) FILTER (WHERE fg = 1), 0) AS area, coalesce(sum(size * size) FILTER (WHERE fg = 1), 0) AS squares,
 coalesce(max(size) FILTER (WHERE fg = 1), 0) AS big, coalesce(sum(size) FILTER (WHERE fg = 0 AND edge = 0), 0) AS inside FROM parts GROUP BY 1),
sides AS (SELECT image_id, avg(v) FILTER (WHERE fg = 1) - avg(v) FILTER (WHERE fg = 0) AS gap FROM maskm GROUP BY 1),
edges AS (SELECT image_id, max(mean) AS gradient_mean, avg(CAST(m > 2 * mean AND mean > 0 AS INTEGER)) AS edge_density FROM (SELECT image_id, sqrt(gx * gx + gy * gy) AS m, avg(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY image_id) AS mean FROM grad) GROUP BY 1),
q8 AS (SELECT image_id, r, c, least(CAST(floor(v * 8) AS INTEGER), 7) AS q FROM grids),
tex AS (SELECT a.image_id, avg(power(a.q - b.q, 2)) AS con, avg(1 / (1 + abs(a.q - b.q))) AS hom FROM q8 a JOIN q8 b ON a.image_id = b.image_id AND a.r = b.r AND b.c = a.c + 1 GROUP BY 1),
waves AS (SELECT a.k AS i, b.k AS j FROM (SELECT unnest(range(8)) AS k) a, (SELECT unnest(range(8)) AS k) b),
fourier AS (SELECT image_id, i, j, sqrt(power(sum(v * cos(-2 * pi() * (r * i + c * j) / 8)), 2) + power(sum(v * sin(-2 * pi() * (r * i + c * j) / 8)), 2)) AS a FROM grids, waves GROUP BY ALL),
low AS (SELECT image_id, sum(a) FILTER (WHERE power(CASE WHEN i > 3 THEN i - 8 ELSE i END, 2) + power(CASE WHEN j > 3 THEN j - 8 ELSE j END, 2) <= 1) / sum(a) AS ratio FROM fourier GROUP BY 1),
lap AS (SELECT image_id, var_pop(v) AS lap FROM ({_conv(LAPLACE)}) GROUP BY 1),
img AS MATERIALIZED (SELECT *, CASE WHEN area > 0 THEN (area + inside) / area ELSE 0 END AS fill, CASE WHEN area > 0 THEN big / area ELSE 0 END AS largest, coalesce(abs(gap), 0) AS contrast, coalesce(CASE WHEN gap > 0 THEN 1 WHEN gap IS NOT NULL THEN -1 END, 0) AS polarity
 FROM comp JOIN sides USING (image_id) JOIN edges USING (image_id) LEFT JOIN tex USING (image_id) JOIN low USING (image_id) JOIN lap USING (image_id))"""


def _characteristics_sql(sample: str, last: str) -> str:
    """The 25 values for each (dataset, rep) of a sample."""
    return f"""WITH RECURSIVE {IMAGES}, members AS (SELECT 'd' || (vec_id % 5) AS dataset, vec_id AS image_id, label FROM embeddings), sample AS MATERIALIZED ({sample}),
cls AS (SELECT dataset, sum(n) AS n, count(*) AS k, max(n) / min(n) AS imbalance FROM (SELECT dataset, label, count(*) AS n FROM members GROUP BY ALL) GROUP BY 1),
px AS MATERIALIZED (SELECT dataset, rep, v FROM grids JOIN sample USING (image_id)), mid AS (SELECT dataset, rep, avg(v) AS mu FROM px GROUP BY ALL),
mom AS (SELECT dataset, rep, any_value(mu) AS mu, avg(power(v - mu, 2)) AS m2, avg(power(v - mu, 3)) AS m3, avg(power(v - mu, 4)) AS m4, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS spread FROM px JOIN mid USING (dataset, rep) GROUP BY ALL),
his AS (SELECT dataset, rep, least(CAST(floor(v * 256) AS INTEGER), 255) AS bin, count(*) AS n FROM px GROUP BY ALL), ent AS (SELECT dataset, rep, -sum(p * log2(p)) AS h FROM (SELECT dataset, rep, n / sum(n) OVER (PARTITION BY dataset, rep) AS p FROM his) GROUP BY ALL),
pool AS (SELECT dataset, rep, avg(n_comp) AS comps, 1 / (1 + stddev_pop(n_comp) / greatest(avg(n_comp), 1e-10)) AS stability, sum(area) / sum(n_comp) AS size, sqrt(greatest(sum(squares) / sum(n_comp) - power(sum(area) / sum(n_comp), 2), 0)) / (sum(area) / sum(n_comp)) AS cv,
 avg(edge_density) AS edge_density, avg(gradient_mean) AS gradient_mean, avg(holes) AS holes, avg(fill) AS fill, avg(con) AS con, avg(hom) AS hom, avg(ratio) AS ratio, avg(contrast) AS contrast, avg(polarity) AS polarity, avg(largest) AS largest, avg(lap) AS lap FROM img JOIN sample USING (image_id) GROUP BY ALL),
out AS (SELECT dataset, rep, CAST(n AS DOUBLE) AS n_samples, CAST(k AS DOUBLE) AS n_classes, n / k AS samples_per_class, imbalance AS class_imbalance, mu AS intensity_mean, sqrt(m2) AS intensity_std, m3 / power(m2, 1.5) AS intensity_skewness, m4 / (m2 * m2) - 3 AS intensity_kurtosis, spread AS intensity_p95_p5, h AS intensity_entropy,
 edge_density, gradient_mean, comps AS otsu_components, holes AS otsu_holes, fill AS binary_fill_ratio, con AS glcm_contrast, hom AS glcm_homogeneity, ratio AS fft_low_freq_ratio, stability AS otsu_stability, size AS component_size_mean, cv AS component_size_cv, contrast AS fg_bg_contrast, polarity, largest AS largest_component_ratio, lap AS laplacian_variance
 FROM mom JOIN ent USING (dataset, rep) JOIN pool USING (dataset, rep) JOIN cls USING (dataset))
{last}"""


ALL_IMAGES = "SELECT dataset, 0 AS rep, image_id FROM members"
DRAWN = "SELECT dataset, rep, image_id FROM members, (SELECT unnest(range(3)) AS rep) QUALIFY row_number() OVER (PARTITION BY dataset, rep ORDER BY md5((42 + 1000 * rep) || ':' || image_id), image_id) <= 40"
EACH = ", ".join(f"round({c}, 6) AS {c}" for c in characteristics.NAMES)
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in characteristics.NAMES)

def _rows(s, d):
    return meta.design(features(s, d), best(s, d).select("dataset", "descriptor", "acc"), ["click", "error", "purchase", "signup", "view"])


def _predicted(f):
    def run(s, d):
        got = f(_rows(s, d))
        return got.select("dataset", "descriptor", *[r6(c, c) for c in got.columns if c not in ("dataset", "descriptor")])

    return run


def _vectors(s, d):
    """Vectors of three descriptors of the grids: each is put together where its images lie, before they come below one another."""
    size = {"euler_curve": 16, "lbp": 10, "minkowski": 30}
    g = views.grids(s, d, dealt=True)
    long = [descriptors.extract(n, g, **given).groupBy("image_id", "descriptor") for n, given in (("euler_curve", {"n": 16}), ("lbp", {}), ("minkowski", {}))]
    place = lambda k: F.coalesce(F.max(F.when(F.col("pos") == k, F.col("x"))), F.lit(0.0))
    return reduce(DataFrame.unionByName, [one.agg(F.array(*map(place, range(n))).alias("vec")) for one, n in zip(long, size.values())])


def _parts(s, d):
    """Three descriptors whose components are given: places of a vector, in other orders and coarser."""
    x = read(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "x")).where("pos < 12")
    x = x.select("image_id", F.element_at(F.array(F.lit("p"), F.lit("q"), F.lit("r")), F.floor(F.col("pos") / 4).cast("int") + 1).alias("descriptor"), (F.col("pos") % 4).alias("k"), F.col("x").cast("double").alias("x"))
    return x.withColumn("x", F.when(F.col("descriptor") == "r", F.round(F.floor(F.col("x") * 10) / 10, 1)).otherwise(F.col("x")))


CORRELATION = """WITH p0 AS (SELECT vec_id AS image_id, CAST(unnest(range(12)) AS INTEGER) AS pos, CAST(unnest(embedding[1:12]) AS DOUBLE) AS y FROM embeddings),
parts AS (SELECT image_id, CASE pos // 4 WHEN 0 THEN 'p' WHEN 1 THEN 'q' ELSE 'r' END AS descriptor, pos % 4 AS k, CASE WHEN pos // 4 = 2 THEN round(floor(y * 10) / 10, 1) ELSE y END AS x FROM p0),
ranks AS (SELECT *, rank() OVER (PARTITION BY descriptor, k ORDER BY x) + (count(*) OVER (PARTITION BY descriptor, k, x) - 1) / 2 AS r FROM parts),
c AS (SELECT a.descriptor AS a, b.descriptor AS b, a.k, abs(corr(a.x, b.x)) AS p, abs(corr(a.r, b.r)) AS s FROM ranks a JOIN ranks b ON a.image_id = b.image_id AND a.k = b.k AND a.descriptor <> b.descriptor GROUP BY ALL)
SELECT a, b, round(avg(p), 6) AS pearson, round(avg(s), 6) AS spearman, count(*) AS n FROM c GROUP BY ALL"""


def _letters(s, d):
    """(id, fold, label, vec): how often each letter stands in a document, and its language."""
    t = read(s, d, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("t"), "lang")
    share = [(F.length("t") - F.length(F.replace("t", F.lit(c)))) / F.greatest(F.length("t"), F.lit(1)) for c in "abcdefghijklmnopqrstuvwxyzäöüßéèàçñóí"]
    label = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1
    return t.select("id", (F.col("id") % 3).alias("fold"), label.cast("int").alias("label"), F.array(*share).alias("vec")).where("label >= 0")


def _taught(name):
    def run(s, d):
        return evaluation.fold_report(evaluation.cross_validate(_letters(s, d), evaluation.classifier(name, 37, 4), 3))

    return run


def _subspaces(s, d):
    """Words hashed to 2600 places, which are too many for one model."""
    t = read(s, d, "documents").where("lang in ('de', 'en', 'es', 'fr')")
    words = t.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("fold"), (F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1).cast("int").alias("label"), F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+").alias("words"))
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=2600, binary=True).transform(words).select("id", "fold", "label", F.col("tf").alias("features"))
    return evaluation.fold_report(evaluation.cross_validate_subspaces(hashed, "logistic", 2600, 4, 2))


def _stream(s, d):
    """The images as a stream into a fresh store, and the bars alive in what it holds."""
    top = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir") + "/.scratch"
    top = f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"
    g = views.grids(s, d).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda p: p["v"]).alias("pixels")).select("image_id", "pixels", F.lit(8).alias("width"))
    g.write.parquet(f"{top}/images")
    images = s.read.parquet(f"{top}/images")
    stream_diagrams(image_stream(s, f"{top}/images", images.schema), f"{top}/store", f"{top}/mark").awaitTermination()
    held = s.read.schema(STORED).parquet(f"{top}/store")
    keyed = images.select("image_id", content_key(F.col("pixels"), F.col("width"), "sublevel").alias("content"))
    return persistence.alive(keyed.join(held, "content").drop("content"), 9)


def _pipeline(f):
    return lambda s, d: f(views.grids(s, d)).select("image_id", "part", "pos", r6("x", "x"))


SCALARS = f"""WITH {GRIDS}, smooth AS ({_conv(gaussian(1.0))}), m AS (SELECT image_id, r, c, CAST(v > 0.5 AS INTEGER) AS fg FROM smooth),
w AS (SELECT image_id, fg, coalesce(lead(fg) OVER a, 0) AS x, coalesce(lead(fg) OVER b, 0) AS y, r, c FROM m WINDOW a AS (PARTITION BY image_id, r ORDER BY c), b AS (PARTITION BY image_id, c ORDER BY r)),
z AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY image_id, r ORDER BY c), 0) AS xy FROM w), e AS (SELECT image_id, CAST(sum(fg - fg * x - fg * y + fg * x * y * xy) AS DOUBLE) AS chi FROM z GROUP BY 1),
o AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS std, avg(CAST(v > 0.5 AS DOUBLE)) AS share FROM grids GROUP BY 1)
SELECT image_id, 'euler' AS part, 0 AS pos, chi AS x FROM e UNION ALL SELECT image_id, 'image_mean', 0, round(mean, 6) FROM o UNION ALL SELECT image_id, 'image_std', 0, round(std, 6) FROM o UNION ALL SELECT image_id, 'foreground_ratio', 0, round(share, 6) FROM o"""

RGB_EULER = f"""WITH {RGB}, ch AS (SELECT image_id, 0 AS ch, r, c, of_r AS x FROM rgb UNION ALL SELECT image_id, 1, r, c, of_g FROM rgb UNION ALL SELECT image_id, 2, r, c, of_b FROM rgb),
n AS (SELECT image_id, ch, r, c, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS v FROM ch WINDOW w AS (PARTITION BY image_id, ch)),
cell AS (SELECT image_id, ch, r * 2 + a AS y, c * 2 + b AS x, 1 - 2 * ((a + b) % 2) AS sign, min(v) AS entry FROM n, (VALUES (0), (1), (2)) p(a), (VALUES (0), (1), (2)) q(b) GROUP BY ALL),
e AS (SELECT image_id, ch, k, coalesce(sum(sign) FILTER (WHERE floor(entry * 7) + 1 <= k), 0) AS chi FROM cell, (SELECT unnest(range(8)) AS k) GROUP BY ALL)
SELECT image_id, count(*) AS n, CAST(sum(chi) AS DOUBLE) AS total, CAST(sum(chi * (ch * 8 + k)) AS DOUBLE) AS moment FROM e GROUP BY 1"""
QUERIES = {
    "d25_statistics": (_pipeline(pipelines.statistics_pipeline), None),
    "d25_landscapes": (_pipeline(pipelines.landscape_pipeline), None),
    "d25_curves": (_pipeline(pipelines.curves_pipeline), None),
    "d25_scalars": (_pipeline(lambda g: pipelines.scalars(g, convolve(g, gaussian(1.0)))), SCALARS),
    "d24_rgb_euler": (lambda s, d: descriptors.extract("euler_curve", minmax_normalize(views.rgb_grids(s, d), "image_id", "channel"), "per_channel", n=8).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("x")).alias("total"), F.sum(F.col("x") * F.col("pos")).alias("moment")), RGB_EULER),
    "r40_meta_ridge": (_predicted(meta.ridge_lodo), None),
    "r40_meta_boosted": (_predicted(lambda rows: meta.boosted_lodo(rows, 6, 2)), None),
    "r40_meta_forest": (_predicted(lambda rows: meta.forest_lodo(rows, 8, 4)), None),
    "f7_correlation": (lambda s, d: correlation.descriptor_correlation(_parts(s, d)).select("a", "b", r6("pearson", "pearson"), r6("spearman", "spearman"), "n"), CORRELATION),
    "f7_principal": (lambda s, d: correlation.descriptor_correlation(correlation.components(_vectors(s, d), 10)).select("a", "b", r6("pearson", "pearson"), r6("spearman", "spearman"), "n"), None),
    "f12_subspaces": (_subspaces, None),
    "m4_boosted": (_taught("boosted"), None),
    "m4_perceptron": (_taught("perceptron"), None),
    "m4_one_vs_rest": (_taught("one_vs_rest"), None),
    "t4_stream_diagrams": (_stream, alive_sql(GRIDS, "grids", 9)),
    "e1_characteristics": (lambda s, d: _rounded(characteristics.dataset_characteristics(views.grids(s, d), _members(s, d))), _characteristics_sql(ALL_IMAGES, f"SELECT dataset, {EACH} FROM out")),
    "e2_stable": (lambda s, d: _rounded(characteristics.stable_characteristics(views.grids(s, d), _members(s, d), 3, 40)), _characteristics_sql(DRAWN, f"SELECT dataset, {MEANS} FROM out GROUP BY 1")),
    "r34_fit_rules": _fit(None),
    "r34_fit_rules_hybrid": _fit(DOMAINS),
    "r36_lodo_rules": _lodo(None),
    "r36_lodo_rules_hybrid": _lodo(DOMAINS),
}
