"""Registered queries over folds, neighbours, verdicts and channels, and further diagram summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import r6, read
from lattica.operators import diagram, evaluation, features, persistence, scoring
from lattica.plans.diagram_queries import BARS, bars
from lattica.plans.diagram_queries import QUERIES as DIAGRAMS
from lattica.plans.pixel_queries import QUALITY, RGB
from lattica.sources import views
from lattica.sources.views import PREDICTIONS

I = "image_id"
K = [I, "hdim"]


def _vectors(s, d):
    e = read(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def _predictions(s, d):
    p = views.predictions(s, d)
    return p.withColumn("confidence", F.when(F.col("fold") != 0, (F.col("doc_id") % 50 + 50) / 100.0))


def _class_scores(s, d):
    return evaluation.class_scores(views.predictions(s, d)).select("fold", "class", "support", r6("recall", "recall"), r6("f1", "f1"))


def _fold_report(s, d):
    got = evaluation.fold_report(_predictions(s, d))
    return got.select("fold", *[r6(c, c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "confidence")])


def _cross_validated(name):
    def run(s, d):
        rows = scoring.stratified_folds(_vectors(s, d), "label", "id")
        return evaluation.fold_report(evaluation.cross_validate(rows, evaluation.classifier(name, 64, 10)))

    return run


def _knn(s, d):
    got = evaluation.knn_report(_vectors(s, d), _vectors(s, d))
    return got.select("id", "label", "pred", r6("confidence", "confidence"), r6("weighted", "weighted"), F.array_join("neighbours", ",").alias("neighbours"))


def _verdict(s, d):
    group = F.concat(F.lit("L"), (F.col("label") % 3).cast("string")).alias("descriptor")
    q = features.feature_quality(_vectors(s, d).withColumnRenamed("id", I)).select(I, r6("sparsity", "sparsity"), r6("variance", "variance"))
    q = q.join(views.image_labels(s, d), I).select(I, group, "sparsity", "variance")
    at = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 6)
    expected = q.groupBy("descriptor").agg(
        at("sparsity", 0.25).alias("sparsity_low"), at("sparsity", 0.75).alias("sparsity_high"),
        at("variance", 0.25).alias("variance_low"), at("variance", 0.75).alias("variance_high"), at("sparsity", 0.9).alias("warning"),
    )
    return evaluation.quality_verdict(q, expected)


def _row_means(grid):
    m = grid.groupBy(I, "r").agg(F.avg("v").alias("m"))
    return m.groupBy(I).agg(F.array_sort(F.collect_list(F.struct("r", "m"))).alias("x")).select(I, F.col("x.m").alias("vec"))


def _channels(s, d):
    got = evaluation.concat_channels(evaluation.by_channel(views.rgb_grids(s, d), _row_means))
    return got.select(I, F.posexplode("vec").alias("pos", "value")).select(I, "pos", r6("value", "value"))


def _compared(s, d):
    b = bars(s, d)
    late = b.where(F.col(I) % 7 != 0).unionByName(b.where((F.col(I) % 7 == 0) & (F.col("birth") > 0)))
    moved = late.withColumn("death", F.when(F.col(I) % 2 == 0, F.col("death") + 0.125).otherwise(F.col("death")))
    return persistence.compare_diagrams(b, moved).select(*K, "same_count", r6("max_diff", "max_diff"), r6("exact", "exact"))


def _essential(s, d):
    """Bars that reach the image's greatest value never die."""
    return bars(s, d).withColumn("death", F.when(F.col("death") < 1, F.col("death")))


def _image_qc(s, d):
    image = diagram.persistence_image(bars(s, d)).withColumn("value", F.round("value", 6))
    got = diagram.persistence_image_qc(bars(s, d), image, views.image_labels(s, d))
    return got.select(I, *[r6(c, c) for c in ("nonzero_ratio", "dominant_scale", "mean_persistence")], "low_persistence", "empty")


def _pilot(s, d):
    got = diagram.pilot_statistics(bars(s, d), views.image_labels(s, d))
    return got.select(I, F.posexplode("vec").alias("pos", "value")).select(I, "pos", r6("value", "value"))


def _centers(s, d):
    x = bars(s, d).withColumn("p", F.col("death") - F.col("birth"))
    return x.groupBy((F.col(I) % 4).cast("int").alias("k")).agg(F.avg("birth").alias("cx"), F.avg("p").alias("cy"))


def _codebook(s, d):
    return diagram.codebook_transform(bars(s, d), _centers(s, d)).select(*K, "k", "n", r6("value", "value"))


def _codebook_fitted(s, d):
    b = bars(s, d)
    return diagram.codebook_transform(b, diagram.codebook_fit(b)).select(*K, "k", "n", r6("value", "value"))


def _labels(s, d):
    return read(s, d, "embeddings").select("vec_id", "label")


def _matched(s, d):
    k = F.col("doc_id") % 6
    told = F.when(k == 0, F.concat(F.lit("Class_"), (F.col("doc_id") % 5).cast("string"))).when(k == 1, F.concat(F.lit("it is class  "), (F.col("doc_id") % 4).cast("string")))
    told = told.when(k == 2, "ng").when(k == 3, F.concat(F.lit(" "), F.upper("lang"))).when(k == 4, "In French?").otherwise("none")
    return scoring.match_label(read(s, d, "documents").select(F.col("doc_id").alias("id"), told.alias("text")), CLASS_NAMES, either_way=True)


CLASS_NAMES = ["English", "French", "de"]
RANKED = "r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS k FROM embeddings)"
_names = " ".join(f"WHEN t = '{x.lower()}' THEN {k}" for k, x in enumerate(CLASS_NAMES)) + " " + " ".join(f"WHEN contains(t, '{x.lower()}') OR contains('{x.lower()}', t) THEN {k}" for k, x in enumerate(CLASS_NAMES))

PREDS = f"{PREDICTIONS}, sure AS (SELECT *, CASE WHEN fold <> 0 THEN (doc_id % 50 + 50) / 100.0::DOUBLE END AS confidence FROM preds)"
CLASSES = f"""{PREDS}, t AS (SELECT fold, truth AS class, count(*) AS support, count(*) FILTER (WHERE truth = pred) AS tp FROM preds GROUP BY ALL), m AS (SELECT fold, pred AS class, count(*) AS predicted FROM preds GROUP BY ALL),
j AS (SELECT fold, class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM t FULL JOIN m USING (fold, class)),
s AS (SELECT fold, class, support, tp, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, 2 * tp / (support + predicted) AS f1 FROM j)"""
PILOT = ["avg(p)", "stddev_pop(p)", "quantile_cont(p, 0.5)", "quantile_cont(p, 0.25)", "quantile_cont(p, 0.75)", "max(p) - min(p)", "min(p)", "max(p)", "count(*)", "sum(p)", "avg(birth)", "stddev_pop(birth)", "avg(death)", "stddev_pop(death)", "-sum(q * ln(q + 1e-10))"]
SCALED = """x AS (SELECT vec_id AS id, label, CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1),
z AS (SELECT id, label, list((x - m) / s ORDER BY pos) AS vec FROM x JOIN st USING (pos) GROUP BY ALL)"""

QUERIES = {
    "m1_equal_sample": (lambda s, d: scoring.equal_sample(_labels(s, d), "label", "vec_id", 103), f"WITH {RANKED}, q AS (SELECT label, 103 // count(*) OVER () + (row_number() OVER (ORDER BY label) <= 103 % count(*) OVER ())::INT AS quota FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, label FROM r JOIN q USING (label) WHERE k <= quota"),
    "m1_proportional_sample": (lambda s, d: scoring.proportional_sample(_labels(s, d), "label", "vec_id", 103), f"WITH {RANKED}, q AS (SELECT label, greatest(1, CAST(round_even(count(*) / sum(count(*)) OVER () * 103, 0) AS INTEGER)) AS quota FROM embeddings GROUP BY 1) SELECT vec_id, label FROM r JOIN q USING (label) ORDER BY k <= quota DESC, md5('42:' || vec_id), vec_id LIMIT 103"),
    "m10_match_either_way": (_matched, f"""WITH x AS (SELECT doc_id AS id, lower(trim(CASE doc_id % 6 WHEN 0 THEN 'Class_' || (doc_id % 5) WHEN 1 THEN 'it is class  ' || (doc_id % 4) WHEN 2 THEN 'ng' WHEN 3 THEN ' ' || coalesce(lang, '') WHEN 4 THEN 'In French?' ELSE 'none' END)) AS t FROM documents)
SELECT id, CAST(CASE {_names} WHEN TRY_CAST(regexp_extract(t, 'class[_\\s]*([0-9]+)', 1) AS INTEGER) < 3 THEN TRY_CAST(regexp_extract(t, 'class[_\\s]*([0-9]+)', 1) AS INTEGER) ELSE -1 END AS INTEGER) AS label FROM x"""),
    "m4_forest": (_cross_validated("forest"), None),
    "m4_logistic": (_cross_validated("logistic"), None),
    "m5_knn_report": (_knn, f"""WITH {SCALED}, p AS (SELECT a.id, a.label, b.id AS id2, b.label AS label2, round(list_distance(a.vec, b.vec), 9) AS d FROM z a JOIN z b ON a.id <> b.id), n AS (SELECT *, 1 / (d + 1e-6) AS w FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, id2) <= 5),
v AS (SELECT id, label, label2, count(*) AS n, sum(w) AS w FROM n GROUP BY ALL), tot AS (SELECT id, sum(w) AS w, string_agg(CAST(id2 AS VARCHAR), ',' ORDER BY d, id2) AS neighbours FROM n GROUP BY 1)
SELECT v.id, v.label, label2 AS pred, round(100.0 * n / 5, 6) AS confidence, round(100 * v.w / tot.w, 6) AS weighted, neighbours FROM v JOIN tot ON v.id = tot.id QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY n DESC, label2) = 1"""),
    "m7_class_scores": (_class_scores, f"WITH {CLASSES} SELECT fold, class, support, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s"),
    "m7_fold_report": (_fold_report, f"""WITH {CLASSES}, c AS (SELECT fold, round(coalesce(avg(confidence), -1), 6) AS confidence FROM sure GROUP BY 1)
SELECT fold, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, any_value(confidence) AS confidence FROM s JOIN c USING (fold) GROUP BY fold"""),
    "f2_quality_verdict": (_verdict, f"""WITH q AS (SELECT image_id, 'L' || (label % 3) AS descriptor, sparsity, variance FROM ({QUALITY}) JOIN embeddings ON vec_id = image_id),
e AS (SELECT descriptor, round(quantile_cont(sparsity, 0.25), 6) AS s0, round(quantile_cont(sparsity, 0.75), 6) AS s1, round(quantile_cont(variance, 0.25), 6) AS v0, round(quantile_cont(variance, 0.75), 6) AS v1, round(quantile_cont(sparsity, 0.9), 6) AS warning FROM q GROUP BY 1)
SELECT descriptor, image_id, sparsity, variance, CASE WHEN sparsity > warning THEN 'warning' WHEN sparsity < s0 THEN 'below' WHEN sparsity > s1 THEN 'above' ELSE 'within' END AS sparsity_verdict,
 CASE WHEN variance < v0 THEN 'below' WHEN variance > v1 THEN 'above' ELSE 'within' END AS variance_verdict, sparsity > warning OR (variance < v0 AND v0 > 0) AS mediocre FROM q JOIN e USING (descriptor)"""),
    "p4_channels": (_channels, f"""WITH {RGB}, m AS (SELECT image_id, r, avg(of_r) AS a, avg(of_g) AS b, avg(of_b) AS c FROM rgb GROUP BY ALL)
SELECT image_id, CAST(r AS INTEGER) AS pos, round(a, 6) AS value FROM m UNION ALL SELECT image_id, CAST(r + 8 AS INTEGER), round(b, 6) FROM m UNION ALL SELECT image_id, CAST(r + 16 AS INTEGER), round(c, 6) FROM m"""),
    "h9_compare_diagrams": (_compared, f"""WITH {BARS}, o AS (SELECT image_id, hdim, birth, CASE WHEN image_id % 2 = 0 THEN death + 0.125 ELSE death END AS death FROM bars WHERE image_id % 7 <> 0 OR birth > 0),
a AS (SELECT *, row_number() OVER (PARTITION BY image_id, hdim ORDER BY birth, death) AS k FROM bars), b AS (SELECT *, row_number() OVER (PARTITION BY image_id, hdim ORDER BY birth, death) AS k FROM o),
j AS (SELECT image_id, hdim, a.birth AS b1, b.birth AS b2, CASE WHEN a.birth IS NOT NULL AND b.birth IS NOT NULL THEN greatest(abs(a.birth - b.birth), abs(a.death - b.death)) END AS gap FROM a FULL JOIN b USING (image_id, hdim, k))
SELECT image_id, hdim, count(b1) = count(b2) AS same_count, round(max(gap), 6) AS max_diff, round(count(*) FILTER (WHERE gap = 0) / count(*), 6) AS exact FROM j GROUP BY ALL"""),
    "h10_threshold_components": (lambda s, d: diagram.threshold_components(_essential(s, d), views.grids(s, d)).select(I, "k", r6("t", "t"), "components"), f"""WITH {BARS}, s AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM grids GROUP BY 1), t AS (SELECT image_id, CAST(k AS INTEGER) AS k, lo + k * (hi - lo) / 19 AS t FROM s, (SELECT unnest(range(20)) AS k))
SELECT t.image_id, k, round(t, 6) AS t, count(birth) AS components FROM t LEFT JOIN bars b ON b.image_id = t.image_id AND hdim = 0 AND birth <= t AND (death >= 1 OR death > t) GROUP BY ALL"""),
    "g19_cubical_summary": (lambda s, d: diagram.cubical_summary(_essential(s, d), views.grids(s, d)), f"""WITH {BARS}, g AS (SELECT image_id, count(*) AS n_cells, max(r) + 1 AS height, max(c) + 1 AS width FROM grids GROUP BY 1)
SELECT image_id, n_cells, height, width, count(*) FILTER (WHERE hdim = 0) AS h0, count(*) FILTER (WHERE hdim = 0 AND death >= 1) AS b0, count(*) FILTER (WHERE hdim = 1) AS h1, count(*) FILTER (WHERE hdim = 1 AND death >= 1) AS b1 FROM g JOIN bars USING (image_id) GROUP BY ALL"""),
    "d12_image_qc": (_image_qc, f"""WITH q AS (SELECT image_id, avg(CAST(value <> 0 AS INTEGER)) AS filled FROM ({DIAGRAMS["d11_persistence_image"][1]}) GROUP BY 1), l AS (SELECT image_id, max(p) AS longest, avg(p) AS mean FROM (WITH {BARS} SELECT * FROM bars) GROUP BY 1)
SELECT image_id, round(filled, 6) AS nonzero_ratio, round(longest, 6) AS dominant_scale, round(mean, 6) AS mean_persistence, filled < 0.01 AS low_persistence, false AS empty FROM q JOIN l USING (image_id)"""),
    "d15_codebook": (_codebook, f"""WITH {BARS}, c AS (SELECT CAST(image_id % 4 AS INTEGER) AS k, avg(birth) AS cx, avg(p) AS cy FROM bars GROUP BY 1), n AS (SELECT b.image_id, hdim, b.birth, b.death, c.k FROM bars b, c QUALIFY row_number() OVER (PARTITION BY b.image_id, hdim, b.birth, b.death ORDER BY (b.birth - cx) ** 2 + (p - cy) ** 2, k) = 1)
SELECT image_id, hdim, k, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY image_id, hdim), 6) AS value FROM n GROUP BY image_id, hdim, k"""),
    "d15_codebook_fitted": (_codebook_fitted, None),
    "d23_pilot_statistics": (_pilot, f"""WITH {BARS}, w AS (SELECT *, p / (sum(p) OVER (PARTITION BY image_id, hdim) + 1e-10) AS q FROM bars), v AS (SELECT image_id, hdim, [{", ".join(f"CAST({x} AS DOUBLE)" for x in PILOT)}] AS vec FROM w GROUP BY ALL), n AS (SELECT CAST(unnest(range(25)) AS INTEGER) AS n)
SELECT image_id, CAST(hdim * 25 + n AS INTEGER) AS pos, round(coalesce(vec[n + 1], 0), 6) AS value FROM v, n"""),
}
