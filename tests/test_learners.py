"""Meta-learners, correlations, subspaces, and vectorisers as Spark ML stages."""

import random
import tempfile

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from lattica.functions import vectorizers
from lattica.operators import correlation, evaluation, meta
from lattica.plans import learned_queries


def made(spark, n=6, seed=1):
    rng = np.random.default_rng(seed)
    f = {f"d{k}": rng.normal(size=3) for k in range(n)}
    scores = [(d, x, float(v @ (1, 2, -1) * 0.1 + 0.3 * j + rng.normal() * 0.01)) for d, v in f.items() for j, x in enumerate("pqr") if (d, x) != ("d2", "q")]
    features = spark.createDataFrame([(d, name, float(x)) for d, v in f.items() for name, x in zip("abc", v)], "dataset string, feature string, x double")
    return f, scores, meta.design(features, spark.createDataFrame(scores, "dataset string, descriptor string, acc double"), ["p", "q", "r"])


def test_ridge_equals_closed_form_without_the_held_out_rows(spark):
    f, scores, rows = made(spark)
    got = {(r.dataset, r.descriptor): r.pred for r in meta.ridge_lodo(rows, 0.5).collect()}
    x = {(d, p): np.array([*f[d], *(float(p == q) for q in "pqr")]) for d, p, _ in scores}
    for held in f:
        train = [(x[d, p], y) for d, p, y in scores if d != held]
        a, y = np.array([v for v, _ in train]), np.array([v for _, v in train])
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + 0.5 * np.eye(6), (a - a.mean(0)).T @ (y - y.mean()))
        for (d, p), v in x.items():
            if d == held:
                assert abs(got[d, p] - (y.mean() + (v - a.mean(0)) @ w)) < 1e-8
    picks = {r.dataset: r for r in meta.choices(meta.ridge_lodo(rows, 0.5)).collect()}
    assert len(picks) == 6 and all(r.regret >= 0 for r in picks.values()) and picks["d0"].choice == "r"


def test_boosted_and_forest_see_no_held_out_row(spark):
    _, scores, rows = made(spark, 4)
    odd = rows.withColumn("y", F.when(F.col("dataset") == "d1", 1000.0).otherwise(F.col("y")))  # a fit that saw them would show it
    for got in (meta.boosted_lodo(odd, 3, 2), meta.forest_lodo(odd, 4, 3)):
        found = {(r.dataset, r.descriptor): r for r in got.collect()}
        assert len(found) == len(scores) and all(abs(r.pred) < 10 for (d, _), r in found.items() if d == "d1")
        assert any(r.pred > 50 for (d, _), r in found.items() if d != "d1")
    assert all(r.spread >= 0 for r in meta.forest_lodo(odd, 4, 3).collect())


def test_components_and_correlations_equal_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 5))
    tables = {"a": base, "b": base @ rng.normal(size=(5, 3)), "c": np.column_stack([np.ones(40), rng.integers(0, 3, (40, 2))])}
    rows = [(i, n, [float(x) for x in m[i]]) for n, m in tables.items() for i in range(40)]
    parts = correlation.components(spark.createDataFrame(rows, "image_id long, descriptor string, vec array<double>"), 4)
    got = {n: np.zeros((40, {"a": 4, "b": 3, "c": 3}[n])) for n in tables}
    for r in parts.collect():
        got[r.descriptor][r.image_id, r.k] = r.x
    for n, m in tables.items():
        sd = m.std(0, ddof=1)
        z = (m - m.mean(0)) / np.where(sd > 0, sd, 1)
        want = np.linalg.svd(z - z.mean(0), full_matrices=False)
        k = min(4, m.shape[1])
        mine = (want[0] * want[1])[:, :k]
        assert np.abs(np.abs(got[n][:, :k]) - np.abs(mine)).max() < 1e-6

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    long = [(i, n, k, float(round(m[i, k], 6))) for n, m in tables.items() for i in range(40) for k in range(m.shape[1])]
    found = {(r.a, r.b): r for r in correlation.descriptor_correlation(spark.createDataFrame(long, "image_id long, descriptor string, k int, x double")).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("c", "b")):
        x, y = np.round(tables[a], 6), np.round(tables[b], 6)
        both = [k for k in range(min(x.shape[1], y.shape[1])) if x[:, k].std() > 0 and y[:, k].std() > 0]
        assert abs(found[a, b].pearson - np.mean([abs(np.corrcoef(x[:, k], y[:, k])[0, 1]) for k in both])) < 1e-9
        assert abs(found[a, b].spearman - np.mean([abs(np.corrcoef(ranks(x[:, k]), ranks(y[:, k]))[0, 1]) for k in both])) < 1e-9


def test_what_rounding_leaves_of_a_component_has_no_rank(spark):
    """A descriptor whose places add up to 1 has a last component of rounding errors only, which change with the order of rows and
    grow with their number."""
    x = spark.range(60).select(F.col("id").alias("image_id"), (F.col("id") * 7 % 60).cast("double").alias("p"), (F.hash("id") % 1000).alias("noise"))
    place = lambda name, k, c: x.select("image_id", F.lit(name).alias("descriptor"), F.lit(k).alias("k"), F.expr(c).alias("x"))
    parts = place("b", 0, "p").union(place("b", 1, "p")).union(place("b", 2, "p"))
    both = parts.union(place("a", 0, "p")).union(place("a", 1, "noise * 1e-18D")).union(place("a", 2, "noise * 1e-13D"))
    assert {(r.a, r.b, round(r.pearson, 9), round(r.spearman, 9), r.n) for r in correlation.descriptor_correlation(both).collect()} == {("a", "b", 1.0, 1.0, 1), ("b", "a", 1.0, 1.0, 1)}
    none = parts.union(place("a", 0, "0D"))
    assert {(r.a, r.b, r.pearson, r.spearman, r.n) for r in correlation.descriptor_correlation(none).collect()} == {("a", "b", 0.0, 0.0, 0), ("b", "a", 0.0, 0.0, 0)}


def test_vectors_of_images_stay_in_all_tasks(spark):
    """Merged by the size of their arrays, all pixels would lie in one task or two."""
    got = learned_queries._vectors(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = {r.descriptor: (r.n, r.low, r.high) for r in got.groupBy("descriptor").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")).collect()}
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert size == {"euler_curve": (n, 16, 16), "lbp": (n, 10, 10), "minkowski": (n, 30, 30)}


def test_subspaces_are_the_mean_of_models_fitted_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        y = i % 3
        v = rng.normal(size=3000)
        v[y * 1000 : (y + 1) * 1000] += 0.4
        rows.append((i, i % 2, y, [float(x) for x in v]))
    table = spark.createDataFrame(rows, "id long, fold int, label int, vec array<double>").repartition(2)
    got = {r.id: r for r in evaluation.cross_validate_subspaces(table, "logistic", 3000, 3, 2, size=50, many=2).collect()}
    sets = evaluation.subspaces(3000, size=50, many=2)
    assert len(sets) == 2 and len(set(sets[0])) == 50 and evaluation.subspaces(2000) is None
    mean = np.zeros((60, 3))
    for k, places in enumerate(sets):
        part = table.withColumn("features", array_to_vector(F.array(*[F.get("vec", p) for p in places])))
        for fold in (0, 1):
            model = evaluation.classifier("logistic", 50, 3, 42 + k).fit(part.where(F.col("fold") != fold))
            for r in model.transform(part.where(F.col("fold") == fold)).select("id", vector_to_array("probability").alias("p")).collect():
                mean[r.id] += np.array(r.p) / 2
    assert all(got[i].pred == mean[i].argmax() and abs(got[i].confidence - mean[i].max()) < 1e-6 for i in range(60))


def test_subspaces_of_sparse_vectors_stay_sparse(spark):
    rng = random.Random(7)
    words = [(i, i % 2, i % 3, sorted({rng.randrange(3000) for _ in range(20)} | {(i % 3) * 700 + j for j in range(0, 600, 9) if rng.random() < 0.5})) for i in range(60)]
    sparse = spark.createDataFrame([(i, f, y, Vectors.sparse(3000, at, [1.0] * len(at))) for i, f, y, at in words], ["id", "fold", "label", "features"])
    dense = sparse.withColumn("vec", vector_to_array("features")).drop("features")
    key = lambda rows: {r.id: r for r in evaluation.cross_validate_subspaces(rows, "logistic", 3000, 3, 2, size=50, many=2).collect()}
    a, b = key(sparse), key(dense)
    assert a.keys() == b.keys() and all(a[i].pred == b[i].pred and abs(a[i].confidence - b[i].confidence) < 1e-6 for i in a)
    model = evaluation.classifier("logistic", 3000, 3, scaled=False).fit(sparse)
    kinds = {type(r.features) for r in model.transform(sparse).select("features").collect()}
    assert kinds == {SparseVector} and "scaled" not in model.transform(sparse).columns


def test_every_classifier_learns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, i % 3, [float(x) for x in rng.normal(size=4) + np.eye(3, 4)[i % 3] * 6]) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, fold int, label int, vec array<double>")
    for name in ("perceptron", "boosted", "one_vs_rest"):
        got = evaluation.cross_validate(table, evaluation.classifier(name, 4, 3), 2).collect()
        assert len(got) == 60 and np.mean([r.truth == r.pred for r in got]) > 0.8


def test_vectorisers_are_saved_and_loaded(spark):
    rng = random.Random(5)
    rows = [(i, h, b := rng.random(), b + rng.random()) for i in range(30) for h in (0, 1) for _ in range(i % 4 + (h == 0))]
    bars = spark.createDataFrame(rows, "image_id long, hdim int, birth double, death double")
    for stage, size in ((vectorizers.Atol(3), 6), (vectorizers.Codebook(4), 8)):
        model = Pipeline(stages=[stage]).fit(bars)
        path = tempfile.mkdtemp() + "/model"
        model.save(path)
        again = PipelineModel.load(path)
        a, b = (sorted((r.image_id, r.vec) for r in m.transform(bars).collect()) for m in (model, again))
        assert a == b and len(a) == 30 and all(len(v) == size for _, v in a) and any(x for _, v in a for x in v)
        path = tempfile.mkdtemp() + "/stage"
        stage.save(path)
        assert type(stage).load(path).getOrDefault("k") == stage.getOrDefault("k")
