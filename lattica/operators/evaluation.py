"""Classifiers trained in folds, their metrics, neighbours with weights, and verdicts over vectors."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.tables import save
from lattica.operators import features, scoring


def classifier(name: str, length: int, classes: int, seed: int = 42, scaled: bool = True) -> Estimator:
    """`forest`, `logistic`, `perceptron`, or one classifier for each class against the rest: `boosted` trees or `one_vs_rest`
    logistic ones; on scaled features. The scaler is part of what is fitted in a fold. Not `scaled`, features stay as sparse as they
    are, which is the same model for `logistic`, whose fit centres and scales by itself."""
    common = {"featuresCol": "scaled" if scaled else "features", "labelCol": "label"}
    made = {
        "forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **common),
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=0.01, **common),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[length, 64, classes], maxIter=100, seed=seed, **common),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=4, seed=seed), parallelism=2, **common),
        "one_vs_rest": lambda: OneVsRest(classifier=LogisticRegression(maxIter=50, regParam=0.01), parallelism=2, **common),
    }
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, made[name]()] if scaled else [made[name]()])


def subspaces(length: int, above: int = 2000, size: int = 500, many: int = 5, seed: int = 42) -> list[list[int]] | None:
    """Places of `many` random subsets of `size` places where vectors are longer than `above`; None for shorter ones."""
    if length <= above:
        return None
    rng = random.Random(seed)
    return [sorted(rng.sample(range(length), size)) for _ in range(many)]


def random_subspace(name: str, train: DataFrame, test: DataFrame, length: int, classes: int, sets: list[list[int]], seed: int = 42) -> DataFrame:
    """test with the mean probability of one classifier for each subset of places, and its greatest place as prediction."""
    for k, places in enumerate(sets):
        cut = VectorSlicer(inputCol="features", outputCol="part", indices=places)
        view = lambda df: cut.transform(df).drop("features").withColumnRenamed("part", "features")  # noqa: B023, E731
        model = classifier(name, len(places), classes, seed + k, name != "logistic").fit(view(train))
        got = model.transform(cut.transform(test).withColumnRenamed("features", "all").withColumnRenamed("part", "features"))
        test = got.withColumn(f"p{k}", vector_to_array("probability")).drop("features", "scaled", "rawPrediction", "probability", "prediction").withColumnRenamed("all", "features")
    mean = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: sum((F.get(f"p{k}", c) for k in range(len(sets))), F.lit(0.0)) / len(sets))
    out = test.withColumn("mean", mean).drop(*[f"p{k}" for k in range(len(sets))])
    return out.withColumn("probability", F.col("mean")).withColumn("prediction", (F.array_position("mean", F.array_max("mean")) - 1).cast("double")).drop("mean")


def cross_validate_subspaces(rows: DataFrame, name: str, length: int, classes: int, k: int = 5, above: int = 2000, size: int = 500, many: int = 5, seed: int = 42) -> DataFrame:
    """cross_validate of a named classifier, by random subspaces where the vectors are longer than `above`. Instead of `vec`, rows may
    hold `features`, ML vectors that stay sparse."""
    sets = subspaces(length, above, size, many, seed)
    if sets is None:
        rows = rows if "vec" in rows.columns else rows.withColumn("vec", vector_to_array("features")).drop("features")
        return cross_validate(rows, classifier(name, length, classes, seed), k)
    if "vec" in rows.columns:
        rows = rows.withColumn("features", array_to_vector(features.sanitize(F.col("vec")))).drop("vec")
    rows = save(_dealt(rows), "folds")

    def one(fold: int) -> DataFrame:
        got = random_subspace(name, rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), length, classes, sets, seed)
        return got.select("id", "fold", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"), F.array_max("probability").alias("confidence"))

    return _each_fold(one, k)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in as many parts as tasks run at once, whatever the files they come from: an iterative fit reads them in every step, and
    rows of one file would keep all but one task idle."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "id").sortWithinPartitions("id")


def _each_fold(one: Callable[[int], DataFrame], k: int, threads: int = 4) -> DataFrame:
    """one(fold) of all folds, a few at a time, as cross-validation of Spark ML does."""
    with ThreadPool(min(k, threads)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(k)))


def cross_validate(rows: DataFrame, estimator: Estimator, k: int = 5, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(id, fold, truth, pred, confidence) of rows(id, fold, label, vec): each fold's rows by a model of the other folds.

    `fit` learns a descriptor from the training rows alone and returns what turns rows into rows with `vec`. Places that
    are no number count as 0. The rows are saved once, as each of the k fits reads them; a fold without rows gives none.
    """
    rows = save(_dealt(rows), "folds")

    learned = [(lambda x: x) if fit is None else fit(rows.where(F.col("fold") != fold)) for fold in range(k)]

    def one(fold: int) -> DataFrame:
        train, test = (learned[fold](rows.where(x)) for x in (F.col("fold") != fold, F.col("fold") == fold))
        ready = [x.withColumn("features", array_to_vector(features.sanitize(F.col("vec")))) for x in (train, test)]
        got = estimator.fit(ready[0]).transform(ready[1])
        sure = F.array_max(vector_to_array("probability")) if "probability" in got.columns else F.lit(-1.0)
        return got.select("id", "fold", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"), sure.alias("confidence"))

    return _each_fold(one, k)


def class_scores(pred: DataFrame) -> DataFrame:
    """(fold, class, support, recall, f1) from pred(fold, truth, pred); a class that is only predicted has recall 0."""
    cell = pred.groupBy("fold", "truth", "pred").agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    truth = cell.groupBy("fold", F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = cell.groupBy("fold", F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    both = truth.join(said, ["fold", "class"], "full").na.fill(0, ["support", "tp", "predicted"])
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return both.select("fold", "class", "support", "tp", recall.alias("recall"), (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f1"))


def fold_report(pred: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro-F1 and mean confidence (-1 without any) of each fold of
    pred(fold, truth, pred, confidence), which is saved, as it is read more than once."""
    pred = save(pred.select("fold", "truth", "pred", "confidence"), "predicted")
    by_class = class_scores(pred).groupBy("fold").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
    )
    sure = pred.groupBy("fold").agg(F.coalesce(F.avg("confidence"), F.lit(-1.0)).alias("confidence"))
    return by_class.join(sure, "fold")


def standardised(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows(.., vec) with each place less the reference's mean and over its deviation (1 where it is 0). What is
    broadcast is one row of two arrays as long as a vector."""
    x = reference.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = x.select("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))
    one = scale.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("scale"))
    z = F.zip_with("vec", "scale", lambda v, p: (v - p["m"]) / p["s"])
    return rows.crossJoin(F.broadcast(one)).withColumn("vec", z).drop("scale")


def knn_report(query: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """(id, label, pred, confidence, weighted, neighbours): the k nearest on vectors scaled by the reference, their
    majority (the lesser label wins ties), its share in percent, its share of 1 / (d + 1e-6), and ids from the nearest."""
    near = scoring.nearest(standardised(query, reference), standardised(reference, reference), k)
    near = near.withColumn("w", 1 / (F.col("d") + 1e-6))
    votes = near.groupBy("id", "label", "label2").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.collect_list(F.struct("d", "id2")).alias("ids"))
    best = votes.groupBy("id", "label").agg(
        F.max_by("label2", F.struct("n", -F.col("label2"))).alias("pred"),
        (100 * F.max("n") / F.sum("n")).alias("confidence"),
        (100 * F.max_by("w", F.struct("n", -F.col("label2"))) / F.sum("w")).alias("weighted"),
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"),
    )
    return best.select("id", "label", "pred", "confidence", "weighted", F.col("ids.id2").alias("neighbours"))


def quality_verdict(quality: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds sparsity_verdict, variance_verdict and mediocre to quality(descriptor, sparsity, variance, ..) by
    expected(descriptor, sparsity_low, sparsity_high, variance_low, variance_high, warning), one row a descriptor. Low
    sparsity is no fault; mediocre: sparsity above the warning, or variance below a lower bound above 0."""

    def place(value: Column, low: str, high: str) -> Column:
        return F.when(value < F.col(low), "below").when(value > F.col(high), "above").otherwise("within")

    got = quality.join(expected, "descriptor")
    warned = F.col("sparsity") > F.col("warning")
    dull = (F.col("variance") < F.col("variance_low")) & (F.col("variance_low") > 0)
    got = got.withColumns({
        "sparsity_verdict": F.when(warned, "warning").otherwise(place(F.col("sparsity"), "sparsity_low", "sparsity_high")),
        "variance_verdict": place(F.col("variance"), "variance_low", "variance_high"),
        "mediocre": warned | dull,
    })
    return got.drop("sparsity_low", "sparsity_high", "variance_low", "variance_high", "warning")


def by_channel(rgb: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over all channels of rgb(image_id, channel, ..) in one run: f sees (image, channel) as its image_id."""
    key = F.struct("image_id", "channel")
    got = f(rgb.withColumn("image_id", key).drop("channel"))
    rest = [c for c in got.columns if c != "image_id"]
    return got.select("image_id.image_id", "image_id.channel", *rest)


def concat_channels(vectors: DataFrame) -> DataFrame:
    """(image_id, vec): the vectors of R, G and B after one another from vectors(image_id, channel, vec)."""
    place = F.array_position(F.array(*map(F.lit, "RGB")), F.col("channel"))
    got = vectors.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "vec"))).alias("parts"))
    return got.select("image_id", F.flatten(F.col("parts.vec")).alias("vec"))
