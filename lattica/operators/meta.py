"""Meta-learners: from a dataset's characteristics and a descriptor's name to its score, always judged on a dataset that no
fit has seen. rows(dataset, descriptor, y, x ARRAY<DOUBLE>) come from `design`."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over, save

PREDICTED = "dataset string, descriptor string, y double, pred double"


def design(features: DataFrame, scores: DataFrame, descriptors: list[str]) -> DataFrame:
    """(dataset, descriptor, y, x): the values of features(dataset, feature, x) in order of their names, then a one for the
    descriptor of scores(dataset, descriptor, acc). A missing value counts as 0."""
    names = features.select("feature").distinct()
    every = features.select("dataset").distinct().join(names).join(features, ["dataset", "feature"], "left")  # datasets times features
    values = every.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("feature", F.coalesce("x", F.lit(0.0)).alias("x")))).alias("f"))
    one = F.array(*[(F.col("descriptor") == d).cast("double") for d in descriptors])
    return scores.where(F.col("descriptor").isin(descriptors)).join(values, "dataset").select("dataset", "descriptor", F.col("acc").alias("y"), F.concat(F.col("f.x"), one).alias("x"))


def ridge_lodo(rows: DataFrame, penalty: float = 1.0) -> DataFrame:
    """(dataset, descriptor, y, pred) by ridge regression with a free intercept. The products of columns are summed for each
    dataset once; what a held-out dataset's fit needs are the sums of all less its own, so the rows are read once
    for all fits and none of its rows is in any of them."""
    rows = save(rows, "rows")
    full = F.concat(F.array(F.lit(1.0)), "x", F.array("y"))
    cell = rows.select("dataset", F.posexplode(full).alias("i", "a"), full.alias("z")).select("dataset", "i", "a", F.posexplode("z").alias("j", "b"))
    own = cell.groupBy("dataset", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("own"))
    rest = own.withColumn("s", F.sum("own").over(over("i", "j")) - F.col("own")).select("dataset", "i", "j", "s")

    def solve(key: tuple, sums: pa.Table) -> pa.Table:
        i, j, s = (sums.column(c).to_numpy() for c in ("i", "j", "s"))
        g = np.zeros((int(i.max()) + 1,) * 2)
        g[i, j] = s
        n = max(g[0, 0], 1.0)
        mean = g[0] / n
        centred = g - np.outer(mean, mean) * n
        inner = centred[1:-1, 1:-1] + penalty * np.eye(len(g) - 2)
        w = np.linalg.solve(inner, centred[1:-1, -1])
        return pa.table([pa.array([key[0].as_py()]), pa.array([[float(mean[-1] - mean[1:-1] @ w), *map(float, w)]])], names=["dataset", "w"])

    weights = rest.groupBy("dataset").applyInArrow(solve, "dataset string, w array<double>")
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), "x"), "w", lambda x, w: x * w)
    return rows.join(weights, "dataset").select("dataset", "descriptor", "y", F.aggregate(terms, F.lit(0.0), lambda a, v: a + v).alias("pred"))


def _each_held_out(rows: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], threads: int) -> DataFrame:
    """run(training rows, held-out rows) for each dataset, a few fits at a time, as cross-validation of Spark ML does."""
    rows = save(rows.withColumn("features", array_to_vector("x")), "rows")
    names = [r[0] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # one row for each dataset
    with ThreadPool(threads) as pool:
        parts = pool.map(lambda d: run(rows.where(F.col("dataset") != d), rows.where(F.col("dataset") == d)), names)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def boosted_lodo(rows: DataFrame, rounds: int = 20, depth: int = 3, threads: int = 4, seed: int = 42) -> DataFrame:
    """(dataset, descriptor, y, pred) by boosted trees, one fit for each held-out dataset."""
    trees = GBTRegressor(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    return _each_held_out(rows, lambda train, test: trees.fit(train).transform(test).select("dataset", "descriptor", "y", F.col("prediction").alias("pred")), threads)


def forest_lodo(rows: DataFrame, trees: int = 20, depth: int = 5, threads: int = 4, seed: int = 42) -> DataFrame:
    """(dataset, descriptor, y, pred, spread): mean and deviation of the trees' own predictions, the latter as uncertainty."""
    forest = RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        one = test
        fitted = forest.fit(train).trees
        for k, tree in enumerate(fitted):
            one = tree.setPredictionCol(f"tree{k}").transform(one)
        each = F.array(*[F.col(f"tree{k}") for k in range(len(fitted))])
        mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(fitted)
        gap = F.aggregate(F.transform(each, lambda x: (x - F.col("pred")) ** 2), F.lit(0.0), lambda a, x: a + x)
        return one.withColumn("pred", mean).select("dataset", "descriptor", "y", "pred", F.sqrt(gap / len(fitted)).alias("spread"))

    return _each_held_out(rows, run, threads)


def choices(predicted: DataFrame) -> DataFrame:
    """(dataset, choice, pred, acc, best_acc, regret): the descriptor with the greatest prediction, ties to the lesser name."""
    w = Window.partitionBy("dataset").orderBy(F.desc("pred"), "descriptor")
    top = predicted.withColumn("k", F.row_number().over(w)).withColumn("best_acc", F.max("y").over(over("dataset"))).where("k = 1")
    return top.select("dataset", F.col("descriptor").alias("choice"), "pred", F.col("y").alias("acc"), "best_acc", (F.col("best_acc") - F.col("y")).alias("regret"))
