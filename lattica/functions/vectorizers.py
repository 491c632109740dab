"""Learned vectors of diagrams as Spark ML stages: an Estimator learns centers from diagrams(image_id, hdim, birth, death), its
Model turns diagrams into (image_id, vec), and both can be saved, loaded and put into a Pipeline. A model is a list of
centers of fixed size."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import diagram

I = "image_id"


class _Sized(Params):
    """Number of centers (of each dimension) and seed."""

    def __init__(self) -> None:
        super().__init__()
        self.k = Param(self, "k", "number of centers", TypeConverters.toInt)
        self.seed = Param(self, "seed", "seed of k-means", TypeConverters.toInt)


class _Centers(Model, DefaultParamsReadable, DefaultParamsWritable):
    """centers: rows (hdim, k, x, y, sigma) as flat lists of numbers, so that they are saved with the parameters."""

    def __init__(self, centers: list[list[float]] | None = None) -> None:
        super().__init__()
        self.centers = Param(self, "centers", "rows of hdim, k, cx, cy, sigma")
        self._set(centers=centers or [])

    def table(self, spark) -> DataFrame:
        rows = [(int(h), int(k), float(x), float(y), float(s)) for h, k, x, y, s in self.getOrDefault("centers")]
        return spark.createDataFrame(rows, "hdim int, k int, cx double, cy double, sigma double")

    def _vectors(self, values: DataFrame, data: DataFrame, places: DataFrame) -> DataFrame:
        """(image_id, vec) with a place for each (hdim, k), 0 where an image has no value."""
        spine = data.select(I).distinct().join(F.broadcast(places))
        got = spine.join(values.select(I, "hdim", "k", "value"), [I, "hdim", "k"], "left").select(I, F.struct("hdim", "k", F.coalesce("value", F.lit(0.0)).alias("value")).alias("p"))
        return got.groupBy(I).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["value"]).alias("vec"))


class AtolModel(_Centers):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        centers = self.table(dataset.sparkSession)
        return self._vectors(diagram.atol_transform(dataset, centers), dataset, centers.select("hdim", "k"))


class CodebookModel(_Centers):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        centers = self.table(dataset.sparkSession)
        both = dataset.sparkSession.createDataFrame([(0,), (1,)], "hdim int")
        return self._vectors(diagram.codebook_transform(dataset, centers.select("k", "cx", "cy", "hdim")), dataset, both.join(centers.select("k")))


class Atol(_Sized, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Centers of each dimension by k-means."""

    def __init__(self, k: int = 4, seed: int = 42) -> None:
        super().__init__()
        self._set(k=k, seed=seed)

    def _fit(self, dataset: DataFrame) -> AtolModel:
        rows: Any = diagram.atol_fit(dataset, self.getOrDefault("k"), self.getOrDefault("seed")).collect()  # k rows a dimension
        return AtolModel(sorted([r["hdim"], r["k"], r["cx"], r["cy"], r["sigma"]] for r in rows))


class Codebook(_Sized, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Centers of all dimensions by one k-means."""

    def __init__(self, k: int = 8, seed: int = 42) -> None:
        super().__init__()
        self._set(k=k, seed=seed)

    def _fit(self, dataset: DataFrame) -> CodebookModel:
        rows: Any = diagram.codebook_fit(dataset, self.getOrDefault("k"), self.getOrDefault("seed")).collect()  # k rows
        return CodebookModel(sorted([0, r["k"], r["cx"], r["cy"], 1.0] for r in rows))
