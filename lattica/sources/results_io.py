"""Result tables as files: nested JSON for each (dataset, descriptor) and the wide CSV, written and read by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["dataset", "descriptor"]
JSON_SCHEMA = "dataset string, descriptor string, classifiers map<string, struct<acc: double>>"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster, or below the warehouse where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.scratch"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_results(cells: DataFrame, path: str) -> None:
    """One JSON line for each (dataset, descriptor) with a map of classifiers; their number is bounded by the classifiers."""
    entry = F.struct(F.col("classifier").alias("key"), F.struct("acc").alias("value"))
    cells.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("classifiers")).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, descriptor, classifier, acc); lines that do not parse give no rows."""
    raw = spark.read.schema(JSON_SCHEMA).json(path)
    return raw.where("dataset is not null").select(*KEYS, F.explode("classifiers").alias("classifier", "value")).select(*KEYS, "classifier", F.col("value.acc").alias("acc"))


def merge_results(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old rows whose keys were not run again."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def write_master_csv(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_csv_matrix(spark: SparkSession, path: str, classifiers: list[str]) -> DataFrame:
    """(dataset, descriptor, classifier, acc) from the wide CSV; empty cells give no rows."""
    schema = "dataset string, descriptor string, " + ", ".join(f"{c} double" for c in classifiers)
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide.unpivot(KEYS, classifiers, "classifier", "acc").where("acc is not null")


def json_round_trip(cells: DataFrame) -> DataFrame:
    path = shared_path(cells.sparkSession, "results")
    write_results(cells, path)
    return read_results(cells.sparkSession, path)


def csv_round_trip(wide: DataFrame, classifiers: list[str]) -> DataFrame:
    path = shared_path(wide.sparkSession, "master")
    write_master_csv(wide.select(*KEYS, *classifiers), path)
    return read_csv_matrix(wide.sparkSession, path, classifiers)
