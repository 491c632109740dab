"""Saved tables that cut lineage, window shorthands and rounding."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the cluster's shared folder (spark.checkpoint.dir, else below the warehouse) and reads it again."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.scratch"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables as `save` returned them that no later step reads, so rounds do not pile up in the shared folder."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if re.fullmatch(r".*-[0-9a-f]{32}", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def micro(c: Column | str) -> Column:
    """Millionths as whole numbers, so that sums do not depend on their order."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long")


def halved_up(millionths: Column, name: str) -> Column:
    """Millionths with a fraction, rounded half up, as a number."""
    return (F.floor(millionths + 0.5) / 1e6).alias(name)


def mean6(c: Column | str, name: str) -> Column:
    """Mean of numbers of at most 6 places: one division of an exact sum."""
    return halved_up(F.sum(micro(c)) / F.count(c), name)


def std6(c: Column | str, name: str) -> Column:
    """Population deviation of numbers of at most 6 places, from exact sums of values and squares. These and their products pass
    64 bits from some thousands of rows on, so they are decimals of 38 digits."""
    x, n = micro(c).cast("decimal(19,0)"), F.count(c).cast("decimal(19,0)")
    total = F.sum(micro(c)).cast("decimal(19,0)")
    return halved_up(F.sqrt((n * F.sum((x * x).cast("decimal(38,0)")) - total * total).cast("double")) / F.count(c), name)


def mean6_sql(c: str) -> str:
    return f"floor(sum(CAST(round(({c}) * 1e6) AS BIGINT)) / count({c}) + 0.5) / 1e6"


def std6_sql(c: str) -> str:
    x = f"CAST(round(({c}) * 1e6) AS BIGINT)"
    return f"floor(sqrt(CAST(count({c}) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE)) / count({c}) + 0.5) / 1e6"


def small(spark: SparkSession, n: int, name: str) -> DataFrame:
    """Integers 0 to n - 1: a grid or threshold table of fixed size, so it may be broadcast."""
    return F.broadcast(spark.range(n).select(F.col("id").cast("int").alias(name)))
