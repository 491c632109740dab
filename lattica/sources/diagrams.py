"""A store of diagrams: parquet in folders of dataset and channel, filled only with what it does not hold yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import persistence

STORED = "content string, hdim int, birth double, death double"


def write_diagrams(diagram: DataFrame, path: str) -> None:
    """Adds diagram(dataset, channel, image_id, hdim, birth, death) to the store, without images it already holds."""
    spark = diagram.sparkSession
    if (held := _stored(spark, path)) is not None:
        keys = ["dataset", "channel", "image_id"]
        diagram = diagram.join(held.select(keys).distinct(), keys, "left_anti")
    diagram.repartition("dataset", "channel", F.pmod(F.xxhash64("image_id"), F.lit(64))).write.partitionBy("dataset", "channel").mode("append").parquet(path)


def read_diagrams(spark: SparkSession, path: str, dataset: str | None = None, channel: str | None = None) -> DataFrame:
    """The store, or the folders of one dataset or channel of it; other folders are not read."""
    out = spark.read.parquet(path)
    for name, value in (("dataset", dataset), ("channel", channel)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table below a path, None where there is none yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def content_key(pixels: Column, width: Column, filtration: str) -> Column:
    """md5 of an image's pixels in row order, its width and the filtration."""
    text = F.array_join(F.transform(pixels, lambda v: v.cast("string")), ",")
    return F.md5(F.concat_ws("|", F.lit(filtration), width.cast("string"), text))


def fill_diagrams(images: DataFrame, path: str, filtration: str = "sublevel") -> DataFrame:
    """(image_id, hdim, birth, death) of images(image_id, pixels ARRAY<DOUBLE>, width): diagrams are solved once for each
    content that the store does not hold, equal images together, and added to it. Also the body of a stream's
    foreachBatch; a batch that is run again finds its contents stored."""
    spark = images.sparkSession
    keyed = images.withColumn("content", content_key(F.col("pixels"), F.col("width"), filtration))
    wanted = keyed.select("content", "pixels", "width").dropDuplicates(["content"])
    if (held := _stored(spark, path, STORED)) is not None:
        wanted = wanted.join(held.select("content").distinct(), "content", "left_anti")
    at = wanted.select(F.col("content").alias("image_id"), "width", F.posexplode("pixels").alias("pos", "v"))
    grid = at.select("image_id", F.expr("pos div width").cast("int").alias("r"), (F.col("pos") % F.col("width")).cast("int").alias("c"), "v")
    if not grid.isEmpty():
        solved = persistence.persistence(grid, filtration).withColumnRenamed("image_id", "content")
        solved.select("content", F.col("hdim").cast("int").alias("hdim"), "birth", "death").write.mode("append").parquet(path)
    return keyed.select("image_id", "content").join(spark.read.schema(STORED).parquet(path), "content").drop("content")
