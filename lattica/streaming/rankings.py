"""Structured Streaming forms of order-dependent state: rankings, windows, a bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def outcome_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file source of events as outcomes (ts, object_type, descriptor, acc)."""
    folder, _, name = path.rpartition("/")
    e = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", name).parquet(folder)
    return outcomes(e)


def outcomes(e: DataFrame) -> DataFrame:
    return e.select("ts", "event_id", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("object_type"), F.col("event_type").alias("descriptor"), (F.col("value") / 100).alias("acc"))


def running_rankings(stream: DataFrame) -> DataFrame:
    """Trials and mean accuracy of each (object_type, descriptor); the same plan over a stream or a table."""
    return stream.groupBy("object_type", "descriptor").agg(F.count("*").alias("trials"), F.avg("acc").alias("mean_acc"))


def windowed_rankings(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Trials and mean accuracy of each window and descriptor. A table gives all its rows; a stream leaves out rows that
    come more than `late` after the newest one seen, as their window may be closed."""
    if stream.isStreaming:
        stream = stream.withWatermark("ts", late)
    got = stream.groupBy(F.window("ts", width).alias("w"), "descriptor").agg(F.count("*").alias("trials"), F.avg("acc").alias("mean_acc"))
    return got.select(F.col("w.start").alias("start"), "descriptor", "trials", "mean_acc")


def fusion_outcomes(stream: DataFrame) -> DataFrame:
    """Mean gain, runs helped, best and worst pair of each type, from (object_type, pair, gain); a stream or a table."""
    by = F.struct("gain", "pair")
    got = stream.groupBy("object_type").agg(F.count("*").alias("n"), F.avg("gain").alias("g"), F.sum((F.col("gain") > 0.001).cast("int")).alias("helped"), F.max_by("pair", by).alias("best_pair"), F.min_by("pair", by).alias("worst_pair"))
    return got.select("object_type", "n", F.round("g", 6).alias("mean_gain"), "helped", "best_pair", "worst_pair")


def bounded_memory(log: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The latest `most` entries of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("_newest", F.row_number().over(w)).where(F.col("_newest") <= most).drop("_newest")


def upsert(path: str, keys: list[str], newest: list[str] | None = None):
    """foreachBatch writer of one row for each key and batch into a parquet table, one folder a batch: a batch that is run
    again overwrites its own folder. Within a batch the row that is greatest by `newest` stays (by all other columns, if
    none are named); `latest` then gives the row of each key's last batch."""

    def write(batch: DataFrame, number: int) -> None:
        by = newest or [c for c in batch.columns if c not in keys]
        order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by] or [F.lit(0)])
        one = batch.withColumn("_newest", F.row_number().over(order)).where("_newest = 1").drop("_newest")
        one.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return write


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return table.withColumn("_newest", F.row_number().over(w)).where("_newest = 1").drop("_newest", "batch")
