"""Pixel, voxel, series, result and label tables derived from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.tables import mean6, mean6_sql, over, read, std6, std6_sql


def grid_from_array(df: DataFrame, width: int, image: str = "vec_id", array: str = "embedding") -> DataFrame:
    """(image_id, r, c, v) from a row-major array of pixels."""
    pos = df.select(F.col(image).alias("image_id"), F.posexplode(array).alias("pos", "x"))
    return pos.select("image_id", F.floor(F.col("pos") / width).cast("int").alias("r"), (F.col("pos") % width).alias("c"), F.col("x").cast("double").alias("v"))


def minmax_normalize(grid: DataFrame, *keys: str, constant: float = 0.0) -> DataFrame:
    """(x - min) / (max - min) in each image; an image of one value becomes `constant`."""
    w = over(*(keys or ("image_id",)))
    low, high = F.min("v").over(w), F.max("v").over(w)
    return grid.withColumn("v", F.when(high > low, (F.col("v") - low) / (high - low)).otherwise(constant))


def grids(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """minmax_normalize of the arrays as images of width 8. The extremes are taken before arrays become pixels, so one row an image is
    shuffled, and the pixels lie by image. `dealt` keeps all shuffle partitions: merged by the size of their arrays, a few tasks would
    hold all pixels."""
    w = over("image_id")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    if dealt:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    rows = rows.withColumn("low", F.min(F.array_min("embedding")).over(w).cast("double")).withColumn("high", F.max(F.array_max("embedding")).over(w).cast("double"))
    pos = rows.select("image_id", "low", "high", F.posexplode("embedding").alias("pos", "x"))
    v = F.when(F.col("high") > F.col("low"), (F.col("x").cast("double") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return pos.select("image_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), v.alias("v"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = grid_from_array(read(spark, sf_dir, "embeddings"), 64)
    cut = flat.select("image_id", F.floor(F.col("c") / 16).cast("int").alias("z"), (F.floor(F.col("c") / 4) % 4).cast("int").alias("y"), (F.col("c") % 4).alias("x"), "v")
    return minmax_normalize(cut)


def rgb_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels from one array, shifted by 0, 21 and 42 places."""
    raw = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("by")) for c, k in (("R", 0), ("G", 21), ("B", 42))])).alias("s"))
    pos = raw.select("image_id", "s.channel", "s.by", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    v = F.element_at("embedding", ((F.col("pos") + F.col("by")) % 64 + 1).cast("int")).cast("double")
    return pos.select("image_id", "channel", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), v.alias("v"))


def heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, r, c, v): a user's summed values by day (30 rows) and hour (24 columns), missing cells 0, in whole hundredths
    and then scaled to 0..1 for each user. Many ties."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), (F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c"), F.round(F.col("value") * 100).cast("long").alias("h"))
    cells_ = e.groupBy("image_id", "r", "c").agg(F.sum("h").alias("h"))
    spine = e.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("r")).select("image_id", "r", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("c"))
    return minmax_normalize(spine.join(cells_, ["image_id", "r", "c"], "left").select("image_id", "r", "c", F.coalesce("h", F.lit(0)).cast("double").alias("v")))


def series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes(g, id, v) and edges(g, a, b): each user's cells of the heat map in time order, neighbours joined."""
    nodes = heatmaps(spark, sf_dir).select(F.col("image_id").alias("g"), (F.col("r") * 24 + F.col("c")).cast("long").alias("id"), "v")
    return nodes, nodes.where("id < 719").select("g", F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")


def fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, object_type, descriptor, classifier, fold, acc): acc is the mean of value / 100, 1 at most, in whole
    millionths from a sum of whole hundredths."""
    e = read(spark, sf_dir, "events")
    d = F.col("user_id") % 26
    keys = e.select(
        F.concat(F.lit("d"), d.cast("string")).alias("dataset"),
        F.concat(F.lit("t"), (d % 5).cast("string")).alias("object_type"),
        F.col("event_type").alias("descriptor"),
        F.concat(F.lit("c"), (F.col("event_id") % 6).cast("string")).alias("classifier"),
        (F.dayofmonth("ts") % 5).alias("fold"),
        F.round(F.col("value") * 100).cast("long").alias("hundredths"),
    )
    total = keys.groupBy("dataset", "object_type", "descriptor", "classifier", "fold").agg(F.sum("hundredths").alias("total"), F.count("hundredths").alias("n"))
    millionths = F.least(F.expr("(200 * total + n) div (2 * n)"), F.lit(1_000_000))
    return total.select("dataset", "object_type", "descriptor", "classifier", "fold", (millionths / 1e6).alias("acc"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, object_type, descriptor, classifier, acc, acc_std, n_folds)"""
    folds = fold_results(spark, sf_dir).groupBy("dataset", "object_type", "descriptor", "classifier")
    return folds.agg(mean6("acc", "acc"), std6("acc", "acc_std"), F.count("*").alias("n_folds"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", (F.col("doc_id") % 5).alias("fold"), F.col("quality").cast("int").alias("truth"), (F.col("n_chars") > 1000).cast("int").alias("pred"))


GRIDS = """g0 AS (SELECT vec_id AS image_id, label, CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
grids AS (SELECT image_id, label, pos // 8 AS r, pos % 8 AS c, (x - min(x) OVER (PARTITION BY image_id)) / (max(x) OVER (PARTITION BY image_id) - min(x) OVER (PARTITION BY image_id)) AS v FROM g0)"""
HEATMAPS = """hourly AS (SELECT user_id AS image_id, day(ts) - 1 AS r, hour(ts) AS c, sum(CAST(round(value * 100) AS BIGINT)) AS h FROM events GROUP BY ALL),
heat AS (SELECT image_id, r, c, CAST(coalesce(h, 0) AS DOUBLE) AS x FROM (SELECT DISTINCT user_id AS image_id FROM events) CROSS JOIN (SELECT unnest(range(30)) AS r) CROSS JOIN (SELECT unnest(range(24)) AS c) LEFT JOIN hourly USING (image_id, r, c)),
heatmaps AS (SELECT image_id, r, c, CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END AS v FROM heat WINDOW w AS (PARTITION BY image_id))"""
CELLS = f"""sums AS (SELECT 'd' || (user_id % 26) AS dataset, 't' || (user_id % 26 % 5) AS object_type, event_type AS descriptor, 'c' || (event_id % 6) AS classifier, day(ts) % 5 AS fold,
 sum(CAST(round(value * 100) AS BIGINT)) AS total, count(value) AS n FROM events GROUP BY ALL),
folds AS (SELECT dataset, object_type, descriptor, classifier, fold, CAST(least((200 * total + n) // (2 * n), 1000000) AS DOUBLE) / 1e6 AS acc FROM sums),
cells AS (SELECT dataset, object_type, descriptor, classifier, {mean6_sql("acc")} AS acc, {std6_sql("acc")} AS acc_std, count(*) AS n_folds FROM folds GROUP BY ALL)"""
PREDICTIONS = "preds AS (SELECT doc_id, doc_id % 5 AS fold, CAST(quality AS INTEGER) AS truth, CAST(n_chars > 1000 AS INTEGER) AS pred FROM labels JOIN documents USING (doc_id))"
