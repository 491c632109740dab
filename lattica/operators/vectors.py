"""Vectors as (image_id, pos, x) or (image_id, vec): scaling, fusion and summaries of correlations and importances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def impute_scale_clip(long: DataFrame, limit: float = 1e6) -> DataFrame:
    """(image_id, pos, x) of long(image_id, pos, x, train): nulls and NaN become the place's median, then each place gets
    mean 0 and deviation 1 (a constant place keeps its deviation), clipped to +-limit. Only training rows are learned
    from; a place without any becomes 0."""
    known = long.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    median = known.where("train").groupBy("pos").agg(F.median("x").alias("mid"))
    filled = known.join(median, "pos", "left").withColumn("x", F.coalesce("x", "mid", F.lit(0.0))).drop("mid")
    fit = filled.where("train").groupBy("pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = (F.col("x") - F.coalesce("mu", "x")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return filled.join(fit, "pos", "left").select("image_id", "pos", F.least(F.greatest(z, F.lit(-limit)), F.lit(limit)).alias("x"))


def fuse(*parts: DataFrame) -> DataFrame:
    """(image_id, vec): the vectors of an image end to end, for images that every part has."""
    named = [x.select("image_id", F.col("vec").alias(f"vec{k}")) for k, x in enumerate(parts)]
    return reduce(lambda a, b: a.join(b, "image_id"), named).select("image_id", F.concat(*[f"vec{k}" for k in range(len(parts))]).alias("vec"))


def group_correlations(rho: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: mean, deviation and number of rho(a, b, rho) within and between groups(descriptor, grp), and how far the
    means are apart."""
    one, other = (groups.select(F.col("descriptor").alias(x), F.col("grp").alias(f"grp_{x}")) for x in ("a", "b"))
    joined = rho.join(one, "a").join(other, "b").withColumn("same", F.col("grp_a") == F.col("grp_b"))
    of = lambda same: F.when(F.col("same") == same, F.col("rho"))
    stats = [f(of(s)).alias(f"{name}_{what}") for s, name in ((True, "within"), (False, "between")) for f, what in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.count, "n"))]
    return joined.agg(*stats).withColumn("separation", F.col("within_mean") - F.col("between_mean"))


def importance_summary(runs: DataFrame, categories: DataFrame) -> DataFrame:
    """(feature, category, mean, std, share, rank, category_share) of runs(run, feature, importance); shares are of the
    summed means. Ties of rank go to the lesser feature."""
    each = runs.groupBy("feature").agg(F.round(F.avg("importance"), 6).alias("mean"), F.stddev_pop("importance").alias("std")).join(categories, "feature", "left")
    all_ = Window.partitionBy(F.lit(1))  # one row a feature
    share = F.col("mean") / F.sum("mean").over(all_)
    ranked = each.withColumns({"share": share, "rank": F.row_number().over(all_.orderBy(F.col("mean").desc(), "feature"))})
    return ranked.withColumn("category_share", F.sum("share").over(Window.partitionBy("category")))


def cross_dataset_average(cells: DataFrame, *keys: str, value: str = "acc") -> DataFrame:
    """Mean, deviation and number of datasets of a value for each key."""
    return cells.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.countDistinct("dataset").alias("n"))


def diagram_profile(bars: DataFrame, groups: DataFrame) -> DataFrame:
    """By object type: mean and deviation over datasets of the numbers of 0- and 1-dimensional bars an image, their ratio
    (datasets without the latter are skipped), and whether the first are more than 5 times the second. groups has
    (image_id, dataset, object_type); an image without bars counts as 0."""
    counts = bars.groupBy("image_id").agg(F.count_if(F.col("hdim") == 0).alias("h0"), F.count_if(F.col("hdim") == 1).alias("h1"))
    images = groups.join(counts, "image_id", "left").fillna(0, ["h0", "h1"])
    sets = images.groupBy("object_type", "dataset").agg(F.avg("h0").alias("h0"), F.avg("h1").alias("h1"), F.count("*").alias("n"))
    ratio = F.avg(F.when(F.col("h1") > 0, F.col("h0") / F.col("h1")))
    return sets.groupBy("object_type").agg(
        F.avg("h0").alias("h0_mean"), F.stddev_pop("h0").alias("h0_std"), F.avg("h1").alias("h1_mean"), F.stddev_pop("h1").alias("h1_std"),
        ratio.alias("ratio"), F.sum("n").alias("n_images"), F.coalesce(ratio > 5, F.lit(False)).alias("h0_dominant"),
    )
