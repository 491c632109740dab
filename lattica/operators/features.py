"""Feature-vector operators on vectors(image_id, vec ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.tables import over

I = "image_id"


def fit_length(vec: Column, n: int) -> Column:
    return F.slice(F.concat(F.coalesce(vec, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def sanitize(vec: Column, limit: float = 1e10) -> Column:
    bad = lambda x: F.isnan(x) | F.abs(x).eqNullSafe(F.lit(float("inf"))) | x.isNull()
    return F.transform(vec, lambda x: F.when(bad(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))))


def feature_quality(vectors: DataFrame) -> DataFrame:
    """Length, sparsity, moments, quartiles and informative or constant places of each vector."""
    x = vectors.select(I, F.posexplode("vec").alias("pos", "x")).withColumn("m", F.avg("x").over(over(I)))
    x = x.withColumn("dev", (F.col("x") - F.col("m")) ** 2).withColumn("all", F.sum("dev").over(over(I))).withColumn("n", F.count("*").over(over(I)))
    q = lambda p: F.expr(f"percentile(x, {p})")
    moment = lambda f: F.when((F.count("*") > 3) & (F.stddev_pop("x") > 1e-12), f("x")).otherwise(0.0)
    return x.groupBy(I).agg(
        F.count("*").alias("n"), (100 * F.avg((F.abs("x") < 1e-10).cast("int"))).alias("sparsity"), F.var_pop("x").alias("variance"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        moment(F.kurtosis).alias("kurtosis"), moment(F.skewness).alias("skew"), q(0.25).alias("p25"), q(0.75).alias("p75"), (q(0.75) - q(0.25)).alias("iqr"),
        F.sum((F.col("dev") > 0.01 * F.col("all") / F.col("n")).cast("int")).alias("n_informative"), F.sum((F.abs(F.col("x") - F.col("m")) < 1e-12).cast("int")).alias("n_constant"),
    )


def vector_summary(vectors: DataFrame) -> DataFrame:
    """(image_id, length, mean, std, max, min); an empty vector has length 0 and no other values."""
    x = vectors.select(I, F.explode_outer("vec").alias("x"))
    return x.groupBy(I).agg(F.count("x").alias("length"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min"))


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


def linear_cka(long: DataFrame, names: str = "descriptor") -> DataFrame:
    """(a, b, cka) from long(image_id, descriptor, pos, x): |XtY|^2 / (|XtX| |YtY|) on standardised columns, through the
    products of columns; no image-by-image kernel is made."""
    w = over(names, "pos")
    sd = F.stddev_pop("x").over(w)
    z = long.select(I, names, "pos", F.when(sd > 1e-12, (F.col("x") - F.avg("x").over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0).alias("z"))
    x, y = z.toDF(I, "a", "i", "za"), z.toDF(I, "b", "j", "zb")
    p = x.join(y, I).groupBy("a", "b", "i", "j").agg(F.sum(F.col("za") * F.col("zb")).alias("p")).groupBy("a", "b").agg(F.sum(F.col("p") ** 2).alias("h"))
    own = p.where("a = b").select(F.col("a").alias("of"), "h")
    left, right = own.toDF("a", "ha"), own.toDF("b", "hb")
    norm = F.sqrt(F.col("ha") * F.col("hb"))
    return p.join(left, "a").join(right, "b").select("a", "b", F.when(norm > 0, F.col("h") / F.nullif(norm, F.lit(0.0))).otherwise(0.0).alias("cka"))
