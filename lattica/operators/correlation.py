"""How alike descriptors are: principal components of each, and correlations of matching components."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over, save
from lattica.operators.features import sanitize

I = "image_id"
BINS = 4096


def components(vectors: DataFrame, most: int = 50) -> DataFrame:
    """(image_id, descriptor, k, x): the first principal components, at most `most`, of the standardised vectors of each
    descriptor of vectors(image_id, descriptor, vec); one fit for each descriptor."""
    vectors = save(vectors.select(I, "descriptor", sanitize(F.col("vec")).alias("vec")), "vectors")
    sizes = vectors.groupBy("descriptor").agg(F.min(F.size("vec")).alias("size"), F.count("*").alias("n")).orderBy("descriptor").collect()  # one row for each descriptor
    out = None
    for name, size, n in sizes:
        k = max(1, min(most, size, n - 1))
        part = vectors.where(F.col("descriptor") == name).withColumn("raw", array_to_vector("vec"))
        steps = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True), PCA(inputCol="z", outputCol="c", k=k)])
        got = steps.fit(part).transform(part).select(I, "descriptor", F.posexplode(vector_to_array("c")).alias("k", "x"))
        out = got if out is None else out.unionByName(got)
    return out


def spread_ranks(long: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the average rank of a value among the rows of its keys. Values are dealt to even bins over their range and ranked there,
    on top of the number of values in lower bins: no task sorts a key's values whole."""
    span = long.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    x = F.col(value)
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(0)
    n = long.groupBy(*keys, value).agg(F.count("*").alias("same")).join(span, keys).withColumn("bin", bin_).drop("low", "high")
    upto = n.groupBy(*keys, "bin").agg(F.sum("same").alias("many"))
    upto = upto.withColumn("before", F.sum("many").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("many")).drop("many")
    inside = F.sum("same").over(Window.partitionBy(*keys, "bin").orderBy(value))
    ranks = n.join(upto, [*keys, "bin"]).select(*keys, value, (F.col("before") + inside - (F.col("same") - 1) / 2).alias(name))
    return long.join(ranks, [*keys, value])


def descriptor_correlation(parts: DataFrame) -> DataFrame:
    """(a, b, pearson, spearman, n) for each ordered pair of descriptors of parts(image_id, descriptor, k, x): means of the absolute
    correlations of matching components; components without spread are left out of both, and a pair without any has 0. Without spread
    are those whose variance is below the rounding error of their descriptor's greatest: what rounding leaves of a component grows
    with the number of rows and changes with their order, and so would its ranks."""
    r = save(spread_ranks(parts, ["descriptor", "k"], "x", "rank"), "ranks")
    a, b = r.select(I, "k", F.col("descriptor").alias("a"), F.col("x").alias("xa"), F.col("rank").alias("ra")), r.select(I, "k", F.col("descriptor").alias("b"), F.col("x").alias("xb"), F.col("rank").alias("rb"))
    alike = lambda x, y: F.abs(F.covar_pop(x, y)) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    c = a.join(b, [I, "k"]).where("a < b").groupBy("a", "b", "k").agg(alike("xa", "xb").alias("p"), alike("ra", "rb").alias("s"), F.stddev_pop("xa").alias("da"), F.stddev_pop("xb").alias("db"))
    flat = lambda d: F.col(d) < F.greatest(F.lit(1e-12), F.max(d).over(over("a", "b")) * 1e-8)
    c = c.withColumn("flat", flat("da") | flat("db")).select("a", "b", *[F.when(~F.col("flat"), F.col(x)).alias(x) for x in "ps"])
    half = c.groupBy("a", "b").agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("pearson"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("spearman"), F.count("p").alias("n"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "pearson", "spearman", "n"))
