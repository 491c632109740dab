"""Most alike rows against the comparison of all pairs, with copies, dense and sparse places, ties and vectors without direction."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.operators import alike
from lattica.operators.features import cosine_similarity


def _rows(rng, n, spread):
    base = [rng.uniform(1, 9) for _ in range(3)]
    return [[x + rng.gauss(0, spread) for x in base] for _ in range(n)]


def _tables(spark):
    rng = random.Random(5)
    vectors = _rows(rng, 150, 1.0) + _rows(rng, 400, 0.01) + _rows(rng, 300, 0.002) + [[1.0, 2.0, 3.0]] * 40 + [[2.0, 4.0, 6.0]] * 20 + [[-1.0, 0.0, 1e-9]] * 3 + [[0.0, 0.0, 0.0]] * 7 + [[float("nan"), 1.0, 1.0]] * 2 + [[None, 1.0, 1.0], [0.0, float("inf"), 1.0]]
    rng.shuffle(vectors)
    known = spark.createDataFrame([(rng.choice("abb") if i % 90 else "c", i, v) for i, v in enumerate(vectors)], "scope string, id long, y array<double>")
    asked = known.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.when(F.col("id") % 6 == 0, "b").otherwise(F.col("scope")).alias("scope"), F.col("y").alias("x"))
    return asked, known


def test_most_alike_is_brute_force(spark):
    asked, known = _tables(spark)
    each = asked.join(known, "scope").select("query_id", "id", F.round(cosine_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    key = lambda df: sorted(map(str, df.select("query_id", "id", "similarity", "rank").collect()))
    assert key(alike.most_alike(asked, known, 5, 3)) == key(each.withColumn("rank", rank).where("rank <= 5"))


def test_rows_are_not_compared_with_all(spark):
    """Ten times the rows of the same spread give about ten times the candidates, not a hundred times."""
    many = {}
    for n in (500, 5000):
        rng = random.Random(1)
        known = spark.createDataFrame([("a", i, v) for i, v in enumerate(_rows(rng, n, 0.05))], "scope string, id long, y array<double>")
        asked = known.where("id % 10 = 0").select(F.col("id").alias("query_id"), "scope", F.col("y").alias("x"))
        many[n] = alike.candidates(asked, known, 5, 3).count()
    assert many[5000] < 20 * many[500]
