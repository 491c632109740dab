"""Rounded means and deviations over many rows."""

import numpy as np
from pyspark.sql import functions as F

from lattica.functions.tables import std6
from lattica.operators import selection


def test_deviation_of_many_rows_passes_64_bits(spark):
    """20,000 numbers near 1, in millionths: the squared sum is 4e20."""
    x = np.round(0.5 + (np.arange(20_000) * 7919 % 1_000_003) / 1e6, 6)
    rows = spark.range(20_000).select(F.lit("a").alias("descriptor"), F.round(0.5 + F.col("id") * 7919 % 1_000_003 / 1e6, 6).alias("acc"))
    assert rows.agg(std6("acc", "std")).first().std == round(float(x.std()), 6)
    got = selection.sweep_sensitivity(rows.select("descriptor", F.create_map(F.lit("p"), F.lit("1")).alias("params"), "acc")).collect()
    assert [(r.std, r.n, r.range) for r in got] == [(round(float(x.std()), 6), 20_000, 0.0)]
    assert spark.createDataFrame([], "acc double").agg(std6("acc", "std")).first().std is None
