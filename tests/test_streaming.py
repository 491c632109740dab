"""A replayed stream ends with the batch aggregate."""

import tempfile

from lattica.streaming import rankings


def test_running_rankings_equal_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    stream = rankings.running_rankings(rankings.outcome_stream(spark, path))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("ranks").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    q.processAllAvailable()
    q.stop()
    rounded = lambda df: sorted((r.object_type, r.descriptor, r.trials, round(r.mean_acc, 9)) for r in df.collect())
    assert rounded(spark.table("ranks")) == rounded(rankings.running_rankings(rankings.outcomes(spark.read.parquet(path))))


def test_upsert_is_idempotent(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    write = rankings.upsert(path, ["k"])
    for batch, v in ((0, 1), (1, 2), (1, 2)):
        write(spark.createDataFrame([("a", v)], "k string, v int"), batch)
    got = rankings.latest(spark.read.option("recursiveFileLookup", "true").parquet(path), ["k"]).collect()
    assert [(r.k, r.v) for r in got] == [("a", 2)]


def test_upsert_keeps_one_row_of_each_key(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    write = rankings.upsert(path, ["k"], ["at"])
    write(spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("b", 9, None), ("b", 4, 0), (None, 5, 5)], "k string, v int, at int"), 0)
    write(spark.createDataFrame([("b", 7, 1), ("b", 8, 1)], "k string, v int, at int"), 1)
    got = rankings.latest(spark.read.option("recursiveFileLookup", "true").parquet(path), ["k"]).collect()
    assert {r.k: r.v for r in got if r.k != "b"} == {"a": 1, None: 5} and sum(r.k == "b" for r in got) == 1
    every = spark.read.option("recursiveFileLookup", "true").parquet(path).where("k = 'b'").collect()
    assert len(every) == 2
