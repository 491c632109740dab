"""Tables of finished rounds are deleted; what later steps read stays."""

import os

from lattica.functions.tables import drop, save
from lattica.operators import components, persistence


def folders(spark):
    top = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.scratch").removeprefix("file:")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def path_graph(spark, n):
    """A path whose heights rise and fall, so that many clusters merge in turn."""
    nodes = spark.createDataFrame([("p", k, float((k * 37) % 23)) for k in range(n)], "g string, id long, v double")
    return nodes, spark.createDataFrame([("p", k, k + 1) for k in range(n - 1)], "g string, a long, b long")


def test_drop_deletes_saved_tables_only(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/mine")
    mine, saved, empty = spark.read.parquet(f"{tmp_path}/mine"), save(spark.range(5), "five"), save(spark.range(0), "none")
    before = folders(spark)
    drop(mine, saved, empty)
    assert mine.count() == 3 and len(before - folders(spark)) == 2


def test_rounds_leave_only_what_is_read(spark):
    nodes, edges = path_graph(spark, 40)
    before = folders(spark)
    found = components.connected_components(nodes, edges)
    assert {r.label for r in found.collect()} == {0} and len(folders(spark) - before) == 1
    before = folders(spark)
    bars = persistence.persistence_h0_graph(nodes, edges)
    got = sorted((r.birth, r.death) for r in bars.where("death is not null").collect())
    assert bars.where("death is null").count() == 1 and got and all(b < d for b, d in got)
    left = sorted(x.rpartition("-")[0] for x in folders(spark) - before)
    assert set(left) <= {"ranked", "least", "deaths"} and left.count("ranked") == 1
