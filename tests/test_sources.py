"""Label sources, logs, resampling, scaling, rules and the descriptor registry on small inputs, with nulls and empty input."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import descriptors
from lattica.operators import resample, rules, vectors
from lattica.sources import labels


def pixels(spark, rows):
    return spark.createDataFrame([(1, r, c, float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "image_id long, r int, c int, v double")


def test_labels_from_path(spark):
    paths = ["d/b/1.png", "d/a/2.PNG", "d/a/.h.png", "d/a/3.txt", "4.png", None]
    got = labels.labels_from_path(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted((r.path, r["class"], r.label) for r in got) == [("d/a/2.PNG", "a", 0), ("d/b/1.png", "b", 1)]


def test_manifest_skips_what_is_no_number(spark):
    files = spark.createDataFrame([("x/1.png",), ("x/2.png",), ("x/3.png",)], "path string")
    one = spark.createDataFrame([("1", "4"), ("2", "n/a")], "id string, label string")
    two = spark.createDataFrame([("3", None), (None, "1")], "id string, label string")
    assert [tuple(r) for r in labels.labels_from_manifest(files, one, two).collect()] == [("x/1.png", 4)]


def test_sections_hold_in_their_own_log(spark):
    rows = [(1, 1, "a: s=1 accuracy=0.5"), (1, 2, "=== one ==="), (1, 3, "noise"), (1, 4, "b: accuracy=0.25"), (2, 1, "c: s=2 t=3 accuracy=1"), (2, 2, None)]
    got = labels.parse_text_logs(spark.createDataFrame(rows, "log_id int, line_no int, line string")).orderBy("log_id", "line_no").collect()
    assert [(r.section, r.descriptor, r.accuracy) for r in got] == [(None, "a", 0.5), ("one", "b", 0.25), (None, "c", 1.0)]
    assert got[2].params == {"s": "2", "t": "3"}


def test_merge_logs_drops_nulls_and_unknown(spark):
    a = spark.createDataFrame([("d", "x", 1, None), ("e", "x", 1, 2)], "dataset string, descriptor string, p int, q int")
    got = labels.merge_logs({"s": a}, spark.createDataFrame([("d",)], "dataset string")).collect()
    assert [(r.dataset, r.experiment, r.fields) for r in got] == [("d", "s", {"p": "1"})]


def test_area_resize_weights_by_overlap(spark):
    got = {(r.r, r.c): r.v for r in resample.area_resize(pixels(spark, [[0, 3, 6]] * 3), 2).collect()}
    assert got == pytest.approx({(0, 0): 1.0, (0, 1): 5.0, (1, 0): 1.0, (1, 1): 5.0})
    same = pixels(spark, [[1, 2], [3, 4]])
    assert sorted(map(tuple, resample.area_resize(same, 2).collect())) == sorted(map(tuple, same.collect()))


def test_rotation_by_a_quarter_and_by_nothing(spark):
    grid = pixels(spark, [[1, 2], [3, 4]])
    turned = {(r.r, r.c): r.v for r in resample.rotate(grid, 90.0).collect()}
    assert sorted(turned.values()) == pytest.approx([1, 2, 3, 4], abs=1e-9) and turned[(0, 0)] != pytest.approx(1)
    assert {(r.r, r.c): r.v for r in resample.rotate(grid, 0.0).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_noise_is_normal_and_repeatable(spark):
    z = spark.range(20_000).select(resample.normal("id").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03
    grid = pixels(spark, [[0, 1], [0.5, 0.5]])
    assert resample.add_noise(grid, 0.3).collect() == resample.add_noise(grid.repartition(3), 0.3).orderBy("r", "c").collect()
    assert resample.stability_report(grid, [0.0], 2).select("mean", "passed").collect()[0] == pytest.approx((1.0, True))


def test_scaling_learns_from_training_rows(spark):
    rows = [(1, 0, 1.0, True), (2, 0, 3.0, True), (3, 0, None, False), (4, 0, 1e12, False), (1, 1, 5.0, True), (2, 1, float("nan"), True), (9, 2, 4.0, False)]
    got = {(r.image_id, r.pos): r.x for r in vectors.impute_scale_clip(spark.createDataFrame(rows, "image_id int, pos int, x double, train boolean")).collect()}
    assert got == {(1, 0): -1.0, (2, 0): 1.0, (3, 0): 0.0, (4, 0): 1e6, (1, 1): 0.0, (2, 1): 0.0, (9, 2): 0.0}


def test_tuned_entries_win_one_by_one(spark):
    kinds = "descriptor string, object_type string, dim int, params map<string,string>"
    known = spark.createDataFrame([("x", "t", 10, {"a": "1", "b": "2"}), ("x", None, 7, {"a": "9"})], kinds)
    asked = spark.createDataFrame([("x", "t", True), ("x", "u", False), ("y", "t", False)], "descriptor string, object_type string, per_channel boolean")
    got = {(r.descriptor, r.object_type): (r.dim, r.params) for r in rules.params_for(asked, known, spark.createDataFrame([("x", "t", None, {"b": "5"})], kinds)).collect()}
    assert got == {("x", "t"): (30, {"a": "1", "b": "5"}), ("x", "u"): (7, {"a": "9"}), ("y", "t"): (None, None)}


def test_registry_takes_own_descriptors(spark):
    descriptors.register("sum", lambda grid, by: grid.groupBy("image_id").agg((F.sum("v") * by).alias("x")).withColumn("pos", F.lit(0)), "sum of pixels", by=1)
    grid = pixels(spark, [[1, 2], [3, 4]])
    assert [tuple(r) for r in descriptors.extract("sum", grid, by=2).collect()] == [(1, "sum", 0, 20.0)]
    assert "sum" in descriptors.names() and descriptors.describe("sum")["params"] == {"by": 1}
    with pytest.raises(KeyError):
        descriptors.extract("none", grid)
    with pytest.raises(TypeError):
        descriptors.extract("sum", grid, other=1)
