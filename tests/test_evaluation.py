"""Cross-validation without leaks, channels, image files and the diagram store."""

import struct
import zlib

from pyspark.sql import functions as F

from lattica.operators import diagram, evaluation, persistence
from lattica.sources import diagrams, images


def rows(spark, flip=None):
    """Two classes apart on the first place; labels of the fold `flip` are turned around."""
    x = spark.range(200).select("id", (F.col("id") % 5).cast("int").alias("fold"), (F.floor(F.col("id") / 5) % 2).cast("double").alias("label"))
    vec = F.array(F.col("label") * 4 + (F.col("id") % 7) / 7, (F.col("id") % 11).cast("double"))
    x = x.withColumn("vec", vec)
    return x if flip is None else x.withColumn("label", F.when(F.col("fold") == flip, 1 - F.col("label")).otherwise(F.col("label")))


def test_cross_validation_learns_and_a_fold_does_not_teach_itself(spark):
    model = evaluation.classifier("logistic", 2, 2)
    plain = {r.id: r.pred for r in evaluation.cross_validate(rows(spark), model).collect()}
    report = evaluation.fold_report(evaluation.cross_validate(rows(spark), model)).collect()
    assert len(plain) == 200 and len(report) == 5 and all(r.accuracy == 1.0 and r.macro_f1 == 1.0 for r in report)
    turned = {r.id: r.pred for r in evaluation.cross_validate(rows(spark, flip=2), model).where("fold = 2").collect()}
    assert turned == {k: v for k, v in plain.items() if k % 5 == 2}


def test_learned_descriptors_see_training_folds_only(spark):
    seen = []

    def fit(train):
        seen.append({r.fold for r in train.select("fold").distinct().collect()})
        low = train.select(F.min(F.col("vec")[0])).first()[0]
        return lambda x: x.withColumn("vec", F.transform("vec", lambda v: v - low))

    got = evaluation.cross_validate(rows(spark), evaluation.classifier("logistic", 2, 2), fit=fit)
    assert got.count() == 200 and seen == [set(range(5)) - {k} for k in range(5)]


def test_fold_report_counts_classes_that_are_only_predicted(spark):
    got = evaluation.fold_report(spark.createDataFrame([(0, 1, 1, None), (0, 1, 2, None)], "fold int, truth int, pred int, confidence double")).first()
    assert (got.accuracy, got.balanced_accuracy, got.confidence) == (0.5, 0.5, -1.0)
    assert abs(got.macro_f1 - (2 / 3 + 0) / 2) < 1e-12


def png(height, width, pixels):
    """An 8-bit RGB file of rows of (r, g, b)."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + bytes(v for p in pixels[r * width : (r + 1) * width] for v in p) for r in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_image_files(spark, tmp_path):
    pixels = [(10 * k, 100 + k, 200 - k) for k in range(6)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(2, 3, pixels))
    (tmp_path / "a" / "flat.png").write_bytes(png(1, 2, [(7, 7, 7)] * 2))
    (tmp_path / "a" / "no.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path))
    assert {(r.height, r.width, r.n_channels) for r in read.collect()} == {(2, 3, 3), (1, 2, 3)}
    at = {(r.channel, r.r, r.c): r.v for r in images.image_pixels(read).where("image_id like '%x.png'").collect()}
    assert at == {(name, k // 3, k % 3): float(p[i]) for k, p in enumerate(pixels) for i, name in enumerate("RGB")}
    gray = images.gray_grids(images.image_pixels(read))
    assert {r.v for r in gray.where("image_id like '%flat.png'").collect()} == {0.0}
    assert [round(r.v, 6) for r in gray.where("image_id like '%x.png'").orderBy("r", "c").collect()] == [k / 5 for k in range(6)]


def test_diagram_store_takes_each_image_once(spark, tmp_path):
    bars = "dataset string, channel string, image_id long, hdim int, birth double, death double"
    path = str(tmp_path / "store")
    diagrams.write_diagrams(spark.createDataFrame([("d", "gray", 1, 0, 0.0, 1.0), ("d", "R", 1, 0, 0.1, 1.0)], bars), path)
    diagrams.write_diagrams(spark.createDataFrame([("d", "gray", 1, 0, 0.5, 1.0), ("e", "gray", 1, 1, 0.2, 0.3)], bars), path)
    assert sorted(tuple(r) for r in diagrams.read_diagrams(spark, path).select("dataset", "channel", "birth").collect()) == [("d", "R", 0.1), ("d", "gray", 0.0), ("e", "gray", 0.2)]
    assert diagrams.read_diagrams(spark, path, "d", "R").count() == 1


def test_equal_images_are_solved_once_and_stored(spark, tmp_path):
    one, two = [0.0, 5.0, 1.0, 5.0, 5.0, 5.0], [3.0, 1.0, 2.0]
    path = str(tmp_path / "filled")
    schema = "image_id long, pixels array<double>, width int"
    first = spark.createDataFrame([(1, one, 3), (2, one, 3), (3, two, 3)], schema)
    got = sorted((r.image_id, r.hdim, r.birth, r.death) for r in diagrams.fill_diagrams(first, path).where("death is not null").collect())
    assert got == [(1, 0, 1.0, 5.0), (2, 0, 1.0, 5.0)]
    stored = spark.read.parquet(path).count()
    again = diagrams.fill_diagrams(spark.createDataFrame([(9, one, 3)], schema), path)
    assert {(r.image_id, r.birth) for r in again.where("death is not null").collect()} == {(9, 1.0)} and spark.read.parquet(path).count() == stored


def test_persistence_by_channel_equals_each_channel_alone(spark):
    x = spark.range(2 * 3 * 9).select((F.col("id") % 2).alias("image_id"), F.element_at(F.array(*map(F.lit, "RGB")), (F.floor(F.col("id") / 2) % 3 + 1).cast("int")).alias("channel"), F.floor(F.col("id") / 18).cast("int").alias("r"), (F.floor(F.col("id") / 6) % 3).cast("int").alias("c"), (F.col("id") * 37 % 11).cast("double").alias("v"))
    shown = lambda d, *more: sorted(((r.image_id, *more, r.hdim, r.birth, r.death) if more else (r.image_id, r.channel, r.hdim, r.birth, r.death) for r in d.collect()), key=str)
    got = shown(evaluation.by_channel(x, persistence.persistence))
    alone = [row for c in "RGB" for row in shown(persistence.persistence(x.where(F.col("channel") == c).drop("channel")), c)]
    assert got == sorted(alone, key=str) and got


def test_codebook_centers_hold_the_points(spark):
    bars = spark.createDataFrame([(1, h, b, b + p) for h in (0, 1) for b, p in ((0.0, 0.1), (0.0, 0.2), (5.0, 3.0))], "image_id long, hdim int, birth double, death double")
    centers = sorted((round(r.cx, 6), round(r.cy, 6)) for r in diagram.codebook_fit(bars, 2).collect())
    assert centers == [(0.0, 0.15), (5.0, 3.0)]


def test_rows_of_one_file_are_dealt_to_all_tasks(spark, monkeypatch):
    """An iterative fit of rows in one part would run in one task."""
    rows = spark.range(400).select("id", (F.col("id") % 2).alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("vec")).coalesce(1)
    kept = {}

    def note(df, name):
        kept[name] = (df.rdd.getNumPartitions(), df.count())
        return df

    monkeypatch.setattr(evaluation, "save", note)
    got = evaluation.cross_validate(rows, evaluation.classifier("logistic", 2, 2), 2)
    assert kept["folds"] == (spark.sparkContext.defaultParallelism, 400)
    assert got.count() == 400 and got.where("truth = pred").count() == 400
