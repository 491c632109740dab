"""Labels from file paths and manifests, and records from experiment logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def labels_from_path(files: DataFrame, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, class, label) of files(path): the class is the parent folder, the label its place in alphabetical order.
    Hidden files, other extensions and files without a folder are left out. Only class names are numbered in one place."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class")).where((F.col("class") != "") & ending.isin(*extensions) & ~F.col("path").rlike(r"(^|/)\.[^/]*$"))
    names = kept.select("class").distinct().withColumn("label", F.row_number().over(Window.orderBy("class")) - 1)
    return kept.join(names, "class").select("path", "class", "label")


def labels_from_manifest(files: DataFrame, *splits: DataFrame) -> DataFrame:
    """(path, label) of files(path) whose name without extension is an id of splits(id, label); labels that are no number
    are left out."""
    listed = reduce(DataFrame.unionByName, [x.select(F.col("id").cast("string").alias("stem"), F.col("label").cast("string").alias("label")) for x in splits])
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", stem.alias("stem")).join(listed.where(F.col("label").rlike("^[0-9]+$")), "stem").select("path", F.col("label").cast("int").alias("label"))


def merge_logs(families: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """(dataset, descriptor, experiment, fields MAP): the entries of every family, each with its experiment's name. Null
    fields and datasets that are not in known(dataset) are dropped."""

    def entries(name: str, df: DataFrame) -> DataFrame:
        pairs = [x for c in df.columns if c not in ("dataset", "descriptor") for x in (F.lit(c), F.col(c).cast("string"))]
        return df.select("dataset", "descriptor", F.lit(name).alias("experiment"), F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("fields"))

    return reduce(DataFrame.unionByName, [entries(k, v) for k, v in families.items()]).join(known.select("dataset"), "dataset", "left_semi")


def parse_text_logs(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, section, descriptor, params, accuracy) of lines(log_id, line_no, line) such as
    `name: sigma=1 bins=4 accuracy=0.93`. A header `=== section ===` holds until the next one of its log; records before
    the first header have no section, other lines are left out."""
    so_far = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.nullif(F.regexp_extract("line", r"^=== (.+) ===$", 1), F.lit(""))
    record = r"^(\w+):((?: \w+=\S+)*) accuracy=([0-9.]+)$"
    rows = lines.select("log_id", "line_no", "line", F.last(header, ignorenulls=True).over(so_far).alias("section")).where(F.col("line").rlike(record))
    params = F.str_to_map(F.btrim(F.regexp_extract("line", record, 2)), F.lit(" "), F.lit("="))
    return rows.select("log_id", "line_no", "section", F.regexp_extract("line", record, 1).alias("descriptor"), params.alias("params"), F.regexp_extract("line", record, 3).cast("double").alias("accuracy"))
