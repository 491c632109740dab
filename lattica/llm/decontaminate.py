"""Benchmark decontamination: size-partitioned MinHash containment search for short test items inside long documents,
verified by exact shingle containment. DataFrame functions only.

Items are partitioned by the power of two of their shingle number. An item of n shingles that a document holds to at
least `threshold` lacks at most n - ceil(threshold * n) of them, so one of its s = n - ceil(threshold * n) + 1 shingles of
least hash is in the document: this bottom-s MinHash sketch loses nothing. Each partition has a limit of its own, its
largest sketch hash, and a least number of shingles that a document must have. A document is probed once for each
partition that it is long enough for, with its hashes up to that partition's limit; probes and sketches meet on
(partition, hash). Documents that meet an item this way are read again, and the shingles themselves are compared.

Defined cases: text that is null or without words holds nothing and is no item; an item of fewer than k words is one
shingle, found only in documents of these words alone; a null id is carried along; repeated rows give repeated
results, repeated items of one id count as one set; a very long text is read whole; empty tables give an empty result;
extra columns are ignored, and carried along by without_contaminated() whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, table, trimmed_words, word_shingles

WORDS, THRESHOLD = 5, 0.8


def _needed(n, threshold: float):
    """ceil(threshold * n) in whole numbers."""
    return F.ceil(n * F.lit(int(round(threshold * 1000))) / 1000 - F.lit(1e-9)).cast("int")


def item_sketches(items: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(item_id, shingle, n) and (part, h, item_id, n): the items' shingles, and their bottom-s sketches."""
    words = trimmed_words(F.col("text"))
    each = items.select("item_id", F.explode(word_shingles(words, k, joined=True)).alias("shingle")).distinct()
    size = F.count("*").over(Window.partitionBy("item_id")).cast("int").alias("n")  # of one item: as long as its text
    hashed = items.select("item_id", F.explode(word_shingles(words, k)).alias("h")).groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs")).withColumn("n", F.size("hs"))
    part = F.floor(F.log2(F.col("n"))).cast("int").alias("part")
    sketch = hashed.select("item_id", part, "n", F.explode(F.slice("hs", F.lit(1), F.col("n") - _needed(F.col("n"), threshold) + 1)).alias("h"))
    return each.select("item_id", "shingle", size), sketch


def contaminated(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_shared, containment) for each row of docs(doc_id, text) that holds at
    least `threshold` of the shingles of an item of items(item_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    shingles, sketch = item_sketches(items.select("item_id", "text"), k, threshold)
    shingles, sketch = scratch.save(shingles, "shingles"), scratch.save(sketch, "sketch")
    parts = sketch.groupBy("part").agg(F.max("h").alias("most"), F.min("n").alias("least")).collect()  # a row for each power of two
    if not parts:
        return spark.createDataFrame([], "doc_id long, text_key long, item_id long, n_shingles int, n_shared int, containment double")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("text_key"))
    hashes = keyed.select("text_key", word_shingles(trimmed_words(F.col("text")), k).alias("hs"))

    def probes(part: int, most: int, least: int) -> Column:
        long_enough = F.size("hs") >= math.ceil(least * threshold - 1e-9)
        own = F.transform(F.filter("hs", lambda h: h <= most), lambda h: F.struct(F.lit(part).alias("part"), h.alias("h")))
        return F.when(long_enough, own).otherwise(F.array().cast("array<struct<part:int,h:bigint>>"))

    of_parts = F.concat(*[probes(r["part"], r["most"], r["least"]) for r in parts])
    met = hashes.select("text_key", F.explode(of_parts).alias("p")).select("text_key", "p.part", "p.h").join(broadcast_if_small(sketch.select("part", "h").distinct()), ["part", "h"], "left_semi")
    wanted = scratch.save(met.select("text_key").distinct(), "wanted")
    doc = keyed.join(broadcast_if_small(wanted), "text_key", "left_semi").select("text_key", F.explode(word_shingles(trimmed_words(F.col("text")), k, joined=True)).alias("shingle"))
    hit = doc.join(broadcast_if_small(shingles), "shingle").select("text_key", "item_id", "n", "shingle").distinct()
    shared = hit.groupBy("text_key", "item_id", "n").agg(F.count("*").cast("int").alias("n_shared")).where(F.col("n_shared") >= _needed(F.col("n"), threshold))
    shared = scratch.save(shared.withColumnRenamed("n", "n_shingles").withColumn("containment", F.col("n_shared") / F.col("n_shingles")), "shared")
    found = keyed.select("doc_id", "text_key").join(broadcast_if_small(shared), "text_key")
    return found.select("doc_id", "text_key", "item_id", "n_shingles", "n_shared", "containment")


def without_contaminated(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    bad = contaminated(docs, items, k, threshold).select("text_key").distinct()
    bad = Scratch(docs.sparkSession, "contaminated").save(bad, "bad")
    return row.join(broadcast_if_small(bad), F.xxhash64("row.doc_id", "row.text") == F.col("text_key"), "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'b', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS shingle FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n.n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared,
  round(count(*) / any_value(n.n), 6) AS containment
FROM s d JOIN s b ON d.kind = 'd' AND b.kind = 'b' AND d.shingle = b.shingle JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 10 >= 8 * any_value(n.n)
"""
