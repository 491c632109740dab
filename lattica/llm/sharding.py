r"""Sampled splitters: a size-weighted sample of keys gives quantile boundaries, records are range-partitioned by them,
and ranges that come out overfull are subdivided by a closer sample until they are small or hold one key.

The key is 64 bits: 40 of the text's hash, then 24 of the id's hash. Equal texts are neighbours and share a range; only
where one text alone is overfull do boundaries fall inside it. Within its range a record's place is exact, and ranges
know what lies before them; so the law `bytes` holds exactly: shard = where the middle of the record falls in the line
of all records. A group of equal texts of at most `whole` of a shard is placed as one record and stays together.

Only the boundaries and one row a range pass the driver: about total bytes / range bytes, at least 16 a shard.

Defined cases: a null text has no bytes (size 16), a null id has a fixed place; repeated rows take different slots
(which of the equal rows takes which is open) and may all lie in one range; a very long text is one record; ties of the key are ordered by text hash, id and size; an empty table
gives an empty result; with fewer records than shards some shards stay empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Sampled keys for each range that is sought.
OVERSAMPLING = 30
RANGE_BYTES = 64_000_000


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, key) of docs(doc_id, text)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    out = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    low = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 40)
    return out.withColumn("key", F.shiftleft(F.shiftright("text_hash", 24), 24).bitwiseOR(low))


def _quantiles(keys: np.ndarray, many: int) -> np.ndarray:
    """Boundaries at the quantiles of a size-weighted sample. A boundary goes to the start of its text's keys, unless
    the text holds several quantiles: then it is to be cut."""
    if not len(keys) or many < 2:
        return np.zeros(0, np.int64)
    keys = np.sort(keys)
    cut = keys[np.arange(1, many) * len(keys) // many]
    text = cut >> 24
    again = np.concatenate(([False], text[1:] == text[:-1]))
    return np.unique(np.where(again, cut, text << 24))


def range_of(cuts: np.ndarray, column: str = "key"):
    shared = cuts

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared, key.to_numpy(), "right").astype(np.int32))

    return find(F.col(column))


def _closer(keys: np.ndarray, many: int, first: int, last: int) -> np.ndarray:
    """Boundaries that part a range of keys `first` to `last`, first < last, from a sample of its keys. Where quantiles do
    not part it, nearly all bytes are at one key: this key is cut out on both sides."""
    inside = lambda cuts: cuts[(cuts > first) & (cuts <= last)]
    cuts = inside(_quantiles(keys, many))
    if len(cuts):
        return cuts
    found, often = np.unique(keys, return_counts=True)
    most = int(found[often.argmax()]) if len(found) else first + (last - first) // 2
    return inside(np.array([most, min(most + 1, last)], np.int64))


def splitters(rows: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, list]:
    """Boundaries and, for each range, (range, bytes, rows, first, last). Overfull ranges are subdivided until each takes
    at most twice its share of bytes or holds a single key, that is rows with equal id and text."""
    chance = lambda share: F.abs(F.xxhash64("doc_id", "text_hash", F.lit(5)) % 1_000_003) / 1_000_003 < share
    goal = max(total / ranges, 1)
    sample = rows.where(chance(F.col("size") * (OVERSAMPLING / goal))).select("key").toPandas()["key"].to_numpy(np.int64)
    cuts = _quantiles(sample, ranges)
    while True:
        found = rows.groupBy(range_of(cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last")).orderBy("range").collect()
        over = [r for r in found if r["bytes"] > 2 * goal and r["last"] > r["first"]]
        if not over:
            return cuts, found
        inside = rows.withColumn("range", range_of(cuts)).where(F.col("range").isin([r["range"] for r in over]))
        closer = inside.where(chance(F.col("size") * (8 * OVERSAMPLING / goal))).select("range", "key").toPandas()
        own = lambda r: closer["key"].to_numpy(np.int64)[closer["range"].to_numpy() == r["range"]]
        cuts = np.unique(np.concatenate([cuts, *[_closer(own(r), int(np.ceil(r["bytes"] / goal)), r["first"], r["last"]) for r in over]]))


def shard_by_bytes(docs: DataFrame, shards: int = 40, whole: float = 0.01) -> DataFrame:
    """Places every row of docs(doc_id, text) in shards 0 to shards - 1 of near equal bytes, with a gapless slot. `whole`
    is a share well below that of a range (1/16 of a shard), so that no range cuts such a group."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.save(records(docs), "records")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goal = max(total / shards, 1.0)
    cuts, found = splitters(rows, total, max(16 * shards, total // RANGE_BYTES))
    before_bytes = np.concatenate(([0], np.cumsum([r["bytes"] for r in found]))).tolist()
    before_rows = np.concatenate(([0], np.cumsum([r["rows"] for r in found]))).tolist()
    ends = np.concatenate(([np.iinfo(np.int64).min], cuts, [np.iinfo(np.int64).max])).tolist()
    offsets = docs.sparkSession.createDataFrame([(r["range"], int(b), int(n), ends[r["range"]], ends[r["range"] + 1]) for r, b, n in zip(found, before_bytes, before_rows)], "range int, bytes_before long, rows_before long, low long, high long")
    line = Window.partitionBy("range").orderBy("key", "text_hash", "doc_id", "size", "text_crc32")
    same = Window.partitionBy("range", "text_hash")
    # one row for each range
    placed = rows.withColumn("range", range_of(cuts)).join(F.broadcast(offsets), "range")
    placed = placed.withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("rank", F.row_number().over(line) - 1)
    # equal texts need not be neighbours where 40 bits of two hashes agree: then each is placed by itself
    placed = placed.withColumn("group_bytes", F.sum("size").over(same)).withColumn("group_first", F.min("upto").over(same)).withColumn("group_end", F.max(F.col("upto") + F.col("size")).over(same))
    start = F.shiftleft(F.shiftright("key", 24), 24)
    uncut = (start >= F.col("low")) & (start.bitwiseOR(F.lit((1 << 24) - 1)) < F.col("high"))
    one = uncut & (F.col("group_bytes") <= whole * goal) & (F.col("group_end") - F.col("group_first") == F.col("group_bytes"))
    middle = F.when(one, F.col("group_first") + F.col("group_bytes") / 2).otherwise(F.col("upto") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + middle) / goal).cast("int"))
    placed = scratch.save(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("rank")).alias("place")), "placed")
    scratch.drop("records")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
