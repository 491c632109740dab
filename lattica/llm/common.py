"""Helpers that the operators of this folder share: scratch tables, word rules, small column expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Parquet tables in the shared folder of the cluster; they cut lineage and outlive a lost executor.

    The folder is the session's spark.checkpoint.dir. Only where that is unset (tests, local mode) a folder below
    the warehouse is used, which local mode shares as well.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.scratch"
        self.path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def drop(self, *tables: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words by the rule `[^\x20\x09-\x0D]+`, A-Z lower-cased; no text: an empty array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: w != "")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def small_slices(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice take about `most` bytes; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()))
        begin = total = 0
        for k, n in enumerate(size.to_pylist()):
            if total and total + (n or 0) > most:
                yield batch.slice(begin, k - begin)
                begin, total = k, 0
            total += n or 0
        yield batch.slice(begin)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A broadcast hint for a saved table of at most `most` narrow rows, counted here; else Spark joins by shuffling."""
    return F.broadcast(df) if df.count() <= most else df


def trimmed_words(text: Column) -> Column:
    """Words by the rule `[^\\x20\\x09-\\x0D]+`, all letters lower-cased; no text or no word: an empty array."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once; inside lambdas a plain expression would be worked out at each step."""
    return F.get(F.transform(F.array(value), f), 0)


def word_shingles(words: Column, k: int, joined: bool = False) -> Column:
    """Of each k words in a row a 64-bit hash, or the words themselves where `joined`; fewer words make one shingle."""
    return bound(words, lambda w: _shingles(w, k, joined))


def _shingles(words: Column, k: int, joined: bool) -> Column:
    whole = F.array_join(words, " ")
    at = lambda i: [F.get(words, i + j) for j in range(k)]
    each = (lambda i: F.concat_ws(" ", *at(i))) if joined else (lambda i: F.xxhash64(*at(i)))
    short = F.array(whole if joined else F.xxhash64(whole))
    none = F.array().cast("array<string>" if joined else "array<bigint>")
    return F.when(F.size(words) == 0, none).when(F.size(words) < k, short).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - k), each))
