r"""Phrase collocations from count streams: the counts of words, pairs and triples of each language lie in one sorted
stream, first in prefix order and then in suffix order, and a scan in lockstep gives each phrase the counts of its left
part, its right part and its longest extension. No count is looked up by hash.

Counting is level by level. A phrase with `least` occurrences has only parts with as many, so pairs are counted where
both words are frequent and triples where both pairs are; a bit table of fixed size (`bits`) tells that, made from the
exact counts of the level below. It lets some rare phrases through, never holds back a frequent one, and whatever it lets
through is counted exactly; a fuller table only costs time.

The stream in prefix order is cut into ranges of (lang, first, second) at sampled splitters. A word's own count is copied
to each range that its phrases reach, so a frequent word takes many tasks and a scan holds one open word and pair. The
rows then go, with what they have learned, into suffix order (last word first), which is cut and scanned the same way.

Defined cases: a null text is empty; a null language is `und`; ties of score and count go by phrase in byte order;
repeated rows count each; a text is read in parts cut at piece ends, so a very long text takes no more memory than
its longest piece; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, arrow_map, record_batch, small_slices, table

PARAMETERS = dict(least=10, top=2000, percent=50, bits=26)
#: A-Z lower-cased, tabs to spaces, all piece ends to commas, which no word holds.
FOLD = bytes.maketrans((UPPER + "\t.;:!?\n\x0b\x0c\r").encode(), (LOWER + " " + "," * 9).encode())
#: Bytes of text that are counted at once.
PART = 4_000_000
SPLITTERS_EACH = 100
GRAM = "lang string, w1 string, w2 string, w3 string, n long"


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray]]:
    """(language, words in order as a dictionary array): a comma stands between pieces."""
    for batch in small_slices(batches, most=PART):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.large_binary()).to_pylist(), strict=True):
            if text:
                by.setdefault("und" if lang is None else lang, []).append(text)
        for lang, many in by.items():
            whole = b",".join(many).translate(FOLD)
            begin = 0
            while begin < len(whole):
                end = len(whole) if len(whole) - begin <= PART else whole.rfind(b",", begin, begin + PART)
                if end < begin:  # one piece longer than a part
                    end = whole.find(b",", begin + PART)
                    end = len(whole) if end < 0 else end
                words = whole[begin:end].replace(b",", b" , ").split()
                begin = end + 1
                if words:
                    yield lang, pa.array([b",", *words], pa.binary()).dictionary_encode()  # number 0 is the comma


def place(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a pair of 32-bit word hashes; of a word: that of (word, 0)."""
    return (a * 40_503 + b * 65_599) % ((1 << bits) - 5)


def frequent_bits(grams: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the words, or pairs, of grams: at most 2^bits / 64 rows come to the driver, whatever the input."""
    crc = lambda c: F.crc32(F.encode(c, "UTF-8"))
    second = F.when(F.col("w2").isNull(), F.lit(0)).otherwise(crc(F.coalesce("w2", F.lit(""))))
    at = (crc(F.col("w1")) * 40_503 + second * 65_599) % ((1 << bits) - 5)
    cells = grams.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros((1 << bits) // 64 + 1, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return out


def _among(table_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def count(docs: DataFrame, k: int, bits: int, tables: list[np.ndarray]) -> DataFrame:
    """(lang, w1, w2, w3, n) of phrases of k words, for k > 1 of those whose parts are in the bit tables of the levels below."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, coded in _parts(batches):
            values, ids = coded.dictionary, coded.indices.to_numpy()
            m, picked, columns = len(values), [], []
            if k == 1:
                n = np.bincount(ids, minlength=m)[1:]
                columns = [np.arange(1, m)]
            else:
                crc = np.fromiter(map(zlib.crc32, values.to_pylist()), np.int64, m)
                ok = _among(shared.value[0], place(crc, np.zeros(m, np.int64), bits))
                ok[0] = False
                at = np.flatnonzero(ok[ids[:-1]] & ok[ids[1:]])  # pairs of frequent words
                pair, number = np.unique(ids[at].astype(np.int64) * m + ids[at + 1], return_inverse=True)
                if k == 2:
                    n, columns = np.bincount(number, minlength=len(pair)), [pair // m, pair % m]
                else:
                    good = _among(shared.value[1], place(crc[pair // m], crc[pair % m], bits))[number]
                    at, number = at[good], number[good]
                    chained = np.flatnonzero(at[1:] == at[:-1] + 1)
                    triple, n = np.unique(number[chained].astype(np.int64) * m + ids[at[chained] + 2], return_counts=True)
                    columns = [pair[triple // m] // m, pair[triple // m] % m, triple % m]
            if len(n):
                picked = [values.take(pa.array(c)).cast(pa.string()) for c in columns]
                none = [pa.nulls(len(n), pa.string())] * (3 - k)
                yield record_batch(schema, pa.repeat(pa.scalar(lang, pa.string()), len(n)), *picked, *none, pa.array(n.astype(np.int64)))

    return arrow_map(docs.select("text", "lang"), run, GRAM).groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))


def dealt(stream: DataFrame) -> DataFrame:
    """The stream in the order of (lang, w1, w2, w3), shorter phrases before their extensions, dealt to ranges of
    (lang, w1, w2) between sampled splitters; each range is one sorted partition. Words are copied to each range that
    their phrases reach; all copies but the first carry copy = true."""
    spark = stream.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longer = stream.where("size > 1").select("lang", "w1", "w2", (F.abs(F.xxhash64("lang", "w1", "w2", "w3") % 1_000_003) / 1_000_003).alias("draw"))
    few = longer.where(F.col("draw") < SPLITTERS_EACH * many / max(longer.count(), 1)).drop("draw")
    sample = sorted(tuple(r) for r in few.collect())  # about SPLITTERS_EACH rows a partition
    cuts = sorted({sample[len(sample) * k // many] for k in range(1, many)}) if sample else []
    shared = spark.sparkContext.broadcast(cuts)
    fields = stream.schema.names
    at = [fields.index(x) for x in ("lang", "w1", "w2", "size")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            take, bucket, copy = [], [], []
            for k, (lang, first, second, size) in enumerate(zip(*(batch.column(i).to_pylist() for i in at), strict=True)):
                if size > 1:
                    low = high = bisect_right(cuts, (lang, first, second))
                else:  # (lang, first) comes before all pairs of the word, first + "\0" is the next string after it
                    low, high = bisect_right(cuts, (lang, first)), bisect_left(cuts, (lang, first + "\0"))
                for b in range(low, high + 1):
                    take.append(k)
                    bucket.append(b)
                    copy.append(b > low)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(bucket, pa.int32()), pa.array(copy, pa.bool_())], [*fields, "bucket", "copy"])

    order = ["lang", *(F.col(c).asc_nulls_first() for c in ("w1", "w2", "w3"))]
    return arrow_map(stream, run, f"{_ddl(stream)}, bucket int, copy boolean").repartitionById(many, "bucket").sortWithinPartitions(*order)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def scan(stream: DataFrame, side: str) -> DataFrame:
    """Lockstep scan of a dealt stream(lang, w1, w2, w3, n, ...): each phrase gets `one`, the count of the word that it
    begins with in this order; a triple also `two`, that of its first pair; a pair `ext`, that of its most frequent extension."""
    kept = stream.drop("bucket", "copy")
    extra = [f"{x}_{side}" for x in ("one", "two", "ext")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_n = pair_n = ext = 0
        held: tuple | None = None  # the open pair, given out when its extensions are over
        schema = None
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:-1], *(pa.field(x, pa.int64()) for x in extra)])
            out = []
            for *row, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, second, third = row[4], row[2], row[3]
                if third is not None:
                    ext = max(ext, n)
                    out.append((*row, word_n, pair_n, None))
                    continue
                if held is not None:
                    out.append((*held, word_n, None, ext))
                    held = None
                if second is not None:
                    held, pair_n, ext = row, n, 0
                else:
                    word_n = n
                    if not copy:
                        out.append((*row, None, None, None))
            if out:
                yield record_batch(schema, *zip(*out))
        if held is not None:
            yield record_batch(schema, *([x] for x in (*held, word_n, None, ext)))

    return arrow_map(stream.select(*kept.columns, "copy"), run, _ddl(kept) + "".join(f", {x} long" for x in extra))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, percent: int = 50, bits: int = 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(text, lang): the first `top` phrases of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    words = scratch.save(count(docs, 1, bits, []), "words")
    levels, tables = [words.where(F.col("n") >= least)], []
    for k in (2, 3):
        tables.append(frequent_bits(levels[-1], bits))
        levels.append(scratch.save(count(docs, k, bits, tables).where(F.col("n") >= least), f"phrases{k}"))
    each = [level.select("lang", "w1", "w2", "w3", "n", F.lit(k).alias("size")) for k, level in enumerate(levels, 1)]
    prefix = scratch.save(scan(dealt(each[0].unionByName(each[1]).unionByName(each[2])), "left"), "prefix")
    # suffix order: w1 becomes the last word of a phrase, w2 the one before it
    last = F.when(F.col("size") == 1, F.col("w1")).when(F.col("size") == 2, F.col("w2")).otherwise(F.col("w3"))
    before = F.when(F.col("size") == 2, F.col("w1")).when(F.col("size") == 3, F.col("w2"))
    first = F.when(F.col("size") == 3, F.col("w1"))
    both = scan(dealt(prefix.select("lang", last.alias("w1"), before.alias("w2"), first.alias("w3"), *prefix.columns[4:])), "right").where("size > 1")
    both = both.where(f"size = 3 or 100 * greatest(ext_left, ext_right) < {percent} * n")
    # decimals of 38 digits: exact while 10^6 times the square of a count is below 10^38
    score = lambda l, r: F.expr(f"(cast(n as decimal(19, 0)) * cast(n as decimal(19, 0)) * 1000000) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0)))")  # noqa: E731, E741
    of_pair, of_word = score("one_left", "if(size = 2, one_right, two_right)"), score("two_left", "one_right")
    cut = F.when((F.col("size") == 3) & (of_word < of_pair), F.struct(of_word.alias("score"), F.col("two_left").alias("l"), F.col("one_right").alias("r")))
    cut = cut.otherwise(F.struct(of_pair.alias("score"), F.col("one_left").alias("l"), F.expr("if(size = 2, one_right, two_right)").alias("r")))
    scored = both.select("lang", F.concat_ws(" ", "w3", "w2", "w1").alias("phrase"), F.col("n").alias("a"), cut.alias("cut"))
    place_of = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", place_of.cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))  # one row for each language
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), **PARAMETERS)


def _sql(least: int, top: int, percent: int, bits: int) -> str:
    grams = "\nUNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(g, ' ') AS phrase, g FROM (SELECT lang, unnest(list_transform(range(1, len(w) - {k - 1} + 1), lambda i: w[i:i + {k - 1}])) AS g FROM pieces)" for k in (1, 2, 3))
    score = lambda l, r: f"CAST((CAST(f.a AS HUGEINT) * f.a * 1000000) // (CAST({l} AS HUGEINT) * {r}) AS BIGINT)"  # noqa: E731, E741
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM texts),
grams AS ({grams}),
f AS (SELECT lang, size, phrase, any_value(g) AS g, count(*) AS a FROM grams GROUP BY lang, size, phrase),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cuts AS (SELECT f.lang, f.phrase, f.size, f.a, k, x.a AS l, y.a AS r, {score("x.a", "y.a")} AS score FROM f, range(1, 3) c(k)
 JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.g[1:k], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.g[k + 1:], ' ') WHERE k < f.size AND f.a >= {least}),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase, a AS longer FROM f WHERE size = 3 AND a >= {least}),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.longer >= {percent} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= {top}"""


SQL = _sql(**PARAMETERS)
