r"""Quality rules: perplexity under a Spark-counted modified Kneser-Ney model of character 4-grams, with a lower and
an upper perplexity band for each language.

Every code point is a symbol of its own: case, single signs, digits and letters of all scripts count apart. The model
grows with the corpus and stays a Spark table; an n-gram's key is the packed context (3 x 21 bits) and its last symbol,
so there are no collisions. Texts are scored against blocks of at most BLOCK n-grams: one block is broadcast at a time
as sorted arrays, and each further block adds its share of the log probabilities in a pass of its own over the texts.
The scored texts are the counted ones, so each of their n-grams is in the model and no back-off is left to do.

The perplexity is that of a word: the log probability of all characters over the number of words that hold a letter or digit.
A mean over characters would hide junk that is frequent in the corpus and so teaches the model itself: words with %%% or
joined by ' | ' cost a surprise each and then characters that are all but certain, which lower a mean of characters
and raise the cost of a word. The two bands of a language decide alone.

Defined cases: a null text counts as empty; a null language is a language of its own ("und"); a text without a word
that holds a letter or digit has a null perplexity and is not kept; a very long text is read whole, in memory that grows with it; ties and repeated rows are judged row by row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, record_batch, small_slices, texts

#: A: all code points and the start symbol 0; a code point's symbol is its number plus 1. BITS hold one symbol.
ORDER, A, BITS = 4, 0x110001, 21
#: Most n-grams of the model that are broadcast at once.
BLOCK = 2_000_000
#: Most rows of counts that a task holds before it gives them out.
HELD = 1_000_000
SYMBOLS = b"#*$%&|<>"
#: Width of the histogram in which the quartiles of log10 perplexity are found.
STEP = 0.001
WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def symbols(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 start symbols, and where each text begins."""
    pad = "\0" * (ORDER - 1)
    out = np.frombuffer((pad + pad.join(many)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    size = np.fromiter(map(len, many), np.int64, len(many)) + ORDER - 1
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    for k in range(ORDER - 1):
        out[begin + k] = 0
    return out, begin


def _distinct(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `size` in order, and the number of each key among them."""
    if size > 1 << 24:
        return np.unique(key, return_inverse=True)
    number = np.zeros(size, np.int32)
    number[key] = 1
    values = np.flatnonzero(number)
    number[values] = np.arange(len(values))
    return values, number[key]


def ngrams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of order ORDER as packed contexts and last symbols; before them, which of these ends at each
    position from ORDER - 1 on."""
    letters, x = _distinct(s, A)
    n, m = len(s) - ORDER + 1, len(letters)
    packed, number = letters.astype(np.int64), x[:n]
    for k in range(1, ORDER):
        values, number = _distinct(number.astype(np.int64) * m + x[k : k + n], len(packed) * m)
        if k < ORDER - 1:
            packed = packed[values // m] << BITS | letters[values % m]
    return number, packed[values // m], letters[values % m].astype(np.int32)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("context", pa.int64()), ("w", pa.int32()), ("n", pa.int64())])
    held: list[pa.Table] = []

    def added() -> pa.Table:
        out = pa.concat_tables(held).group_by(["lang", "context", "w"]).aggregate([("n", "sum")])
        return out.rename_columns(["lang", "context", "w", "n"]).select(schema.names)

    for batch in small_slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(1).to_pylist(), texts(batch), strict=True):
            by.setdefault(lang or "und", []).append(text)
        for lang, many in by.items():
            s, _ = symbols(many)
            if len(s) >= ORDER:
                number, context, w = ngrams(s)
                n = np.bincount(number, minlength=len(w))
                real = w > 0
                names = pa.repeat(pa.scalar(lang, pa.string()), int(real.sum()))
                held.append(pa.Table.from_arrays([names, pa.array(context[real]), pa.array(w[real]), pa.array(n[real])], schema=schema))
        if sum(t.num_rows for t in held) > HELD:
            held = [added()]
            if held[0].num_rows > HELD // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from added().to_batches()


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, context, w, n) of all character ORDER-grams, added up in each task before the shuffle."""
    return arrow_map(docs.select("text", "lang"), _count, "lang string, context long, w int, n long").groupBy("lang", "context", "w").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, context, w, p): interpolated modified Kneser-Ney probabilities of all n-grams of order ORDER. Orders below
    the highest use continuation counts; n-grams that begin at the start use plain counts."""
    levels = {ORDER: scratch.save(counts, f"level{ORDER}")}
    low = lambda k: F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))  # noqa: E731 (last k - 1 symbols of a context)
    for k in range(ORDER - 1, 0, -1):
        adjusted = F.when(F.col("context") < 1 << BITS * (k - 2), F.sum("n")).otherwise(F.count("*")) if k > 1 else F.count("*")
        levels[k] = scratch.save(levels[k + 1].withColumn("context", low(k)).groupBy("lang", "context", "w").agg(adjusted.alias("n")), f"level{k}")
    below = None
    for k in range(1, ORDER + 1):
        level = levels[k]
        of = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"t{i}") for i in range(1, 5)]
        t = level.groupBy("lang").agg(*of).withColumn("y", F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")))
        usable = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0)
        # a language with too few counts of counts gets plain discounts
        cut = [F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * F.col("y") * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}"))))).otherwise(0.5 * i) for i in (1, 2, 3)]
        t = t.select("lang", *[c.alias(f"d{i}") for i, c in enumerate(cut, 1)])
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(F.broadcast(t), "lang").withColumn("d", d)  # one row for each language
        context = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
        level = level.join(context, ["lang", "context"])
        lower = F.lit(1.0 / (A - 1))
        if below is not None:
            level = level.withColumn("suffix", low(k - 1)).join(below.select("lang", F.col("context").alias("suffix"), "w", F.col("p").alias("lower")), ["lang", "suffix", "w"])
            lower = F.col("lower")
        below = scratch.save(level.select("lang", "context", "w", ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * lower).alias("p")), f"p{k}")
    return below


def blocks(model: DataFrame, most: int = BLOCK) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The model in blocks of about `most` n-grams by hash: language -> contexts, keys (number of the context, last
    symbol) and log10 p, sorted. An empty model is one empty block."""
    many = max(1, -(-model.count() // most))
    for k in range(many):
        t = (model.where(F.pmod(F.xxhash64("lang", "context"), F.lit(many)) == k) if many > 1 else model).toArrow()
        out = {}
        for name in pc.unique(t.column("lang")).to_pylist():
            own = t.filter(pc.equal(t.column("lang"), name))
            contexts, number = np.unique(own.column("context").to_numpy(), return_inverse=True)
            key = number << BITS | own.column("w").to_numpy()
            order = np.argsort(key)
            out[name] = (contexts, key[order], np.log10(own.column("p").to_numpy()[order]).astype(np.float32))
        yield out


def log_probabilities(block: tuple[np.ndarray, np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """log10 p of the symbol at each position from ORDER - 1 on; 0 for start symbols and n-grams of other blocks."""
    number, context, w = ngrams(s)
    contexts, keys, p = block
    at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
    key = np.where(contexts[at] == context, at << BITS | w, -1)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, p[at], 0).astype(float)[number]


def lettered(text: str) -> int:
    """Number of words that hold a letter or digit."""
    return sum(w[0].isalnum() or any(map(str.isalnum, w)) for w in WORDS.findall(text))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        seen: set = set()
        twice = {g for g in grams if g in seen or seen.add(g)} if len(set(grams)) < len(grams) else ()
        if twice:
            hit = np.zeros(n, bool)
            at = np.fromiter((k for k, g in enumerate(grams) if g in twice), np.int64)
            for k in range(3):
                hit[at + k] = True
            repeat = int(hit.sum())
    return n, word_chars, n_symbols, dup, repeat


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_scored long, total double, key binary"


def _totals(block: dict, many: list[str], lang: list[str]) -> np.ndarray:
    """Of each text the sum of log10 p over the n-grams of this block."""
    length, total = np.fromiter(map(len, many), np.int64, len(many)), np.zeros(len(many))
    for name in set(lang):
        at = np.array([k for k, x in enumerate(lang) if x == name])
        s, begin = symbols([many[k] for k in at])
        if name in block and len(s) >= ORDER:
            upto = np.concatenate(([0], np.cumsum(log_probabilities(block[name], s))))
            total[at] = upto[begin + length[at]] - upto[begin]
    return total


def _key(text: str, lang: str) -> bytes:
    return hashlib.blake2b(f"{lang}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def score(docs: DataFrame, model: DataFrame, scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """Base counts and log10 perplexity of a word of every whole text."""
    sc = docs.sparkSession.sparkContext
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored")] + [("total", pa.float64()), ("key", pa.binary())])
    out, steps = None, []
    for number, block in enumerate(blocks(model, most)):
        shared = sc.broadcast(block)

        def base(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_slices(batches):
                many, lang = texts(batch), [x or "und" for x in batch.column(2).to_pylist()]
                counts = np.array([base_counts(x) for x in many], np.int64).reshape(-1, 5)
                yield record_batch(schema, batch.column(1), lang, *counts.T, [lettered(x) for x in many], _totals(shared.value, many, lang), [_key(*x) for x in zip(many, lang)])

        def more(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_slices(batches):
                many, lang = texts(batch), [x or "und" for x in batch.column(1).to_pylist()]
                yield record_batch(pa.schema([schema.field(c) for c in ("key", "total")]), [_key(*x) for x in zip(many, lang)], _totals(shared.value, many, lang))

        if number == 0:
            out = scratch.save(arrow_map(docs.select("text", "doc_id", "lang"), base, SCORED), "block0")
        else:  # equal texts of a language have equal sums
            part = arrow_map(docs.select("text", "lang"), more, "key binary, total double")
            steps.append(scratch.save(part.groupBy("key").agg(F.min("total").alias("total")), f"block{number}"))
        shared.destroy()
    if steps:
        rest = steps[0]
        for step in steps[1:]:
            rest = rest.unionByName(step)
        rest = rest.groupBy("key").agg(F.sum("total").alias("more"))
        out = out.join(rest, "key").withColumn("total", F.col("total") + F.col("more")).drop("more")
    return out.withColumn("log_perplexity", F.when(F.col("n_scored") > 0, -F.col("total") / F.col("n_scored"))).drop("total", "key")


def bands(scored: DataFrame, value: str, step: float, below: float, above: float) -> DataFrame:
    """(lang, low, high): quartiles of a value over all texts that pass the base rules, from a histogram, less `below`
    times and plus `above` times the distance between them."""
    bins = scored.where(~F.col("base_failed") & F.col(value).isNotNull()).groupBy("lang", F.floor(F.col(value) / step).alias("bin")).count()
    up = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("count").over(up)).withColumn("all", F.sum("count").over(Window.partitionBy("lang")))
    q = [F.min(F.when(F.col("upto") >= share * F.col("all"), (F.col("bin") + 0.5) * step)).alias(name) for share, name in ((0.25, "q1"), (0.75, "q3"))]
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(10 * step))
    return bins.groupBy("lang").agg(*q).select("lang", (F.col("q1") - below * width).alias("low"), (F.col("q3") + above * width).alias("high"))


def quality(docs: DataFrame, below: float = 4.0, above: float = 5.0, min_words: int = 50, max_repeat: int = 50, block: int = BLOCK) -> DataFrame:
    """Base counts, log10 perplexity of a word, the language's bands and the verdict `kept` for every row of docs(doc_id, text, lang)."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = kneser_ney(ngram_counts(docs), scratch)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    scored = scratch.save(score(docs, model, scratch, block).withColumn("base_failed", failed), "scored")
    scratch.drop(*[f"level{k}" for k in range(1, ORDER + 1)], *[f"p{k}" for k in range(1, ORDER + 1)])
    # one row for each language
    out = scored.join(F.broadcast(bands(scored, "log_perplexity", STEP, below, above)), "lang", "left")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"), "low", "high")
