r"""Non-negative positive-unlabelled learning: numpy classifiers learn from confirmed toxic texts and unlabelled texts, by
a risk estimate that the class prior corrects and that may not fall below zero.

A text's features are its distinct words (A-Z lower-cased, ASCII punctuation as white space), hashed to `bits` bits. Only
features that several positive texts hold can get a weight, and an L1 penalty takes noise out; so a score does not
drift with length. Each of `models` classifiers has all sampled positives and its own share of the unlabelled; their
mean decides. Training uses a bounded, documented sample: at most about `most` positive and 3 * `most` unlabelled texts.

Defined cases: null text counts as empty and gets a score; a label that is null, or of no text, is no label; a null
id counts as the empty text in the split; no positive example: every score is the class prior; repeated rows are
scored each, repeated training texts count once; a very long text is read whole; an empty table gives an empty result;
extra columns are ignored by the query and carried along, whatever their names, by without_toxic().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_crc, record_batch, small_slices, texts

PARAMETERS = dict(bits=18, most=3000, models=3, epochs=200, penalty=3e-4, least=3)
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SIGNS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_SIGNS))


def features(text: str, bits: int) -> np.ndarray:
    """Sorted distinct hashes of the words of a whole text."""
    mask, crc = (1 << bits) - 1, zlib.crc32
    words = set(text.encode("utf-8", "surrogatepass").translate(FOLD).split())
    return np.unique(np.fromiter((crc(w) & mask for w in words), np.int32, len(words)))


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int, epochs: int, penalty: float, least: int) -> tuple[np.ndarray, float]:
    """Weights and bias. Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss and an L1 penalty,
    by accelerated proximal steps; where the second part is negative its gradient is followed upwards, as published
    (Kiryo et al. 2017). Features that are not clearly commoner in positive texts are left out."""
    n, many_p, many_u = 1 << bits, len(positive), len(unlabelled)
    start = float(np.log(prior / (1 - prior)))
    if not many_p or not many_u:
        return np.zeros(n), start
    share_p, share_u = (np.bincount(np.concatenate([np.zeros(0, np.int32), *x]), minlength=n) / len(x) for x in (positive, unlabelled))
    usable = (share_p * many_p >= least) & (share_p - share_u > 3 * np.sqrt(share_p / many_p + share_u / many_u))
    cut = [x[usable[x]] for x in (*positive, *unlabelled)]
    owner = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
    at = np.concatenate([np.zeros(0, np.int32), *cut])
    w, b = np.zeros(n), start
    ahead_w, ahead_b, pace = w, b, 1.0
    rate = 4.0 / (1 + max(map(len, cut)) ** 0.5 + 0.25 * np.mean([len(x) for x in cut]))
    for _ in range(epochs):
        z = np.clip(ahead_b + np.bincount(owner, ahead_w[at], len(cut)), -40, 40)
        s = 1 / (1 + np.exp(-z))
        loss = np.logaddexp(0, z)
        g = np.empty(len(cut))
        if loss[many_p:].mean() - prior * loss[:many_p].mean() >= 0:
            g[:many_p] = -prior / many_p
            g[many_p:] = s[many_p:] / many_u
        else:
            g[:many_p] = prior * s[:many_p] / many_p
            g[many_p:] = -s[many_p:] / many_u
        next_w = ahead_w - rate * np.bincount(at, g[owner], n)
        next_w = np.sign(next_w) * np.maximum(np.abs(next_w) - rate * penalty, 0)
        next_b = ahead_b - rate * g.sum()
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push = (pace - 1) / next_pace
        ahead_w, ahead_b = next_w + push * (next_w - w), next_b + push * (next_b - b)
        w, b, pace = next_w, next_b, next_pace
    return w, b


def train(docs: DataFrame, labels: DataFrame, bits: int, most: int, models: int, epochs: int, penalty: float, least: int) -> tuple[np.ndarray, float, float]:
    """(weights, bias, prior) from docs(doc_id, text) and labels(doc_id, toxic). The mean of all classifiers."""
    labels = labels.where("toxic is not null").select("doc_id", "toxic").distinct()
    known, positives = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, max(0.001, positives / known)) if known else 0.1
    nothing = (np.zeros(1 << bits), float(np.log(prior / (1 - prior))), prior)
    if not positives:
        return nothing
    many = docs.count()
    share = lambda bound, seed: F.abs(F.xxhash64("doc_id", F.lit(seed)) % 1_000_003) / 1_000_003 < bound
    # about `most` ids at most, whatever the number of labels: a bounded table, so texts are filtered before any shuffle
    toxic = labels.where("toxic = 1").where(share(most / positives, 17)).select("doc_id", F.lit(True).alias("positive"))
    joined = docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id", "left")
    few = joined.where(F.col("positive") | share(3 * most / max(many, 1), 19))
    schema = pa.schema([("positive", pa.bool_()), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            yield record_batch(schema, [bool(x) for x in batch.column(1).to_pylist()], [features(x, bits) for x in texts(batch)])

    # every text once; a text that is toxic anywhere is positive
    sample = arrow_map(few.groupBy("text").agg(F.max("positive").alias("positive")).select("text", "positive"), run, "positive boolean, at array<int>")
    bagged = sample.withColumn("bag", F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(models - 1))).otherwise(F.array(F.pmod(F.hash("at"), F.lit(models))))).withColumn("bag", F.explode("bag"))
    found = pa.schema([("at", pa.int32()), ("weight", pa.float64())])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows.column("positive").to_pylist(), rows.column("at").to_pylist()), key=lambda x: (x[0], x[1]))
        sides = [[np.array(at, np.int32) for is_positive, at in order if is_positive == side] for side in (True, False)]
        w, b = nnpu(*sides, prior, bits, epochs, penalty, least)
        at = np.flatnonzero(w)
        return pa.table([np.append(at, 1 << bits).astype(np.int32), np.append(w[at], b)], schema=found)

    weights = bagged.groupBy("bag").applyInArrow(fit, "at int, weight double").groupBy("at").agg((F.sum("weight") / models).alias("weight")).toArrow()
    w = np.zeros((1 << bits) + 1)
    w[weights.column("at").to_numpy()] = weights.column("weight").to_numpy()
    return w[:-1], float(w[-1]), prior


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], bits: int, name: str = "toxic_score") -> DataFrame:
    """Adds the column `name` to docs(text, ...), which may not have it yet; the other columns are carried along."""
    shared = docs.sparkSession.sparkContext.broadcast(model[:2])
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in small_slices(batches):
            z = np.array([b + w[features(x or "", bits)].sum() for x in batch.column(place).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float, float], bits: int) -> DataFrame:
    """The rows of docs that score below 0.5. The other columns travel in a struct, so their names clash with nothing."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")
    kept = score(docs.select("text", row.alias("row")), model, bits).where(F.col("toxic_score") < 0.5)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text", (id_crc() % 5 == 0).alias("held_out"))
    model = train(docs.where("not held_out"), labels.where(id_crc() % 5 != 0), **PARAMETERS)
    slim = score(docs, model, PARAMETERS["bits"])
    return slim.select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
