r"""Segmentation-marginalised unigrams: each language has probabilities for the pieces of one fixed public vocabulary,
and a forward algorithm sums all segmentations of a word into pieces to score it.

Words are maximal runs of letters, lower-cased, with the vocabulary's word-start mark in front; a run of more than 32
letters is cut every 32. A letter that no piece covers is a piece of its own with the language's unknown probability.
The piece probabilities come from expectation-maximisation over a bounded, documented sample of labelled texts
(`per_lang` texts a language, by hash of the id); the model has pieces x languages numbers, which bounds what is sent.

Defined cases: null text or text without a letter: `und` with score 0; a null id counts as the empty text in the split;
without any labelled text every prediction is `und`; ties go to the alphabetically first language; repeated rows are
scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_crc, record_batch, small_slices, texts

RUN = re.compile(r"[^\W\d_]+")
MARK, LONGEST, MOST = "▁", 32, 16
PRIME = np.uint64(1_000_003)
#: Probability of one certain letter among all that no piece covers.
UNKNOWN_LETTER = 1e-5
#: Factor by which the recursion lifts each letter, so that a word of LONGEST letters that no piece covers stays in the range of
#: doubles; every segmentation of a word gets the same power of it, which is taken off again.
LIFT = 1e8


def vocabulary(path: str) -> list[str]:
    """Pieces of letters of the public vocabulary, after the word-start mark or without it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = {sp.id_to_piece(k) for k in range(sp.get_piece_size())}
    return sorted(p for p in every if len(p) <= MOST and p.replace(MARK, "", 1).isalpha() and p == p.lower()) + [MARK]


class Pieces:
    """Piece numbers by the hash of their letters: sorted arrays."""

    def __init__(self, pieces: list[str]):
        code = [np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64) for p in pieces]
        self.many = len(pieces)
        value = np.array([self._hash(c) for c in code], np.uint64)
        self.order = np.argsort(value)
        self.sorted = value[self.order]
        self.longest = max(map(len, code))

    @staticmethod
    def _hash(code: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in code:
                h = h * PRIME + c + np.uint64(7)
        return h

    def spans(self, code: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, piece number or -1) for code[:, i:j], ends first to last."""
        n, length = code.shape
        power = np.ones(length + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                power[k + 1] = power[k] * PRIME
            h = np.zeros((n, length + 1), np.uint64)
            for k in range(length):
                h[:, k + 1] = h[:, k] * PRIME + code[:, k] + np.uint64(7)
            for j in range(1, length + 1):
                for i in range(max(0, j - self.longest), j):
                    key = h[:, j] - h[:, i] * power[j - i]
                    at = np.minimum(np.searchsorted(self.sorted, key), self.many - 1)
                    yield i, j, np.where(self.sorted[at] == key, self.order[at], -1)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their code points with the mark) for each length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        raw = "".join(MARK + words[k] for k in at).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(raw, np.uint32).reshape(len(at), n + 1).astype(np.uint64)


def word_log10(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log10 of each word's probability in each language, over all segmentations. prob: piece (the last: unknown) x language."""
    out = np.zeros((len(words), prob.shape[1]))
    for where, every in by_length(words):
        for cut in range(0, len(where), 20_000):
            at, code = where[cut : cut + 20_000], every[cut : cut + 20_000]
            ahead = np.zeros((code.shape[1] + 1, len(at), prob.shape[1]))
            ahead[0] = 1
            for i, j, piece in pieces.spans(code):
                hit = np.flatnonzero(piece >= 0)
                ahead[j, hit] += ahead[i, hit] * (prob[piece[hit]] * LIFT ** (j - i))
                if j == i + 1:
                    miss = np.flatnonzero(piece < 0)
                    ahead[j, miss] += ahead[i, miss] * (prob[-1] * UNKNOWN_LETTER * LIFT)
            out[at] = np.log10(ahead[-1]) - code.shape[1] * np.log10(LIFT)
    return out


def expected_pieces(words: list[str], weight: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (the last: unknown) by weighted words under prob, over all segmentations."""
    total = np.zeros(pieces.many + 1)
    for where, every in by_length(words):
        for cut in range(0, len(where), 20_000):
            at, code = where[cut : cut + 20_000], every[cut : cut + 20_000]
            length = code.shape[1]
            spans = [(i, j, np.where(piece < 0, pieces.many, piece), LIFT ** (j - i) * np.where(piece >= 0, prob[piece], prob[-1] * UNKNOWN_LETTER if j == i + 1 else 0.0)) for i, j, piece in pieces.spans(code)]
            ahead, back = np.zeros((length + 1, len(at))), np.zeros((length + 1, len(at)))
            ahead[0] = back[length] = 1
            for i, j, _, p in spans:
                ahead[j] += ahead[i] * p
            for i, j, _, p in sorted(spans, key=lambda x: -x[1]):
                back[i] += back[j] * p
            scale = weight[at] / ahead[length]
            for i, j, piece, p in spans:
                total += np.bincount(piece, ahead[i] * p * back[j] * scale, pieces.many + 1)
    return total


def letter_words(text: str) -> list[str]:
    words = RUN.findall(text.lower())
    if any(len(w) > LONGEST for w in words):
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of docs(text, lang), added up in each batch before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(w for w in letter_words(text) if any(map(str.isalpha, w)))
            for lang, count in by.items():
                yield record_batch(schema, [lang] * len(count), list(count), list(count.values()))

    return arrow_map(labelled.select("text", "lang"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, path: str, rounds: int, per_lang: int) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (piece x language). labelled(doc_id, text, lang): at most about `per_lang`
    texts of each language are used, by a hash of the id."""
    spark = labelled.sparkSession
    pieces_list = vocabulary(path)
    many = len(pieces_list)
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(share)
    if not langs:
        return [], np.zeros((many + 1, 0))
    # one row for each language
    few = labelled.join(F.broadcast(spark.createDataFrame(list(share.items()), "lang string, share double")), "lang")
    few = few.where(F.abs(F.xxhash64("doc_id", F.lit(11)) % 1_000_003) / 1_000_003 < F.col("share"))
    counts = word_counts(few).persist()
    prob = np.full((many + 1, len(langs)), 1.0 / (many + 1))
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces_list, langs, prob))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, langs, prob = shared.value
            pieces = Pieces(names)
            total = np.zeros((pieces.many + 1, len(langs)))
            for batch in batches:
                lang, words, n = (batch.column(k).to_pylist() for k in range(3))
                for k, name in enumerate(langs):
                    at = [i for i, x in enumerate(lang) if x == name]
                    if at:
                        total[:, k] += expected_pieces([words[i] for i in at], np.array([n[i] for i in at], float), pieces, prob[:, k])
            piece, k = np.nonzero(total)
            yield record_batch(schema, k.astype(np.int32), piece.astype(np.int32), total[piece, k])

        found = arrow_map(counts, run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.full((many + 1, len(langs)), 0.01)
        total[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("n").to_numpy()
        prob = total / total.sum(0)
    counts.unpersist()
    return langs, prob


def identify(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs(doc_id, text, held_out). The score is the language's probability
    among the learned ones, all equally likely before."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(path), langs, prob))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, prob = shared.value
        pieces, known, table = Pieces(names), {}, np.zeros((0, len(langs)))
        for batch in small_slices(batches):
            rows = [letter_words(x) for x in texts(batch)]
            if len(known) > 1_500_000:
                known, table = {}, np.zeros((0, len(langs)))
            new = [w for w in set().union(*rows) if w not in known]
            if new and langs:
                value = word_log10(new, pieces, prob)
                value[[not any(map(str.isalpha, w)) for w in new]] = np.nan  # numerals are no letters
                known.update(zip(new, range(len(known), len(known) + len(new))))
                table = np.concatenate([table, value])
            pred, score = ["und"] * len(rows), np.zeros(len(rows))
            for k, words in enumerate(rows if langs else ()):
                if words:
                    value = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                    if np.isnan(value).any():
                        value = value[~np.isnan(value[:, 0])]
                        if not len(value):
                            continue
                    total = value.sum(0) * np.log(10)
                    best = int(total.argmax())
                    pred[k], score[k] = langs[best], 1 / np.exp(total - total[best]).sum()
            yield record_batch(schema, batch.column(1), batch.column(2), pred, score)

    return arrow_map(docs.select("text", "doc_id", "held_out"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str, rounds: int = 3, per_lang: int = 2000) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", (id_crc() % 3 == 1).alias("held_out"))
    langs, prob = train(docs.where("not held_out and lang is not null and text is not null"), path, rounds, per_lang)
    return identify(docs, langs, prob, path)
