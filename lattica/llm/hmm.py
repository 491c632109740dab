r"""Hidden Markov language model: Baum-Welch counts added up across partitions train latent states; a scaled forward
recursion gives the exact likelihood of each whole text.

A state emits the class of a token and the class emits the token. The `own` most frequent training tokens are classes
of their own, all others share a class by their last letters; so transition and emission tables have a fixed size
whatever the corpus is (states * (states + own + shared) numbers), while the counts of all tokens stay a table that is
joined, never broadcast. p(token | class) = (c + 0.5) / (class total + 0.5 * (class vocabulary + 1)), c in training.

Documents are read once and turned into blocks of a few megabytes of text: the block's distinct tokens, and its
documents as numbers of these. Only a block's distinct tokens are shuffled, to meet the corpus counts.

Defined cases: a null text is empty and holds the end token alone; a null id counts as the empty text in the split;
repeated rows are scored each; without training tokens every count is 0, the shared start distribution is used and
scores stay finite; an empty table gives an empty result; a very long text is learned from and scored as one sequence,
in memory that grows with its tokens; of equally frequent tokens those first in byte order get classes of their own;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, id_crc, record_batch, texts

#: Tokens of a training window. What a text tells before and behind a window enters it exactly, see `_messages`.
WINDOW = 512
#: Tokens that one step of the recursions works on at most, unless a single text has more.
BATCH = 400_000
PARAMETERS = dict(states=12, own=4096, shared=2048, rounds=8, start_docs=400, start_rounds=15, gain=0.02)

BLOCKS = pa.schema([("block", pa.string()), ("k", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())), ("tokens", pa.binary())])


def encode_blocks(docs: DataFrame, block_bytes: int = 16_000_000) -> DataFrame:
    """Rows of two kinds for each block of docs(doc_id, text, held_out): (block, k, word, n) for its k-th distinct
    token with its number in training documents, and one with the block's documents. The end token is the empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        rows: list = []
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            name, n = f"{part}-{made}", len(number)
            train = [x for x, out in zip(rows, held, strict=True) if not out[1]]
            count = np.bincount(np.concatenate(train) if train else np.zeros(0, np.int32), minlength=n)
            yield record_batch(BLOCKS, [name] * n, np.arange(n, dtype=np.int32), list(number), count, *[[None] * n] * 4)
            packed = zstandard.compress(np.concatenate(rows).tobytes(), 1)
            yield record_batch(BLOCKS, [name], [None], [None], [None], [[x[0] for x in held]], [[x[1] for x in held]], [[len(x) for x in rows]], [packed])
            made, size = made + 1, 0
            number.clear(), rows.clear(), held.clear()

        for batch in batches:
            for text, doc_id, out in zip(texts(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(b"")
                rows.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
                held.append((doc_id, out))
                size += len(text)
                if size >= block_bytes:
                    yield from flush()
        if rows:
            yield from flush()

    schema = "block string, k int, word binary, n long, doc_id array<long>, held_out array<boolean>, n_tokens array<int>, tokens binary"
    return arrow_map(docs.select("text", "doc_id", "held_out"), run, schema)


def with_class(words: DataFrame, frequent: DataFrame, own: int, shared: int) -> DataFrame:
    """Adds the class of `word`: the rank of a frequent one, else one by the last three characters."""
    ending = F.encode(F.substring(F.col("word").cast("string"), -3, 3), "UTF-8")
    # `frequent` has at most `own` rows
    return words.join(F.broadcast(frequent), "word", "left").withColumn("class", F.coalesce(F.col("rank"), own + F.crc32(ending) % shared).cast("int")).drop("rank")


def encode_documents(blocks: DataFrame, counts: DataFrame, classes: DataFrame, frequent: DataFrame, own: int, shared: int, total: int, distinct: int) -> DataFrame:
    """One row a document: its base score, the log10 probability of its tokens given their classes, its classes."""
    words = blocks.where("word is not null").select("block", "k", "word").join(counts.select("word", "c"), "word", "left")
    words = with_class(words, frequent, own, shared).withColumn("c", F.coalesce("c", F.lit(0)))
    # one row for each class, so at most own + shared
    words = words.join(F.broadcast(classes), "class", "left").select("block", "k", "c", "class", F.log10((F.col("c") + 0.5) / (F.coalesce("class_total", F.lit(0)) + 0.5 * (F.coalesce("class_words", F.lit(0)) + 1))).alias("within"))
    whole = total + 0.5 * (distinct + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within_score", pa.float64()), ("classes", pa.binary())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        at = left.column("k").to_numpy()
        c, kind, within = np.zeros(n, np.int64), np.zeros(n, np.uint16), np.zeros(n)
        c[at], kind[at], within[at] = (left.column(x).to_numpy() for x in ("c", "class", "within"))
        base = np.log10((c + 0.5) / whole)
        out = []
        for row in right.to_pylist():
            ids = np.frombuffer(zstandard.decompress(row["tokens"]), np.int32)
            size = np.array(row["n_tokens"], np.int64)
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            sums = [np.add.reduceat(x[ids], begin) for x in ((c > 0).astype(np.int64), base, within)]
            packed = kind[ids]
            out.append(record_batch(schema, row["doc_id"], row["held_out"], size, *sums, [packed[a : a + b].tobytes() for a, b in zip(begin, size, strict=True)]))
        return pa.Table.from_batches(out, schema)

    packed = blocks.where("word is null").select(F.col("block").alias("of_block"), "doc_id", "held_out", "n_tokens", "tokens")
    return words.groupBy("block").cogroup(packed.groupBy("of_block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within_score double, classes binary")


class Model:
    """Start distribution of texts, transitions and class emissions."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit

    @classmethod
    def from_counts(cls, flat: np.ndarray, states: int, kinds: int) -> Model:
        """Counts in one vector: first, move, emit. A little is added to each, so nothing is impossible."""
        first, move, emit = np.split(flat, np.cumsum([states, states * states]))
        even = lambda x: x / x.sum(-1, keepdims=True)
        emit = emit.reshape(states, kinds)
        prior = 0.05 * (emit.sum(0) + 1) / (emit.sum() + kinds) * kinds
        return cls(even(first + 1), even(move.reshape(states, states) + 0.1), even(emit + prior))


def _stacked(rows: list[np.ndarray]) -> np.ndarray:
    """Rows sorted by length as the columns of one array, padded with 0."""
    seen = np.zeros((len(rows[-1]), len(rows)), np.int64)
    for k, x in enumerate(rows):
        seen[: len(x), k] = x
    return seen


def _batches(rows: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of rows, sorted by length, with about BATCH tokens each when padded."""
    begin = 0
    for k, x in enumerate(rows):
        if k > begin and (k + 1 - begin) * len(x) > BATCH:
            yield begin, k
            begin = k
    if begin < len(rows):
        yield begin, len(rows)


def _messages(cut: list[np.ndarray], number: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each window of texts in their order, `number` being its place in its text: the state distribution after all
    tokens before it, and how likely each state at its end makes all tokens behind it (up to a factor). Windows of long
    texts become products of transitions and emissions, all windows at once; the products of a text are then chained."""
    states = len(model.first)
    before, behind = np.ones((len(cut), states)), np.ones((len(cut), states))
    inner = number[1:] > 0
    long_ = np.flatnonzero(np.append(inner, False) | (number > 0))
    through = np.empty((len(long_), states, states), np.float32)
    move, emit = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T, dtype=np.float32)
    order = sorted(range(len(long_)), key=lambda k: len(cut[long_[k]]))
    ranked = [cut[long_[k]] for k in order]
    for a, b in _batches(ranked):
        own, seen = np.array(order[a:b]), _stacked(ranked[a:b])
        size = np.array([len(x) for x in ranked[a:b]])
        now = np.where((number[long_[own]] > 0)[:, None, None], move, model.first.astype(np.float32))
        at = 0
        for t, kind in enumerate(seen):
            ended = np.searchsorted(size, t, "right")
            if ended > at:
                through[own[at:ended]] = now[: ended - at]
                now, at = now[ended - at :], ended
            now = ((now.reshape(-1, states) @ move).reshape(now.shape) if t else now) * emit[kind[at:]][:, None, :]
            if t % 2:
                now /= now.sum((1, 2), keepdims=True)
        through[own[at:]] = now
    for k in range(1, len(long_)):
        w = long_[k]
        if number[w]:
            x = before[w - 1] @ through[k - 1]
            before[w] = x / x.sum()
    for k in range(len(long_) - 1, 0, -1):
        w = long_[k]
        if number[w]:
            x = through[k] @ behind[w]
            behind[w - 1] = x / x.sum()
    return before, behind


def expected_counts(rows: list[np.ndarray], model: Model) -> np.ndarray:
    """Baum-Welch counts of whole training texts, as one vector: first, move, emit; the last entry is their natural log
    likelihood. Long texts are worked on in windows at once; the counts are those of the whole text."""
    states, kinds = model.emit.shape
    first, move, emit, likely = np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds)), 0.0
    move32, emit32 = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T, dtype=np.float32)
    cut = [x[k : k + WINDOW] for x in rows for k in range(0, len(x), WINDOW)]
    number = np.array([k for x in rows for k in range(-(-len(x) // WINDOW))], np.int64)
    before, behind = _messages(cut, number, model)
    order = sorted(range(len(cut)), key=lambda k: len(cut[k]))
    cut = [cut[k] for k in order]
    for a, b in _batches(cut):
        own, seen = order[a:b], _stacked(cut[a:b])
        n, size = b - a, np.array([len(x) for x in cut[a:b]])
        steps = len(seen)
        ends = np.searchsorted(size, np.arange(steps), "right")  # windows before it have ended
        live = np.arange(steps)[:, None] < size[None, :]
        start, past = number[own] == 0, before[own].astype(np.float32)
        alpha, scale = np.empty((steps, n, states), np.float32), np.ones((steps, n, 1), np.float32)
        e = emit32[seen]
        now = np.where(start[:, None], model.first.astype(np.float32), past @ move32)
        for t, k in enumerate(ends):
            now = (alpha[t - 1, k:] @ move32 if t else now) * e[t, k:]
            scale[t, k:] = np.maximum(now.sum(1, keepdims=True), 1e-30)
            np.divide(now, scale[t, k:], out=alpha[t, k:])
        likely += float(np.log(scale, dtype=float).sum())
        e /= scale
        beta = behind[own]
        beta = (beta / (alpha[size - 1, np.arange(n)] * beta).sum(1, keepdims=True)).astype(np.float32)
        for t in range(steps - 1, -1, -1):
            k = ends[t]
            onward = e[t, k:] * beta[k:]
            alpha[t, k:] *= beta[k:]
            if t:
                move += (alpha[t - 1, k:].T @ onward) * move32
                beta[k:] = onward @ move32.T
            else:
                first += alpha[0, start].sum(0)
                move += (past[~start].T @ onward[~start]) * move32
        at, gamma = seen[live], alpha[live]
        for s in range(states):
            emit[s] += np.bincount(at, gamma[:, s], kinds)
    return np.concatenate([first, move.ravel(), emit.ravel(), [likely]])


def log_likelihoods(rows: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each class sequence by the scaled forward recursion over the whole sequence."""
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    out, emit = np.zeros(len(rows)), np.ascontiguousarray(model.emit.T)
    ranked = [rows[k] for k in order]
    for a, b in _batches(ranked):
        size = np.array([len(x) for x in ranked[a:b]])
        total, seen = np.zeros(b - a), _stacked(ranked[a:b])
        ends = np.searchsorted(size, np.arange(int(size[-1])), "right")  # texts before it have ended
        now = np.broadcast_to(model.first, (b - a, len(model.first)))
        at = 0
        for t in range(int(size[-1])):
            if ends[t] > at:
                now, at = now[ends[t] - at :], ends[t]
            now = (now @ model.move if t else now) * emit[seen[t, at:]]
            scale = now.sum(1)
            total[at:] += np.log10(scale)
            now = now / scale[:, None]
        out[order[a:b]] = total
    return out


def start_model(sample: list[np.ndarray], states: int, kinds: int, rounds: int) -> Model:
    """Starting values from a bounded sample: sticky states with random emissions, then a few rounds over the sample."""
    rng = np.random.default_rng(7)
    seen = np.concatenate([np.bincount(x, minlength=kinds) for x in sample]).reshape(-1, kinds) if sample else np.zeros((1, kinds))
    mix = rng.dirichlet(np.full(states, 0.2), len(seen))
    emit = mix.T @ seen
    move = np.full((states, states), 1.0) + np.eye(states) * states * 9
    model = Model.from_counts(np.concatenate([np.ones(states), move.ravel(), emit.ravel()]), states, kinds)
    for _ in range(rounds if sample else 0):
        model = Model.from_counts(expected_counts(sample, model)[:-1], states, kinds)
    return model


def train(encoded: DataFrame, states: int, kinds: int, rounds: int, start_docs: int, start_rounds: int, gain: float = 0.0) -> Model:
    """Baum-Welch over all training documents: rounds on the whole corpus until one gains less than `gain` nats a token,
    `rounds` at most. The start comes from `start_docs` documents of at most 4000 tokens."""
    fit = encoded.where("not held_out").select("classes")
    few = encoded.where("not held_out and n_tokens <= 4000").orderBy(F.xxhash64("doc_id", "classes"), "classes").limit(start_docs).select("classes")
    model = start_model([np.frombuffer(r[0], np.uint16) for r in few.collect()], states, kinds, start_rounds)
    schema, numbers = pa.schema([("at", pa.int32()), ("value", pa.float64())]), states * (1 + states + kinds)
    last = -np.inf
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    counts = expected_counts([np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()], shared.value)
                    total = counts if total is None else total + counts
            if total is not None:
                at = np.flatnonzero(total)
                yield record_batch(schema, at.astype(np.int32), total[at])

        counts = arrow_map(fit, run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros(numbers + 1)
        flat[counts.column("at").to_numpy()] = counts.column("value").to_numpy()
        if not flat.any():
            break
        model = Model.from_counts(flat[:-1], states, kinds)
        now = flat[-1] / flat[-1 - states * kinds : -1].sum()
        if now - last < gain:
            break
        last = now
    return model


def hmm_scores(docs: DataFrame, states: int, own: int, shared: int, rounds: int, start_docs: int, start_rounds: int, gain: float = 0.0) -> DataFrame:
    """Scores docs(doc_id, text, held_out); see the module's text. Adds train_tokens, base_score and score."""
    scratch, kinds = Scratch(docs.sparkSession, "hmm"), own + shared
    blocks = scratch.save(encode_blocks(docs), "blocks")
    counts = scratch.save(blocks.where("word is not null and n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(own).collect()
    frequent = docs.sparkSession.createDataFrame([(bytes(r["word"]), k) for k, r in enumerate(top)], "word binary, rank int")
    classes = scratch.save(with_class(counts, frequent, own, shared).groupBy("class").agg(F.sum("c").alias("class_total"), F.count("*").alias("class_words")), "classes")
    encoded = scratch.save(encode_documents(blocks, counts, classes, frequent, own, shared, total, distinct), "encoded")
    scratch.drop("blocks", "counts")
    model = train(encoded, states, kinds, rounds, start_docs, start_rounds, gain)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_part = log_likelihoods([np.frombuffer(x, np.uint16) for x in batch.column(6).to_pylist()], held.value)
            yield record_batch(schema, *[batch.column(k) for k in range(5)], own_part + batch.column(5).to_numpy())

    out = arrow_map(encoded, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (id_crc() % 5 == 1).alias("held_out"))
    return hmm_scores(docs, **PARAMETERS).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
