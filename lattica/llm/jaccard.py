r"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix. Blocks of rows (documents) are
multiplied with each other, which accumulates overlap counts of their pairs, and pairs below the bound that their sizes
give are discarded inside the block; only the links left, thinned out to a forest of each block, leave it.

Documents with the same shingle set are one class first, so copies never meet. Under one global order of shingles (rare
before those that a sample finds frequent, then by hash) two sets of Jaccard >= t share one of their first
n - ceil(t * n) + 1 shingles; only these columns bring rows together. Any order gives the same result, so the sample
decides speed alone. The classes of a column belong to the group of the column's leader, the class with most frequent
shingles among its first ones; the columns of a group of near copies mostly have the same leader, so a class is in few
groups; a group that is part of another is dropped. A group is dealt into blocks of bounded size. First each block is
multiplied with itself: by the first columns, whose overlap counts and places bound those of the whole rows, and what is
left by whole rows. Where a group of
several blocks then still holds classes outside its main component, these few are multiplied with all blocks of the
group. Every pair of a column whose classes are not connected yet is thus looked at; no pair is ever a row.

Shingles are 64-bit hashes of the words (48 bits of them where sets of one block are compared). Defined cases: text that is null or without a word has the empty set, links with
nothing and is its own component; fewer than k words are one shingle; repeated rows are copies; a null id is carried
along, and a component of null ids alone has a null id; a very long text is read whole and may be a block of its own; an
empty table gives an empty result; extra columns are ignored, and carried along by one_of_each() whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, broadcast_if_small, record_batch, small_slices, table

WORDS, PERCENT = 4, 85
#: Documents of the sample that tells frequent shingles: one in 200, but within these bounds; and the number of sampled
#: classes from which a shingle is frequent.
SAMPLE, FREQUENT = (4000, 50_000), 6
#: Parts into which a frequent column is dealt while columns are put together.
SALT = 64
#: Shingles and classes of a block, about.
BLOCK_SHINGLES, BLOCK_CLASSES = 3_000_000, 2000
#: Columns of at most so many classes are looked through for pairs that size and position allow.
NARROW = 512
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(parts: list[np.ndarray], n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), n, np.uint64)
        for h in parts:
            out = (out ^ h) * ODD
            out ^= out >> np.uint64(29)
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each whole text the sorted distinct hashes of its k-word shingles, A-Z lower-cased."""
    words = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    coded = words.flatten().dictionary_encode()
    distinct = [w.lower() for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]  # bytes: A-Z alone
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    full = np.fromiter(map(bool, distinct), bool, len(distinct))  # white space at an end makes an empty word
    code = coded.indices.to_numpy()
    before = np.append(0, np.cumsum(full[code]))
    offsets = before[words.offsets.to_numpy() - words.offsets[0].as_py()]
    h = h[code[full[code]]]
    windows = _mixed([h[j : len(h) - k + 1 + j] for j in range(k)], k) if len(h) >= k else np.zeros(0, np.uint64)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = end - begin
        if n >= k:
            yield np.unique(windows[begin : end - k + 1])
        else:
            yield _mixed([h[begin + j : begin + j + 1] for j in range(n)], n) if n else np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles of a bounded sample of documents, and in how many sampled classes they are."""
    many = docs.count()
    share = min(max(many // 200, SAMPLE[0]), SAMPLE[1]) / max(many, 1)
    few = docs.where(F.abs(F.xxhash64("doc_id", F.lit(23)) % 1_000_003) / 1_000_003 < share)
    schema = pa.schema([("c", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            for s in shingle_sets(batch.column(0), k):
                yield record_batch(schema, np.full(len(s), class_of(s)), s.view(np.int64))

    seen = arrow_map(few.select("text"), run, "c long, h long").distinct().groupBy("h").count()
    found = seen.where(F.col("count") >= FREQUENT).toArrow()
    h, count = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("prefix", pa.binary()), ("rank", pa.binary())])


def _incidence(docs: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row a document: set size, class and the first columns of its row (mostly once for each class and task)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = shared.value
        seen: set[int] = set()
        for batch in small_slices(batches):
            out = []
            for doc_id, s in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0), k), strict=True):
                n, c = len(s), class_of(s)
                prefix = rank = None
                if n and c not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()  # a class may come again, and is one again later
                    seen.add(c)
                    rank = np.zeros(n, np.int32)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        rank = np.where(hot[at] == s, count[at], 0).astype(np.int32)
                    first = n - -(-percent * n // 100) + 1
                    order = np.lexsort((s, rank))[:first]
                    prefix, rank = s[order].tobytes(), rank[order].tobytes()
                out.append((doc_id, n, c, prefix, rank))
            yield record_batch(ROWS, *zip(*out))

    return arrow_map(docs.select("text", "doc_id"), run, "doc_id long, n long, c long, prefix binary, rank binary")


def _entries(rows: DataFrame) -> DataFrame:
    """(h, c, z): the entries of the columns that are multiplied. z packs the share of frequent shingles among the class's
    first ones (8 bits), its size n (28 bits), the entry's place (26 bits), and whether the column is frequent."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("z", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in raw])
            h = np.frombuffer(b"".join(raw), np.int64)
            hot = (np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32) > 0).astype(np.int64)
            begin = np.cumsum(size) - size
            share = 255 * np.add.reduceat(hot, begin) // size
            at = np.arange(len(h)) - np.repeat(begin, size)
            yield record_batch(schema, h, np.repeat(c, size), np.repeat(share << 55 | n << 27, size) | at << 1 | hot)

    return arrow_map(rows.where("prefix is not null").select("n", "c", "prefix", "rank"), run, "h long, c long, z long")


def _possible(n1, at1, n2, at2, percent: int):
    """Size and position bounds for two sets whose first shared entries are at at1 and at2. Every link is found at its
    first shared entry; before it nothing is shared."""
    need = (percent * (n1 + n2) + 99 + percent) // (100 + percent)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - at1, n2 - at2) >= need)


MET = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("share", pa.int32())])


def _met(h: np.ndarray, c: np.ndarray, z: np.ndarray, percent: int) -> pa.RecordBatch:
    """The classes of whole columns, or parts of frequent ones, that are sorted by column and class."""
    hot = (z & 1).astype(bool)
    new = np.append(True, (h[1:] != h[:-1]) | hot[1:] & (c[1:] % SALT != c[:-1] % SALT))
    once = new | np.append(True, c[1:] != c[:-1])
    h, c, z, hot, new = (x[once] for x in (h, c, z, hot, new))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(h)))
    size = np.repeat(size, size)
    keep = hot | (size > NARROW)
    at = np.flatnonzero((size > 1) & ~keep)
    column, n, place = np.cumsum(new)[at], z[at] >> 27 & (1 << 28) - 1, z[at] >> 1 & (1 << 26) - 1
    k, left = 1, np.arange(len(at))
    while len(left):  # the k-th next class of the same column
        left = left[left + k < len(at)]
        left = left[column[left + k] == column[left]]
        fit = left[_possible(n[left], place[left], n[left + k], place[left + k], percent)]
        keep[at[fit]] = keep[at[fit + k]] = True
        k += 1
    h, c, z, hot, column = (x[keep] for x in (h, c, z, hot, np.cumsum(new)))
    share, n = z >> 55, z >> 27 & (1 << 28) - 1
    begin = np.flatnonzero(np.append(True, column[1:] != column[:-1])[: len(column)])
    order = np.lexsort((c, share, column))  # the leader is last in its column
    many = np.diff(np.append(begin, len(h)))
    leader = np.repeat(c[order][begin + many - 1], many)
    return record_batch(MET, pa.array(h, mask=~hot), leader, c, n, share.astype(np.int32))


def _groups(entries: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(g, c, n): the classes that share a column, by the column's leader g. The parts of a frequent column agree on one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([x, y.to_numpy()]) for x, y in zip(held, batch.columns)]
            if len(now[0]):
                cut = np.searchsorted(now[0], now[0][-1]) if now[0][0] != now[0][-1] else 0
                if cut:
                    yield _met(*(x[:cut] for x in now), percent)
                elif now[2][-1] & 1 and len(now[0]) > 1:  # frequent: parts that are complete
                    part = now[1] % SALT
                    cut = int(np.flatnonzero(part != part[-1]).max(initial=-1)) + 1
                    if cut:
                        yield _met(*(x[:cut] for x in now), percent)
                now = [x[cut:] for x in now]
            held = now
        if len(held[0]):
            yield _met(*held, percent)

    salt = F.when(F.col("z").bitwiseAND(1) == 1, F.pmod("c", F.lit(SALT))).otherwise(-1)
    dealt = entries.repartition("h", salt).sortWithinPartitions("h", salt, "c").select("h", "c", "z")
    met = scratch.save(arrow_map(dealt, run, "h long, g long, c long, n long, share int"), "met")
    wide = met.where("h is not null")
    leader = wide.groupBy("h").agg(F.max(F.struct("share", "c"))["c"].alias("g"))
    of_wide = wide.drop("g").join(broadcast_if_small(scratch.save(leader, "leaders")), "h").select("g", "c", "n")
    return _maximal(scratch.save(met.where("h is null").select("g", "c", "n").unionByName(of_wide).distinct(), "all-groups"), scratch)


def _maximal(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups without those whose classes are all in the largest other group that their leader is in. There is no circle:
    a leader is in groups of higher leaders only."""
    size = groups.groupBy("g").agg(F.count("*").alias("size"))
    sizes = size.toDF("outer", "size")
    leaders = groups.select(F.col("g").alias("inner")).distinct()
    within = groups.select(F.col("g").alias("outer"), F.col("c").alias("inner")).where("outer <> inner").join(leaders, "inner").join(sizes, "outer")
    best = within.groupBy("inner").agg(F.max(F.struct("size", "outer"))["outer"].alias("outer"))
    shared = groups.select(F.col("g").alias("inner"), "c").join(best, "inner").join(groups.select(F.col("g").alias("outer"), "c"), ["outer", "c"], "left_semi")
    held = shared.groupBy(F.col("inner").alias("g")).agg(F.count("*").alias("size")).join(size, ["g", "size"], "left_semi").select("g")
    return scratch.save(groups.join(held, "g", "left_anti"), "groups")


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Overlap counts of the first `left` rows with all later rows: a product of sparse rows. Columns of many rows go
    through a dense product, a slice of columns at a time; the others add up row by row."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(flat)))
    out = np.zeros((left, m), np.int32)
    heavy = max(8, m // 10)
    dense = np.flatnonzero(size > heavy)
    for k in range(0, len(dense), 2048):
        part = dense[k : k + 2048]
        at = np.repeat(begin[part], size[part]) + _steps(size[part])
        x = np.zeros((m, len(part)), np.float32)
        x[owner[at], np.repeat(np.arange(len(part)), size[part])] = 1
        out += (x[:left] @ x.T).astype(np.int32)
    sparse = np.flatnonzero((size > 1) & (size <= heavy))
    column, owner = np.repeat(sparse, size[sparse]), owner[np.repeat(begin[sparse], size[sparse]) + _steps(size[sparse])]
    waiting: list[np.ndarray] = []

    def add() -> None:
        nonlocal out
        out += np.bincount(np.concatenate([np.zeros(0, np.int64), *waiting]), minlength=left * m).reshape(left, m).astype(np.int32)
        waiting.clear()

    rest = np.flatnonzero(owner < left)
    for k in range(1, heavy):
        rest = rest[rest + k < len(owner)]
        rest = rest[column[rest + k] == column[rest]]
        if not len(rest):
            break
        waiting.append(owner[rest].astype(np.int64) * m + owner[rest + k])
        if sum(map(len, waiting)) > 2_000_000:
            add()
    add()
    return out


def _steps(size: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each size."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def forest(c: np.ndarray, sets: list[np.ndarray], percent: int, left: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block's classes to the first class of their component within the block. Of the first `left` classes all
    links count, or those to another label."""
    n = np.array([len(s) for s in sets])
    shared = overlaps(sets, left)
    strips = [np.nonzero((100 + percent) * shared[k : k + 256] >= percent * (n[k : min(k + 256, left), None] + n)) for k in range(0, left, 256)]
    a, b = np.concatenate([x + 256 * k for k, (x, _) in enumerate(strips)]), np.concatenate([y for _, y in strips])
    later = b > a
    if label is not None:
        later &= label[a] != label[b]
    a, b = a[later], b[later]
    root = np.arange(len(c))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    linked = np.flatnonzero(root != np.arange(len(c)))
    return c[linked], c[root[linked]]


MEMBERS = pa.schema([("g", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("c", pa.int64()), ("label", pa.int64()), ("first", pa.bool_())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _once(rows: pa.Table) -> tuple[pa.Table, int, np.ndarray | None]:
    """A block's classes once each, those of its left side first; the number of these, and the labels if they count. A
    block without a left side is multiplied with itself."""
    own, first = rows.column("c").to_numpy(), rows.column("first").to_numpy()
    c, at = np.unique(own, return_index=True)
    at[np.searchsorted(c, own[first])] = np.flatnonzero(first)  # a class on both sides is on the left
    at = at[np.argsort(~first[at], kind="stable")]
    rows, left = rows.take(at), int(first[at].sum())
    return rows, left or len(at), rows.column("label").to_numpy() if left else None


def _likely(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks(g, p, q, c, label, first, n, prefix, rank) whose first columns have enough in common with those of
    another row of the block. Up to the place where one set's first columns end, all that two sets share is known; so the
    overlap is at most the shared first columns and the lesser number of columns behind that place. Columns are compared
    by 53 bits of place and hash; one is added as columns that look alike may change places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            rows, left, label = _once(rows)
            if rows.num_rows < 2:
                continue
            sets = [
                np.frombuffer(r, np.int32) + (np.frombuffer(x, np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53
                for x, r in zip(rows.column("prefix").to_pylist(), rows.column("rank").to_pylist())
            ]
            n, shared, last = rows.column("n").to_numpy(), overlaps(sets, left), np.array([s[-1] for s in sets])
            stay = np.zeros(len(n), bool)
            for k in range(0, left, 256):  # a strip of rows at a time
                own = slice(k, min(k + 256, left))
                # first columns of one set that do not come after the last one of the other
                one = np.stack([np.searchsorted(s, last, "right") for s in sets[own]])
                other = np.stack([np.searchsorted(s, last[own], "right") for s in sets], 1)
                most = shared[own] + np.minimum(n[own, None] - one, n - other) + 1
                a, b = np.nonzero((shared[own] > 0) & ((100 + percent) * most >= percent * (n[own, None] + n)))
                a += k
                met = (b > a) if label is None else (b > a) & (label[a] != label[b])
                stay[a[met]] = stay[b[met]] = True
            if stay.any():
                yield rows.select(MEMBERS.names).filter(pa.array(stay)).cast(MEMBERS).combine_chunks().to_batches()[0]

    dealt = blocks.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return arrow_map(dealt.select(*MEMBERS.names, "n", "prefix", "rank"), run, "g long, p int, q int, c long, label long, first boolean")


def _products(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of links for each block of blocks(g, p, q, c, label, first, s) with whole sets s."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in _runs(batches, 3):
            rows, left, label = _once(rows)
            if rows.num_rows < 2:
                continue
            sets = [_whole(x) for x in rows.column("s").to_pylist()]
            found.append(forest(rows.column("c").to_numpy(), sets, percent, left, label))
            if len(found) >= 2000:
                yield record_batch(LINKS, *(np.concatenate(x) for x in zip(*found)))
                found = []
        if found:
            yield record_batch(LINKS, *(np.concatenate(x) for x in zip(*found)))

    dealt = blocks.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return arrow_map(dealt.select(*MEMBERS.names, "s"), run, "a long, b long")


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole runs of two rows or more with the same first `keys` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([x.to_numpy() for x in batch.columns[:keys]])
        begin = np.append(np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), key.shape[1])
        for x, y in zip(begin[:-1].tolist(), begin[1:].tolist()):
            now = key[:, x].tolist()
            if now != last:
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, last = [], now
            held.append(batch.slice(x, y - x))
    if sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks()


BLOCKS = "g long, p int, q int, c long, label long, first boolean, s binary"


def _multiplied(blocks: DataFrame, docs: DataFrame, rows: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The links within blocks(g, p, q, c, label, first). The first columns tell which classes of a block may have a link in
    it. One document of each of these is read again, and its whole set goes to the class's blocks at once, 48 bits of
    each hash."""
    first = rows.where("prefix is not null").select("c", "n", "prefix", "rank")
    likely = scratch.save(_likely(first.join(broadcast_if_small(scratch.save(blocks, f"blocks-{name}")), "c"), percent), f"likely-{name}")
    places = likely.groupBy("c").agg(F.collect_list(F.struct("g", "p", "q", "label", "first")).alias("places"))
    ids = rows.where("prefix is not null").select("doc_id", "c").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("of_id"))
    one = scratch.save(ids.join(places, "c"), f"places-{name}")
    schema = pa.schema([*MEMBERS, ("s", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, most=2_000_000):
            for s, c, at in zip(shingle_sets(batch.column(0), k), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if class_of(s) == c:  # an id may have several texts
                    low = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    yield record_batch(schema, *zip(*[(x["g"], x["p"], x["q"], c, x["label"], x["first"], low) for x in at]))

    again = docs.join(broadcast_if_small(one), F.col("doc_id").eqNullSafe(F.col("of_id"))).select("text", "c", "places")
    return scratch.save(_products(arrow_map(again, run, BLOCKS), percent), f"links-{name}")


def _whole(s: bytes) -> np.ndarray:
    out = np.zeros((len(s) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, label) for the classes of links(a, b): least-label propagation with pointer jumping until nothing changes.
    Every round is a written table; the one before is deleted."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.save(edges.distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = edges.join(labels.select(F.col("c").alias("b"), "label"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "c").select("c", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        up = closer.select(F.col("c").alias("label"), F.col("label").alias("up"))
        jumped = scratch.save(closer.join(up, "label").select("c", F.least("label", "up").alias("label"), "before"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = jumped.select("c", "label")
        if jumped.where("label <> before").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels


def _blocks(shingles: Column, classes: Column) -> Column:
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(classes / BLOCK_CLASSES)).cast("int")


def _block(many: str | Column) -> Column:
    return F.pmod(F.xxhash64("c", F.lit(7)), many if isinstance(many, Column) else F.col(many)).cast("int")


def _links(docs: DataFrame, rows: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(c, label): the components of all classes that are linked with another."""
    groups = _groups(_entries(rows), percent, scratch)
    size = groups.groupBy("g").agg(_blocks(F.sum("n"), F.count("*")).alias("many")).where("many > 1")
    large = scratch.save(size, "large")  # groups of several blocks
    nothing = [F.lit(None).cast("long").alias("label"), F.lit(False).alias("first")]
    dealt = groups.join(broadcast_if_small(large), "g", "left").withColumn("many", F.coalesce("many", F.lit(1)))
    within = dealt.select("g", F.lit(0).alias("p"), _block("many").alias("q"), "c", *nothing)
    links = _multiplied(within, docs, rows, k, percent, scratch, "within")
    labels = components(links, scratch, "within")
    if large.isEmpty():
        return labels
    members = groups.join(broadcast_if_small(large), "g").join(labels, "c", "left")
    members = scratch.save(members.select("g", "c", "n", "many", F.coalesce("label", "c").alias("label")), "members")
    main = members.groupBy("g", "label").agg(F.count("*").alias("classes")).groupBy("g").agg(F.max(F.struct("classes", "label"))["label"].alias("main"))
    outside = members.join(main, "g").where("label <> main")
    few = scratch.save(outside.groupBy("g").agg(_blocks(F.sum("n"), F.count("*")).alias("outer")), "few")
    if few.isEmpty():
        return labels
    right = members.join(broadcast_if_small(few), "g").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    left = outside.join(broadcast_if_small(few), "g").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    right = right.select("g", "p", _block("many").alias("q"), "c", "label", F.lit(False).alias("first"))
    left = left.select("g", _block("outer").alias("p"), "q", "c", "label", F.lit(True).alias("first"))
    across = _multiplied(left.unionByName(right), docs, rows, k, percent, scratch, "across")
    return components(links.unionByName(across), scratch, "across")


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs(doc_id, text)."""
    scratch, docs = Scratch(docs.sparkSession, "jaccard"), docs.select("doc_id", "text")
    rows = scratch.save(_incidence(docs, k, percent, _frequent(docs, k)), "rows")
    labels = _links(docs, rows, k, percent, scratch)
    scratch.drop("met", "all-groups", "groups", "members", *(f"{x}-{y}" for x in ("blocks", "likely", "places") for y in ("within", "across")))
    ids = rows.where("n > 0").select("doc_id", "c")
    classes = ids.groupBy("c").agg(F.min("doc_id").alias("least")).join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = classes.join(classes.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("c", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return rows.select("doc_id", "n", "c").join(named, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.coalesce(alone, "component_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the least id stays, once. Rows with an empty set stay; of
    rows with the same id and text (empty or not) one stays."""
    found = Scratch(docs.sparkSession, "nearcopies").save(jaccard_components(docs, k, percent), "components")
    stays = F.max(F.expr("n_shingles = 0 or doc_id = component_id or component_id is null"))
    ids = found.groupBy("doc_id").agg(stays.alias("stays"), (F.count("*") > 1).alias("repeated")).where("stays")
    ids = Scratch(docs.sparkSession, "nearcopies").save(ids.select(F.col("doc_id").alias("kept_id"), "repeated"), "ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(row).join(broadcast_if_small(ids), F.col("row.doc_id").eqNullSafe(F.col("kept_id")))
    repeated = kept.where("repeated").select("row", F.col("row.doc_id").alias("id"), F.col("row.text").alias("text")).dropDuplicates(["id", "text"])
    return kept.where("not repeated").select("row").unionByName(repeated.select("row")).select("row.*")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
