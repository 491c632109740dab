r"""Hard negatives by a multiway hyperplane tree (GNAT, Brin 1995): a row belongs to the nearest of a node's split points,
and each split point stores the range of its distances to the rows of every sibling subtree. A query asks for windows of
scores; a window is an annulus of distances around the query, and a sibling whose ranges the annulus cannot meet is
eliminated with all below it. Leaves are scored exactly, so nothing is lost, however little the tree eliminates.

Scores are inner products. To make them distances, each row gets one more coordinate sqrt(M - |x|^2), M the greatest square of
a row; the query gets 0 there. Then distance^2 = |q|^2 + M - 2 * score, and the triangle inequality holds.

Split points come from a bounded sample (at most about SAMPLE rows, far apart from each other); the tree has at most
MOST_LEAVES leaves, whatever the input, and ranges are taken over all rows. The rows of a leaf are dealt to slices of about
SLICE rows, its visiting queries to slices of about VISITS, and each pair of slices is one block of exact products; so
equal vectors, however many, are no large group. A block gives out at most `most` rows for each window.

Round 1 scores a query's own leaf and finds a bound for its positives; round 2 searches from that bound upwards; round 3
searches the windows of negatives.

Defined cases: rows with a null id, label or vector, a null or non-finite component, or another length than the commonest
(ties: the longer) take no part; of rows that share an id the least by label and vector takes part; ties of score go by id;
an anchor without another row of its label has no positives, a positive score below 0 has no negatives; an empty table
gives an empty result; extra columns are ignored. Products that may pass 2^53 are worked out in whole numbers; a sum
that may pass 2^63 is an error, as its score has no place in a long. Texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, record_batch, table

PARAMETERS = dict(anchors=100, most=5, low=80)
ARITY, SAMPLE, LEAF, MOST_LEAVES, SLICE, VISITS = 8, 20_000, 1000, 4096, 4000, 1000


def prepared(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vec array<long>): the rows that take part, with vec_id distinct."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(F.lit(scale) * v))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long").alias("label"), x.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("m")).select("vec_id", "m.label", "m.vec")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top >= 1 << 63:
        raise OverflowError("an inner product may pass 2^63")
    return a @ b.T


def far_apart(points: np.ndarray, many: int) -> np.ndarray:
    """Numbers of at most `many` points, each the farthest from those before it; equal points are taken once."""
    at, chosen = int(np.argmax((points**2).sum(1))), []
    nearest = np.full(len(points), np.inf)
    while len(chosen) < many and nearest[at] > 0:
        chosen.append(at)
        nearest = np.minimum(nearest, ((points - points[at]) ** 2).sum(1))
        at = int(nearest.argmax())
    return np.array(chosen)


class Tree:
    """Nodes by level: node k of a level has split points (lifted), and its child j is node first + j of the next level
    or a leaf. `ranges` holds, for each split point i and sibling j, the least and greatest distance to the rows of j."""

    def __init__(self, top: float):
        self.top, self.points, self.children, self.n_leaves = top, [], [], 0
        self.ranges: list[np.ndarray] = []

    @classmethod
    def grow(cls, sample: np.ndarray, rows: int, top: float) -> Tree:
        tree = cls(top)
        lifted, rng = tree.lift(sample), np.random.default_rng(11)
        want = min(MOST_LEAVES, max(1, rows // LEAF))

        def node(part: np.ndarray, share: float, depth: int) -> int:
            """Number of the node over these sample rows; -1 - leaf where it is a leaf. Split points are the points far
            apart among a few drawn ones, as published; a leaf too deep for more is only larger."""
            chosen: np.ndarray | list = []
            if share >= 2 and len(part) > ARITY and depth < 24:
                drawn = rng.permutation(len(part))[: 3 * ARITY]
                chosen = drawn[far_apart(part[drawn], ARITY)]
                chosen = far_apart(part, ARITY) if len(chosen) < 2 else chosen
            if len(chosen) < 2:
                tree.n_leaves += 1
                return -tree.n_leaves
            number = len(tree.points)
            tree.points.append(part[chosen])
            tree.children.append(np.zeros(len(chosen), np.int64))
            near = tree.distances(part, part[chosen]).argmin(1)
            for j in range(len(chosen)):
                own = part[near == j]
                tree.children[number][j] = node(own, share * len(own) / len(part), depth + 1)
            return number

        tree.root = node(lifted, float(want), 0)
        return tree

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x**2).sum(1), 0.0))])

    @staticmethod
    def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * x @ points.T, 0.0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The leaf of each row, and for each node reached the ranges [split point, child] of these rows' distances."""
        lifted, leaf, found = self.lift(x), np.zeros(len(x), np.int64), {}
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            number, rows = stack.pop()
            if number < 0 or not len(rows):
                leaf[rows] = -1 - number
                continue
            d = self.distances(lifted[rows], self.points[number])
            near, k = d.argmin(1), d.shape[1]
            low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
            for j in range(k):
                own = near == j
                if own.any():
                    low[:, j], high[:, j] = d[own].min(0), d[own].max(0)
                stack.append((int(self.children[number][j]), rows[own]))
            found[number] = low, high
        return leaf, found

    def visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the windows that may have rows there): window k of query row x[k] is low[k] <= score <= high[k]."""
        x = x.astype(float)
        base = (x**2).sum(1) + self.top
        slack = 1e-6 * (np.sqrt(base) + 1)
        inner = np.sqrt(np.maximum(base - 2 * high, 0.0)) - slack
        outer = np.sqrt(np.maximum(base - 2 * low, 0.0)) + slack
        x = np.column_stack([x, np.zeros(len(x))])
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            number, rows = stack.pop()
            if not len(rows):
                continue
            if number < 0:
                yield -1 - number, rows
                continue
            d = self.distances(x[rows], self.points[number])
            alive = np.ones_like(d, bool)
            for i in range(d.shape[1]):
                from_, upto = np.maximum(inner[rows] - d[:, i], d[:, i] - outer[rows]), d[:, i] + outer[rows]
                alive &= (self.ranges[number][0][i] <= upto[:, None]) & (self.ranges[number][1][i] >= from_[:, None])
            for j in range(d.shape[1]):
                stack.append((int(self.children[number][j]), rows[alive[:, j]]))


def index(rows: DataFrame, scratch: Scratch) -> tuple[Tree, DataFrame]:
    """The tree, and the saved rows with their leaf."""
    spark = rows.sparkSession
    rows = scratch.save(rows, "rows")
    lengths = rows.groupBy(F.size("vec").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = rows.where(F.size("vec") == (lengths["k"] if lengths else 0))
    many, top = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0))).first()
    few = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) / 1_000_003 < SAMPLE / max(many, 1)).select("vec_id", "vec").toArrow()  # a bounded sample
    few = few.sort_by("vec_id").combine_chunks()
    sample = matrix(few.column("vec").combine_chunks()) if few.num_rows else np.zeros((1, lengths["k"] if lengths else 1), np.int64)
    tree = Tree.grow(sample, many, top)
    shared = spark.sparkContext.broadcast(tree)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.int64())), ("leaf", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, _ = shared.value.place(matrix(batch.column(2)))
                yield record_batch(schema, *batch.columns, leaf)

    def widest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                for number, (low, high) in shared.value.place(matrix(batch.column(0)))[1].items():
                    old = found.get(number, [low, high])
                    found[number] = [np.minimum(old[0], low), np.maximum(old[1], high)]
        rows = [(number, i, j, low[i, j], high[i, j]) for number, (low, high) in found.items() for i in range(len(low)) for j in range(len(low))]
        if rows:
            yield record_batch(pa.schema([("node", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]), *zip(*rows))

    placed = scratch.save(arrow_map(rows.select("vec_id", "label", "vec"), run, "vec_id long, label long, vec array<long>, leaf int"), "placed")
    got = arrow_map(placed.select("vec"), widest, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()  # at most ARITY^2 rows a node
    tree.ranges = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)]) for p in tree.points]
    for number, i, j, low, high in zip(*(got.column(c).to_pylist() for c in ("node", "i", "j", "low", "high"))):
        tree.ranges[number][:, i, j] = low, high
    shared.destroy()
    return tree, placed


VISIT = "leaf int, anchor_id long, label long, vec array<long>, key array<long>, low array<long>, high array<long>"


def search(tree: Tree, placed: DataFrame, windows: DataFrame, same: bool, most: int, scratch: Scratch, name: str) -> DataFrame:
    """(anchor_id, key, vec_id, score): for each window(anchor_id, label, vec, key, low, high) the first `most` rows with
    low <= score <= high, of the anchor's label (without the anchor) or of other labels."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    schema = pa.schema([("leaf", pa.int32()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.int64())), ("key", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each anchor and leaf, with the windows that may have rows there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, (anchor, label, key, low, high) = matrix(batch.column(2)), (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            for leaf, rows in shared.value.visits(x, low.astype(float), high.astype(float)):
                rows = rows[np.argsort(anchor[rows], kind="stable")]
                begin = np.flatnonzero(np.append(True, anchor[rows][1:] != anchor[rows][:-1]))
                first, upto = rows[begin], np.append(begin, len(rows)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(v[rows])) for v in (key, low, high)]
                yield record_batch(schema, np.full(len(first), leaf, np.int32), anchor[first], label[first], batch.column(2).take(pa.array(first)), *lists)

    visits = arrow_map(windows.select("anchor_id", "label", "vec", "key", "low", "high"), run, VISIT)
    return scored(scratch.save(visits, f"{name}_visits"), placed, same, most)


def scored(visits: DataFrame, placed: DataFrame, same: bool, most: int) -> DataFrame:
    """The windows' first rows over the leaves that they visit, in blocks of exact products."""
    # a few thousand rows: the leaves
    leaves = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts")).join(visits.groupBy("leaf").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("turns")), "leaf"))
    up_to = lambda c: F.expr(f"explode(sequence(0L, {c} - 1L))")
    members = placed.join(leaves, "leaf").withColumn("part", F.expr("pmod(xxhash64(vec_id), parts)")).withColumn("turn", up_to("turns")).drop("parts", "turns")
    asking = visits.join(leaves, "leaf").withColumn("turn", F.expr("pmod(xxhash64(anchor_id), turns)")).withColumn("part", up_to("parts")).drop("parts", "turns")
    keys = ["leaf", "part", "turn"]
    out = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def block(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return out.empty_table()
        given = given.sort_by("vec_id")
        ids, labels = given.column("vec_id").to_numpy(), given.column("label").to_numpy()
        score = products(matrix(asked.column("vec").combine_chunks()), matrix(given.column("vec").combine_chunks()))
        found = []
        for row, s in zip(asked.select(["anchor_id", "label", "key", "low", "high"]).to_pylist(), score, strict=True):
            fit = (labels == row["label"]) & (ids != row["anchor_id"]) if same else labels != row["label"]
            for key, low, high in zip(row["key"], row["low"], row["high"]):
                at = np.flatnonzero(fit & (s >= low) & (s <= high))
                if len(at) > most:
                    at = at[s[at] >= np.partition(s[at], len(at) - most)[len(at) - most]]
                at = at[np.lexsort((ids[at], -s[at]))][:most]
                found += [(row["anchor_id"], key, int(ids[k]), int(s[k])) for k in at]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out) if found else out.empty_table()

    got = asking.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(block, "anchor_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, anchors: int = 100, most: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings(vec_id, embedding, label)."""
    scratch = Scratch(embeddings.sparkSession, "gnat")
    tree, placed = index(prepared(embeddings), scratch)
    asking = placed.where(F.col("vec_id") % anchors == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec", "leaf")
    least, greatest, zero = (F.lit(x).cast("long") for x in (-(1 << 62), 1 << 62, 0))
    home = scratch.save(asking.select("leaf", "anchor_id", "label", "vec", *(F.array(x).alias(c) for x, c in ((zero, "key"), (least, "low"), (greatest, "high")))), "home_visits")
    # where an anchor's own leaf has enough rows of its label, its positives score no less than the last of them
    bound = scored(home, placed, True, most).where(F.col("rank") == most).select("anchor_id", F.col("score").alias("bound"))
    upwards = asking.join(bound, "anchor_id", "left").select("anchor_id", "label", "vec", zero.alias("key"), F.coalesce("bound", least).alias("low"), greatest.alias("high"))
    positives = search(tree, placed, upwards, True, most, scratch, "positives").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = scratch.save(positives, "positives")
    # low * positive <= 100 * negative in whole numbers; a positive below 0 has an empty window
    lowest = F.expr(f"({low} * positive_score + 99) div 100")
    windows = positives.where("positive_score >= 0").join(asking, "anchor_id").select("anchor_id", "label", "vec", F.col("positive_id").alias("key"), lowest.alias("low"), F.col("positive_score").alias("high"))
    negatives = search(tree, placed, windows, False, most, scratch, "negatives")
    out = negatives.select("anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), **PARAMETERS)


def _sql(anchors: int, most: int, low: int) -> str:
    return f"""WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
scores AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % {anchors} = 0),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {most})
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND {low} * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= {most}"""


SQL = _sql(**PARAMETERS)
