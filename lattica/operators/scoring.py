"""Sampling, folds, voting and scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import mean6, over, r6, std6


def hash_order(seed: int, key: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with largest-remainder quotas for each label; rows of a label are taken in hash order."""
    count = df.groupBy(label).agg(F.count("*").alias("size"))
    total = count.agg(F.sum("size").alias("total"))  # one row
    q = count.join(F.broadcast(total)).withColumn("exact", F.col("size") * n / F.col("total")).withColumn("floor", F.floor("exact"))
    left = n - F.sum("floor").over(over())  # one row for each label
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), label))
    quota = q.withColumn("quota", F.least("size", F.col("floor") + (order <= left).cast("int"))).select(label, "quota")
    ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key)))
    return ranked.join(F.broadcast(quota), label).where("k <= quota").drop("k", "quota")


def equal_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n // k rows of each of the k labels, the first n % k labels one more, all rows of a label that has fewer."""
    count = df.select(label).distinct()
    place, many = F.row_number().over(Window.orderBy(label)), F.count("*").over(over())  # one row for each label
    quota = count.select(label, (F.floor(F.lit(n) / many) + (place <= F.lit(n) % many).cast("int")).alias("quota"))
    ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key)))
    return ranked.join(F.broadcast(quota), label).where("k <= quota").drop("k", "quota")


def proportional_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all if there are fewer): each label's rounded share, one row at least, in hash order; rows too many go and
    missing ones are added in hash order of all rows. Halves are rounded to the even number."""
    count = df.groupBy(label).agg(F.count("*").alias("size"))
    share = F.col("size") / F.sum("size").over(over()) * n  # one row for each label
    quota = count.select(label, F.greatest(F.lit(1), F.bround(share).cast("int")).alias("quota"))
    ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key)))
    first = (F.col("k") <= F.col("quota")).alias("first")
    return ranked.join(F.broadcast(quota), label).orderBy(F.desc(first), hash_order(seed, key), key).limit(n).drop("k", "quota")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key)) - 1) % k).cast("int"))


def class_balance_flags(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < least)


def confusion_report(pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class from (truth, pred)."""
    cell = pred.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    t = cell.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = cell.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = t.join(p, "class", "full").select("class", z("support").alias("support"), z("tp").alias("tp"), z("predicted").alias("predicted"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return j.select("class", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), r6(safe(F.col("tp"), F.col("predicted")), "precision"), r6(safe(F.col("tp"), F.col("support")), "recall"), r6(safe(2 * F.col("tp"), F.col("predicted") + F.col("support")), "f1"))


def fold_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy and balanced accuracy of each fold from (fold, truth, pred)."""
    hit = (F.col("truth") == F.col("pred")).cast("int")
    c = pred.groupBy("fold", "truth").agg(F.sum(hit).alias("tp"), F.count("*").alias("n"))
    return c.groupBy("fold").agg(r6(F.sum("tp") / F.sum("n"), "accuracy"), r6(F.avg(F.col("tp") / F.col("n")), "balanced_accuracy"))


def cell_summary(folds: DataFrame) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("fold", "acc"))), lambda x: F.round(x["acc"], 6))
    return folds.groupBy("dataset", "descriptor", "classifier").agg(mean6("acc", "mean_acc"), std6("acc", "std_acc"), order.alias("folds"))


def closest(x: np.ndarray, y: np.ndarray, one: np.ndarray, two: np.ndarray, k: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y and distance, at 9 places, of the k rows of y that are nearest to each row of x; the earlier row
    of y first where distances are equal. Rows of one id (`one`, `two`) and distances that are no finite number are left
    out. A product of matrices gives rough distances with a bound on their error; only pairs that may be among the k by
    this bound are measured exactly. At most about `cells` numbers, or one row's, are held at once, whatever the length."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    many, length = y.shape
    if not many or not len(x):
        return found[0]
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    most = yy[np.isfinite(yy)].max(initial=0)
    for s in range(0, len(x), rows := max(1, cells // many)):
        own = slice(s, s + rows)
        rough = xx[own, None] + yy - 2 * (x[own] @ y.T)
        rough[~np.isfinite(rough) | (one[own, None] == two)] = np.inf
        last = np.partition(rough, min(k, many) - 1, axis=1)[:, min(k, many) - 1]
        error = 8 * (length + 4) * np.finfo(float).eps * (xx[own] + most)
        far = np.sqrt(np.maximum(last + error, 0)) + 2e-9  # distances are equal where 9 places are
        i, j = np.nonzero(np.isfinite(rough) & (rough <= (far * far + error)[:, None]))
        d = np.empty(len(i))
        for p in range(0, len(i), step := max(1, cells // max(length, 1))):
            at = slice(p, p + step)
            d[at] = np.round(np.sqrt(((x[s + i[at]] - y[j[at]]) ** 2).sum(-1)), 9)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        near = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(d)
        found.append((s + i[near], j[near], d[near]))
    return tuple(np.concatenate(c) for c in zip(*found))


def blocks_of(rows: int, length: int, block: int = 2000, most: int = 16, numbers: int = 4_000_000) -> int:
    """Number of blocks of rows of `length` numbers: of `block` rows each, but at most `most` blocks as long as a block holds at
    most `numbers` numbers."""
    return max(1, -(-rows // max(block, min(-(-rows // most), numbers // max(length, 1)))))


def nearest(query: DataFrame, reference: DataFrame, k: int = 5, block: int = 2000) -> DataFrame:
    """(id, label, id2, label2, d): the k nearest of reference(id, vec, label) by Euclidean distance for each row of
    query(id, vec, label), exact; ties go to the lesser id, and a row is not its own neighbour. Both sides are dealt into
    blocks as `blocks_of` says; a pair of blocks is one task, which keeps k rows for each row of its query side. The
    work is the product of both sizes; what is shuffled grows with a side's rows times the other side's blocks, of which
    there are 16 at most while a block stays small enough for a task."""
    sizes = [x.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first() for x in (query, reference)]
    blocks = [blocks_of(n, length, block) for n, length in sizes]

    def dealt(x: DataFrame, own: str, many: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias(own)
        return x.select("id", F.col("vec").cast("array<double>").alias("vec"), "label", place, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    q = dealt(query, "qb", blocks[0], "rb", blocks[1])
    r = dealt(reference, "rb", blocks[1], "qb", blocks[0])
    kind = {c: query.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {kind['id']}, label {kind['label']}, id2 {kind['id']}, label2 {kind['label']}, d double"

    def met(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")  # equal distances stay in this order
        x, y = (t.column("vec").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in (a, b))
        one, two = (t.column("id").to_numpy() for t in (a, b))
        rows, cols, gaps = closest(x, y, one, two, k)
        a, b = a.take(rows), b.take(cols)
        return pa.table([a["id"], a["label"], b["id"], b["label"], pa.array(gaps)], names=["id", "label", "id2", "label2", "d"])

    near = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(met, schema)
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "id2"))  # k rows for each block of the reference
    return near.withColumn("k", place).where(F.col("k") <= k).drop("k")


def knn_classify(query: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """Majority vote of the k nearest; the lesser label wins ties."""
    votes = nearest(query, reference, k).groupBy("id", "label", "label2").agg(F.count("*").alias("n"))
    return votes.groupBy("id", "label").agg(F.max_by("label2", F.struct("n", -F.col("label2"))).alias("pred"), r6(100.0 * F.max("n") / k, "confidence"))


def soft_vote(votes: DataFrame) -> DataFrame:
    """(id, label, share) of greatest weighted probability from votes(id, label, weight, confidence, probs): probs is a map
    of label to probability; without it the confidence in percent (50 where unknown) counts for the label. The smaller
    label wins ties."""
    sure = F.create_map(F.col("label"), F.coalesce("confidence", F.lit(50)) / 100.0)
    each = votes.select("id", "weight", F.explode(F.coalesce("probs", sure)).alias("label", "p"))
    n = each.groupBy("id", "label").agg(F.round(F.sum(F.col("weight") * F.col("p")), 9).alias("w"))
    return n.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"), r6(F.max("w") / F.sum("w"), "share"))


def hard_vote(votes: DataFrame) -> DataFrame:
    """(id, label) of greatest total weight from votes(id, label, weight); the smaller label wins ties."""
    n = votes.groupBy("id", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
    return n.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"), r6(F.max("w") / F.sum("w"), "share"))


def match_label(texts: DataFrame, classes: list[str], either_way: bool = False) -> DataFrame:
    """(id, label) of the first class that equals the text or is held by it, else -1. With `either_way` a class that holds
    the text counts as well (an empty text: the first class), and then a number after the word class."""
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    best = F.lit(-1)
    if either_way:
        number = F.regexp_extract(low, r"class[_\s]*(\d+)", 1).try_cast("int")
        best = F.when(number < len(classes), number).otherwise(best)
    for k in range(len(classes) - 1, -1, -1):
        held = low.contains(classes[k].lower())
        best = F.when(held | F.lit(classes[k].lower()).contains(low) if either_way else held, k).otherwise(best)
    for k in range(len(classes) - 1, -1, -1):
        best = F.when(low == classes[k].lower(), k).otherwise(best)
    return texts.select("id", best.alias("label"))


def keyword_search(texts: DataFrame, query: str, n: int) -> DataFrame:
    """The n rows that hold most of the query's words."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((low.contains(w).cast("int") for w in query.lower().split()), F.lit(0))
    return texts.select("id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(n)
