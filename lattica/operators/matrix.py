"""Result-matrix and selection analytics on cells(dataset, object_type, descriptor, classifier, acc, acc_std, n_folds)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import halved_up, mean6, micro, over, r6, std6

D, X = "dataset", "descriptor"


def best_cell(cells: DataFrame, pinned: str | None = None) -> DataFrame:
    """(dataset, object_type, descriptor, classifier, acc) of the best classifier; a pinned one wins where present."""
    first = F.when(F.col("classifier") == pinned, 0).otherwise(1) if pinned else F.lit(0)
    w = Window.partitionBy(D, X).orderBy(first, F.desc("acc"), "classifier")
    return cells.withColumn("k", F.row_number().over(w)).where("k = 1").select(D, "object_type", X, "classifier", "acc")


def ranking(best: DataFrame, n: int | None = None) -> DataFrame:
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy(D).orderBy(F.desc("acc"), X))).select(D, X, "acc", "rank")
    return out.where(F.col("rank") <= n) if n else out


def oracle(best: DataFrame) -> DataFrame:
    return ranking(best, 1).select(D, F.col(X).alias("oracle"), F.col("acc").alias("oracle_acc"))


def single_best(best: DataFrame) -> DataFrame:
    """The descriptor of greatest (coverage, mean accuracy)."""
    got = best.groupBy(X).agg(F.countDistinct(D).alias("coverage"), mean6("acc", "mean_acc"))
    return got.orderBy(F.desc("coverage"), F.desc("mean_acc"), X).limit(1)


def rank_by_type(best: DataFrame) -> DataFrame:
    got = best.groupBy("object_type", X).agg(mean6("acc", "mean_acc"), std6("acc", "std_acc"), F.count("*").alias("n"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("object_type").orderBy(F.desc("mean_acc"), X)))


def rank_by_type_lodo(best: DataFrame) -> DataFrame:
    """Means of each type without one dataset: (sum - own) / (n - 1), no loop over held-out datasets."""
    w = over("object_type", X)
    n = F.count("*").over(w)
    rest = (F.sum(micro("acc")).over(w) - micro("acc")) / F.nullif(n - 1, F.lit(0))
    got = best.select("object_type", X, D, halved_up(rest, "mean_acc")).where("mean_acc is not null")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("object_type", D).orderBy(F.desc("mean_acc"), X)))


def master_matrix(cells: DataFrame, classifiers: list[str]) -> DataFrame:
    wide = cells.groupBy(D, X).pivot("classifier", classifiers).agg(F.max("acc"))
    best = best_cell(cells).select(D, X, F.col("classifier").alias("best_classifier"), F.col("acc").alias("best_acc"))
    return wide.join(best, [D, X])


def classifier_comparison(cells: DataFrame) -> DataFrame:
    """Overall and by type in one pass of grouping sets; a null type is the overall row."""
    return cells.groupingSets([["classifier"], ["classifier", "object_type"]], "classifier", "object_type").agg(mean6("acc", "mean_acc"), std6("acc", "std_acc"), halved_up(F.percentile(micro("acc"), 0.5), "median_acc"), F.count("*").alias("n"))


def descriptor_comparison(cells: DataFrame) -> DataFrame:
    return cells.rollup(X, "object_type").agg(mean6("acc", "mean_acc"), F.count("*").alias("n"))


def missing_cells(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def completeness(cells: DataFrame, expected: int) -> DataFrame:
    return cells.groupBy(D).agg(F.count("*").alias("present"), r6(100.0 * F.count("*") / expected, "percent"))


def scored(selections: DataFrame, best: DataFrame) -> DataFrame:
    """Selections(method, dataset, descriptor) with accuracy, rank, oracle and regret; unmatched ones are skipped."""
    got = selections.join(ranking(best), [D, X]).join(oracle(best), D)
    return got.withColumn("regret", F.col("oracle_acc") - F.col("acc")).withColumn("is_match", F.col(X) == F.col("oracle"))


def method_metrics(got: DataFrame) -> DataFrame:
    share = lambda n: r6(F.avg((F.col("rank") <= n).cast("int")), f"dsa{n}")
    return got.groupBy("method").agg(mean6("acc", "mba"), share(1), share(3), mean6("regret", "mean_regret"), r6(F.max("regret"), "max_regret"), F.count("*").alias("n"))


def mba_by_type(got: DataFrame, types: DataFrame) -> DataFrame:
    return got.join(types, D).groupBy("method", "object_type").agg(mean6("acc", "mba"), mean6(F.col("oracle_acc") - F.col("acc"), "gap"))


def selection_distribution(selections: DataFrame) -> DataFrame:
    n = selections.groupBy("method", X).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(over("method")), 6))


def method_summary(got: DataFrame, best: DataFrame) -> DataFrame:
    """Metrics against the single best descriptor: win rate and the share of its gap to the oracle that is closed."""
    sba = best.join(single_best(best).select(X), X).select(D, F.col("acc").alias("sba_acc"))
    total = lambda c, name: F.sum(micro(c)).alias(name)  # noqa: E731 (whole millionths)
    g = got.join(sba, D).groupBy("method").agg(F.count("*").alias("n"), total("acc", "m"), total("oracle_acc", "o"), total("sba_acc", "s"), r6(F.avg((F.col("acc") >= F.col("sba_acc")).cast("int")), "win_rate"))
    gap = F.col("o") - F.col("s")
    return g.select("method", "n", halved_up(F.col("m") / F.col("n"), "mean_acc"), "win_rate", r6(F.when(gap > 5000 * F.col("n"), 100 * (F.col("m") - F.col("s")) / F.nullif(gap, F.lit(0))), "gap_closed"))


def win_loss_tie(got: DataFrame, eps: float = 1e-6) -> DataFrame:
    a, b = got.select(D, F.col("method").alias("a"), F.col("acc").alias("x")), got.select(D, F.col("method").alias("b"), F.col("acc").alias("y"))
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).alias(n)
    gap = F.col("x") - F.col("y")
    return a.join(b, D).where("a < b").groupBy("a", "b").agg(count(gap > eps, "wins"), count(gap < -eps, "losses"), count(F.abs(gap) <= eps, "ties"))


def agreement_matrix(selections: DataFrame) -> DataFrame:
    a, b = selections.select(D, F.col("method").alias("a"), F.col(X).alias("x")), selections.select(D, F.col("method").alias("b"), F.col(X).alias("y"))
    return a.join(b, D).groupBy("a", "b").agg(r6(100 * F.avg((F.col("x") == F.col("y")).cast("int")), "percent"))


def baseline_random(best: DataFrame, seeds: DataFrame) -> DataFrame:
    """One available descriptor for each dataset and seed, by a hash."""
    key = F.md5(F.concat_ws(":", F.col("seed").cast("string"), D, X))
    pick = best.join(F.broadcast(seeds)).groupBy("seed", D).agg(F.min_by(F.struct(X, "acc"), key).alias("p"))
    return pick.groupBy("seed").agg(r6(F.avg("p.acc"), "mba"), F.countDistinct(f"p.{X}").alias("n_unique"))


def baseline_fixed(best: DataFrame, descriptor: str) -> DataFrame:
    fixed = best.where(F.col(X) == descriptor).select(D, F.col(X).alias("own"))
    return oracle(best).join(fixed, D, "left").select(D, F.coalesce("own", "oracle").alias(X))


def baseline_by_type(best: DataFrame) -> DataFrame:
    """First available descriptor in the ranking of the dataset's type."""
    r = rank_by_type(best).select("object_type", X, "rank")
    return best.join(r, ["object_type", X]).groupBy(D).agg(F.min_by(X, "rank").alias(X))


def bootstrap_ci(got: DataFrame, n: int = 200, ci: float = 0.95) -> DataFrame:
    """Percentile interval of resampled means of acc for each method; draws come from md5 of (replicate, draw)."""
    rows = got.withColumn("k", F.row_number().over(Window.partitionBy("method").orderBy(D)) - 1).select("method", "k", "acc")
    many = rows.groupBy("method").agg(F.count("*").alias("n"), mean6("acc", "mean_acc"))
    draws = many.select("method", "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")).select("method", "n", "rep", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("draw"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    sums = draws.select("method", "rep", "n", at.alias("k")).join(rows, ["method", "k"]).groupBy("method", "rep", "n").agg(F.sum(micro("acc")).alias("m"))
    # percentiles of whole sums in whole thousandths, divided once
    end = lambda p, name: halved_up(F.round(F.expr(f"percentile(m, {p})") * 1000) / (1000 * F.first("n")), name)
    out = sums.groupBy("method").agg(end((1 - ci) / 2, "low"), end(1 - (1 - ci) / 2, "high"))
    return many.join(out, "method").select("method", "mean_acc", "low", "high")


def mcnemar_counts(pred: DataFrame) -> DataFrame:
    """Discordant counts and statistic of predictions(truth, a, b)."""
    b, c = (F.sum(F.when(x, 1).otherwise(0)) for x in ((F.col("a") == F.col("truth")) & (F.col("b") != F.col("truth")), (F.col("a") != F.col("truth")) & (F.col("b") == F.col("truth"))))
    g = pred.agg(b.alias("b"), c.alias("c"))
    return g.select("b", "c", r6(F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)) / F.nullif(F.col("b") + F.col("c"), F.lit(0))).otherwise(0.0), "statistic"))


def mcnemar_p(statistic: float) -> float:
    return math.erfc(math.sqrt(statistic / 2))


def wilcoxon_w(got: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of positive signed average ranks of acc differences between two methods."""
    x = got.where(F.col("method") == a).select(D, F.col("acc").alias("x")).join(got.where(F.col("method") == b).select(D, F.col("acc").alias("y")), D)
    d = x.select(F.round(F.col("x") - F.col("y"), 9).alias("d")).where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("int")).alias("plus"))
    up = F.sum("n").over(Window.orderBy("size"))  # one row for each distinct difference between two methods
    return d.withColumn("rank", up - (F.col("n") - 1) / 2).agg(r6(F.coalesce(F.sum(F.col("plus") * F.col("rank")), F.lit(0.0)), "w_plus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def convergence_n(curve: DataFrame, eps: float, std: float) -> DataFrame:
    """Smallest n of curve(descriptor, n, acc, acc_std) near the value at the largest n."""
    last = F.max_by("acc", "n").over(over(X))
    ok = curve.withColumn("last", last).where((F.abs(F.col("acc") - F.col("last")) < eps) & (F.col("acc_std") < std))
    return ok.groupBy(X).agg(F.min("n").alias("n"))


def average_rank(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Average rank of ties: rank plus half of the other equal rows."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(over(*keys, value)) - 1) / 2)


def ranking_stability(best: DataFrame) -> DataFrame:
    """Spearman correlation of each dataset's accuracies with the mean accuracies."""
    mean = best.groupBy(X).agg((F.sum(micro("acc")) / F.count("acc")).alias("mean"))
    r = average_rank(average_rank(best.join(mean, X), "acc", "ra", D), "mean", "rm", D)
    return r.groupBy(D).agg(r6(F.corr("ra", "rm"), "rho"))


def regret_summary(got: DataFrame) -> DataFrame:
    share = lambda c, n: r6(F.avg(c.cast("int")), n)
    g = F.col("regret")
    return got.groupBy("method").agg(r6(F.avg(g), "mean"), r6(F.stddev_pop(g), "std"), r6(F.expr("percentile(regret, 0.5)"), "median"), r6(F.max(g), "max"), share(g == 0, "top1"), share(g < 0.01, "soft"), share(g < 0.02, "near"))


def lodo_baselines(best: DataFrame) -> DataFrame:
    """For each held-out dataset: random expectation, and the accuracy of the descriptor that is best on all others."""
    w = over(X)
    n = F.count("*").over(w)
    rest = best.withColumn("rest", (F.sum(micro("acc")).over(w) - micro("acc")) / F.nullif(n - 1, F.lit(0)))
    top = rest.groupBy(D).agg(F.max_by(F.struct(X, "acc"), F.struct("rest", F.col(X))).alias("p"), mean6("acc", "random_acc"))
    return top.select(D, F.col(f"p.{X}").alias("picked"), r6("p.acc", "picked_acc"), "random_acc")


def adjust_and_winners(best: DataFrame, learned: list[str], penalty: float = 0.02) -> DataFrame:
    adj = best.withColumn("adj", F.round(F.col("acc") - F.when(F.col(X).isin(learned), penalty).otherwise(0.0), 6))
    r = adj.withColumn("k", F.row_number().over(Window.partitionBy(D).orderBy(F.desc("adj"), X))).where("k <= 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return r.groupBy(D).agg(at(1, X).alias("winner"), at(2, X).alias("runner_up"), r6(at(1, "adj") - at(2, "adj"), "gap"))


def synergy(best: DataFrame) -> DataFrame:
    """Mean accuracy of each pair of descriptors against the better of the two."""
    a, b = best.select(D, F.col(X).alias("a"), F.col("acc").alias("x")), best.select(D, F.col(X).alias("b"), F.col("acc").alias("y"))
    p = a.join(b, D).where("a < b").select("a", "b", micro("x").alias("x"), micro("y").alias("y"))
    gain = (F.sum(F.greatest("x", "y")) - F.greatest(F.sum("x"), F.sum("y"))) / F.count("*")
    return p.groupBy("a", "b").agg(halved_up(gain, "gain"), F.count("*").alias("n"))


def cost_report(runs: DataFrame) -> DataFrame:
    """Calls and time with subtotals, from runs(object_type, dataset, value)."""
    return runs.rollup("object_type", D).agg(F.count("*").alias("calls"), r6(F.sum("value"), "total"), r6(F.avg((F.col("value") > 50).cast("int")), "retry_rate"))


def majority_choice(votes: DataFrame) -> DataFrame:
    """Most frequent descriptor of votes(dataset, i, descriptor), first seen wins ties."""
    n = votes.groupBy(D, X).agg(F.count("*").alias("n"), F.min("i").alias("first"))
    return n.groupBy(D).agg(F.max_by(X, F.struct("n", -F.col("first"))).alias(X), F.max("n").alias("votes"))


def ph_signals(profile: DataFrame) -> DataFrame:
    """(image_id, signal) from ph_profile rows by fixed limits; several may hold."""
    h0, h1, total = F.col("h0_count"), F.col("h1_count"), F.col("h0_count") + F.col("h1_count")
    ratio = h0 / F.greatest(h1, F.lit(1))
    limits = [("h1_dominant", (h1 > h0 * 0.5) & (h1 > 3)), ("rich_topology", (total > 20) & (ratio > 1.4)), ("low_persistence", (F.col("h0_avg") < 0.1) & (F.col("h1_avg") < 0.1)), ("sparse_distinctive", (total < 12) & (F.col("h0_avg") > 0.2))]
    return profile.select("image_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in limits]))).alias("signal"))
