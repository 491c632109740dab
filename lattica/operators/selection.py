"""Analytics of selections, parameter sweeps and logs: thresholds, rules, fusion, seeds, failures, lookups."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import halved_up, mean6, micro, over, r6, std6
from lattica.operators import alike
from lattica.operators.matrix import D, X, average_rank, rank_by_type


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t with whole degrees of freedom, by bisection on the finite sums of its distribution."""
    if df < 1:
        return math.nan

    def below(t: float) -> float:
        angle = math.atan(t / math.sqrt(df))
        sine, cosine = math.sin(angle), math.cos(angle)
        term = total = cosine if df % 2 else 1.0
        for k in range(3 if df % 2 else 2, df - 1, 2):
            term *= cosine * cosine * (k - 1) / k
            total += term
        middle = 2 / math.pi * (angle + (sine * total if df > 1 else 0.0)) if df % 2 else sine * total
        return 0.5 + middle / 2

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def t_interval(got: DataFrame, ci: float = 0.95) -> DataFrame:
    """Mean and its t interval for each method; one row has no interval. The quantile follows from the number of rows."""

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        return df.map({k: t_quantile(1 - (1 - ci) / 2, int(k)) for k in df.unique()})

    x, n = micro("acc"), F.col("n")
    g = got.groupBy("method").agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
    half = F.when(n > 1, quantile(n - 1) * F.sqrt((n * F.col("squares") - F.col("total") * F.col("total")).cast("double") / (n - 1)))
    at = lambda c, name: halved_up(c / n, name)  # noqa: E731 (all from sums of whole millionths)
    return g.select("method", at(F.col("total"), "mean"), at(F.col("total") - half, "low"), at(F.col("total") + half, "high"), "n")


def paired_t(got: DataFrame) -> DataFrame:
    """Paired t statistic of each pair of methods on their common datasets; null without spread."""
    a, b = got.select(D, F.col("method").alias("a"), F.col("acc").alias("x")), got.select(D, F.col("method").alias("b"), F.col("acc").alias("y"))
    d = a.join(b, D).where("a < b").withColumn("d", F.round(F.col("x") - F.col("y"), 9)).groupBy("a", "b").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("*").alias("n"))
    return d.select("a", "b", r6(F.when(F.col("s") > 1e-12, F.col("m") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))), "t"), (F.col("n") - 1).alias("df"))


def summary_stats(got: DataFrame) -> DataFrame:
    """Spread of each method's accuracies; zeros are failures and left out."""
    return got.where("acc <> 0").groupBy("method").agg(mean6("acc", "mean"), r6(F.stddev_samp("acc"), "std"), r6(F.min("acc"), "min"), halved_up(F.percentile(micro("acc"), 0.5), "median"), r6(F.max("acc"), "max"), F.count("*").alias("n"))


def n_grid(sizes: DataFrame, standard: list[int]) -> DataFrame:
    """(dataset, n): standard sizes from max(50, 10 a class) to n_max, and n_max, of sizes(dataset, n_max, n_classes)."""
    low = F.greatest(F.lit(50), 10 * F.col("n_classes"))
    at = F.filter(F.array(*[F.lit(x).cast("long") for x in standard]), lambda x: (x >= low) & (x <= F.col("n_max")))
    return sizes.select(D, F.explode(F.array_union(at, F.array("n_max"))).alias("n"))


def frozen_n(sizes: DataFrame, converged: DataFrame, least: int = 200) -> DataFrame:
    """Sample size of each dataset: the converged one, at least `least`; n_max where none; never above n_max."""
    got = sizes.join(converged.select(D, F.col("n").alias("conv")), D, "left")
    return got.select(D, F.least(F.when(F.col("conv").isNotNull(), F.greatest("conv", F.lit(least))).otherwise(F.col("n_max")), "n_max").alias("n"))


def best_threshold(long: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, threshold, side, accuracy) of the best one-feature split of long(feature, x, target 0 or 1): midpoints of
    neighbouring values, either side. Rows are counted for each distinct value first, so running sums replace a join of
    values with thresholds; callers round x so that a feature has few distinct values."""
    v = long.groupBy("feature", "x").agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    up, whole = Window.partitionBy("feature").orderBy("x"), over("feature")
    v = v.withColumn("mid", (F.col("x") + F.lead("x").over(up)) / 2).withColumn("p_below", F.sum("p").over(up)).withColumn("n_below", F.sum("n").over(up)).withColumn("p_all", F.sum("p").over(whole)).withColumn("n_all", F.sum("n").over(whole))
    right = F.col("p_all") - F.col("p_below") + F.col("n_below") - F.col("p_below")  # target above, others below
    side = F.explode(F.array(F.struct(F.lit(">=").alias("side"), right.alias("hits")), F.struct(F.lit("<").alias("side"), (F.col("n_all") - right).alias("hits"))))
    c = v.where("mid is not null").select("feature", "mid", "n_all", side.alias("s")).select("feature", r6("mid", "threshold"), "s.side", "s.hits", "n_all")
    first = Window.partitionBy("feature").orderBy(F.desc("hits"), "threshold", F.desc("side"))
    best = c.withColumn("k", F.row_number().over(first)).where("k = 1").select("feature", "threshold", "side", r6(F.col("hits") / F.col("n_all"), "accuracy"))
    return best.orderBy(F.desc("accuracy"), "feature").limit(top) if top else best


def apply_rules(features: DataFrame, rules: list[tuple[str, str, float, str]], default: str) -> DataFrame:
    """Adds the choice of the first rule (feature, side, threshold, choice) that holds, else the default."""
    choice = F.lit(default)
    for name, side, at, pick in reversed(rules):
        choice = F.when(F.col(name) >= at if side == ">=" else F.col(name) < at, pick).otherwise(choice)
    return features.withColumn("choice", choice)


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """Of scores(dataset, descriptor, acc, pred): regret and true rank of the best predicted one, rank correlation."""
    pick = Window.partitionBy(D).orderBy(F.desc("pred"), X)
    true = Window.partitionBy(D).orderBy(F.desc("acc"), X)
    r = scores.withColumn("kp", F.row_number().over(pick)).withColumn("kt", F.row_number().over(true))
    r = average_rank(average_rank(r, "acc", "ra", D), "pred", "rp", D)
    own = lambda c: F.max(F.when(F.col("kp") == 1, F.col(c)))
    return r.groupBy(D).agg(r6(F.max("acc") - own("acc"), "regret"), *[(own("kt") <= k).alias(f"top{k}") for k in (1, 2, 3)], r6(F.corr("ra", "rp"), "rho"))


def sweep_sensitivity(trials: DataFrame) -> DataFrame:
    """Mean, spread and count for each value of each parameter, and the range of means, of trials(descriptor, params
    MAP<STRING, STRING>, acc)."""
    long = trials.select(X, F.explode("params").alias("param", "value"), "acc")
    g = long.groupBy(X, "param", "value").agg(mean6("acc", "mean"), std6("acc", "std"), F.count("*").alias("n"))
    w = over(X, "param")
    return g.select(X, "param", "value", "mean", "std", "n", r6(F.max("mean").over(w) - F.min("mean").over(w), "range"))


def config_key(params: Column) -> Column:
    """Parameters as text in name order, so that equal maps have equal keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def consensus_params(trials: DataFrame) -> DataFrame:
    """Most frequent best configuration of each descriptor over datasets; ties go to the greater mean accuracy."""
    t = trials.select(D, X, config_key(F.col("params")).alias("config"), "acc").groupBy(D, X, "config").agg(mean6("acc", "acc"))
    best = t.withColumn("k", F.row_number().over(Window.partitionBy(D, X).orderBy(F.desc("acc"), "config"))).where("k = 1")
    n = best.groupBy(X, "config").agg(F.count("*").alias("n"), mean6("acc", "mean_acc"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy(X).orderBy(F.desc("n"), F.desc("mean_acc"), "config"))).where("k = 1").drop("k")


def best_dimension(curve: DataFrame, most: int) -> DataFrame:
    """Best size of curve(descriptor, n, acc) for each descriptor, and whether it lies on the edge of the sizes tried, so
    that the range must be extended. Sizes above `most` and failures (acc <= 0) do not count."""
    ok = curve.where((F.col("n") <= most) & (F.col("acc") > 0))
    g = ok.groupBy(X).agg(F.max_by("n", F.struct("acc", -F.col("n"))).alias("n"), r6(F.max("acc"), "acc"), F.min("n").alias("low"), F.max("n").alias("high"))
    return g.select(X, "n", "acc", ((F.col("n") == F.col("low")) | (F.col("n") == F.col("high"))).alias("at_boundary"))


def color_method_ranking(runs: DataFrame, base: str, least: float = 0.02) -> DataFrame:
    """Mean of runs(method, acc) without failures (negative), rank, and whether a method beats the base by `least`."""
    g = runs.where("acc >= 0").groupBy("method").agg(mean6("acc", "mean_acc"), F.count("*").alias("n"))
    one = g.where(F.col("method") == base).select(F.col("mean_acc").alias("base"))  # one row
    gain = F.round(F.col("mean_acc") - F.col("base"), 6)
    return g.join(F.broadcast(one)).select("method", "mean_acc", "n", gain.alias("gain"), (gain > least).alias("recommended"), F.rank().over(Window.orderBy(F.desc("mean_acc"))).alias("rank"))


def fusion_lookup(asked: DataFrame, fused: DataFrame, best: DataFrame) -> DataFrame:
    """Accuracy of asked(dataset, first, second): that of the pair in fused(dataset, a, b, acc) in either order, else that
    of the first alone."""
    key = F.array_sort(F.array("first", "second"))
    q = asked.withColumn("a", key[0]).withColumn("b", key[1])
    got = q.join(fused.select(D, "a", "b", F.col("acc").alias("pair_acc")), [D, "a", "b"], "left").join(best.select(D, F.col(X).alias("first"), F.col("acc").alias("own_acc")), [D, "first"], "left")
    return got.select(D, "first", "second", F.coalesce("pair_acc", "own_acc").alias("acc"), F.col("pair_acc").isNotNull().alias("is_pair"))


def fusion_summary(looked: DataFrame, fused: DataFrame, best: DataFrame) -> DataFrame:
    """Regret of fused choices against the best single descriptor and the best pair; choices that beat the best single."""
    single, pair = best.groupBy(D).agg(F.max("acc").alias("single")), fused.groupBy(D).agg(F.max("acc").alias("pair"))
    j = looked.join(single, D).join(pair, D, "left")
    return j.agg(r6(F.avg(F.col("single") - F.col("acc")), "single_regret"), r6(F.avg(F.col("pair") - F.col("acc")), "pair_regret"), F.sum((F.col("acc") > F.col("single") + 0.001).cast("int")).alias("beats"), r6(F.avg(F.col("is_pair").cast("int")), "pair_share"), F.count("*").alias("n"))


def seed_aggregate(runs: DataFrame) -> DataFrame:
    """Of runs(dataset, temperature, acc, descriptor): spread over seeds, most frequent choice (ties: the first name)."""
    keys = [D, "temperature"]
    c = runs.groupBy(*keys, X).agg(F.count("*").alias("n"), F.sum("acc").alias("s"), F.sum(F.col("acc") ** 2).alias("q"), F.min("acc").alias("lo"), F.max("acc").alias("hi"))
    n = F.sum("n")
    spread = F.sqrt(F.greatest((F.sum("q") - F.sum("s") ** 2 / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    return c.groupBy(*keys).agg(r6(F.sum("s") / n, "mean"), r6(spread, "std"), r6(F.min("lo"), "min"), r6(F.max("hi"), "max"), F.min_by(X, F.struct(-F.col("n"), F.col(X))).alias("mode"), F.count("*").alias("n_unique"))


def decision_behaviour(rows: DataFrame) -> DataFrame:
    """Of rows(primary, alternative, final): counts and shares of confirmed, alternative and switched decisions."""
    kind = F.when(F.col("final") == F.col("primary"), "confirmed").when(F.col("final") == F.col("alternative"), "alternative").otherwise("switched")
    n = rows.groupBy(kind.alias("decision")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(over()), 6))  # three rows


def failure_report(choices: DataFrame, best: DataFrame) -> DataFrame:
    """By (object_type, perceived): choices in the top 1 and 3 of the true and the perceived type's ranking; misses of the
    true top 3 are perception errors where the types differ, else reasoning errors."""
    r = rank_by_type(best).select("object_type", X, "rank")
    j = choices.join(r.withColumnRenamed("rank", "kt"), ["object_type", X], "left").join(r.select(F.col("object_type").alias("perceived"), X, F.col("rank").alias("kp")), ["perceived", X], "left")
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    count = lambda c, n: F.sum(c.cast("int")).alias(n)
    miss, same = ~within("kt", 3), F.col("object_type") == F.col("perceived")
    return j.groupBy("object_type", "perceived").agg(F.count("*").alias("n"), count(within("kt", 1), "true_top1"), count(within("kt", 3), "true_top3"), count(within("kp", 1), "seen_top1"), count(within("kp", 3), "seen_top3"), count(miss & ~same, "perception_errors"), count(miss & same, "reasoning_errors"))


def run_profile(log: DataFrame) -> DataFrame:
    """Distribution of rounds over the runs of log(conv_id, turn)."""
    n = log.groupBy("conv_id").agg(F.count("*").alias("rounds")).groupBy("rounds").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(over()), 6))  # one row for each number of rounds


def tool_patterns(log: DataFrame, first: int = 5) -> DataFrame:
    """Runs for each sequence of their first tools; only those entries are gathered."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    top = log.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "role"))), lambda x: x["role"]), "->")
    return top.groupBy("conv_id").agg(path.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def common_suggestions(log: DataFrame, n: int = 10, chars: int = 100) -> DataFrame:
    key = F.lower(F.trim(F.substring("text", 1, chars)))
    return log.where("text is not null").groupBy(key.alias("suggestion")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suggestion").limit(n)


def execution_stats(log: DataFrame, least: int = 1) -> DataFrame:
    """Calls, share of successes (an output of `least` characters or more) and last output of each tool."""
    size = F.coalesce(F.length("text"), F.lit(0))
    return log.groupBy("role").agg(F.count("*").alias("calls"), r6(F.avg((size >= least).cast("int")), "success_rate"), F.max_by(size, F.struct("conv_id", "turn")).alias("last_length"))


def object_type_from_text(texts: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(id, object_type) with most keywords in the text, null without any; the first type wins ties. The counts are
    columns, so no row is multiplied."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array(*[F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(keywords.items())])
    return texts.select("id", F.array_max(hits).alias("best")).select("id", F.when(F.col("best.n") > 0, F.col("best.name")).alias("object_type"))


def top_descriptors(best: DataFrame, n: int, supported: list[str] | None = None) -> DataFrame:
    r = rank_by_type(best.where(F.col(X).isin(supported)) if supported else best)
    return r.where(F.col("rank") <= n).select("object_type", X, "mean_acc", "rank")


def pair_correlation(best: DataFrame) -> DataFrame:
    """(a, b, rho, n) for descriptors a < b over their common datasets."""
    a, b = best.select(D, F.col(X).alias("a"), F.col("acc").alias("x")), best.select(D, F.col(X).alias("b"), F.col("acc").alias("y"))
    return a.join(b, D).where("a < b").groupBy("a", "b").agg(r6(F.corr("x", "y"), "rho"), F.count("*").alias("n"))


def pair_kinds(rho: DataFrame, high: float = 0.85, low: float = 0.3) -> DataFrame:
    kind = F.when(F.col("rho") >= high, "redundant").when(F.col("rho") <= low, "complementary")
    return rho.select("a", "b", "rho", kind.alias("kind")).where("kind is not null")


def complementary(rho: DataFrame, primary: str, n: int) -> DataFrame:
    both = rho.select("a", "b", "rho").unionByName(rho.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    return both.where(F.col("a") == primary).orderBy("rho", "b").limit(n).select(F.col("b").alias(X), "rho")


def resolve_choice(choices: DataFrame, best: DataFrame, supported: list[str], blocked: list[str], backup: str) -> DataFrame:
    """Supported, unblocked choices stay; unsupported ones become the type's best; blocked ones the first unblocked of the
    type's ranking, else the backup."""
    r = rank_by_type(best)
    top = r.groupBy("object_type").agg(F.min_by(X, "rank").alias("top"))
    free = r.where(~F.col(X).isin(blocked)).groupBy("object_type").agg(F.min_by(X, "rank").alias("free"))
    j = choices.join(top, "object_type", "left").join(free, "object_type", "left")
    j = j.withColumn("wanted", F.when(F.col(X).isin(supported), F.col(X)).otherwise(F.coalesce("top", F.lit(backup))))
    return j.select(D, F.col(X).alias("asked"), F.when(F.col("wanted").isin(blocked), F.coalesce("free", F.lit(backup))).otherwise(F.col("wanted")).alias("resolved"))


def extension_overrides(runs: DataFrame) -> DataFrame:
    """One row of runs(dataset, is_extension, n, acc) for each dataset: extensions first, then the greater n."""
    w = Window.partitionBy(D).orderBy(F.desc("is_extension"), F.desc("n"))
    return runs.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def leave_one_out(best: DataFrame) -> DataFrame:
    """(dataset, descriptor, acc, pred): pred is the descriptor's mean over all other datasets."""
    w = over(X)
    rest = (F.sum("acc").over(w) - F.col("acc")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return best.select(D, X, "acc", F.round(rest, 9).alias("pred")).where("pred is not null")


def fused_pairs(best: DataFrame) -> DataFrame:
    """(dataset, a, b, acc): mean accuracy of both, a stand-in where no fused run exists."""
    a, b = best.select(D, F.col(X).alias("a"), F.col("acc").alias("x")), best.select(D, F.col(X).alias("b"), F.col("acc").alias("y"))
    return a.join(b, D).where("a < b").select(D, "a", "b", r6((F.col("x") + F.col("y")) / 2, "acc"))




def similar_experiences(asked: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, id, rank, similarity): the n experiences most alike each row of asked(query_id, object_type, h0, h1, a0,
    a1, ratio) by the cosine of [ln(1 + h0), ln(1 + h1), 100 a0, 100 a1, ratio]; an unknown ratio is 1. Only those of the same
    object type count, or all of known(id, object_type, ...) where a type has none."""
    vec = F.array(F.log1p("h0"), F.log1p("h1"), 100.0 * F.col("a0"), 100.0 * F.col("a1"), F.coalesce("ratio", F.lit(1.0)))
    q, e = asked.select("query_id", F.col("object_type").alias("own"), vec.alias("x")), known.select("id", "object_type", vec.alias("y"))
    types = known.select("object_type").distinct().withColumn("found", F.lit(True))
    q = q.join(types, q["own"] == types["object_type"], "left")
    scope = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    q = q.select("query_id", "x", F.when(F.col("found"), scope("own")).otherwise("all").alias("scope"))
    # each row belongs to its type and to all rows, as far as a query asks for them
    e = e.select("id", "y", F.explode(F.array(scope("object_type"), F.lit("all"))).alias("scope")).join(q.select("scope").distinct(), "scope", "left_semi")
    return alike.most_alike(q, e, n, 5)
