"""Ordered rule lists learned by sequential covering, for many training sets in one plan.

Inputs are long: features(g, dataset, feature, x) and winners(g, dataset, winner), where g names the training set (a held-out
dataset, or one constant). For each target in turn a rule is sought among the datasets that no earlier rule of its g
captures: the best split of one feature at a midpoint of neighbouring values, either side; where that is not perfect and
there are two targets or more, the best conjunction of splits of two features, if it is strictly better. A rule stays if
more than half of the datasets are told rightly. Ties go to the first feature by name, the lower threshold, ">=" before "<".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import r6, save

SIDES = (">=", "<")
RULE = "g string, rule int, target string, conditions array<struct<feature: string, side: string, threshold: double>>, accuracy double"


def splits(rows: DataFrame) -> DataFrame:
    """(g, feature, side, threshold, order) of all candidate splits of rows(g, feature, x)."""
    up = Window.partitionBy("g", "feature").orderBy("x")
    mid = rows.select("g", "feature", "x").distinct().withColumn("threshold", (F.col("x") + F.lead("x").over(up)) / 2).where("threshold is not null")
    each = mid.select("g", "feature", "threshold", F.explode(F.array(*map(F.lit, SIDES))).alias("side"))
    return each.withColumn("order", F.struct("feature", "threshold", F.col("side") == "<"))


def holds(x: str, side: str, threshold: str) -> Column:
    return F.when(F.col(side) == ">=", F.col(x) >= F.col(threshold)).otherwise(F.col(x) < F.col(threshold))


def best_rule(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """(g, conditions, accuracy) of the best split or conjunction for labelled(g, dataset, is_target)."""
    rows = save(features.join(labelled, ["g", "dataset"]), "rows")
    size = save(labelled.groupBy("g").agg(F.count("*").alias("n"), F.sum("is_target").alias("targets")).where("targets > 0"), "sizes")
    condition = F.struct("feature", "side", "threshold")
    cand = splits(rows).join(size, "g")
    # rows that a split takes in: right ones, and all; each split meets the values of its own feature only
    taken = rows.join(cand, ["g", "feature"]).where(holds("x", "side", "threshold"))
    taken = save(taken.select("g", "dataset", "is_target", "order", condition.alias("c"), "n", "targets"), "taken")
    hits = F.sum("is_target") + F.first("n") - F.first("targets") - (F.count("*") - F.sum("is_target"))
    one = taken.groupBy("g", "order").agg(hits.alias("hits"), F.sum("is_target").alias("right"), F.first("c").alias("c"), F.first("n").alias("n"), F.first("targets").alias("targets"))
    one = save(one, "one")
    first = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("hits"), "order"))
    single = one.withColumn("k", first).where("k = 1").select("g", "hits", F.array("c").alias("conditions"), "n", "targets")
    # a conjunction has at most the right rows of each part: only parts that could still beat the best single split meet
    able = one.join(single.select("g", F.col("hits").alias("best")), "g").where("targets >= 2 and best < n and right + n - targets > best").select("g", "order")
    part = taken.join(able, ["g", "order"])
    a = part.select("g", "dataset", "is_target", "n", "targets", F.col("order").alias("o1"), F.col("c").alias("c1"))
    b = part.select("g", "dataset", F.col("order").alias("o2"), F.col("c").alias("c2"))
    pair = a.join(b, ["g", "dataset"]).where("c1.feature < c2.feature").groupBy("g", "o1", "o2").agg(hits.alias("hits"), F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.first("n").alias("n"))
    two = pair.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("hits"), "o1", "o2"))).where("k = 1").select("g", F.col("hits").alias("hits2"), F.array("c1", "c2").alias("conditions2"))
    both = single.join(two, "g", "left")
    better = F.coalesce(F.col("hits2") > F.col("hits"), F.lit(False))
    out = both.select("g", F.when(better, F.col("conditions2")).otherwise(F.col("conditions")).alias("conditions"), F.when(better, F.col("hits2")).otherwise(F.col("hits")).alias("hits"), "n")
    return out.where("2 * hits > n").select("g", "conditions", (F.col("hits") / F.col("n")).alias("accuracy"))


def captured(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(g, dataset, rule): the rules whose conditions all hold."""
    each = rules.select("g", "rule", F.size("conditions").alias("many"), F.explode("conditions").alias("c")).select("g", "rule", "many", "c.*")
    met = features.join(each, ["g", "feature"]).where(holds("x", "side", "threshold"))
    return met.groupBy("g", "dataset", "rule", "many").count().where("count = many").select("g", "dataset", "rule")


def fit_rules(features: DataFrame, winners: DataFrame, targets: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """(g, rule, target, conditions, accuracy): at most one rule for each target, in the order of `targets`. `domains` names
    the features that a target's rule may use (the hybrid mode); without it all are tried (the data-driven mode)."""
    features = save(features, "features")
    left = save(winners.select("g", "dataset", "winner"), "winners")
    rules = features.sparkSession.createDataFrame([], RULE)
    for k, target in enumerate(targets, 1):
        own = features.where(F.col("feature").isin(domains[target])) if domains else features
        free = save(left.join(captured(features, rules), ["g", "dataset"], "left_anti"), "free") if k > 1 else left
        found = best_rule(own, free.select("g", "dataset", (F.col("winner") == target).cast("int").alias("is_target")))
        rules = save(rules.unionByName(found.select("g", F.lit(k).alias("rule"), F.lit(target).alias("target"), "conditions", "accuracy")), "rules")
    return rules


def choose(features: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(g, dataset, choice): the target of the first rule that holds, else the default."""
    first = captured(features, rules).join(rules.select("g", "rule", "target"), ["g", "rule"]).groupBy("g", "dataset").agg(F.min_by("target", "rule").alias("target"))
    return features.select("g", "dataset").distinct().join(first, ["g", "dataset"], "left").select("g", "dataset", F.coalesce("target", F.lit(default)).alias("choice"))


def held_out(rows: DataFrame) -> DataFrame:
    """rows(dataset, ...) once for each held-out dataset g, without its own rows."""
    every = rows.select(F.col("dataset").alias("g")).distinct()
    return every.join(rows, F.col("g") != F.col("dataset"))


def lodo_rules(features: DataFrame, scores: DataFrame, targets: list[str], default: str, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """(dataset, choice, winner, choice_acc, winner_acc, regret, hit): rules learned without a dataset choose for it. A chosen
    descriptor that scores(dataset, descriptor, acc) does not have counts as the dataset's mean."""
    first = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("acc"), "descriptor"))
    best = scores.withColumn("k", first).where("k = 1").select("dataset", F.col("descriptor").alias("winner"), F.col("acc").alias("winner_acc"))
    rules = fit_rules(held_out(features), held_out(best.select("dataset", "winner")), targets, domains)
    choice = choose(features.withColumn("g", F.col("dataset")), rules, default).select("dataset", "choice")
    own = scores.select("dataset", F.col("descriptor").alias("choice"), F.col("acc").alias("own"))
    mean = scores.groupBy("dataset").agg((F.floor(F.sum(F.round(F.col("acc") * 1e6).cast("long")) / F.count("*") + 0.5) / 1e6).alias("mean"))
    out = choice.join(best, "dataset").join(mean, "dataset").join(own, ["dataset", "choice"], "left").withColumn("choice_acc", F.coalesce("own", "mean"))
    return out.select("dataset", "choice", "winner", "choice_acc", "winner_acc", r6(F.col("winner_acc") - F.col("choice_acc"), "regret"), (F.col("choice") == F.col("winner")).alias("hit"))


def described(rules: DataFrame) -> DataFrame:
    """Rules as text."""
    text = F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", c["feature"], c["side"], F.format_number(c["threshold"], 6))), " and ")
    return rules.select("g", "rule", "target", text.alias("text"), r6("accuracy", "accuracy"))
