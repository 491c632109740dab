"""Deterministic rules: parameters, classifier, colour mode and retries, as joins and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def params_for(asked: DataFrame, rules: DataFrame, tuned: DataFrame) -> DataFrame:
    """Adds dim and params to asked(descriptor, object_type, per_channel). rules(descriptor, object_type, dim, params)
    gives them by type; its row of null type is the default of unknown types. Entries of tuned (same columns) win one by
    one. With per_channel the dimension triples; a descriptor without any rule has null."""
    own = lambda df, p: df.select("descriptor", "object_type", F.col("dim").alias(f"dim_{p}"), F.col("params").alias(f"params_{p}"))
    keys = ["descriptor", "object_type"]
    default = own(rules.where("object_type is null"), "d").drop("object_type")
    joined = asked.join(own(rules.where("object_type is not null"), "r"), keys, "left").join(default, "descriptor", "left").join(own(tuned, "t"), keys, "left")
    base, best = F.coalesce("params_r", "params_d"), F.coalesce("params_t", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(best, k)), best)
    dim = F.coalesce("dim_t", "dim_r", "dim_d") * F.when(F.col("per_channel"), 3).otherwise(1)
    return joined.select(*asked.columns, dim.alias("dim"), F.when(base.isNotNull(), merged).otherwise(F.col("params_t")).alias("params"))


def classifier_rule(descriptor: Column, dim: Column, always: dict[str, list[str]], threshold: int, wide: str, default: str) -> Column:
    """The classifier that always takes the descriptor, else `wide` above the threshold, else the default."""
    by_size = F.when(dim > threshold, wide).otherwise(default)
    return F.coalesce(*[F.when(descriptor.isin(*names), k) for k, names in always.items()], by_size)


def color_mode_rule(name: Column, channels: Column, path: Column, known: dict[str, str]) -> Column:
    """Mode of a known dataset in either case; else by the number of channels (3: per_channel, 1: grayscale); else of the
    first known name in the path; else grayscale."""
    named = [F.when(F.lower(name) == k.lower(), v) for k, v in known.items()]
    by_channels = F.when(channels == 3, "per_channel").when(channels == 1, "grayscale")
    in_path = [F.when(F.lower(path).contains(k.lower()), v) for k, v in known.items()]
    return F.coalesce(*named, by_channels, *in_path, F.lit("grayscale"))


def reflect_gate(asked: Column, count: Column, time_left: Column, most: int = 2) -> Column:
    """`retry` if asked for, below `most` retries and with time left; else `complete`."""
    return F.when(asked & (count < most) & (time_left > 0), "retry").otherwise("complete")
