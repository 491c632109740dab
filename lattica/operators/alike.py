"""The rows of greatest cosine for each question, exactly, without comparing all pairs.

Cosines are rounded to 6 places, so vectors are dealt to cells of unit vectors, the smallest so narrow that any two in one have
cosine 1.000000. A question whose cell holds n rows of its scope needs only smaller ids than the n-th of them; others take the
narrowest of ever wider cells that holds n rows. Its width bounds the n-th best cosine, and that bound the cells to look into.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import save
from lattica.operators.features import cosine_similarity

#: Diagonal of the smallest cells; a chord of less than 0.001 is a cosine of more than 0.9999995.
DIAGONAL = 9e-4
CELL = ["scope", "level", "cell"]


def _levels(places: int) -> tuple[float, list[float]]:
    """Side of the smallest cells and, for each doubling up to one cell for all, how far a row may lie that can be among the best."""
    side, reach = DIAGONAL / math.sqrt(places), []
    while not reach or side * 2 ** (len(reach) - 1) <= 2:
        wide = DIAGONAL * 2 ** len(reach)
        least = math.floor((1 - wide * wide / 2) * 1e6 + 0.499) / 1e6  # rounded cosine of any two rows of a cell
        reach.append(math.sqrt(2 * (1 - least + 5e-7)) + 1e-9)
    return side, reach


def _prepared(rows: DataFrame, vec: str, side: float) -> DataFrame:
    """Adds kind (`plain`, or `zero`, `nan` and `null`, whose cosines do not depend on the direction of the other vector), the unit
    vector from 0 to 2 and its smallest cell."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm).withColumn("kind", F.when(F.col("norm").isNull(), "null").when(F.col("norm") == 0, "zero").when(F.isnan("norm") | (F.col("norm") == float("inf")), "nan").otherwise("plain"))
    rows = rows.withColumn("unit", F.when(F.col("kind") == "plain", F.transform(vec, lambda x: x / F.col("norm") + 1))).drop("norm")
    return rows.withColumn("cell", F.transform("unit", lambda x: F.floor(x / side)))


def _first(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("place") <= n)


def _wider(cell: Column, level: Column) -> Column:
    return F.transform(cell, lambda x: F.floor(x / F.pow(F.lit(2.0), level)))


def _gap(low: Column, high: Column, cell: Column, side: Column) -> Column:
    """Squared distance of a box from a cell."""
    apart = F.zip_with(F.arrays_zip(low.alias("low"), high.alias("high")), cell, lambda b, c: F.greatest(F.lit(0.0), c * side - b["high"], b["low"] - (c + 1) * side))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def candidates(asked: DataFrame, known: DataFrame, n: int, places: int) -> DataFrame:
    """(query_id, id, x, y): pairs that hold the n most alike rows of each query."""
    side, reach = _levels(places)
    top = len(reach) - 1
    # rows with equal vectors have equal cosines, so the first n are enough
    e = save(_prepared(_first(known.select("scope", "id", "y"), ["scope", "y"], n).drop("place"), "y", side), "known")
    q = save(_prepared(asked.select("query_id", "scope", "x"), "x", side), "asked")
    heads = _first(e, ["scope", "kind"], n).select("scope", "id", "y", F.col("kind").alias("other"))
    odd = q.join(heads, "scope").where("kind <> 'plain' or other <> 'plain'").select("query_id", "id", "x", "y")
    e, q = e.where("kind = 'plain'").drop("kind"), q.where("kind = 'plain'").drop("kind")

    # the narrowest cell with n rows around each cell that is asked about
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    cells = save(e.groupBy("scope", "cell").agg(F.count("*").alias("rows")).select("scope", "cell", "rows", level).withColumn("cell", _wider(F.col("cell"), F.col("level"))).groupBy(*CELL).agg(F.sum("rows").alias("rows")), "cells")
    own = q.select("scope", F.col("cell").alias("own")).distinct()
    full = cells.where(F.col("rows") >= n).select(*CELL)
    found = own.select("scope", "own", level).withColumn("cell", _wider(F.col("own"), F.col("level"))).join(full, CELL).groupBy("scope", "own").agg(F.min("level").alias("level"))
    own = own.join(found, ["scope", "own"], "left").select("scope", "own", F.coalesce("level", F.lit(top)).alias("level"))
    # where that is the smallest cell, n rows have cosine 1, and no later ids are needed
    nth = _first(e, ["scope", "cell"], n).where(F.col("place") == n).select("scope", F.col("cell").alias("own"), F.lit(0).alias("level"), F.col("id").alias("last"))
    own = own.join(nth, ["scope", "own", "level"], "left")

    # cells in reach of each cell, by blocks of 8 cells a side: reach and cell together are narrower than a block
    far = F.element_at(F.array(*map(F.lit, reach)), F.col("level") + 1)
    wide = F.pow(F.lit(2.0), F.col("level")) * side
    low, high = F.transform("own", lambda x: x * side), F.transform("own", lambda x: (x + 1) * side)
    block = own.withColumn("far", far).withColumn("wide", wide).withColumn("block", F.array().cast("array<bigint>"))
    for k in range(places):
        at = lambda x: F.floor(x / (8 * F.col("wide")))
        block = block.withColumn("one", F.explode(F.sequence(at(low[k] - F.col("far")), at(high[k] + F.col("far"))))).withColumn("block", F.concat("block", F.array("one"))).drop("one")
    blocks = cells.select(*CELL, F.transform("cell", lambda x: F.floor(x / 8)).alias("block"))
    pairs = block.join(blocks, ["scope", "level", "block"]).where(_gap(low, high, F.col("cell"), F.col("wide")) <= F.col("far") ** 2).drop("block")
    asks = q.withColumnRenamed("cell", "own").join(pairs, ["scope", "own"]).where(_gap(F.col("unit"), F.col("unit"), F.col("cell"), F.col("wide")) <= F.col("far") ** 2)
    asks = save(asks.select("query_id", "x", *CELL, "last"), "asks")

    # the rows of these cells, none of an id that no question of a cell needs
    met = asks.groupBy(*CELL).agg(F.max("last").alias("limit"), F.max(F.col("last").isNull()).alias("all"))
    used = F.broadcast(asks.select("level").distinct())  # one row for each doubling
    rows = e.select("scope", "id", "y", F.col("cell").alias("own")).crossJoin(used).withColumn("cell", _wider(F.col("own"), F.col("level"))).drop("own")
    rows = rows.join(met, CELL).where(F.col("all") | (F.col("id") <= F.col("limit"))).drop("all", "limit")
    close = asks.join(rows, CELL).where(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("query_id", "id", "x", "y")
    return close.unionByName(odd)


def most_alike(asked: DataFrame, known: DataFrame, n: int, places: int) -> DataFrame:
    """(query_id, id, similarity, rank): the n rows of greatest cosine, rounded to 6 places, then smallest id, of known(scope, id, y)
    for each row of asked(query_id, scope, x) among those of its scope. Vectors have `places` numbers."""
    got = candidates(asked, known, n, places).select("query_id", "id", F.round(cosine_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= n)
