"""Named descriptors: functions of (image_id, r, c, v) that give vectors as (image_id, pos, x)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.tables import save
from lattica.operators import diagram as d
from lattica.operators import grid as g
from lattica.operators import persistence as ph
from lattica.operators import pixels, spatial
from lattica.operators.evaluation import by_channel

_known: dict[str, tuple[Callable[..., DataFrame], str, dict[str, Any]]] = {}


def register(name: str, run: Callable[..., DataFrame], about: str = "", **defaults: Any) -> None:
    """Adds or replaces a descriptor run(grid, **params) and the parameters that it takes, with their defaults."""
    _known[name] = (run, about, defaults)


def names() -> list[str]:
    return sorted(_known)


def describe(name: str) -> dict[str, Any]:
    run, about, defaults = _known[name]
    return {"name": name, "about": about or (run.__doc__ or ""), "params": dict(defaults)}


def extract(name: str, grid: DataFrame, channel_mode: str = "gray", **params: Any) -> DataFrame:
    """(image_id, descriptor, pos, x) of one descriptor. `per_channel` takes grids with a channel R, G or B, works on each and
    puts their places after one another. Unknown names and parameters are errors."""
    if name not in _known:
        raise KeyError(f"unknown descriptor {name}; known: {', '.join(names())}")
    run, _, defaults = _known[name]
    if extra := set(params) - set(defaults):
        raise TypeError(f"{name} takes no {', '.join(sorted(extra))}")
    given = {**defaults, **params}
    if channel_mode == "per_channel":
        got = save(by_channel(grid, lambda g: run(g, **given).select("image_id", "pos", "x")), "channels")  # read for the span and the rows
        span = F.broadcast(got.agg((F.max("pos") + 1).alias("span")))  # one row
        place = F.array_position(F.array(*map(F.lit, "RGB")), F.col("channel")) - 1
        out = got.crossJoin(span).select("image_id", (place * F.col("span") + F.col("pos")).alias("pos"), "x")
    elif channel_mode == "gray":
        out = run(grid, **given)
    else:
        raise ValueError(f"unknown channel mode {channel_mode}")
    return out.select("image_id", F.lit(name).alias("descriptor"), F.col("pos").cast("int").alias("pos"), F.col("x").cast("double").alias("x"))


def extract_all(grid: DataFrame, wanted: dict[str, dict[str, Any]]) -> DataFrame:
    """The vectors of several descriptors, one below the other."""
    return reduce(DataFrame.unionByName, [extract(k, grid, **v) for k, v in wanted.items()])


def _glcm(grid: DataFrame, levels: int) -> DataFrame:
    both = F.posexplode(F.array("contrast", "homogeneity")).alias("pos", "x")
    return g.glcm(grid, levels).select("image_id", both)


register("euler_curve", lambda grid, n: g.euler_curve(grid, n).select("image_id", F.col("k").alias("pos"), F.col("chi").alias("x")), "Euler numbers at even thresholds", n=32)
register("lbp", lambda grid, uniform: g.lbp_histogram(grid, uniform).select("image_id", F.col("bin").alias("pos"), F.col("density").alias("x")), "shares of local binary patterns", uniform=True)
register("glcm", _glcm, "contrast and homogeneity of neighbours", levels=8)


def _bars(grid: DataFrame) -> DataFrame:
    """Real diagrams, with endless bars ended at the image's greatest value."""
    return ph.valid_pairs(ph.cap_infinite(ph.persistence(grid), grid))


def _places(df: DataFrame, place, value: str) -> DataFrame:
    return df.select("image_id", place.alias("pos"), F.col(value).alias("x"))


def _columns(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The other columns, in their order, as places; those of the second dimension after those of the first."""
    rest = [c for c in df.columns if c not in keys]
    at = F.posexplode(F.array(*[F.col(c).cast("double") for c in rest])).alias("p", "x")
    long = df.select(*keys, at)
    return long.select("image_id", (F.col("hdim") * len(rest) + F.col("p") if "hdim" in keys else F.col("p")).alias("pos"), "x")


def _curve(f: Callable[..., DataFrame], value: str) -> Callable[..., DataFrame]:
    return lambda grid, n: _places(f(_bars(grid), grid, n=n), F.col("hdim") * n + F.col("k"), value)


def _minkowski(grid: DataFrame, n: int) -> DataFrame:
    m = g.minkowski(grid, [k / (n - 1) for k in range(n)])
    at = F.posexplode(F.array("volume", "surface", F.col("chi").cast("double"))).alias("p", "x")
    return m.select("image_id", "t", at).select("image_id", (F.col("p") * n + F.round(F.col("t") * (n - 1))).cast("int").alias("pos"), "x")


register("persistence_statistics", lambda grid, subset: _columns(d.persistence_statistics(_bars(grid), grid, subset), ("image_id", "hdim")), "statistics of bars", subset="full")
register("persistence_image", lambda grid, res, sigma, weight: _places(d.persistence_image(_bars(grid), res, sigma, weight), (F.col("hdim") * res + F.col("j")) * res + F.col("i"), "value"), "weighted surface of bars", res=20, sigma=0.1, weight="linear")
register("persistence_landscapes", lambda grid, layers, n: _places(d.persistence_landscapes(_bars(grid), grid, layers, n), (F.col("hdim") * layers + F.col("layer") - 1) * n + F.col("k"), "value"), "greatest tents at even places", layers=4, n=100)
register("betti_curves", _curve(d.betti_curves, "betti"), "bars alive at even places", n=100)
register("persistence_entropy", _curve(d.persistence_entropy, "entropy"), "entropy of the bars alive at even places", n=100)
register("persistence_silhouette", lambda grid, power, n: _places(d.persistence_silhouette(_bars(grid), grid, power, n), F.col("hdim") * n + F.col("k"), "value"), "weighted mean tent at even places", power=1.0, n=100)
register("carlsson_coordinates", lambda grid: _columns(d.carlsson_coordinates(_bars(grid), grid), ("image_id", "hdim")), "polynomials of births and deaths")
register("template_functions", lambda grid, n, kind: _places(d.template_functions(_bars(grid), n, kind), F.col("hdim") * n + F.col("k"), "value"), "sums of tents over a lattice", n=25, kind="tent")
register("minkowski", _minkowski, "area, perimeter and Euler number at even thresholds", n=10)
register("euler_transform", lambda grid, directions, heights: _places(g.euler_transform(pixels.binarize(grid), directions, heights), F.col("d") * heights + F.col("k"), "chi"), "Euler numbers by direction and height", directions=32, heights=20)
register("edge_histogram", lambda grid, bins, cells: _places(g.edge_histogram(grid, bins, cells), F.col("cell") * bins + F.col("bin"), "density"), "orientations of strong edges by cell", bins=8, cells=2)
register("lbp_scales", lambda grid, scales: _places(spatial.lbp_multi_scale(grid, scales), F.expr("scale * (scale + 1) * 4 + 2 * scale") + F.col("bin"), "density"), "uniform patterns on circles of growing radius", scales=2)
register("topological_features", lambda grid: _columns(d.topological_features(_bars(grid), grid), ("image_id", "hdim")), "basic statistics of bars")
