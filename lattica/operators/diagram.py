"""Statistics and vectors of persistence diagrams, diagram(image_id, hdim, birth, death)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over, small

I = "image_id"
KEY = [I, "hdim"]


def pers() -> Column:
    return F.col("death") - F.col("birth")


def spine(diagram: DataFrame, images: DataFrame, dims: int = 2) -> DataFrame:
    """Every image with every dimension, so that empty diagrams get rows."""
    return images.select(I).distinct().join(small(diagram.sparkSession, dims, "hdim"))


def _zeros(diagram: DataFrame, images: DataFrame, got: DataFrame) -> DataFrame:
    out = spine(diagram, images).join(got, KEY, "left")
    return out.select(*KEY, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in got.columns if c not in KEY])


def diagram_stats(diagram: DataFrame, images: DataFrame) -> DataFrame:
    got = diagram.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(pers()).alias("total"), F.max(pers()).alias("max"), F.avg(pers()).alias("mean"), F.stddev_pop(pers()).alias("std"))
    return _zeros(diagram, images, got)


def topological_features(diagram: DataFrame, images: DataFrame) -> DataFrame:
    d = diagram.withColumn("p", pers())
    d = d.withColumn("share", F.col("p") / F.nullif(F.sum("p").over(over(*KEY)), F.lit(0.0)))
    q = lambda x: F.expr(f"percentile(p, {x})")
    entropy = -F.sum(F.col("share") * F.log(F.col("share") + 1e-10))
    reach = F.max("birth") - F.min("birth")
    got = d.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum("p").alias("total"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.max("p").alias("max"), F.min("p").alias("min"),
        q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), (q(0.75) - q(0.25)).alias("iqr"), q(0.9).alias("p90"), F.sqrt(F.sum(F.col("p") ** 2)).alias("l2"),
        (F.max("p") - F.min("p")).alias("range"), entropy.alias("entropy"), F.when(F.count("*") > 1, entropy / F.nullif(F.log(F.count("*")), F.lit(0.0))).otherwise(0.0).alias("entropy_norm"),
        F.when(F.count("*") == 1, 1.0).otherwise(F.max("p") / F.nullif(reach, F.lit(0.0))).alias("amplitude"), F.avg("birth").alias("birth_mean"), F.avg("death").alias("death_mean"), F.avg((F.col("birth") + F.col("death")) / 2).alias("mid_mean"),
    )
    return _zeros(diagram, images, got)


BASIC = ["count", "mean", "std", "median", "min", "max", "iqr", "q25", "q75", "sum", "skewness", "kurtosis", "range", "entropy"]


def persistence_statistics(diagram: DataFrame, images: DataFrame, subset: str = "full", bins: int = 20) -> DataFrame:
    """Statistics of each diagram: `basic` of the persistences; `extended` adds births, deaths and correlations; `full` adds
    sums, weighted means and the normalised entropy. The entropy is that of a density histogram of `bins` bins; a skewness
    takes 3 bars and a kurtosis 4, else they are 0. An empty diagram has zeros."""
    d = diagram.withColumn("p", pers())
    w = over(*KEY)
    low, high = F.min("p").over(w), F.max("p").over(w)
    wide = d.withColumn("width", F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0 / bins)))
    place = F.when(high > low, F.least(F.floor((F.col("p") - low) / F.nullif("width", F.lit(0.0))), F.lit(bins - 1))).otherwise(bins // 2)
    h = wide.withColumn("bin", place).groupBy(*KEY, "bin", "width").agg(F.count("*").alias("k"))
    h = h.withColumn("h", F.col("k") / (F.sum("k").over(w) * F.col("width")))
    entropy = h.groupBy(*KEY).agg(F.sum("k").alias("all"), (-F.sum(F.col("h") * F.log(F.col("h") + 1e-10))).alias("e"))
    entropy = entropy.select(*KEY, F.when(F.col("all") > 1, F.col("e")).otherwise(0.0).alias("entropy"))

    p, n, sd = F.col("p"), F.count("*").cast("double"), F.stddev_pop("p")
    q = lambda x: F.percentile("p", x)
    share = lambda total, part: F.when(total > 1e-10, part / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    mid = (F.col("birth") + F.col("death")) / 2

    def corr(a: str, b: str) -> Column:
        spread = (F.stddev_pop(a) >= 1e-10) & (F.stddev_pop(b) >= 1e-10)
        return F.when((n > 1) & spread, F.corr(a, b)).otherwise(0.0)

    values = {
        "count": n, "mean": F.avg(p), "std": sd, "median": q(0.5), "min": F.min(p), "max": F.max(p), "iqr": q(0.75) - q(0.25), "q25": q(0.25), "q75": q(0.75), "sum": F.sum(p),
        "skewness": F.when((n > 2) & (sd >= 1e-10), F.skewness(p) * n * n / F.nullif((n - 1) * (n - 2), F.lit(0.0))).otherwise(0.0),
        "kurtosis": F.when((n > 3) & (sd >= 1e-10), F.kurtosis(p)).otherwise(0.0), "range": F.max(p) - F.min(p),
    }
    if subset in ("extended", "full"):
        values |= {f"{x}_{name}": f(x) for x in ("birth", "death") for name, f in (("mean", F.avg), ("std", F.stddev_pop))}
        values |= {"birth_death_corr": corr("birth", "death"), "birth_p_corr": corr("birth", "p"), "death_p_corr": corr("death", "p")}
    if subset == "full":
        values |= {
            "midlife_mean": F.avg(mid), "midlife_std": F.stddev_pop(mid), "amplitude": F.max("death") - F.min("birth"),
            "weighted_birth": share(F.sum(p), F.sum(F.col("birth") * p)), "weighted_death": share(F.sum(p), F.sum(F.col("death") * p)),
            "sum_squares": F.sum(p * p), "sum_cubes": F.sum(p * p * p), "sum_logs": F.sum(F.log(p + 1e-10)),
        }
    elif subset not in ("basic", "extended"):
        raise ValueError(f"subset {subset}: basic, extended or full")
    got = d.groupBy(*KEY).agg(*[v.alias(k) for k, v in values.items()]).join(entropy, KEY)
    return _zeros(diagram, images, got)


def total_persistence_stats(diagram: DataFrame, images: DataFrame, power: float = 3.0) -> DataFrame:
    n = F.count("*").cast("double")
    skew = F.when((n > 2) & (F.stddev_pop(pers()) > 1e-12), F.skewness(pers()) * n * n / F.nullif((n - 1) * (n - 2), F.lit(0.0))).otherwise(0.0)
    kurt = F.when((n > 3) & (F.stddev_pop(pers()) > 1e-12), F.kurtosis(pers())).otherwise(0.0)
    got = diagram.groupBy(*KEY).agg(F.sum(pers()).alias("l1"), F.sqrt(F.sum(pers()**2)).alias("l2"), F.pow(F.sum(pers()**power), F.lit(1 / power)).alias("lp"), F.max(pers()).alias("linf"), skew.alias("skew"), kurt.alias("kurtosis"))
    return _zeros(diagram, images, got)


def carlsson_coordinates(diagram: DataFrame, images: DataFrame) -> DataFrame:
    got = diagram.groupBy(*KEY).agg(F.sum(pers()).alias("f1"), F.sum(pers()**2).alias("f2"), F.max(pers()).alias("f3"), F.sum(F.col("birth") * pers()).alias("f4"))
    return _zeros(diagram, images, got)


def tropical_coordinates(diagram: DataFrame, images: DataFrame, k: int = 5) -> DataFrame:
    """(image_id, hdim, rank, birth, death, pers, mid): the k longest bars, -1 where there are fewer, 0 where none."""
    top = diagram.withColumn("p", pers()).withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("p"), "birth"))).where(F.col("rank") <= k)
    places = spine(diagram, images).join(small(diagram.sparkSession, k, "z")).withColumn("rank", F.col("z") + 1)
    any_ = diagram.select(*KEY).distinct().withColumn("any", F.lit(True))
    out = places.join(top, [*KEY, "rank"], "left").join(any_, KEY, "left")
    fill = lambda c: F.coalesce(c, F.when(F.col("any"), -1.0).otherwise(0.0))
    return out.select(*KEY, "rank", fill(F.col("birth")).alias("birth"), fill(F.col("death")).alias("death"), fill(F.col("p")).alias("pers"), fill((F.col("birth") + F.col("death")) / 2).alias("mid"))


def _places(diagram: DataFrame, images: DataFrame, n: int, margin: float = 0.01) -> DataFrame:
    """(image_id, ts): n even places over an image's births and deaths, widened by `margin` of the range."""
    b = diagram.groupBy(I).agg(F.min("birth").alias("lo"), F.max("death").alias("hi"))
    b = images.select(I).distinct().join(b, I, "left").select(I, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * margin
    lo, hi = F.col("lo") - pad, F.col("hi") + pad
    return b.select(I, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: lo + k * (hi - lo) / (n - 1)).alias("ts"))


def thresholds(diagram: DataFrame, images: DataFrame, n: int, margin: float = 0.01) -> DataFrame:
    """(image_id, k, t) of these places."""
    return _places(diagram, images, n, margin).select(I, F.posexplode("ts").alias("k", "t"))


def _alive(diagram: DataFrame, images: DataFrame, n: int, closed: bool) -> DataFrame:
    """Bars at the thresholds that they span: the steps are even, so a bar names its first and last step (no range join). Bars meet
    the places of their image as an array, so one shuffle by image serves all."""
    step = _places(diagram, images, n).withColumn("t0", F.array_min("ts")).withColumn("step", (F.array_max("ts") - F.array_min("ts")) / (n - 1))
    d = diagram.join(step, I).withColumn("a", F.greatest(F.floor((F.col("birth") - F.col("t0")) / F.nullif("step", F.lit(0.0))) - 1, F.lit(0))).withColumn("z", F.least(F.ceil((F.col("death") - F.col("t0")) / F.nullif("step", F.lit(0.0))) + 1, F.lit(n - 1)))
    on = d.where("a <= z").withColumn("k", F.explode(F.sequence(F.col("a").cast("int"), F.col("z").cast("int")))).withColumn("t", F.get("ts", F.col("k"))).drop("ts")
    return on.where((F.col("birth") <= F.col("t")) & ((F.col("t") <= F.col("death")) if closed else (F.col("t") < F.col("death"))))


def betti_curves(diagram: DataFrame, images: DataFrame, n: int = 20) -> DataFrame:
    """Bars alive at each threshold. A bar of no weight for each image and dimension gives all thresholds a row, so that counts need no
    join with them."""
    none = spine(diagram, images).select(*KEY, F.lit(None).cast("double").alias("birth"), F.lit(None).cast("double").alias("death"), F.lit(0).alias("one"))
    both = diagram.select(*KEY, "birth", "death", F.lit(1).alias("one")).unionByName(none)
    at = both.join(_places(diagram, images, n), I).select(*KEY, "birth", "death", "one", F.posexplode("ts").alias("k", "t"))
    alive = (F.col("one") == 0) | ((F.col("birth") <= F.col("t")) & (F.col("t") < F.col("death")))
    return at.where(alive).groupBy(*KEY, "k").agg(F.sum("one").alias("betti"))


def persistence_entropy(diagram: DataFrame, images: DataFrame, n: int = 20) -> DataFrame:
    """Entropy of the bars alive at each threshold."""
    d = _alive(diagram, images, n, True).withColumn("p", pers()).withColumn("share", pers() / F.sum(pers()).over(over(*KEY, "k")))
    got = d.groupBy(*KEY, "k").agg((F.lit(0.0) - F.sum(F.col("share") * F.log("share"))).alias("entropy"))
    at = spine(diagram, images).join(thresholds(diagram, images, n), I)
    return at.join(got, [*KEY, "k"], "left").select(*KEY, "k", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def _tent() -> Column:
    return F.least(F.col("t") - F.col("birth"), F.col("death") - F.col("t"))


def persistence_landscapes(diagram: DataFrame, images: DataFrame, layers: int = 3, n: int = 20) -> DataFrame:
    """(image_id, hdim, layer, k, value): the layer-th greatest tent at each threshold."""
    d = _alive(diagram, images, n, True).withColumn("value", _tent()).where("value > 0")
    top = d.withColumn("layer", F.row_number().over(Window.partitionBy(*KEY, "k").orderBy(F.desc("value")))).where(F.col("layer") <= layers)
    at = spine(diagram, images).join(thresholds(diagram, images, n), I).join(small(diagram.sparkSession, layers, "z")).withColumn("layer", F.col("z") + 1)
    return at.join(top.select(*KEY, "k", "layer", "value"), [*KEY, "k", "layer"], "left").select(*KEY, "layer", "k", F.coalesce("value", F.lit(0.0)).alias("value"))


def persistence_silhouette(diagram: DataFrame, images: DataFrame, power: float = 1.0, n: int = 20) -> DataFrame:
    weight = diagram.groupBy(*KEY).agg(F.sum(pers()**power).alias("whole"))
    got = _alive(diagram, images, n, True).groupBy(*KEY, "k").agg(F.sum(F.greatest(_tent(), F.lit(0.0)) * pers()**power).alias("s"))
    at = spine(diagram, images).join(thresholds(diagram, images, n), I)
    out = at.join(got, [*KEY, "k"], "left").join(weight, KEY, "left")
    return out.select(*KEY, "k", F.coalesce(F.col("s") / F.nullif("whole", F.lit(0.0)), F.lit(0.0)).alias("value"))


def _surface(diagram: DataFrame, res: int, weight: str | Callable[[Column], Column], kind: str | Callable[[Column, Column, Column], Column], sigma: float | None, margin: float) -> DataFrame:
    """Weights are named or functions of a bar's length, templates named or functions of the distances to a node in both
    directions and of the lattice's step."""
    d = diagram.withColumn("p", pers())
    b = d.groupBy(*KEY).agg(F.min("birth").alias("b0"), F.max("birth").alias("b1"), F.max("p").alias("p1"))
    pad = F.greatest((F.col("b1") - F.col("b0")) * margin, F.lit(1e-6))
    b = b.select(*KEY, (F.col("b0") - pad).alias("b0"), (F.col("b1") + pad).alias("b1"), (F.col("p1") * (1 + margin)).alias("p1"))
    s = diagram.sparkSession
    d = d.join(b, KEY).join(small(s, res, "i")).join(small(s, res, "j"))
    x, y = F.col("b0") + F.col("i") * (F.col("b1") - F.col("b0")) / (res - 1), F.col("j") * F.col("p1") / (res - 1)
    w = weight(F.col("p")) if callable(weight) else {"linear": F.col("p"), "squared": F.col("p") ** 2, "const": F.lit(1.0)}[weight]
    gap = F.greatest((F.col("b1") - F.col("b0")) / (res - 1), F.col("p1") / (res - 1))
    if callable(kind):
        value = kind(F.abs(F.col("birth") - x), F.abs(F.col("p") - y), gap)
    elif kind == "tent":
        value = F.greatest(F.lit(0.0), 1 - F.greatest(F.abs(F.col("birth") - x), F.abs(F.col("p") - y)) / gap)
    else:
        s2 = F.lit(2 * sigma * sigma) if sigma else 2 * (gap / 2) ** 2
        value = F.exp(-((F.col("birth") - x) ** 2 + (F.col("p") - y) ** 2) / s2)
    return d.groupBy(*KEY, "i", "j").agg(F.sum(w * value).alias("value"))


def persistence_image(diagram: DataFrame, res: int = 5, sigma: float = 0.1, weight: str | Callable[[Column], Column] = "linear") -> DataFrame:
    """(image_id, hdim, i, j, value): a Gaussian surface on (birth, persistence), divided by its maximum."""
    got = _surface(diagram, res, weight, "gaussian", sigma, 0.1)
    top = F.max("value").over(over(*KEY))
    return got.withColumn("value", F.when(top > 0, F.col("value") / F.nullif(top, F.lit(0.0))).otherwise(0.0))


def template_functions(diagram: DataFrame, n: int = 25, kind: str | Callable[[Column, Column, Column], Column] = "tent") -> DataFrame:
    side = math.ceil(math.sqrt(n))
    got = _surface(diagram, side, "const", kind, None, 0.1).withColumn("k", F.col("j") * side + F.col("i"))
    return got.where(F.col("k") < n).select(*KEY, "k", "value")


def betti_ratios(diagram: DataFrame, images: DataFrame, threshold: float = 0.1, t: float = 0.5) -> DataFrame:
    count = lambda h, cond=F.lit(True): F.sum(F.when((F.col("hdim") == h) & cond, 1).otherwise(0))
    long_, alive = F.abs(pers()) >= threshold, (F.col("birth") <= t) & (F.col("death") > t)
    got = diagram.groupBy(I).agg(*[count(h, c).alias(f"b{h}{n}") for h in (0, 1) for n, c in (("", F.lit(True)), ("_long", long_), ("_alive", alive))])
    out = images.select(I).distinct().join(got, I, "left").na.fill(0)
    ratio = F.col("b1") / F.greatest("b0", F.lit(1))
    return out.withColumn("ratio", ratio).withColumn("chi", F.col("b0") - F.col("b1")).withColumn("chi_long", F.col("b0_long") - F.col("b1_long"))


def significant(diagram: DataFrame) -> DataFrame:
    """Number of bars longer than median + std, and the five longest."""
    d = diagram.withColumn("p", pers())
    cut = d.groupBy(*KEY).agg((F.expr("percentile(p, 0.5)") + F.stddev_pop("p")).alias("cut"))
    return d.join(cut, KEY).groupBy(*KEY).agg(F.sum((F.col("p") > F.col("cut")).cast("int")).alias("n_significant"), F.slice(F.sort_array(F.collect_list("p"), False), 1, 5).alias("top"))


def diagonal_distance(diagram: DataFrame, images: DataFrame, power: float = 2.0) -> DataFrame:
    got = diagram.groupBy(*KEY).agg(F.pow(F.sum(F.pow(pers() / math.sqrt(2), F.lit(power))), F.lit(1 / power)).alias("wasserstein"), (F.max(pers()) / 2).alias("bottleneck"))
    return _zeros(diagram, images, got)


def sliced_distance(pairs: DataFrame, diagram: DataFrame, directions: int = 8) -> DataFrame:
    """Sliced Wasserstein distance for pairs(a, b) of images: both sets of points, each with the other's projections to the
    diagonal, are projected, sorted and compared by rank."""
    d = diagram.select(F.col(I).alias("of"), "hdim", "birth", "death")
    mid = (F.col("birth") + F.col("death")) / 2
    rows = None
    for own, other in (("a", "b"), ("b", "a")):
        x = pairs.join(d, pairs[own] == d["of"]).select("a", "b", "hdim", F.col("birth").alias("x"), F.col("death").alias("y"), F.lit(own).alias("side"))
        y = pairs.join(d, pairs[other] == d["of"]).select("a", "b", "hdim", mid.alias("x"), mid.alias("y"), F.lit(own).alias("side"))
        rows = x.unionByName(y) if rows is None else rows.unionByName(x).unionByName(y)
    angle = F.col("q") * math.pi / directions - math.pi / 2
    p = rows.join(small(diagram.sparkSession, directions, "q")).withColumn("p", F.cos(angle) * F.col("x") + F.sin(angle) * F.col("y"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("a", "b", "hdim", "q", "side").orderBy("p")))
    at = p.groupBy("a", "b", "hdim", "q", "k").agg((F.max(F.when(F.col("side") == "a", F.col("p"))) - F.max(F.when(F.col("side") == "b", F.col("p")))).alias("gap"))
    return at.groupBy("a", "b", "hdim").agg((F.sum(F.abs("gap")) / directions).alias("distance"))


def ph_profile(diagram: DataFrame, images: DataFrame) -> DataFrame:
    """One row an image: count, maximum and mean persistence of H0 and H1."""
    of = lambda f, h: f(F.when(F.col("hdim") == h, pers()))
    got = diagram.groupBy(I).agg(*[of(f, h).alias(f"h{h}_{n}") for h in (0, 1) for n, f in (("count", F.count), ("max", F.max), ("avg", F.avg))])
    return images.select(I).distinct().join(got, I, "left").na.fill(0)


def atol_transform(diagram: DataFrame, centers: DataFrame) -> DataFrame:
    """(image_id, hdim, k, value) with centers(hdim, k, cx, cy, sigma), a model table of fixed size."""
    d = diagram.withColumn("p", pers()).join(F.broadcast(centers), "hdim")
    gap = (F.col("birth") - F.col("cx")) ** 2 + (F.col("p") - F.col("cy")) ** 2
    return d.groupBy(*KEY, "k").agg(F.sum(F.col("p") * F.exp(-gap / (2 * F.col("sigma") ** 2))).alias("value"))


def codebook_transform(diagram: DataFrame, centers: DataFrame) -> DataFrame:
    """Share of a diagram's points nearest to each of centers(k, cx, cy)."""
    near = None
    best = F.min(F.struct(((F.col("birth") - F.col("cx")) ** 2 + (F.col("p") - F.col("cy")) ** 2).alias("gap"), "k"))["k"]
    d = diagram.withColumn("p", pers()).withColumn("point", F.monotonically_increasing_id())
    near = d.join(F.broadcast(centers.drop("hdim"))).groupBy(*KEY, "point").agg(best.alias("k"))
    return near.groupBy(*KEY, "k").agg(F.count("*").alias("n")).withColumn("value", F.col("n") / F.sum("n").over(over(*KEY)))


def atol_fit(diagram: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """Centers by k-means on (birth, persistence) of each dimension; sigma is the spread of all coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = diagram.select("hdim", F.col("birth"), pers().alias("p"))
    rows = []
    for (h,) in d.select("hdim").distinct().orderBy("hdim").collect():  # two or three dimensions
        part = d.where(F.col("hdim") == h).withColumn("features", array_to_vector(F.array("birth", "p")))
        spread = part.select(F.explode(F.array("birth", "p")).alias("x")).agg(F.stddev_pop("x")).first()[0] or 1.0
        rows += [(h, i, float(c[0]), float(c[1]), float(spread)) for i, c in enumerate(KMeans(k=k, seed=seed).fit(part).clusterCenters())]
    return diagram.sparkSession.createDataFrame(rows, "hdim int, k int, cx double, cy double, sigma double")


def codebook_fit(diagram: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """centers(k, cx, cy) by one k-means on (birth, persistence) of all dimensions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = diagram.select(array_to_vector(F.array("birth", pers())).alias("features"))
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(KMeans(k=k, seed=seed).fit(points).clusterCenters())]
    return diagram.sparkSession.createDataFrame(rows, "k int, cx double, cy double")


def persistence_image_qc(diagram: DataFrame, image: DataFrame, images: DataFrame, least: float = 0.01) -> DataFrame:
    """Share of places of a persistence image(image_id, .., value) that are not 0, with a flag below `least`, whether the
    diagram is empty, and its longest and mean bar (null where empty)."""
    filled = image.groupBy(I).agg(F.avg((F.col("value") != 0).cast("int")).alias("nonzero_ratio"))
    scale = diagram.groupBy(I).agg(F.max(pers()).alias("dominant_scale"), F.avg(pers()).alias("mean_persistence"))
    got = images.select(I).distinct().join(filled, I, "left").join(scale, I, "left").na.fill(0.0, ["nonzero_ratio"])
    return got.withColumn("low_persistence", F.col("nonzero_ratio") < least).withColumn("empty", F.col("dominant_scale").isNull())


#: Places of a dimension in the older layout; the rest are 0.
PILOT_LENGTH = 25


def pilot_statistics(diagram: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, vec): the older layout of 15 statistics for each of H0 and H1, each padded to 25 places."""
    d = diagram.withColumn("p", pers())
    d = d.withColumn("share", F.col("p") / (F.sum("p").over(over(*KEY)) + 1e-10))
    q = lambda x: F.expr(f"percentile(p, {x})")
    spread = lambda c: [F.avg(c), F.stddev_pop(c)]
    lifetimes = [*spread("p"), q(0.5), q(0.25), q(0.75), F.max("p") - F.min("p"), F.min("p"), F.max("p"), F.count("*"), F.sum("p")]
    entropy = -F.sum(F.col("share") * F.log(F.col("share") + 1e-10))
    values = [*lifetimes, *spread("birth"), *spread("death"), entropy]
    got = d.groupBy(*KEY).agg(F.array(*[v.cast("double") for v in values]).alias("vec"))
    pad = F.array_repeat(F.lit(0.0), PILOT_LENGTH)
    each = spine(diagram, images).join(got, KEY, "left").select(*KEY, F.slice(F.concat(F.coalesce("vec", pad), pad), 1, PILOT_LENGTH).alias("vec"))
    both = each.groupBy(I).agg(F.array_sort(F.collect_list(F.struct("hdim", "vec"))).alias("parts"))
    return both.select(I, F.flatten(F.col("parts.vec")).alias("vec"))


def cubical_summary(diagram: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells and shape of each image, bars of H0 and H1, and Betti numbers of the whole complex: the bars that never die
    (death null)."""
    size = grid.groupBy(I).agg(F.count("*").alias("n_cells"), (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    of = lambda h, cond: F.count_if((F.col("hdim") == h) & cond)
    bars = diagram.groupBy(I).agg(*[of(h, c).alias(f"{n}{h}") for h in (0, 1) for n, c in (("h", F.lit(True)), ("b", F.col("death").isNull()))])
    return size.join(bars, I, "left").na.fill(0)


def threshold_components(diagram: DataFrame, grid: DataFrame, n: int = 20) -> DataFrame:
    """(image_id, k, t, components): components of the pixels up to n even thresholds, counted as bars of H0 alive there.
    A bar makes at most n rows, counted before they are shuffled."""
    span = grid.groupBy(I).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = span.join(small(grid.sparkSession, n, "k")).select(I, "k", (F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (n - 1)).alias("t"))
    alive = (F.col("birth") <= F.col("t")) & (F.col("death").isNull() | (F.col("death") > F.col("t")))
    return at.join(diagram.where("hdim = 0"), I, "left").groupBy(I, "k", "t").agg(F.count_if(F.coalesce(alive, F.lit(False))).alias("components"))
