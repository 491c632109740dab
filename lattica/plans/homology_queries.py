"""Registered queries that run the solver, on images with and without ties and on graphs, and their SQL: bars alive at a
threshold are components and holes of the pixels up to it, which SQL counts without a solver."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import r6
from lattica.operators import diagram, persistence
from lattica.plans.diagram_queries import BARS, bars
from lattica.sources import views
from lattica.sources.views import GRIDS, HEATMAPS

I = "image_id"


def alive_sql(view: str, name: str, n: int, value: str = "v") -> str:
    """(image_id, k, b0, b1) by components of {v <= t} with 8 neighbours, and its Euler number from cells. Only pixels without an
    earlier neighbour start a walk."""
    return f"""WITH RECURSIVE {view}, ks AS (SELECT CAST(unnest(range({n})) AS INTEGER) AS k),
low AS MATERIALIZED (SELECT image_id, k, r, c, r * 1000 + c AS id FROM {name}, ks WHERE {value} <= k / {n - 1}.0::DOUBLE),
seed AS (SELECT * FROM low a WHERE NOT EXISTS (SELECT 1 FROM low b WHERE b.image_id = a.image_id AND b.k = a.k AND ((b.r = a.r AND b.c = a.c - 1) OR (b.r = a.r - 1 AND abs(b.c - a.c) <= 1)))),
reach AS (SELECT image_id, k, r, c, id AS start FROM seed UNION SELECT p.image_id, p.k, p.r, p.c, q.start FROM reach q JOIN low p ON p.image_id = q.image_id AND p.k = q.k AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1),
comp AS (SELECT image_id, k, count(DISTINCT label) AS b0 FROM (SELECT image_id, k, r, c, min(start) AS label FROM reach GROUP BY ALL) GROUP BY ALL),
cell AS (SELECT DISTINCT image_id, k, r * 2 + a AS y, c * 2 + b AS x, 1 - 2 * ((a + b) % 2) AS sign FROM low, (VALUES (0), (1), (2)) p(a), (VALUES (0), (1), (2)) q(b)),
chi AS (SELECT image_id, k, sum(sign) AS chi FROM cell GROUP BY ALL)
SELECT i.image_id, k, CAST(coalesce(b0, 0) AS BIGINT) AS b0, CAST(coalesce(b0 - chi, 0) AS BIGINT) AS b1 FROM (SELECT DISTINCT image_id FROM {name}) i CROSS JOIN ks LEFT JOIN comp USING (image_id, k) LEFT JOIN chi USING (image_id, k)"""


def _series(s, d):
    nodes, edges = views.series(s, d)
    found = persistence.persistence_h0_graph(nodes, edges).select(F.col("g").alias(I), F.lit(0).alias("hdim"), "birth", "death")
    return persistence.alive(found, 9).select(I, "k", "b0")


def _caps(s, d):
    """Of each policy the number of bars that never died and are left, and the greatest death among all that are left."""
    g = views.heatmaps(s, d).withColumn("v", 1 - F.col("v"))
    found = persistence.persistence(g).where("hdim = 0")
    finite = found.where("death is not null").groupBy(I).agg(F.count("*").alias("finite"))
    out = None
    for policy in ("image_max", "drop"):
        left = persistence.cap_infinite(found, g, policy).groupBy(I).agg(F.count("*").alias("n"), F.max("death").alias("top"))
        one = finite.join(left, I).select(I, F.lit(policy).alias("policy"), (F.col("n") - F.col("finite")).alias("endless"), r6(F.when(F.lit(policy == "image_max"), F.col("top")), "top"))
        out = one if out is None else out.unionByName(one)
    return out


STATS = f"""WITH {BARS} SELECT image_id, hdim, count(*) AS n, round(sum(p), 6) AS total, round(max(p), 6) AS max, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std FROM bars GROUP BY ALL"""


def _stats(s, d):
    got = diagram.diagram_stats(bars(s, d), views.image_labels(s, d))
    return got.select(I, "hdim", "n", *[r6(c, c) for c in ("total", "max", "mean", "std")])


def _valid(s, d):
    """Pairs of the series in whole numbers, some turned round or far out, before and after the filter."""
    b = bars(s, d).select(I, "hdim", "birth", F.when(F.col(I) % 3 == 0, F.col("birth")).when(F.col(I) % 3 == 1, F.col("death") * 1e7).otherwise(F.col("death")).alias("death"))
    return persistence.valid_pairs(b).groupBy(I).agg(F.count("*").alias("n"))


QUERIES = {
    "h1_alive_grids": (lambda s, d: persistence.alive(persistence.persistence(views.grids(s, d)), 9), alive_sql(GRIDS, "grids", 9)),
    "h3_alive_superlevel": (lambda s, d: persistence.alive(persistence.persistence(views.grids(s, d), "superlevel"), 9), alive_sql(GRIDS, "grids", 9, "1 - v")),
    "h1_alive_heatmaps": (lambda s, d: persistence.alive(persistence.persistence(views.heatmaps(s, d)), 9), alive_sql(HEATMAPS, "heatmaps", 9)),
    "h3_alive_heatmaps": (lambda s, d: persistence.alive(persistence.persistence(views.heatmaps(s, d), "superlevel"), 9), alive_sql(HEATMAPS, "heatmaps", 9, "1 - v")),
    "h4_cap_infinite": (_caps, f"WITH {HEATMAPS}, m AS (SELECT image_id, round(max(1 - v), 6) AS top FROM heatmaps GROUP BY 1) SELECT image_id, 'image_max' AS policy, 1 AS endless, top FROM m UNION ALL SELECT image_id, 'drop', 0, NULL FROM m"),
    "h5_valid_pairs": (_valid, f"WITH {BARS} SELECT image_id, count(*) FILTER (WHERE death > birth AND abs(birth) < 1e6) AS n FROM bars WHERE image_id % 3 = 2 GROUP BY 1"),
    "h7_series_alive": (_series, f"WITH {HEATMAPS}, l AS (SELECT image_id, v, lag(v) OVER (PARTITION BY image_id ORDER BY r, c) AS before FROM heatmaps) SELECT image_id, CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE v <= k / 8.0::DOUBLE AND (before IS NULL OR before > k / 8.0::DOUBLE)) AS b0 FROM l, (SELECT unnest(range(9)) AS k) GROUP BY ALL"),
    "h8_diagram_stats": (_stats, STATS),
}
