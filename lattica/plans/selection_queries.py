"""Registered queries over selections, sweeps, fused pairs and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import mean6_sql, r6, read, std6_sql
from lattica.operators import matrix as m
from lattica.operators import selection as sel
from lattica.plans.result_queries import B, RANKED, S, best, cells, scored, selections
from lattica.sources import results_io
from lattica.sources.views import CELLS
from lattica.streaming import rankings as st

STANDARD = [50, 100, 200, 500, 1000, 2000, 5000]
KEYWORDS = {"code": ["error", "file", "system"], "talk": ["you", "what", "how"], "place": ["city", "house", "road"]}
RULES = [("mean_value", ">=", 52.0, "click"), ("n", "<", 380.0, "view"), ("users", ">=", 6.0, "error")]


def _number():
    """Number in a dataset's name. Columns need a running session, so they are made in calls, not on import."""
    return F.substring("dataset", 2, 9).cast("int")


def _dataset():
    return F.concat(F.lit("d"), (F.col("user_id") % 26).cast("string")).alias("dataset")


def _events(s, d):
    return read(s, d, "events")


def _sizes(s, d):
    return _events(s, d).groupBy(_dataset()).agg(F.count("*").alias("n_max"), F.countDistinct("event_type").alias("n_classes"))


SIZES = "sizes AS (SELECT 'd' || (user_id % 26) AS dataset, count(*) AS n_max, count(DISTINCT event_type) AS n_classes FROM events GROUP BY 1)"


def _converged(s, d):
    return _events(s, d).where("user_id % 26 % 3 <> 0").groupBy(_dataset()).agg((F.countDistinct("user_id") * 50).alias("n"))


def _split(s, d):
    x = read(s, d, "embeddings").select(F.posexplode("embedding").alias("feature", "x"), (F.col("label") < 5).cast("int").alias("target"))
    return x.select("feature", F.round(F.floor(F.col("x").cast("double") * 20) / 20, 2).alias("x"), "target")


def _features(s, d):
    return _events(s, d).groupBy(_dataset()).agg(r6(F.avg("value"), "mean_value"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def _trials(s, d):
    params = F.create_map(F.lit("sigma"), (F.col("user_id") % 3).cast("string"), F.lit("bins"), (F.col("event_id") % 4).cast("string"))
    return _events(s, d).select(_dataset(), F.col("event_type").alias("descriptor"), params.alias("params"), (F.col("value") / 100).alias("acc"))


MICRO = "CAST(round(acc * 1e6) AS BIGINT)"
TRIALS = "trials AS (SELECT 'd' || (user_id % 26) AS dataset, event_type AS descriptor, CAST(user_id % 3 AS VARCHAR) AS sigma, CAST(event_id % 4 AS VARCHAR) AS bins, value / 100 AS acc FROM events)"


def _sized(s, d):
    return _events(s, d).groupBy(F.col("event_type").alias("descriptor"), (F.col("event_id") % 8 * 32).alias("n")).agg(r6(F.avg("value") / 100, "acc"))


def _pairs(s, d):
    return sel.fused_pairs(best(s, d)).where(_number() % 3 != 0)


def _wide(s, d):
    """(dataset, primary, alternative, final) from the three methods."""
    return selections(s, d).groupBy("dataset").agg(*[F.max(F.when(F.col("method") == x, F.col("descriptor"))).alias(n) for x, n in (("m1", "primary"), ("m2", "alternative"), ("m3", "final"))])


def _looked(s, d):
    asked = _wide(s, d).select("dataset", F.col("primary").alias("first"), F.col("final").alias("second"))
    return sel.fusion_lookup(asked, _pairs(s, d), best(s, d))


WIDE = "wide AS (SELECT dataset, max(descriptor) FILTER (WHERE method = 'm1') AS p, max(descriptor) FILTER (WHERE method = 'm2') AS q, max(descriptor) FILTER (WHERE method = 'm3') AS f FROM sel GROUP BY 1)"
PAIRS = "pairs AS (SELECT dataset, x.descriptor AS a, y.descriptor AS b, round((x.acc + y.acc) / 2, 6) AS acc FROM best x JOIN best y USING (dataset) WHERE x.descriptor < y.descriptor AND CAST(substr(dataset, 2) AS INTEGER) % 3 <> 0)"
LOOKED = f"{SIZES}, {WIDE}, {PAIRS}, looked AS (SELECT w.dataset, w.p AS first, w.f AS second, coalesce(k.acc, o.acc) AS acc, k.acc IS NOT NULL AS is_pair FROM wide w LEFT JOIN pairs k ON k.dataset = w.dataset AND k.a = least(w.p, w.f) AND k.b = greatest(w.p, w.f) LEFT JOIN best o ON o.dataset = w.dataset AND o.descriptor = w.p)"


def _choices(s, d):
    t = F.concat(F.lit("t"), (_number() % 3).cast("string"))
    types = cells(s, d).select("dataset", "object_type").distinct()
    return selections(s, d).where("method = 'm3'").join(types, "dataset").select("dataset", "object_type", t.alias("perceived"), "descriptor")


TYPES = "means AS (SELECT object_type, descriptor, round(avg(acc), 6) AS mean_acc FROM best GROUP BY ALL), ranks AS (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY mean_acc DESC, descriptor) AS k FROM means), ch AS (SELECT dataset, b.object_type, 't' || (CAST(substr(dataset, 2) AS INTEGER) % 3) AS perceived, sel.descriptor FROM sel JOIN (SELECT DISTINCT dataset, object_type FROM cells) b USING (dataset) WHERE method = 'm3')"


def _by_classifier(s, d):
    w = cells(s, d).groupBy(F.col("classifier").alias("method"), "dataset").agg(F.min_by("descriptor", F.struct(-F.col("acc"), F.col("descriptor"))).alias("descriptor"))
    return m.method_metrics(m.scored(w, best(s, d)))


def _r3(long):
    """Three places: at six, means of few folds lie on the rounding edge."""
    return long.select("dataset", "descriptor", "classifier", F.round("acc", 3).alias("acc"))


def _log(s, d):
    return read(s, d, "conversations")


def _fusion_log(s, d):
    e = _events(s, d)
    return st.fusion_outcomes(e.select(F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("object_type"), F.col("event_type").alias("pair"), F.round(F.col("value") / 100 - 0.5, 6).alias("gain")))


QUERIES = {
    "r17_t_interval": (lambda s, d: sel.t_interval(scored(s, d)), S + f""", t AS (SELECT method, count(*) AS n, sum({MICRO}) AS total, sum({MICRO} * {MICRO}) AS squares FROM sd GROUP BY 1),
h AS (SELECT *, 2.0595385527532946::DOUBLE * sqrt(CAST(n * squares - total * total AS DOUBLE) / (n - 1)) AS half FROM t WHERE n = 26)
SELECT method, floor(total / n + 0.5) / 1e6 AS mean, floor((total - half) / n + 0.5) / 1e6 AS low, floor((total + half) / n + 0.5) / 1e6 AS high, n FROM h"""),
    "r17_paired_t": (lambda s, d: sel.paired_t(scored(s, d)), S + ", d AS (SELECT x.method AS a, y.method AS b, round(x.acc - y.acc, 9) AS d FROM sd x JOIN sd y ON x.dataset = y.dataset AND x.method < y.method) SELECT a, b, round(CASE WHEN stddev_samp(d) > 1e-12 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t, count(*) - 1 AS df FROM d GROUP BY ALL"),
    "r21_fusion_summary": (lambda s, d: sel.fusion_summary(_looked(s, d), _pairs(s, d), best(s, d)), S + f", {LOOKED}, o AS (SELECT dataset, max(acc) AS single FROM best GROUP BY 1), p AS (SELECT dataset, max(acc) AS pair FROM pairs GROUP BY 1) SELECT round(avg(single - acc), 6) AS single_regret, round(avg(pair - acc), 6) AS pair_regret, CAST(count(*) FILTER (WHERE acc > single + 0.001) AS BIGINT) AS beats, round(avg(is_pair::INT), 6) AS pair_share, count(*) AS n FROM looked JOIN o USING (dataset) LEFT JOIN p USING (dataset)"),
    "r22_summary_stats": (lambda s, d: sel.summary_stats(scored(s, d)), S + f"SELECT method, {mean6_sql('acc')} AS mean, round(stddev_samp(acc), 6) AS std, round(min(acc), 6) AS min, floor(median(CAST(round(acc * 1e6) AS BIGINT)) + 0.5) / 1e6 AS median, round(max(acc), 6) AS max, count(*) AS n FROM sd WHERE acc <> 0 GROUP BY 1"),
    "r30_n_grid": (lambda s, d: sel.n_grid(_sizes(s, d), STANDARD), f"WITH {SIZES} SELECT dataset, n FROM sizes, (SELECT unnest({STANDARD})::BIGINT AS n) WHERE n BETWEEN greatest(50, 10 * n_classes) AND n_max UNION SELECT dataset, n_max FROM sizes"),
    "r31_frozen_n": (lambda s, d: sel.frozen_n(_sizes(s, d), _converged(s, d)), f"WITH {SIZES}, c AS (SELECT 'd' || (user_id % 26) AS dataset, count(DISTINCT user_id) * 50 AS conv FROM events WHERE user_id % 26 % 3 <> 0 GROUP BY 1) SELECT dataset, CAST(least(CASE WHEN conv IS NULL THEN n_max ELSE greatest(conv, 200) END, n_max) AS BIGINT) AS n FROM sizes LEFT JOIN c USING (dataset)"),
    "r33_best_threshold": (lambda s, d: sel.best_threshold(_split(s, d)), """WITH x AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS feature, round(floor(CAST(unnest(embedding) AS DOUBLE) * 20) / 20, 2) AS x, (label < 5)::INT AS t FROM embeddings),
v AS (SELECT DISTINCT feature, x FROM x), c AS (SELECT feature, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 AS mid FROM v QUALIFY mid IS NOT NULL),
h AS (SELECT feature, mid, side, count(*) FILTER (WHERE (t = 1) = CASE WHEN side = '>=' THEN x >= mid ELSE x < mid END) AS hits, count(*) AS n FROM c JOIN x USING (feature), (VALUES ('>='), ('<')) q(side) GROUP BY ALL)
SELECT feature, round(mid, 6) AS threshold, side, round(hits / n, 6) AS accuracy FROM h QUALIFY row_number() OVER (PARTITION BY feature ORDER BY hits DESC, round(mid, 6), side DESC) = 1"""),
    "r35_apply_rules": (lambda s, d: sel.apply_rules(_features(s, d), RULES, "purchase"), "WITH f AS (SELECT 'd' || (user_id % 26) AS dataset, round(avg(value), 6) AS mean_value, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT *, CASE WHEN mean_value >= 52 THEN 'click' WHEN n < 380 THEN 'view' WHEN users >= 6 THEN 'error' ELSE 'purchase' END AS choice FROM f"),
    "r39_ranking_metrics": (lambda s, d: sel.ranking_metrics(sel.leave_one_out(best(s, d))), B + ", t AS (SELECT a.dataset, a.descriptor, a.acc, round(avg(b.acc), 9) AS pred FROM best a JOIN best b ON b.descriptor = a.descriptor AND b.dataset <> a.dataset GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pred DESC, descriptor) AS kp, row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, descriptor) AS kt, rank() OVER (PARTITION BY dataset ORDER BY acc) + (count(*) OVER (PARTITION BY dataset, acc) - 1) / 2 AS ra, rank() OVER (PARTITION BY dataset ORDER BY pred) + (count(*) OVER (PARTITION BY dataset, pred) - 1) / 2 AS rp FROM t) SELECT dataset, round(max(acc) - max(acc) FILTER (WHERE kp = 1), 6) AS regret, " + ", ".join(f"max(kt) FILTER (WHERE kp = 1) <= {k} AS top{k}" for k in (1, 2, 3)) + ", round(corr(ra, rp), 6) AS rho FROM r GROUP BY 1"),
    "r42_sweep_sensitivity": (lambda s, d: sel.sweep_sensitivity(_trials(s, d)), f"WITH {TRIALS}, l AS (SELECT descriptor, 'sigma' AS param, sigma AS value, acc FROM trials UNION ALL SELECT descriptor, 'bins', bins, acc FROM trials), g AS (SELECT descriptor, param, value, {mean6_sql('acc')} AS mean, {std6_sql('acc')} AS std, count(*) AS n FROM l GROUP BY ALL) SELECT descriptor, param, value, mean, std, n, round(max(mean) OVER w - min(mean) OVER w, 6) AS range FROM g WINDOW w AS (PARTITION BY descriptor, param)"),
    "r43_consensus_params": (lambda s, d: sel.consensus_params(_trials(s, d)), f"WITH {TRIALS}, t AS (SELECT dataset, descriptor, 'bins=' || bins || ',sigma=' || sigma AS config, {mean6_sql('acc')} AS acc FROM trials GROUP BY ALL), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dataset, descriptor ORDER BY acc DESC, config) = 1), n AS (SELECT descriptor, config, count(*) AS n, {mean6_sql('acc')} AS mean_acc FROM b GROUP BY ALL) SELECT descriptor, config, n, mean_acc FROM n QUALIFY row_number() OVER (PARTITION BY descriptor ORDER BY n DESC, n.mean_acc DESC, config) = 1"),
    "r44_r55_best_dimension": (lambda s, d: sel.best_dimension(_sized(s, d), 160), "WITH c AS (SELECT event_type AS descriptor, event_id % 8 * 32 AS n, round(avg(value) / 100, 6) AS acc FROM events GROUP BY ALL), k AS (SELECT *, min(n) OVER w AS lo, max(n) OVER w AS hi FROM c WHERE n <= 160 AND acc > 0 WINDOW w AS (PARTITION BY descriptor)) SELECT descriptor, n, acc, n = lo OR n = hi AS at_boundary FROM k QUALIFY row_number() OVER (PARTITION BY descriptor ORDER BY acc DESC, n) = 1"),
    "r45_color_methods": (lambda s, d: sel.color_method_ranking(_events(s, d).select(F.col("event_type").alias("method"), (F.col("value") / 100 - 0.1).alias("acc")), "view"), f"WITH g AS (SELECT event_type AS method, {mean6_sql('value / 100 - 0.1::DOUBLE')} AS mean_acc, count(*) AS n FROM events WHERE value / 100 - 0.1::DOUBLE >= 0 GROUP BY 1), b AS (SELECT mean_acc AS base FROM g WHERE method = 'view') SELECT method, mean_acc, n, round(mean_acc - base, 6) AS gain, round(mean_acc - base, 6) > 0.02 AS recommended, CAST(rank() OVER (ORDER BY mean_acc DESC) AS INTEGER) AS rank FROM g, b"),
    "r47_fusion_lookup": (_looked, S + f", {LOOKED} SELECT * FROM looked"),
    "r49_seed_aggregate": (lambda s, d: sel.seed_aggregate(_events(s, d).select(_dataset(), (F.col("event_id") % 3).alias("temperature"), (F.col("value") / 100).alias("acc"), F.col("event_type").alias("descriptor"))), "WITH r AS (SELECT 'd' || (user_id % 26) AS dataset, event_id % 3 AS temperature, value / 100 AS acc, event_type AS x FROM events), c AS (SELECT dataset, temperature, x, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT dataset, temperature, x AS mode FROM c QUALIFY row_number() OVER (PARTITION BY dataset, temperature ORDER BY n DESC, x) = 1) SELECT dataset, temperature, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS std, round(min(acc), 6) AS min, round(max(acc), 6) AS max, any_value(mode) AS mode, count(DISTINCT x) AS n_unique FROM r JOIN o USING (dataset, temperature) GROUP BY ALL"),
    "r50_decisions": (lambda s, d: sel.decision_behaviour(_wide(s, d)), S + f", {WIDE}, n AS (SELECT CASE WHEN f = p THEN 'confirmed' WHEN f = q THEN 'alternative' ELSE 'switched' END AS decision, count(*) AS n FROM wide GROUP BY 1) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM n"),
    "r52_failure_report": (lambda s, d: sel.failure_report(_choices(s, d), best(s, d)), S + f", {TYPES}, j AS (SELECT ch.*, coalesce(a.k, 99) AS kt, coalesce(b.k, 99) AS kp FROM ch LEFT JOIN ranks a ON a.object_type = ch.object_type AND a.descriptor = ch.descriptor LEFT JOIN ranks b ON b.object_type = ch.perceived AND b.descriptor = ch.descriptor) SELECT object_type, perceived, count(*) AS n, count(*) FILTER (WHERE kt <= 1) AS true_top1, count(*) FILTER (WHERE kt <= 3) AS true_top3, count(*) FILTER (WHERE kp <= 1) AS seen_top1, count(*) FILTER (WHERE kp <= 3) AS seen_top3, count(*) FILTER (WHERE kt > 3 AND object_type <> perceived) AS perception_errors, count(*) FILTER (WHERE kt > 3 AND object_type = perceived) AS reasoning_errors FROM j GROUP BY ALL"),
    "r53_ablation": (_by_classifier, f"WITH {RANKED}, w AS (SELECT classifier AS method, dataset, descriptor FROM cells QUALIFY row_number() OVER (PARTITION BY classifier, dataset ORDER BY acc DESC, descriptor) = 1), sd AS (SELECT method, acc, rank, oracle_acc - acc AS regret FROM w JOIN rk USING (dataset, descriptor) JOIN orc USING (dataset)) SELECT method, round(avg(acc), 6) AS mba, round(avg((rank <= 1)::INT), 6) AS dsa1, round(avg((rank <= 3)::INT), 6) AS dsa3, round(avg(regret), 6) AS mean_regret, round(max(regret), 6) AS max_regret, count(*) AS n FROM sd GROUP BY 1"),
    "r56_run_profile": (lambda s, d: sel.run_profile(_log(s, d)), "WITH n AS (SELECT rounds, count(*) AS n FROM (SELECT conv_id, count(*) AS rounds FROM conversations GROUP BY 1) GROUP BY 1) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM n"),
    "k5_object_type": (lambda s, d: sel.object_type_from_text(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), KEYWORDS), "WITH h AS (SELECT doc_id AS id, " + ", ".join(" + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in ws) + f" AS {k}" for k, ws in KEYWORDS.items()) + ") SELECT id, CASE WHEN greatest(code, talk, place) = 0 THEN NULL WHEN code >= talk AND code >= place THEN 'code' WHEN talk >= place THEN 'talk' ELSE 'place' END AS object_type FROM h".replace(") SELECT", " FROM documents) SELECT", 1)),
    "k6_top_descriptors": (lambda s, d: sel.top_descriptors(best(s, d), 2, ["click", "view", "error"]), B + ", t AS (SELECT object_type, descriptor, round(avg(acc), 6) AS mean_acc FROM best WHERE descriptor IN ('click', 'view', 'error') GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY object_type ORDER BY mean_acc DESC, descriptor) AS INTEGER) AS rank FROM t QUALIFY rank <= 2"),
    "k9_common_suggestions": (lambda s, d: sel.common_suggestions(_log(s, d)), "SELECT lower(trim(substr(text, 1, 100))) AS suggestion, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, suggestion LIMIT 10"),
    "k9_tool_patterns": (lambda s, d: sel.tool_patterns(_log(s, d)), "WITH t AS (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) SELECT pattern, count(*) AS n FROM (SELECT conv_id, string_agg(role, '->' ORDER BY turn) AS pattern FROM t GROUP BY 1) GROUP BY 1"),
    "k10_complementary": (lambda s, d: sel.complementary(sel.pair_correlation(best(s, d)), "click", 3), B + ", c AS (SELECT y.descriptor AS descriptor, round(corr(x.acc, y.acc), 6) AS rho FROM best x JOIN best y USING (dataset) WHERE x.descriptor = 'click' AND y.descriptor <> 'click' GROUP BY 1) SELECT * FROM c ORDER BY rho, descriptor LIMIT 3"),
    "f9_pair_kinds": (lambda s, d: sel.pair_kinds(sel.pair_correlation(best(s, d))), B + ", c AS (SELECT x.descriptor AS a, y.descriptor AS b, round(corr(x.acc, y.acc), 6) AS rho FROM best x JOIN best y ON x.dataset = y.dataset AND x.descriptor < y.descriptor GROUP BY ALL) SELECT a, b, rho, CASE WHEN rho >= 0.85 THEN 'redundant' ELSE 'complementary' END AS kind FROM c WHERE rho >= 0.85 OR rho <= 0.3"),
    "k11_resolve_choice": (lambda s, d: sel.resolve_choice(_choices(s, d), best(s, d), ["click", "view", "error"], ["view"], "click"), S + f", {TYPES} SELECT dataset, descriptor AS asked, CASE WHEN w = 'view' THEN coalesce(free, 'click') ELSE w END AS resolved FROM (SELECT ch.dataset, ch.descriptor, CASE WHEN ch.descriptor IN ('click', 'view', 'error') THEN ch.descriptor ELSE (SELECT min_by(descriptor, k) FROM ranks r WHERE r.object_type = ch.object_type) END AS w, (SELECT min_by(descriptor, k) FROM ranks r WHERE r.object_type = ch.object_type AND r.descriptor <> 'view') AS free FROM ch)"),
    "k13_execution_stats": (lambda s, d: sel.execution_stats(_log(s, d), 40), "SELECT role, count(*) AS calls, round(avg((coalesce(length(text), 0) >= 40)::INT), 6) AS success_rate, max_by(coalesce(length(text), 0), conv_id * 100000 + turn) AS last_length FROM conversations GROUP BY 1"),
    "t2_fusion_outcomes": (_fusion_log, "WITH g AS (SELECT 't' || (user_id % 5) AS object_type, event_type AS pair, round(value / 100 - 0.5::DOUBLE, 6) AS gain FROM events) SELECT object_type, count(*) AS n, round(avg(gain), 6) AS mean_gain, count(*) FILTER (WHERE gain > 0.001) AS helped, arg_max(pair, (gain, pair)) AS best_pair, arg_min(pair, (gain, pair)) AS worst_pair FROM g GROUP BY 1"),
    "s7_read_results": (lambda s, d: _r3(results_io.json_round_trip(cells(s, d))), f"WITH {CELLS} SELECT dataset, descriptor, classifier, round(acc, 3) AS acc FROM cells"),
    "s7_merge_results": (lambda s, d: _r3(results_io.merge_results(cells(s, d).where(_number() % 2 == 0).withColumn("acc", F.col("acc") + 1), cells(s, d), ["dataset", "descriptor", "classifier"])), f"WITH {CELLS} SELECT dataset, descriptor, classifier, round(CASE WHEN CAST(substr(dataset, 2) AS INTEGER) % 2 = 0 THEN acc + 1 ELSE acc END, 3) AS acc FROM cells"),
    "s8_s9_master_csv": (lambda s, d: _r3(results_io.csv_round_trip(m.master_matrix(cells(s, d), [f"c{k}" for k in range(6)]), [f"c{k}" for k in range(6)])), f"WITH {CELLS} SELECT dataset, descriptor, classifier, round(acc, 3) AS acc FROM cells"),
    "s12_extension_overrides": (lambda s, d: sel.extension_overrides(_events(s, d).select(_dataset(), (F.col("event_id") % 7 == 0).alias("is_extension"), F.col("event_id").alias("n"), r6("value", "acc"))), "SELECT 'd' || (user_id % 26) AS dataset, event_id % 7 = 0 AS is_extension, event_id AS n, round(value, 6) AS acc FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 26 ORDER BY (event_id % 7 = 0)::INT DESC, event_id DESC) = 1"),
}
