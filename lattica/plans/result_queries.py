"""Registered queries over result cells, selections, predictions and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.tables import mean6, mean6_sql, r6, read, std6, std6_sql
from lattica.operators import matrix as m
from lattica.operators import scoring as sc
from lattica.sources import views
from lattica.sources.views import CELLS, PREDICTIONS
from lattica.streaming import rankings as st

BEST = f"{CELLS}, best AS (SELECT dataset, object_type, descriptor, classifier, acc FROM cells QUALIFY row_number() OVER (PARTITION BY dataset, descriptor ORDER BY acc DESC, classifier) = 1)"
RANKED = f"{BEST}, rk AS (SELECT dataset, descriptor, acc, CAST(row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, descriptor) AS INTEGER) AS rank FROM best), orc AS (SELECT dataset, descriptor AS oracle, acc AS oracle_acc FROM rk WHERE rank = 1)"
SELECTIONS = f"""{RANKED}, sel AS (SELECT 'm1' AS method, dataset, descriptor FROM cells WHERE classifier = 'c0' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, descriptor) = 1
 UNION ALL SELECT DISTINCT 'm2', dataset, 'view' FROM cells UNION ALL SELECT 'm3', dataset, descriptor FROM best QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('7:' || dataset || ':' || descriptor)) = 1),
sd AS (SELECT method, dataset, descriptor, acc, rank, oracle, oracle_acc, oracle_acc - acc AS regret FROM sel JOIN rk USING (dataset, descriptor) JOIN orc USING (dataset))"""


def cells(s, d):
    return views.cells(s, d)


def best(s, d):
    return m.best_cell(cells(s, d))


def selections(s, d):
    c = cells(s, d)
    one = c.where("classifier = 'c0'").groupBy("dataset").agg(F.min_by("descriptor", F.struct(-F.col("acc"), F.col("descriptor"))).alias("descriptor")).select(F.lit("m1").alias("method"), "dataset", "descriptor")
    two = c.select(F.lit("m2").alias("method"), "dataset", F.lit("view").alias("descriptor")).distinct()
    three = best(s, d).groupBy("dataset").agg(F.min_by("descriptor", F.md5(F.concat(F.lit("7:"), F.col("dataset"), F.lit(":"), F.col("descriptor")))).alias("descriptor")).select(F.lit("m3").alias("method"), "dataset", "descriptor")
    return one.unionByName(two).unionByName(three)


def scored(s, d):
    return m.scored(selections(s, d), best(s, d))


def _missing(s, d):
    c = cells(s, d)
    keys = ["dataset", "descriptor", "classifier"]
    code = F.substring(F.col("dataset"), 2, 9).cast("int") + F.ascii("descriptor")
    full = c.select("dataset").distinct().crossJoin(c.select("descriptor").distinct()).crossJoin(c.select("classifier").distinct())  # names only
    return m.missing_cells(full, c.where(code % 13 != 0), keys)


def _pred2(s, d):
    return views.predictions(s, d).select("truth", F.col("pred").alias("a"), (F.col("doc_id") % 2).cast("int").alias("b"))


def _outcomes(s, d):
    return st.outcomes(read(s, d, "events"))


def _curve(s, d):
    return cells(s, d).select("descriptor", F.substring("dataset", 2, 9).cast("int").alias("n"), "acc", "acc_std").groupBy("descriptor", "n").agg(mean6("acc", "acc"), mean6("acc_std", "acc_std"))


def _convs(s, d):
    return read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _soft(s, d):
    e = F.col("event_id")
    probs = F.create_map(*[x for k in range(4) for x in (F.lit(k).cast("bigint"), (e + k) % 4 / 6.0)])
    votes = read(s, d, "events").select(F.col("user_id").alias("id"), (e % 4).cast("bigint").alias("label"), (1 + e % 3).cast("double").alias("weight"), F.when(e % 7 != 0, e % 101).alias("confidence"), F.when(e % 5 != 0, probs).alias("probs"))
    return votes


S, B = f"WITH {SELECTIONS} ", f"WITH {BEST} "
Qr = {
    "r1_best_cell": (best, B + "SELECT * FROM best"),
    "r1_best_cell_pinned": (lambda s, d: m.best_cell(cells(s, d), "c3"), f"WITH {CELLS} SELECT dataset, object_type, descriptor, classifier, acc FROM cells QUALIFY row_number() OVER (PARTITION BY dataset, descriptor ORDER BY CASE WHEN classifier = 'c3' THEN 0 ELSE 1 END, acc DESC, classifier) = 1"),
    "r2_oracle": (lambda s, d: m.oracle(best(s, d)), f"WITH {RANKED} SELECT * FROM orc"),
    "r3_ranking": (lambda s, d: m.ranking(best(s, d), 3), f"WITH {RANKED} SELECT * FROM rk WHERE rank <= 3"),
    "r4_single_best": (lambda s, d: m.single_best(best(s, d)), B + f"SELECT descriptor, count(DISTINCT dataset) AS coverage, {mean6_sql('acc')} AS mean_acc FROM best GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1"),
    "r5_rank_by_type": (lambda s, d: m.rank_by_type(best(s, d)), B + f", t AS (SELECT object_type, descriptor, {mean6_sql('acc')} AS mean_acc, {std6_sql('acc')} AS std_acc, count(*) AS n FROM best GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY object_type ORDER BY mean_acc DESC, descriptor) AS INTEGER) AS rank FROM t"),
    "r6_rank_by_type_lodo": (lambda s, d: m.rank_by_type_lodo(best(s, d)), B + f", t AS (SELECT a.object_type, a.descriptor, a.dataset, {mean6_sql('b.acc')} AS mean_acc FROM best a JOIN best b ON a.object_type = b.object_type AND a.descriptor = b.descriptor AND a.dataset <> b.dataset GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY object_type, dataset ORDER BY mean_acc DESC, descriptor) AS INTEGER) AS rank FROM t"),
    "r7_master_matrix": (lambda s, d: m.master_matrix(cells(s, d), [f"c{k}" for k in range(6)]), B + "SELECT c.dataset, c.descriptor, " + ", ".join(f"max(c.acc) FILTER (WHERE c.classifier = 'c{k}') AS c{k}" for k in range(6)) + ", any_value(b.classifier) AS best_classifier, any_value(b.acc) AS best_acc FROM cells c JOIN best b USING (dataset, descriptor) GROUP BY c.dataset, c.descriptor"),
    "r8_classifier_comparison": (lambda s, d: m.classifier_comparison(cells(s, d)), f"WITH {CELLS} SELECT classifier, object_type, {mean6_sql('acc')} AS mean_acc, {std6_sql('acc')} AS std_acc, floor(median(CAST(round(acc * 1e6) AS BIGINT)) + 0.5) / 1e6 AS median_acc, count(*) AS n FROM cells GROUP BY GROUPING SETS ((classifier), (classifier, object_type))"),
    "r9_descriptor_comparison": (lambda s, d: m.descriptor_comparison(cells(s, d)), f"WITH {CELLS} SELECT descriptor, object_type, {mean6_sql('acc')} AS mean_acc, count(*) AS n FROM cells GROUP BY ROLLUP (descriptor, object_type)"),
    "r10_best_per_dataset": (lambda s, d: cells(s, d).groupBy("dataset").agg(F.min_by(F.struct("descriptor", "classifier"), F.struct(-F.col("acc"), "descriptor", "classifier")).alias("b"), F.max("acc").alias("acc"), F.count("*").alias("n")).select("dataset", "b.descriptor", "b.classifier", "acc", "n"), f"WITH {CELLS} SELECT dataset, descriptor, classifier, acc, count(*) OVER (PARTITION BY dataset) AS n FROM cells QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, descriptor, classifier) = 1"),
    "r11_missing_cells": (_missing, f"WITH {CELLS}, p AS (SELECT * FROM cells WHERE (CAST(substr(dataset, 2) AS INTEGER) + ascii(descriptor)) % 13 <> 0), f AS (SELECT * FROM (SELECT DISTINCT dataset FROM cells), (SELECT DISTINCT descriptor FROM cells), (SELECT DISTINCT classifier FROM cells)) SELECT dataset, descriptor, classifier FROM f EXCEPT SELECT dataset, descriptor, classifier FROM p"),
    "r11_completeness": (lambda s, d: m.completeness(cells(s, d), 30), f"WITH {CELLS} SELECT dataset, count(*) AS present, round(100.0 * count(*) / 30, 6) AS percent FROM cells GROUP BY 1"),
    "r12_method_metrics": (lambda s, d: m.method_metrics(scored(s, d)), S + f"SELECT method, {mean6_sql('acc')} AS mba, round(avg((rank <= 1)::INT), 6) AS dsa1, round(avg((rank <= 3)::INT), 6) AS dsa3, {mean6_sql('regret')} AS mean_regret, round(max(regret), 6) AS max_regret, count(*) AS n FROM sd GROUP BY 1"),
    "r13_mba_by_type": (lambda s, d: m.mba_by_type(scored(s, d), best(s, d).select("dataset", "object_type").distinct()), S + f", ty AS (SELECT DISTINCT dataset, object_type FROM best) SELECT method, object_type, {mean6_sql('acc')} AS mba, {mean6_sql('oracle_acc - acc')} AS gap FROM sd JOIN ty USING (dataset) GROUP BY ALL"),
    "r14_selection_distribution": (lambda s, d: m.selection_distribution(selections(s, d)), S + ", c AS (SELECT method, descriptor, count(*) AS n FROM sel GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY method), 6) AS percent FROM c"),
    "r15_detail_table": (lambda s, d: scored(s, d).select("method", "dataset", "descriptor", "acc", "oracle", "oracle_acc", r6("regret", "regret"), "is_match"), S + "SELECT method, dataset, descriptor, acc, oracle, oracle_acc, round(regret, 6) AS regret, descriptor = oracle AS is_match FROM sd"),
    "r16_bootstrap_ci": (lambda s, d: m.bootstrap_ci(scored(s, d)), S + """, n AS (SELECT method, dataset, acc, row_number() OVER (PARTITION BY method ORDER BY dataset) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM sd), dr AS (SELECT method, n, rep, draw, CAST(('0x' || substr(md5(rep || ':' || draw), 1, 8)) AS BIGINT) % n AS k FROM (SELECT DISTINCT method, n FROM n), (SELECT unnest(range(200)) AS rep), (SELECT unnest(range(1000)) AS draw) WHERE draw < n),
 me AS (SELECT method, rep, dr.n, CAST(sum(CAST(round(acc * 1e6) AS BIGINT)) AS BIGINT) AS m FROM dr JOIN n USING (method, k) GROUP BY ALL),
 mean AS (SELECT method, """ + mean6_sql('acc') + """ AS mean_acc FROM sd GROUP BY 1)
SELECT method, mean_acc, floor(round(quantile_cont(m, 0.025) * 1000) / (1000 * n) + 0.5) / 1e6 AS low, floor(round(quantile_cont(m, 0.975) * 1000) / (1000 * n) + 0.5) / 1e6 AS high FROM me JOIN mean USING (method) GROUP BY method, mean_acc, n"""),
    "r18_mcnemar": (lambda s, d: m.mcnemar_counts(_pred2(s, d)), f"WITH {PREDICTIONS}, c AS (SELECT count(*) FILTER (WHERE pred = truth AND doc_id % 2 <> truth) AS b, count(*) FILTER (WHERE pred <> truth AND doc_id % 2 = truth) AS c FROM preds) SELECT b, c, round(CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) ELSE 0 END, 6) AS statistic FROM c"),
    "r19_wilcoxon": (lambda s, d: m.wilcoxon_w(scored(s, d), "m1", "m3"), S + ", d AS (SELECT round(x.acc - y.acc, 9) AS d FROM sd x JOIN sd y USING (dataset) WHERE x.method = 'm1' AND y.method = 'm3' AND round(x.acc - y.acc, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d) SELECT round(coalesce(sum(r) FILTER (WHERE d > 0), 0), 6) AS w_plus, count(*) AS n FROM r"),
    "r20_method_summary": (lambda s, d: m.method_summary(scored(s, d), best(s, d)), S + f", b1 AS (SELECT descriptor FROM best GROUP BY 1 ORDER BY count(DISTINCT dataset) DESC, {mean6_sql('acc')} DESC, 1 LIMIT 1), sba AS (SELECT dataset, acc AS sa FROM best JOIN b1 USING (descriptor)) , t AS (SELECT method, count(*) AS n, sum(CAST(round(acc * 1e6) AS BIGINT)) AS m, sum(CAST(round(oracle_acc * 1e6) AS BIGINT)) AS o, sum(CAST(round(sa * 1e6) AS BIGINT)) AS s, round(avg((acc >= sa)::INT), 6) AS win_rate FROM sd JOIN sba USING (dataset) GROUP BY 1) SELECT method, n, floor(m / n + 0.5) / 1e6 AS mean_acc, win_rate, round(CASE WHEN o - s > 5000 * n THEN 100 * (m - s) / (o - s) END, 6) AS gap_closed FROM t"),
    "r23_win_loss_tie": (lambda s, d: m.win_loss_tie(scored(s, d)), S + "SELECT x.method AS a, y.method AS b, count(*) FILTER (WHERE x.acc - y.acc > 1e-6) AS wins, count(*) FILTER (WHERE x.acc - y.acc < -1e-6) AS losses, count(*) FILTER (WHERE abs(x.acc - y.acc) <= 1e-6) AS ties FROM sd x JOIN sd y ON x.dataset = y.dataset AND x.method < y.method GROUP BY ALL"),
    "r24_agreement": (lambda s, d: m.agreement_matrix(selections(s, d)), S + "SELECT x.method AS a, y.method AS b, round(100 * avg((x.descriptor = y.descriptor)::INT), 6) AS percent FROM sel x JOIN sel y USING (dataset) GROUP BY ALL"),
    "r25_baseline_random": (lambda s, d: m.baseline_random(best(s, d), s.range(5).select(F.col("id").alias("seed"))), B + ", p AS (SELECT seed, dataset, descriptor, acc FROM best, (SELECT unnest(range(5)) AS seed) QUALIFY row_number() OVER (PARTITION BY seed, dataset ORDER BY md5(seed || ':' || dataset || ':' || descriptor)) = 1) SELECT seed, round(avg(acc), 6) AS mba, count(DISTINCT descriptor) AS n_unique FROM p GROUP BY 1"),
    "r26_baseline_fixed": (lambda s, d: m.baseline_fixed(best(s, d), "click"), f"WITH {RANKED} SELECT o.dataset, coalesce(b.descriptor, o.oracle) AS descriptor FROM orc o LEFT JOIN best b ON b.dataset = o.dataset AND b.descriptor = 'click'"),
    "r27_baseline_by_type": (lambda s, d: m.baseline_by_type(best(s, d)), B + f", t AS (SELECT object_type, descriptor, {mean6_sql('acc')} AS a FROM best GROUP BY ALL) SELECT dataset, best.descriptor FROM best JOIN t ON t.object_type = best.object_type AND t.descriptor = best.descriptor QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY a DESC, best.descriptor) = 1"),
    "r28_convergence": (lambda s, d: m.convergence_n(_curve(s, d), 0.05, 0.5), f"WITH {CELLS}, c AS (SELECT descriptor, CAST(substr(dataset, 2) AS INTEGER) AS n, {mean6_sql('acc')} AS acc, {mean6_sql('acc_std')} AS sd FROM cells GROUP BY ALL), l AS (SELECT *, max_by(acc, n) OVER (PARTITION BY descriptor) AS last FROM c) SELECT descriptor, min(n) AS n FROM l WHERE abs(acc - last) < 0.05 AND sd < 0.5 GROUP BY 1"),
    "r29_ranking_stability": (lambda s, d: m.ranking_stability(best(s, d)), B + ", me AS (SELECT descriptor, sum(CAST(round(acc * 1e6) AS BIGINT)) / count(*) AS mean FROM best GROUP BY 1), r AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY acc) + (count(*) OVER (PARTITION BY dataset, acc) - 1) / 2 AS ra, rank() OVER (PARTITION BY dataset ORDER BY mean) + (count(*) OVER (PARTITION BY dataset, mean) - 1) / 2 AS rm FROM best JOIN me USING (descriptor)) SELECT dataset, round(corr(ra, rm), 6) AS rho FROM r GROUP BY 1"),
    "r32_winners": (lambda s, d: m.adjust_and_winners(best(s, d), ["click", "error"]), B + ", a AS (SELECT dataset, descriptor, round(acc - CASE WHEN descriptor IN ('click', 'error') THEN 0.02 ELSE 0 END, 6) AS adj FROM best), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY adj DESC, descriptor) AS k FROM a) SELECT dataset, max(descriptor) FILTER (WHERE k = 1) AS winner, max(descriptor) FILTER (WHERE k = 2) AS runner_up, round(max(adj) FILTER (WHERE k = 1) - max(adj) FILTER (WHERE k = 2), 6) AS gap FROM k GROUP BY 1"),
    "r37_lodo_baselines": (lambda s, d: m.lodo_baselines(best(s, d)), B + ", t AS (SELECT a.dataset, a.descriptor, a.acc, sum(CAST(round(b.acc * 1e6) AS BIGINT)) / count(*) AS rest FROM best a JOIN best b ON b.descriptor = a.descriptor AND b.dataset <> a.dataset GROUP BY ALL), p AS (SELECT dataset, descriptor, acc FROM t QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY rest DESC, descriptor DESC) = 1) SELECT p.dataset, p.descriptor AS picked, round(p.acc, 6) AS picked_acc, " + mean6_sql('b.acc') + " AS random_acc FROM p JOIN best b USING (dataset) GROUP BY ALL"),
    "r38_regret_summary": (lambda s, d: m.regret_summary(scored(s, d)), S + "SELECT method, round(avg(regret), 6) AS mean, round(stddev_pop(regret), 6) AS std, round(median(regret), 6) AS median, round(max(regret), 6) AS max, round(avg((regret = 0)::INT), 6) AS top1, round(avg((regret < 0.01)::INT), 6) AS soft, round(avg((regret < 0.02)::INT), 6) AS near FROM sd GROUP BY 1"),
    "r46_synergy": (lambda s, d: m.synergy(best(s, d)), B + ", m AS (SELECT dataset, descriptor, CAST(round(acc * 1e6) AS BIGINT) AS acc FROM best) SELECT x.descriptor AS a, y.descriptor AS b, floor((sum(greatest(x.acc, y.acc)) - greatest(sum(x.acc), sum(y.acc))) / count(*) + 0.5) / 1e6 AS gain, count(*) AS n FROM m x JOIN m y ON x.dataset = y.dataset AND x.descriptor < y.descriptor GROUP BY ALL"),
    "r48_cost_report": (lambda s, d: m.cost_report(read(s, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 26 % 5).cast("string")).alias("object_type"), F.concat(F.lit("d"), (F.col("user_id") % 26).cast("string")).alias("dataset"), "value")), "SELECT object_type, dataset, count(*) AS calls, round(sum(value), 6) AS total, round(avg((value > 50)::INT), 6) AS retry_rate FROM (SELECT 't' || (user_id % 26 % 5) AS object_type, 'd' || (user_id % 26) AS dataset, value FROM events) GROUP BY ROLLUP (object_type, dataset)"),
    "r51_majority_choice": (lambda s, d: m.majority_choice(read(s, d, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 26).cast("string")).alias("dataset"), F.col("event_id").alias("i"), F.col("event_type").alias("descriptor"))), "WITH n AS (SELECT 'd' || (user_id % 26) AS dataset, event_type AS descriptor, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT dataset, descriptor, n AS votes FROM n QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, f) = 1"),
    "m1_stratified_sample": (lambda s, d: sc.stratified_sample(read(s, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 101), """WITH c AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), q AS (SELECT label, size, size * 101 / sum(size) OVER () AS e FROM c), w AS (SELECT *, floor(e) AS f, 101 - sum(floor(e)) OVER () AS spare, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, label) AS o FROM q), t AS (SELECT label, least(size, f + (o <= spare)::INT) AS quota FROM w),
 r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS k FROM embeddings) SELECT vec_id, label FROM r JOIN t USING (label) WHERE k <= quota"""),
    "m2_class_balance": (lambda s, d: sc.class_balance_flags(read(s, d, "embeddings"), "label", 50), "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) < 50"),
    "m3_stratified_folds": (lambda s, d: sc.stratified_folds(read(s, d, "embeddings").select("vec_id", "label"), "label", "vec_id"), "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings"),
    "m5_knn": (lambda s, d: (lambda e: sc.knn_classify(e, e))(read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")), """WITH p AS (SELECT a.vec_id AS id, a.label, b.vec_id AS id2, b.label AS label2, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, id2) <= 5), v AS (SELECT id, label, label2, count(*) AS n FROM t GROUP BY ALL)
 SELECT id, label, label2 AS pred, round(100.0 * n / 5, 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label2) = 1"""),
    "m6_hard_vote": (lambda s, d: sc.hard_vote(read(s, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 4).alias("label"), (1 + F.col("event_id") % 3).cast("double").alias("weight"))), "WITH v AS (SELECT user_id AS id, event_id % 4 AS label, sum(1 + event_id % 3) AS w FROM events GROUP BY ALL) SELECT id, label, round(w / sum(w) OVER (PARTITION BY id), 6) AS share FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1"),
    "m6_soft_vote": (lambda s, d: sc.soft_vote(_soft(s, d)), """WITH v AS (SELECT user_id AS id, event_id % 4 AS label, 1 + event_id % 3 AS w, event_id AS e, CASE WHEN event_id % 7 = 0 THEN 50 ELSE event_id % 101 END AS conf FROM events),
 p AS (SELECT id, k AS label, w * ((e + k) % 4) / 6.0::DOUBLE AS s FROM v, (SELECT unnest(range(4)) AS k) WHERE e % 5 <> 0 UNION ALL SELECT id, label, w * conf / 100.0::DOUBLE FROM v WHERE e % 5 = 0),
 t AS (SELECT id, label, round(sum(s), 9) AS s FROM p GROUP BY ALL) SELECT id, label, round(s / sum(s) OVER (PARTITION BY id), 6) AS share FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, label) = 1"""),
    "m7_fold_metrics": (lambda s, d: sc.fold_metrics(views.predictions(s, d)), f"WITH {PREDICTIONS}, c AS (SELECT fold, truth, count(*) FILTER (WHERE truth = pred) AS tp, count(*) AS n FROM preds GROUP BY ALL) SELECT fold, round(sum(tp) / sum(n), 6) AS accuracy, round(avg(tp / n), 6) AS balanced_accuracy FROM c GROUP BY 1"),
    "m8_cell_summary": (lambda s, d: sc.cell_summary(views.fold_results(s, d)), f"WITH {CELLS} SELECT dataset, descriptor, classifier, {mean6_sql('acc')} AS mean_acc, {std6_sql('acc')} AS std_acc, list(round(acc, 6) ORDER BY fold) AS folds FROM folds GROUP BY ALL"),
    "m9_confusion_report": (lambda s, d: sc.confusion_report(views.predictions(s, d)), f"""WITH {PREDICTIONS}, k AS (SELECT unnest([0, 1])::INT AS class), c AS (SELECT class, (SELECT count(*) FROM preds WHERE truth = class) AS support, (SELECT count(*) FROM preds WHERE truth = class AND pred = class) AS tp, (SELECT count(*) FROM preds WHERE pred = class) AS predicted FROM k)
 SELECT class, support, tp, predicted - tp AS fp, support - tp AS fn, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) AS f1 FROM c"""),
    "m10_match_label": (lambda s, d: sc.match_label(read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("text")), ["English", "e", "fr"]), "SELECT doc_id AS id, CASE WHEN lower(lang) = 'english' THEN 0 WHEN lower(lang) = 'e' THEN 1 WHEN lower(lang) = 'fr' THEN 2 WHEN contains(lower(lang), 'english') THEN 0 WHEN contains(lower(lang), 'e') THEN 1 WHEN contains(lower(lang), 'fr') THEN 2 ELSE -1 END AS label FROM documents"),
    "k8_keyword_search": (lambda s, d: sc.keyword_search(_convs(s, d), "the and of", 20), "SELECT conv_id * 1000 + turn AS id, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'of')::INT AS hits FROM conversations WHERE hits > 0 ORDER BY hits DESC, id LIMIT 20"),
    "t1_running_rankings": (lambda s, d: st.running_rankings(_outcomes(s, d)).select("object_type", "descriptor", "trials", r6("mean_acc", "mean_acc")), "SELECT 't' || (user_id % 5) AS object_type, event_type AS descriptor, count(*) AS trials, round(avg(value / 100), 6) AS mean_acc FROM events GROUP BY ALL"),
    "t3_bounded_memory": (lambda s, d: st.bounded_memory(_outcomes(s, d), ["object_type"], 20).select("object_type", "event_id", "descriptor", r6("acc", "acc")), "SELECT 't' || (user_id % 5) AS object_type, event_id, event_type AS descriptor, round(value / 100, 6) AS acc FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) <= 20"),
    "t5_windowed_rankings": (lambda s, d: st.windowed_rankings(_outcomes(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "descriptor", "trials", r6("mean_acc", "mean_acc")), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS descriptor, count(*) AS trials, round(avg(value / 100), 6) AS mean_acc FROM events GROUP BY ALL"),
}
QUERIES = Qr
