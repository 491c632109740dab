"""Selection analytics on small tables whose results are known, with ties, nulls and empty input."""

from lattica.operators import selection as sel
from lattica.sources import results_io
from lattica.streaming import rankings as st


def cells(spark, rows):
    return spark.createDataFrame(rows, "dataset string, object_type string, descriptor string, classifier string, acc double")


BEST = [("d1", "t1", "x", "c", 0.9), ("d1", "t1", "y", "c", 0.5), ("d2", "t1", "x", "c", 0.4), ("d2", "t1", "y", "c", 0.6), ("d2", "t1", "z", "c", 0.6)]


def test_frozen_n_keeps_n_max_without_convergence(spark):
    sizes = spark.createDataFrame([("a", 500), ("b", 500), ("c", 90)], "dataset string, n_max long")
    conv = spark.createDataFrame([("a", 120), ("c", 120)], "dataset string, n long")
    assert {r.dataset: r.n for r in sel.frozen_n(sizes, conv).collect()} == {"a": 200, "b": 500, "c": 90}


def test_n_grid_has_n_max_once(spark):
    sizes = spark.createDataFrame([("a", 200, 2), ("b", 30, 2)], "dataset string, n_max long, n_classes long")
    assert sorted((r.dataset, r.n) for r in sel.n_grid(sizes, [50, 100, 200, 500]).collect()) == [("a", 50), ("a", 100), ("a", 200), ("b", 30)]


def test_best_threshold_is_brute_force(spark):
    rows = [("f", x, t) for x, t in [(1.0, 0), (1.0, 0), (2.0, 1), (3.0, 1), (4.0, 0)]] + [("g", 1.0, 1), ("g", 2.0, 0), ("h", 5.0, 1)]
    got = {r.feature: (r.threshold, r.side, r.accuracy) for r in sel.best_threshold(spark.createDataFrame(rows, "feature string, x double, target int")).collect()}
    assert got == {"f": (1.5, ">=", 0.8), "g": (1.5, "<", 1.0)}  # h has one value and no midpoint


def test_first_rule_wins(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (3.0, 9.0), (None, 9.0)], "a double, b double")
    assert [r.choice for r in sel.apply_rules(df, [("a", ">=", 2.0, "p"), ("b", "<", 5.0, "q")], "none").collect()] == ["q", "p", "p", "none"]


def test_config_key_ignores_map_order(spark):
    df = spark.sql("SELECT explode(array(map('b', '1', 'a', '2'), map('a', '2', 'b', '1'))) AS p")
    assert {r[0] for r in df.select(sel.config_key(df.p)).collect()} == {"a=2,b=1"}


def test_fusion_lookup_in_either_order_and_fallback(spark):
    best = cells(spark, BEST)
    fused = spark.createDataFrame([("d1", "x", "y", 0.7)], "dataset string, a string, b string, acc double")
    asked = spark.createDataFrame([("d1", "y", "x"), ("d2", "x", "y"), ("d3", "x", "y")], "dataset string, first string, second string")
    assert {r.dataset: (r.acc, r.is_pair) for r in sel.fusion_lookup(asked, fused, best).collect()} == {"d1": (0.7, True), "d2": (0.4, False), "d3": (None, False)}


def test_resolve_choice(spark):
    choices = spark.createDataFrame([("d1", "t1", "x"), ("d1", "t1", "y"), ("d1", "t1", "q"), ("d9", "t9", "q")], "dataset string, object_type string, descriptor string")
    got = {(r.dataset, r.asked): r.resolved for r in sel.resolve_choice(choices, cells(spark, BEST), ["x", "y", "z"], ["y"], "x").collect()}
    assert got == {("d1", "x"): "x", ("d1", "y"): "x", ("d1", "q"): "x", ("d9", "q"): "x"}


def test_tool_patterns_and_suggestions(spark):
    log = spark.createDataFrame([(1, 2, "b", " Do it "), (1, 1, "a", "do it"), (2, 1, "a", None), (3, 1, "a", "x"), (3, 2, "b", "")], "conv_id long, turn long, role string, text string")
    assert {r.pattern: r.n for r in sel.tool_patterns(log).collect()} == {"a->b": 2, "a": 1}
    assert sel.common_suggestions(log).first().asDict() == {"suggestion": "do it", "n": 2}
    assert {r.role: (r.calls, r.success_rate) for r in sel.execution_stats(log).collect()} == {"a": (3, 0.666667), "b": (2, 0.5)}


def test_object_type_ties_and_null(spark):
    texts = spark.createDataFrame([(1, "A cat, a dog"), (2, "dog"), (3, None)], "id long, text string")
    assert {r.id: r.object_type for r in sel.object_type_from_text(texts, {"p": ["cat"], "q": ["dog"]}).collect()} == {1: "p", 2: "q", 3: None}


def test_results_survive_json_and_csv(spark):
    rows = [("d1", "x", "c0", 0.5), ("d1", "x", "c1", 0.25), ("d2", "y", "c1", 1.0)]
    long = spark.createDataFrame(rows, "dataset string, descriptor string, classifier string, acc double")
    assert sorted(map(tuple, results_io.json_round_trip(long).collect())) == rows
    wide = long.groupBy("dataset", "descriptor").pivot("classifier", ["c0", "c1"]).max("acc")
    assert sorted(map(tuple, results_io.csv_round_trip(wide, ["c0", "c1"]).collect())) == rows
    new = long.where("classifier = 'c1'").selectExpr("dataset", "descriptor", "classifier", "acc * 2 AS acc")
    assert sorted(r.acc for r in results_io.merge_results(new, long, ["dataset", "descriptor", "classifier"]).collect()) == [0.5, 0.5, 2.0]


def test_empty_tables(spark):
    none = cells(spark, [])
    assert sel.pair_correlation(none).count() == sel.ranking_metrics(sel.leave_one_out(none)).count() == sel.top_descriptors(none, 3).count() == 0
    log = spark.createDataFrame([], "object_type string, pair string, gain double")
    assert st.fusion_outcomes(log).count() == 0


def test_t_quantiles_are_those_of_the_tables(spark):
    from lattica.operators.selection import t_interval, t_quantile

    known = {(0.975, 1): 12.7062, (0.975, 2): 4.3027, (0.975, 3): 3.1824, (0.975, 10): 2.2281, (0.975, 25): 2.0595, (0.95, 7): 1.8946, (0.995, 30): 2.7500, (0.975, 1000): 1.9623}
    assert all(abs(t_quantile(p, df) - t) < 5e-5 for (p, df), t in known.items())
    rows = [("m", 0.1), ("m", 0.2), ("m", 0.4), ("one", 0.5)]
    got = {r.method: r for r in t_interval(spark.createDataFrame(rows, "method string, acc double")).collect()}
    mean, half = 0.7 / 3, 4.302653 * (0.07 / 3) ** 0.5 / 3**0.5
    assert abs(got["m"].low - (mean - half)) < 1e-5 and abs(got["m"].high - (mean + half)) < 1e-5
    assert got["one"].mean == 0.5 and got["one"].low is None
