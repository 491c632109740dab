"""Rule lists against a search over all splits and conjunctions."""

import itertools
import random

from lattica.operators import rule_fit


def brute(features, winners, targets):
    """features {dataset: {feature: x}}, winners {dataset: winner} -> [(rule, target, conditions, accuracy)]"""
    out, free = [], dict(winners)
    test = lambda c, d: features[d][c[0]] >= c[2] if c[1] == ">=" else features[d][c[0]] < c[2]
    for k, target in enumerate(targets, 1):
        if target not in free.values():
            continue
        names, cands = sorted({f for d in free for f in features[d]}), []
        for f in names:
            x = sorted({features[d][f] for d in free})
            cands += [(f, side, (a + b) / 2) for a, b in zip(x, x[1:]) for side in (">=", "<")]
        n = len(free)
        hits = lambda conds: sum(all(test(c, d) for c in conds) == (w == target) for d, w in free.items())
        if not cands:
            continue
        best = max(((c,) for c in cands), key=hits)
        if hits(best) < n and sum(w == target for w in free.values()) >= 2:
            two = max(((a, b) for a, b in itertools.product(cands, cands) if a[0] < b[0]), key=hits, default=best)
            best = two if hits(two) > hits(best) else best
        if 2 * hits(best) > n:
            out.append((k, target, [tuple(c) for c in best], hits(best) / n))
            free = {d: w for d, w in free.items() if not all(test(c, d) for c in best)}
    return out


def test_rules_equal_brute_force(spark):
    rng = random.Random(8)
    features, winners, many = {}, {}, 8
    for g in range(many):
        for d in range(12):
            features[g, d] = {f: float(rng.randint(0, 5)) for f in ("a", "b", "c")}
            x = features[g, d]
            winners[g, d] = "p" if x["a"] > 2 and x["b"] < 4 else "q" if x["c"] > 3 else rng.choice("pqr")
    rows = [(str(g), str(d), f, x) for (g, d), fs in features.items() for f, x in fs.items()]
    fs = spark.createDataFrame(rows, "g string, dataset string, feature string, x double")
    ws = spark.createDataFrame([(str(g), str(d), w) for (g, d), w in winners.items()], "g string, dataset string, winner string")
    got = {}
    rules = rule_fit.fit_rules(fs, ws, ["p", "q"])
    for r in sorted(rules.collect(), key=lambda r: (r.g, r["rule"])):
        got.setdefault(int(r.g), []).append((r["rule"], r.target, [(c.feature, c.side, c.threshold) for c in r.conditions], r.accuracy))
    want = {g: brute({str(d): features[g, d] for d in range(12)}, {str(d): winners[g, d] for d in range(12)}, ["p", "q"]) for g in range(many)}
    assert got == {g: x for g, x in want.items() if x}
    assert any(len(c) == 2 for x in got.values() for *_, c, _ in x) and any(len(x) == 2 for x in got.values())
    text = rule_fit.described(rules).where("rule = 1").first().text
    assert " >= " in text or " < " in text
    choice = {(r.g, r.dataset): r.choice for r in rule_fit.choose(fs, rules, "z").collect()}
    assert len(choice) == many * 12 and "z" in choice.values() and "p" in choice.values()


def test_lodo_equals_a_loop_and_missing_choices_count_as_the_mean(spark):
    rng = random.Random(2)
    features = {str(d): {f: float(rng.randint(0, 4)) for f in "ab"} for d in range(7)}
    scores = {(str(d), x): round(rng.random(), 2) for d in range(7) for x in "pqr" if (d, x) != (3, "r")}
    fs = spark.createDataFrame([(d, f, x) for d, v in features.items() for f, x in v.items()], "dataset string, feature string, x double")
    sc = spark.createDataFrame([(d, x, a) for (d, x), a in scores.items()], "dataset string, descriptor string, acc double")
    got = {r.dataset: r for r in rule_fit.lodo_rules(fs, sc, ["p", "q"], "r").collect()}
    test = lambda c, d: features[d][c[0]] >= c[2] if c[1] == ">=" else features[d][c[0]] < c[2]
    for d in features:
        best = {e: min((-a, x) for (o, x), a in scores.items() if o == e)[1] for e in features}
        rules = brute({e: v for e, v in features.items() if e != d}, {e: w for e, w in best.items() if e != d}, ["p", "q"])
        choice = next((t for _, t, cs, _ in rules if all(test(c, d) for c in cs)), "r")
        own = [a for (o, _), a in scores.items() if o == d]
        assert got[d].choice == choice and got[d].winner == best[d]
        assert abs(got[d].choice_acc - scores.get((d, choice), sum(own) / len(own))) < 1e-6


def test_empty(spark):
    fs = spark.createDataFrame([], "g string, dataset string, feature string, x double")
    assert rule_fit.fit_rules(fs, spark.createDataFrame([], "g string, dataset string, winner string"), ["p"]).count() == 0
