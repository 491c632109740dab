"""Hard negatives, personal data and phrases against brute force, and their edge cases."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from lattica.llm import collocations, gnat, pii

DOCS = "doc_id long, text string, lang string, extra string"


def brute_negatives(rows, anchors=100, most=5):
    seen = {}
    for vec_id, vec, label in sorted((r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [int(np.floor(256 * x)) for x in r[1]])):
        seen.setdefault(vec_id, ((label + 1) % 10 if vec_id % 7 == 0 else label, np.array([int(np.floor(256 * x)) for x in vec], object)))
    lengths = Counter(len(v) for _, v in seen.values())
    size = max(lengths, key=lambda k: (lengths[k], k), default=0)
    seen = {i: x for i, x in seen.items() if len(x[1]) == size}
    out = []
    for a, (label, v) in seen.items():
        if a % anchors:
            continue
        score = sorted((-(v * w).sum(), i, other) for i, (other, w) in seen.items() if i != a)
        for s, p, _ in [x for x in score if x[2] == label][:most]:
            good = [(n, i) for n, i, other in score if other != label and 80 * -s <= 100 * -n <= 100 * -s][:most]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(good, 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf, part, visits", [(1000, 4000, 1000), (6, 5, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, leaf, part, visits):
    monkeypatch.setattr(gnat, "LEAF", leaf)
    monkeypatch.setattr(gnat, "SLICE", part)
    monkeypatch.setattr(gnat, "VISITS", visits)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(3))) for i in range(400)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], i % 3) for i in range(400, 460)]  # a group of equal vectors
    rows += [(600, None, 1), (601, [1.0, None, 1.0, 1.0], 1), (602, [float("nan")] * 4, 1), (603, [float("inf")] * 4, 1), (604, [1.0] * 4, None), (605, [1.0] * 7, 1), (None, [1.0] * 4, 1), (606, [], 0)]
    rows += [rows[100], rows[3], (100, [2.0] * 4, 9)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = sorted(tuple(r) for r in gnat.hard_negatives(table, anchors=20).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows, 20) and len(got) > 100


def test_hard_negatives_empty_and_eliminates(spark):
    assert gnat.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 3)) * 256).astype(np.int64)
    tree = gnat.Tree.grow(x, 64 * gnat.LEAF, float((x**2).sum(1).max()))
    leaf, found = tree.place(x)
    tree.ranges = [np.stack(found[k]) for k in range(len(tree.points))]
    low, high = np.full(20, 150_000.0), np.full(20, 160_000.0)
    visited = {(int(r), leaf_) for leaf_, rows in tree.visits(x[:20], low, high) for r in rows}
    needed = {(q, int(leaf[k])) for q in range(20) for k in np.flatnonzero((x @ x[q] >= 150_000) & (x @ x[q] <= 160_000))}
    assert needed <= visited and len(visited) < 0.75 * 20 * tree.n_leaves


def test_products_are_exact():
    a = np.array([[2_000_000_019, 1], [1, 2]])
    assert gnat.products(a, a).tolist() == [[2_000_000_019**2 + 1, 2_000_000_021], [2_000_000_021, 5]]
    with pytest.raises(OverflowError):
        gnat.products(a * 2, a * 2)


FORMS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_pii(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in form.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d)))
            if (kind != 1 or all(int(x) <= 255 for x in m[0].split("."))) and (kind != 2 or 16 <= len(d) <= 19 and doubled % 10 == 0) and (kind != 3 or 8 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_equal_brute_force():
    rng, many = random.Random(3), 0
    for _ in range(8000):
        text = "".join(rng.choice("a@.1-+ ()0.@_9") if rng.random() < 0.6 else rng.choice(["4111111111111111", "1.2.3.4", "a@b.c", "+1 (", "999", "é"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_pii(text)
        many += len(brute_pii(text))
    assert many > 5000
    assert pii.base_spans("0" * 9000 + "1.2.3.4") == [(1, 0, 9007)]
    begin = time.time()
    for unit in ("a", "a@", "1", "1.1.1 ", "+1(", "A ", "Anna Bob ", "a dot ", "DE12 ", "at dot. "):
        pii.candidates(unit * (300_000 // len(unit)))
    assert time.time() - begin < 20


def test_em_finds_reliabilities():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.8, 0.6])
    votes = np.where(rng.random((20_000, 3)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    posterior, prior, rate = pii.em(np.zeros(len(patterns), int), patterns, n.astype(float))
    assert abs(prior[0] - 0.3) < 0.05
    assert np.abs(rate[1, :, 2] - right).max() < 0.06 and np.abs(rate[0, :, 0] - right).max() < 0.06
    # one round more moves nothing: a fixed point of the published updates
    q = posterior
    again = np.log((np.sum(n * q) + 1) / (n.sum() + 2)) - np.log(1 - (np.sum(n * q) + 1) / (n.sum() + 2))
    assert np.abs(1 / (1 + np.exp(-(again + sum(np.log(rate[1, j, patterns[:, j] + 1]) - np.log(rate[0, j, patterns[:, j] + 1]) for j in range(3))))) - q).max() < 1e-4


def test_added_spans_and_decoys(spark):
    rng = random.Random(4)
    words = "lorem ipsum dolor sit amet elit sed tempor magna aliqua".split()
    some = lambda: " ".join(rng.choices(words, k=8))
    good, bad = [], []
    for k in range(150):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        good += [f"phone ({a}) {b}-{c}", f"call me on ({a}) {b}-{c}", f"mail x{a}.{b} [at] host{k} [dot] com", f"contact me at y{a} (at) host{k} (dot) org", f"email: n{a}@mail{k}.example.com", f"call +1 ({a}) {b}-{c}"]
        bad += [f"order {a}-{b}-{c}/x", f"version {a % 90}.{b}.{c % 100}.{a}", f"serial key={a}-{b}-{c}", f"build {a}.{b}.{c % 1000}"]
    rows = [(k, f"{some()} {x} {some()}", "en", None) for k, x in enumerate(good + bad)]
    rows += [(9001, None, "en", None), (9002, "", None, None), (9003, "plain text without any", "en", None), (9003, "plain text without any", "en", None), (None, "mail a@b.cd", "en", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = pii.report(docs, pii.train(docs, **pii.PARAMETERS), pii.PARAMETERS["bits"]).collect()
    assert len(got) == len(rows)
    added = {r.doc_id: r.n_added for r in got}
    loose = [k for k, x in enumerate(good) if "[" in x or "(at)" in x or "phone (" in x or "on (" in x]
    assert sum(added[k] > 0 for k in loose) >= 0.9 * len(loose)
    assert sum(added[k] for k in range(len(good), len(good) + len(bad))) <= 0.05 * len(bad)
    assert added[9001] == added[9002] == added[9003] == 0 and next(r for r in got if r.doc_id is None).spans == "email:5:11"
    empty = docs.where("false")
    assert pii.report(empty, pii.train(empty, **pii.PARAMETERS), pii.PARAMETERS["bits"]).count() == 0


def brute_phrases(rows, least=10, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    for (lang, *w), a in counts.items():
        if a < least or len(w) == 1:
            continue
        if any(len(o) == 4 > len(w) + 1 and o[0] == lang and (list(o[1:3]) == w or list(o[2:]) == w) and 100 * n >= 50 * a for o, n in counts.items() if n >= least):
            continue
        cuts = [(1_000_000 * a * a // (x * y), k, x, y) for k in range(1, len(w)) for x, y in [(counts[(lang, *w[:k])], counts[(lang, *w[k:])])]]
        score, _, x, y = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), x, y))
    return sorted((lang, k, p.decode(), -a, x, y, total[lang], -s) for lang, many in out.items() for k, (s, a, p, x, y) in enumerate(sorted(many)[:top], 1))


@pytest.mark.parametrize("part, bits, top", [(4_000_000, 26, 2000), (300, 7, 12)])
def test_collocations_equal_brute_force(spark, monkeypatch, part, bits, top):
    """Also with tiny parts, a bit table that is nearly full, and ranges cut through one frequent word."""
    monkeypatch.setattr(collocations, "PART", part)
    rng = random.Random(6)
    words = [*"abcdefgh", "über", "\0x", "the", "the", "the", "the"]
    rows = [(k, rng.choice(("", "A b\tC. ")) + " ".join(rng.choice(words) + rng.choice(("", "", "", ",", ".\n")) for _ in range(60)), rng.choice(("en", "en", "fr", None)), "x") for k in range(120)]
    rows += [(1, None, "en", None), (2, "", None, None), (3, " \t ", "xx", None), rows[0], rows[0], (4, "a b c " * 3000, "en", None)]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), bits=bits, top=top).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, top=top) and len(got) > 20
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
