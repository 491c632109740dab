"""Counts and places against plain versions: Baum-Welch over windows, shards of one sorted line, base columns of quality."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import hmm, quality, sharding


@pytest.mark.parametrize("window", [1, 2, 3, 512])
def test_baum_welch_counts_are_those_of_all_paths(window, monkeypatch):
    """Windows of any size give the counts of whole texts, transitions over the cuts included."""
    monkeypatch.setattr(hmm, "WINDOW", window)
    monkeypatch.setattr(hmm, "BATCH", 10)
    rng, states, kinds = np.random.default_rng(window), 3, 5
    m = hmm.Model.from_counts(rng.random(states + states**2 + states * kinds), states, kinds)
    rows = [rng.integers(0, kinds, n).astype(np.uint16) for n in (1, 5, 7, 8, 3, 6, 1)]
    first, move, emit, likely = np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds)), 0.0
    for row in rows:
        total, one = 0.0, [np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds))]
        for path in itertools.product(range(states), repeat=len(row)):
            p = m.first[path[0]] * m.emit[path[0], row[0]]
            for a, b, o in zip(path, path[1:], row[1:]):
                p *= m.move[a, b] * m.emit[b, o]
            total += p
            one[0][path[0]] += p
            for a, b in zip(path, path[1:]):
                one[1][a, b] += p
            for a, o in zip(path, row):
                one[2][a, o] += p
        first, move, emit, likely = first + one[0] / total, move + one[1] / total, emit + one[2] / total, likely + np.log(total)
    want = np.concatenate([first, move.ravel(), emit.ravel(), [likely]])
    assert np.abs(hmm.expected_counts(rows, m) - want).max() < 1e-5


def test_each_round_makes_the_texts_likelier():
    rng, states, kinds = np.random.default_rng(3), 4, 30
    rows = [((np.arange(n) // 3 % 2) * 15 + rng.integers(0, 15, n)).astype(np.uint16) for n in (1500, 40, 700)]
    model, last = hmm.start_model(rows[1:2], states, kinds, 1), -np.inf
    for _ in range(6):
        counts = hmm.expected_counts(rows, model)
        assert counts[-1] > last - 1e-3 and abs(counts[-1] / np.log(10) - hmm.log_likelihoods(rows, model).sum()) < 1e-2
        model, last = hmm.Model.from_counts(counts[:-1], states, kinds), counts[-1]


def line(rows, shards, whole):
    """Shard and slot of each record of one sorted line, record by record."""
    rows = sorted(rows, key=lambda r: (r["key"], r["text_hash"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
    goal = sum(r["size"] for r in rows) / shards
    begin = np.concatenate(([0], np.cumsum([r["size"] for r in rows])))
    group = defaultdict(list)
    for k, r in enumerate(rows):
        group[r["text_hash"]].append(k)
    out, slot = Counter(), Counter()
    for k, r in enumerate(rows):
        own = group[r["text_hash"]]
        size = begin[own[-1] + 1] - begin[own[0]]
        middle = begin[own[0]] + size / 2 if size <= whole * goal else begin[k] + r["size"] / 2
        shard = min(shards - 1, int(middle / goal))
        out[r["doc_id"], r["size"], shard, slot[shard]] += 1
        slot[shard] += 1
    return out


def test_shards_are_those_of_one_sorted_line(spark):
    """Small groups stay together, a hot text and a record longer than a shard are cut where the line says."""
    words = [f"text number {k} " * (1 + k % 17) for k in range(900)]
    texts = words + words[:40] * 3 + ["a hot text"] * 1500 + ["long " * 4000, "", None, None]
    docs = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for shards, whole in ((8, 0.01), (5, 0.02), (40, 0.01)):
        got = Counter((r.doc_id, r["size"], r.shard, r.slot) for r in sharding.shard_by_bytes(docs, shards, whole).collect())
        assert got == line(sharding.records(docs).collect(), shards, whole)


def test_overfull_ranges_are_subdivided_to_single_keys(spark):
    """Rows of equal id and text cannot be parted; all else ends in ranges of at most twice their share."""
    docs = spark.createDataFrame([(7, "the same row")] * 3000 + [(k, f"other {k}") for k in range(300)], "doc_id long, text string")
    rows = sharding.records(docs)
    total = rows.groupBy().sum("size").first()[0]
    _, found = sharding.splitters(rows, total, 50)
    assert all(r["bytes"] <= 2 * total / 50 or r["first"] == r["last"] for r in found) and sum(r["rows"] for r in found) == 3300


def test_a_range_without_sampled_keys_is_still_parted():
    assert list(sharding._closer(np.zeros(0, np.int64), 4, -10, 10)) == [0, 1]
    assert list(sharding._closer(np.array([5, 5, 5], np.int64), 4, 5, 9)) == [6]
    assert list(sharding._closer(np.array([9, 9, 9], np.int64), 4, 5, 9)) == [9]


def test_quality_base_columns_against_a_plain_version(spark):
    """Equal lines with and without a word, odd white space, repeated windows, symbols, null and empty texts."""
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b", "#tag", "x*y", "\u00fcber", "\u3000", "A", "$%&", "|<>", "\x85"]
    space = [" ", "\n", "\n", "\t", "\r\n", "\x0b", "\n \n", "  "]
    made = ["".join(vocabulary[i % 10] + space[j % 8] for i, j in rng.integers(0, 40, (n, 2))) for n in (0, 1, 3, 20, 60, 200, 400)]
    made += [None, "", "\n\n\n", "one\none\none ", "one two three\n" * 30, "a b a b a b", " \n \n"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for k, text in enumerate(made):
        text = text or ""
        word = "[^\x20\x09-\x0d]+"
        words = re.findall(word, text)
        seen, twice = set(), 0
        for line_ in text.split("\n"):
            if re.search(word, line_):
                twice += line_ in seen
                seen.add(line_)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(windows)
        repeated = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(repeated))
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == want, (k, text)
        assert got[k].base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
