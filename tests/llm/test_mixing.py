import random

import numpy as np
import pytest

from strataloom.llm import mixing

WORDS = {"a": ["river", "stone", "cloud"], "b": ["bread", "butter", "oven"], "c": ["piano", "violin", "chord"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(900):
        source = rng.choice("aaaaabbbc")
        text = " ".join(rng.choice(WORDS[source]) for _ in range(rng.randint(5, 80)))
        rows.append((k, text, None if rng.random() < 0.1 else source))
    rows += [(1000 + k, "left out", "other") for k in range(20)] + [(2000, None, "a"), (2001, "", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_met(spark, docs):
    got = {r.source: r for r in mixing.shares(docs, targets(spark, [("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.28, 4), ("none", 0.02, 2)])).collect()}
    assert got["none"].tokens == 0
    for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.28)):
        assert abs(got[s].reached_share - share / 0.98) < 0.01
        assert got[s].most_copies <= got[s].max_repeats


def test_documents_without_a_source_are_judged(spark, docs):
    rows = mixing.mix(docs, targets(spark, [("a", 0.3, 2), ("b", 0.3, 3), ("c", 0.4, 3)])).join(docs.select("doc_id", "text"), "doc_id").collect()
    judged = [r for r in rows if r.source is None and r.tokens > 5]
    wrong = [(r.domain, r.text) for r in judged if r.text.split()[0] not in WORDS[r.domain]]
    assert judged and not wrong
    assert all(r.copies >= 1 for r in rows) and not any(r.source == "other" for r in rows)
    assert all(r.domain == r.source for r in rows if r.source)


def test_moves_are_projected():
    p, cap = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([1.0, 2.0])
    assert np.allclose(mixing.rates(p, cap, np.array([3.0, 3.0]), [np.array([0.5, 0.0]), np.array([5.0, 5.0])]), [0.0, 0.0])
    assert np.allclose(mixing.rates(p, cap, np.array([3.0, 3.0]), [np.array([0.5, 0.0])]), [0.5, 1.75])


def test_nothing(spark, docs):
    aims = targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert mixing.mix(docs.limit(0), aims).count() == 0
    assert mixing.mix(docs, targets(spark, [])).count() == 0
    assert [r.tokens for r in mixing.shares(docs.limit(0), aims).collect()] == [0, 0]


def test_posteriors_of_all_documents_change_rates(spark):
    rng = random.Random(9)
    rows = []
    for k in range(900):
        kind = rng.choice("aab")
        text = " ".join(rng.choice(WORDS[kind]) for _ in range(40))
        # a third of the documents of the one kind are named after the other
        rows.append((k, text, "a" if kind == "b" and rng.random() < 0.33 else kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    aims = targets(spark, [("a", 0.4, 2), ("b", 0.6, 3)])
    named, soft = (mixing.Mix(docs, aims, "doc_id", "text", "source", trust) for trust in (1.0, 0.2))
    assert soft.rounds > 1 and abs(soft.expected / soft.expected.sum() - [0.4, 0.6]).max() < 0.005
    one, two = ({r.key: r.rate for r in m.copies.collect()} for m in (named, soft))
    false = [k for k, text, source in rows if source == "a" and text.split()[0] in WORDS["b"]]
    true = [k for k, text, source in rows if source == "a" and text.split()[0] in WORDS["a"]]
    mean = lambda rate, keys: sum(rate.get(k, 0.0) for k in keys) / len(keys)
    assert abs(mean(one, false) - mean(one, true)) < 1e-6
    assert mean(two, false) > 1.3 * mean(two, true)


def test_rounding_factors_stay_close_to_one(spark, docs):
    fitted = mixing.Mix(docs, targets(spark, [("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 4)]), "doc_id", "text", "source")
    assert fitted.rounds >= 1 and abs(fitted.scale - 1).max() < 0.15 and fitted.accuracy > 0.95
