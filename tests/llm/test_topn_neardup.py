import html
import random
import re
import unicodedata

import pytest

from strataloom.llm import neardup, topn


def plain(text):
    text = html.unescape(re.sub(r"<[^>]*>", "", text)).lower()
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


def test_top_n_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(f"a{k}", rng.choice(["hot"] * 5 + ["x", "y", "z", None]), rng.choice([0, 0, 0, 1, 7, None]), k, "extra") for k in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, questionid string, voteupcount long, captureseq long, place_ string").repartition(7)
    got = {(r.questionid, r.id, r.place) for r in topn.top_n_per_group(df, "questionid", "voteupcount", "captureseq", 10).collect()}
    want = set()
    for q in {r[1] for r in rows} - {None}:
        best = sorted((r for r in rows if r[1] == q), key=lambda r: (-(r[2] or 0), r[3]))[:10]
        want |= {(q, r[0], k + 1) for k, r in enumerate(best)}
    assert got == want


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "id string, questionid string, voteupcount long, captureseq long")
    assert topn.top_n_per_group(df, "questionid", "voteupcount", "captureseq", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "questionid", "voteupcount", "captureseq", 0)


def _texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    rows, n = [], 0
    for family in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(25, 120))]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 14)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((str(1000 + n), "<p>" + " ".join(text) + "&amp;</p>"))
            n += 1
    rows += [("9001", None), ("9002", ""), ("9003", "short"), (None, rows[0][1]), ("9004", rows[0][1]), ("9004", rows[0][1])]
    return rows


def brute(rows):
    shapes = {}
    for i, t in rows:
        if i and t and len(p := plain(t)) >= 80:
            shapes.setdefault(i, []).append({p[k : k + 10] for k in range(len(p) - 9)})
    ids, out = sorted(shapes), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(len(s & t) >= 0.6 * len(s | t) for s in shapes[a] for t in shapes[b]):
                out.add((a, b))
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = _texts()
    df = spark.createDataFrame(rows, "id string, content string").repartition(3)
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df).collect()}
    want = brute(rows)
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 60


def test_tables_too_large_for_a_task_lose_nothing(spark, monkeypatch):
    rows = _texts()
    df = spark.createDataFrame(rows, "id string, content string")
    usual = set(map(tuple, neardup.near_duplicate_pairs(df).collect()))
    monkeypatch.setattr(neardup, "IN_TASK", 1)
    # the workers see the changed value through the closure of the module only if they fork anew; _collide is called here
    import numpy as np

    key = np.array([1, 1, 1, 2], dtype=np.int64)
    second = np.zeros((4, neardup.SIDE), dtype=np.uint16)
    a, b, later = neardup._collide(key, np.array([5, 6, 7, 8], dtype=np.int64), second)
    assert not len(a) and len(later) == 3 * neardup.SIDE
    assert usual
    # the same pairs where every table goes through Spark's join
    assert set(map(tuple, neardup.near_duplicate_pairs(df, in_task=1).collect())) == usual


def test_copies_beyond_the_limit_form_a_star(spark):
    text = "the same long text about nothing in particular " * 4
    df = spark.createDataFrame([(f"{k}", text) for k in range(6)], "id string, content string")
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, expand=3).collect()}
    assert got == {("0", str(k)) for k in range(1, 6)}


def test_groups(spark):
    rows = _texts()
    df = spark.createDataFrame(rows, "id string, content string")
    pairs = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(df).collect()}
    for a, b in pairs:
        assert groups[a] == groups[b] == root(a)
    assert sum(k == v for k, v in groups.items()) == len({root(i) for i in groups})


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert neardup.near_duplicate_pairs(df).count() == 0
    assert neardup.near_duplicate_groups(df).count() == 0
