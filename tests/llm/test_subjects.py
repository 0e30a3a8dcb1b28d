import random
from collections import Counter

import pytest

from strataloom.llm import mining
from strataloom.llm import subjects as S

WORDS = {
    "sea": ["珊瑚礁", "潮汐", "灯塔", "coral reef", "lighthouse", "tide"],
    "clock": ["钟摆", "齿轮箱", "发条", "pendulum", "gearbox", "mainspring"],
    "farm": ["拖拉机", "稻田", "谷仓", "tractor", "paddy", "barn"],
}
AREAS = sorted(WORDS)


def sentence(rng, area):
    latin = rng.random() < 0.4
    a, b = rng.sample([w for w in WORDS[area] if w[0].isascii() == latin], 2)
    if latin:
        return rng.choice([f"My friend thinks the {a} is better than the {b}. ", f"Keep the {a} away from the {b}, he said. "])
    return rng.choice([f"先把{a}和{b}的关系弄清楚。", f"当时{a}其实比{b}更重要。", f"他说{b}会拖累{a}。"])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    samples = []
    for k in range(900):
        area = AREAS[k % 3]
        text = sentence(rng, area) + sentence(rng, area)
        # the samples hold back one word of each area
        if WORDS[area][0] not in text and WORDS[area][3] not in text:
            samples.append((k, text, [area]))
    texts = ["".join(sentence(rng, area) for _ in range(8)) for area in AREAS for _ in range(150)]
    df = spark.createDataFrame(samples, "sample_id long, text string, subjects array<string>")
    return df, spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.fixture(scope="module")
def fitted(spark, tables):
    return S.fit_rules(spark, *tables, AREAS)


def test_without_mined_rules_there_is_none(spark, tables, monkeypatch):
    monkeypatch.setattr(S, "mine", lambda *a: {})
    rules = S.fit_rules(spark, *tables, AREAS)
    assert not rules.single and not rules.double and not rules.terms


def test_mined_sets_are_those_of_brute_force(spark):
    rng = random.Random(5)
    terms, classes = 12, 3
    rows = []
    for _ in range(400):
        items = sorted(rng.sample(range(terms), rng.randint(1, 6)))
        rows.append((rng.randrange(classes), items, list(range(0, 10 * len(items), 10)), [2] * len(items)))
    packed = []
    for part in (rows[:150], rows[150:151], rows[151:]):
        block = mining.Block(*(S.np.array(x) for x in ([r[0] for r in part], [len(r[1]) for r in part], [x for r in part for x in r[1]], [x for r in part for x in r[2]], [x for r in part for x in r[3]])))
        packed.append((True, *block.packed()))
    df = spark.createDataFrame(packed, "taught boolean, label binary, lengths binary, items binary, starts binary, sizes binary").repartition(3)
    want = {}
    for label, items, _, _ in rows:
        for body in [(a,) for a in items] + [(a, b) for a in items for b in items if a < b]:
            want.setdefault(body, S.np.zeros(classes))[label] += 1
    got = S.mine(df, S.np.full(terms, -1, dtype=S.np.int32), S.np.arange(terms), list(range(10)), classes, 15)
    kept = {b: row for b, row in want.items() if row.sum() >= 15 and max(b) < 10}
    assert got.keys() == kept.keys() and all((got[b] == kept[b]).all() for b in got)


def test_vocabulary_counts_all_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(1, 30))) + "。" + " ".join(rng.choice(["ant", "bee", "cat", "the"]) for _ in range(6)) for _ in range(200)]
    want = Counter()
    for t in texts:
        han, latin = t.split("。")
        want.update(han[k : k + 2] for k in range(len(han) - 1))
        words = latin.split()
        want.update(w for w in words if w != "the")
        want.update(f"{a} {b}" for a, b in zip(words, words[1:]) if "the" not in (a, b))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").repartition(3)
    words = mining.vocabulary(df, 0.0, 20)
    got = dict(zip(words.terms, words.frequency.tolist()))
    assert all(got[t] == n for t, n in want.items() if n >= 20 and t[0] <= "z")
    assert got and all(want[t] == n for t, n in got.items() if len(t) == 2 and t[0] > "z")


def test_evidence_is_capped_by_held_out_samples():
    rules = S.Rules(["a", "b"], ["alpha"], {0: (0, 4.5)}, {})
    held = [("alpha", {0})] * 30 + [("alpha", {1})] * 10
    assert abs(S.calibrated(rules, held).single[0][1] - S.np.log(31 / 11)) < 1e-9
    assert S.calibrated(rules, held[:5]).single[0][1] == 4.5


def test_held_out_texts_and_words_missing_from_the_samples(fitted):
    rng = random.Random(8)
    matcher = fitted.matcher()
    for area in AREAS:
        for _ in range(40):
            text = "<p>" + sentence(rng, area) + "</p>天气不错。" + sentence(rng, area)
            assert [fitted.areas[k] for k in S.areas_of(fitted, matcher, text)] == [area]
    known = {fitted.terms[k]: fitted.areas[a] for k, (a, _) in fitted.single.items()}
    assert known.get("珊瑚礁") == "sea" and known.get("coral reef") == "sea"


def test_a_third_of_the_sentences_counts(fitted):
    matcher = fitted.matcher()
    sea, clock = "先把潮汐和灯塔的关系弄清楚。", "他说钟摆会拖累发条。"
    assert len(S.areas_of(fitted, matcher, sea * 2 + clock)) == 2
    assert len(S.areas_of(fitted, matcher, sea * 3 + clock)) == 1
    assert S.areas_of(fitted, matcher, "天气不错。") == []
    assert len(S.title_areas(fitted, matcher, "潮汐和钟摆有什么区别？")) == 2


def test_operator(spark, fitted):
    df = spark.createDataFrame([("1", "先把潮汐和灯塔的关系弄清楚。"), ("2", None), ("3", ""), ("4", "他说" * 50_000)], "id string, content string").withColumn("subject", S.F.lit("x"))
    got = [(r.id, r.subject) for r in S.subject_areas(df, ["id"], "content", fitted).collect()]
    assert got == [("1", "sea")]
    assert S.subject_areas(df.limit(0), ["id"], "content", fitted).count() == 0


def test_long_unpunctuated_text_is_cut():
    parts = S.spans("字" * 1000)
    assert parts[0][0] == 0 and parts[-1][1] == 1000 and all(b - a <= 40 for a, b in parts)
