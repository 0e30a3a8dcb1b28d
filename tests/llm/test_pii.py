import itertools

import pytest

from strataloom.llm import pii, pii_samples


def test_held_out_accuracy():
    common = pii_samples.common()
    hits = wrong = missed = 0
    for text, truth in pii_samples.documents(300, seed=99):
        got = {(kind, start) for kind, start, _, _ in pii.find_in(text, common)}
        truth = {(kind, start) for kind, start, _ in truth}
        hits += len(got & truth)
        wrong += len(got - truth)
        missed += len(truth - got)
    assert hits / (hits + wrong) > 0.97 and hits / (hits + missed) > 0.97


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to ada\\.l@post\\.example today.", [("email", "ada")]),
        ("mail ada at post dot example now", [("email", "ada")]),
        ("mail ada \\(at\\) post\\.example now", [("email", "ada")]),
        ("mail ada&#64;post.example now", [("email", "ada")]),
        ("<a href=\"mailto:ada@post.example\">ada@post.example</a>", [("email", "ada@post.example\">"), ("email", "ada@post.example</")]),
        ("电话\\(0199\\) 5550314，下午都在。", [("phone", "(0199")]),
        ("Call me (07700 900166) now", [("phone", "07700")]),
        ("加我，微信同号１６９３６０２６６９９。", [("phone", "１６９")]),
        ("电话一六四七八二九一八八九，晚上别打", [("phone", "一六四")]),
        ("the line, 1\\-555\\-555\\-0189 ext\\. 62, is busy", [("phone", "1\\-555")]),
        ("订单号205769542665608899查不到物流。", []),
        ("身份证号339965 19590316 4410被抄了。", [("idnum", "339965")]),
        ("I live at Flat 2, 26 Tallow Lane, Ashcombe Vale QX6 4ZZ.", [("address", "Flat 2")]),
        ("我住鹤川省临渡市鹿鸣县柳荫路212号9栋，欢迎。", [("address", "鹤川省")]),
        ("He saw 29 kinds of road last year.", []),
        ("Dr. Zelda Brackwell explained it best.", [("person", "Zelda")]),
        ("Parcel for Netherby, Rowan, 68 Sallowfield Drive.", [("person", "Netherby"), ("address", "68 ")]),
        ("Professor Netherby said so. Mossgrave Analytics published a chart.", []),
        ("@northfox317 装的是 parser@6.24.1 那个包。", []),
    ],
)
def test_places(text, want):
    got = [(kind, start) for kind, start, _, _ in pii.find_in(text)]
    places, at = [], 0
    for kind, mark in want:
        at = text.index(mark, at)
        places.append((kind, at))
        at += 1
    assert sorted(got) == sorted(places)


def test_repeats_share_their_label():
    items = [pii.Candidate(0, 5, "person", "en_name", "ada lovel", ["weak"]), pii.Candidate(500, 505, "person", "en_name", "ada lovel", ["sure"])]
    pairs = pii.np.zeros(pii.Graph.PAIRS)
    pairs[36], pairs[37] = 2.0, -2.0
    field = pii.Field({("person", "weak"): -0.5, ("person", "sure"): 4.0}, pairs)
    alone = field.marginals(items[:1])[0]
    assert alone < 0.5 < field.marginals(items)[0]
    assert abs(field.without_skip().marginals(items)[0] - alone) < 1e-9


def _enumerated(field, items):
    """Marginals of the readings by summing over all states."""
    np = pii.np
    graph = pii.Graph([items])
    own = np.full((len(graph.labels), pii.Graph.STATES), -np.inf)
    own[:, 0] = 0.0
    own[graph.node, graph.state] = [field.score(c) for c in items]
    weight, total = np.zeros(own.shape), 0.0
    for state in itertools.product(*[np.flatnonzero(np.isfinite(row)) for row in own]):
        p = np.exp(sum(own[k, x] for k, x in enumerate(state)) + sum(field.pairs[graph.slot[e, state[i], state[j]]] for e, (i, j) in enumerate(zip(graph.one, graph.two))))
        total += p
        for k, x in enumerate(state):
            weight[k, x] += p
    return (weight / total)[graph.node, graph.state]


def test_messages_are_exact_on_a_tree():
    np = pii.np
    rng = np.random.default_rng(3)
    items = [pii.Candidate(10 * k, 10 * k + size, "person", "zh_name", f"{k}{size}", [f"f{k}{size}"]) for k in range(5) for size in (2, 3)]
    pairs = rng.normal(size=pii.Graph.PAIRS)
    field = pii.Field({("person", c.features[0]): float(rng.normal()) for c in items}, pairs)
    assert np.allclose(field.marginals(items, rounds=80), _enumerated(field, items), atol=1e-6)


def test_overlapping_readings_exclude_each_other():
    items = [pii.Candidate(0, 3, "person", "zh_name", "温岑朔", ["a"]), pii.Candidate(1, 3, "person", "zh_name", "岑朔", ["b"])]
    pairs = pii.np.zeros(pii.Graph.PAIRS)
    pairs[-1] = pii.EXCLUDE
    got = pii.Field({("person", "a"): 3.0, ("person", "b"): 2.0}, pairs).marginals(items)
    assert got[0] > 0.6 > 0.4 > got[1] and got.sum() < 1.01


def test_skip_factors_find_what_no_context_tells():
    """Phrases the training never has: a name of common characters is introduced once and then comes back without a cue."""
    common = pii.Commonness("".join(sorted(set(pii_samples.common()) | pii.COMMON_ZH | set("国建明军志海天小子雨强高平方云"))), pii_samples.WORDS)
    field = pii.trained()
    lost = 0
    for text, name in (
        ("联系人马小云。马小云不太懂。", "马小云"),
        ("署名：严正行。这本书里严正行提到很多。", "严正行"),
        ("我叫高明，做这行八年。天气不错。听说高明去了北边工作。", "高明"),
        ("我跟王大海聊过。人人都说王大海好。", "王大海"),
    ):
        full = [text[a:b] for kind, a, b, _ in pii.find_in(text, common, field=field)]
        bare = [text[a:b] for kind, a, b, _ in pii.find_in(text, common, field=field.without_skip())]
        assert full.count(name) == 2
        lost += full.count(name) - bare.count(name)
    assert lost >= 3


def test_many_items_on_one_place_and_none():
    assert pii.find_each(["", "无", "赵" * 400]) is not None
    assert pii.Field({}, pii.np.zeros(pii.Graph.PAIRS)).marginals([]).shape == (0,)


def test_operator_and_replacement(spark):
    rows = [("1", "电话0199-5550314，找我。"), ("2", None), ("3", ""), ("3", "x" * 200_000 + " ada@post.example"), ("4", "无"), ("4", "无")]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("kind", pii.F.lit("x"))
    got = {(r.id, r.kind, r.start_pos) for r in pii.personal_items(df, ["id"], "content", "").collect()}
    assert got == {("1", "phone", 2), ("3", "email", 200_001)}
    clean = {r.id: r.clean for r in pii.redact(df.where("id in ('1', '4')"), ["id"], "content", "").collect()}
    assert clean == {"1": "电话[PHONE]，找我。", "4": "无"}
    assert pii.personal_items(df.limit(0), ["id"], "content", "").count() == 0
    assert "的" in pii.common_characters(df.select("content"))


@pytest.mark.parametrize("name", ["李国强", "陈天明", "王建军", "周小雨"])
def test_names_of_common_given_characters(name):
    common = pii.Commonness("".join(sorted(set(pii_samples.common()) | pii.COMMON_ZH | set("国建明军志海小天子雨强"))), pii_samples.WORDS)
    for text in (f"昨天{name}没有来。", f"我跟{name}聊过。", f"当时{name}在场。"):
        assert [(kind, text[a:b]) for kind, a, b, _ in pii.find_in(text, common)] == [("person", name)]
    assert pii.find_in("周末打算去爬山，水平不高。", common) == []


def test_a_text_copied_to_a_third_of_the_rows_makes_nothing_common(spark):
    rng = pii.np.random.default_rng(5)
    others = ["".join(chr(0x5000 + k) for k in rng.integers(0, 4000, 40)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in ["我跟秦珩栖聊过。"] * 100 + others], "content string")
    common = pii.commonness(df)
    assert "珩" not in common.characters and "栖" not in common.characters and "秦珩" not in common.words
    once = pii.commonness(df.distinct())
    assert once == common


def test_nothing_is_found_inside_a_mail_address_among_hundreds():
    text = "".join(f"mail ada{k}@post.example or 159-1234-{k:04d}@post.example now. " for k in range(500))
    got = pii.find_in(text)
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
