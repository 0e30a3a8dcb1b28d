import random

import pytest

from strataloom.llm import split


def units(text):
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def check(text, most, overlap):
    parts = split.cuts(text, most, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(parts, parts[1:]):
        assert a < c <= b < d
        assert units(text[c:b]) <= 2 * overlap
    assert all(units(text[a:b]) <= most for a, b, _ in parts)
    return parts


def prose(seed, sentences):
    rng = random.Random(seed)
    out = []
    for k in range(sentences):
        out.append("".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳") for _ in range(rng.randint(8, 40))) + rng.choice("。！？"))
        if rng.random() < 0.2:
            out.append("\n\n")
    return "".join(out)


@pytest.mark.parametrize("most,overlap", [(400, 0), (400, 40), (1000, 100), (4000, 200)])
def test_pieces_cover_the_text_within_the_limit(most, overlap):
    for seed in range(6):
        text = prose(seed, 400)
        parts = check(text, most, overlap)
        assert all(r >= split.SENTENCE for _, _, r in parts)
        assert len(parts) <= 1 + 3.2 * units(text) / most


def test_no_character_is_split():
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    for unit in (family, "\U0001f1e8\U0001f1f3", "é̂", "\r\n", "&nbsp;", "😀"):
        text = unit * 900
        parts = check(text, 400, 40)
        for a, b, _ in parts:
            assert text[a:b].count(unit) * len(unit) == b - a


def test_an_edit_alters_only_neighbouring_pieces():
    text = prose(3, 1500)
    changed = text[:20000] + "改动" + text[20000:]
    before = {text[a:b] for a, b, _ in split.cuts(text, 1000, 100)}
    after = {changed[a:b] for a, b, _ in split.cuts(changed, 1000, 100)}
    assert len(before - after) <= 6 < len(before)


def test_html_is_not_cut_inside_tags():
    text = "<p class='a b'>" + "字" * 50 + "</p>" + ("<p data-x='1 2 3'>" + "词" * 90 + "。</p>") * 60
    for a, b, _ in check(text, 500, 50):
        assert text[:b].count("<") == text[:b].count(">")


def test_operator(spark):
    rows = [("1", "x" * 5000), ("2", "短"), ("3", None), ("4", ""), ("5", "a b " * 2000), ("5", "a b " * 2000)]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("piece", split.F.lit(9)).withColumnRenamed("id", "key id")
    got = split.split_oversized(df, ["key id"], "content", 400, 40).collect()
    by = {}
    for r in got:
        by.setdefault(r["key id"], []).append(r)
    assert set(by) == {"1", "2", "4", "5"}
    assert by["1"][0].longest_run == 5000 and {r.cut for r in by["1"]} == {"forced", "end"}
    assert by["5"][0].longest_run == 1 and {r.cut for r in by["5"]} == {"word", "end"}
    assert by["2"][0].piece_text == "短" and by["4"][0].end_unit == 0
    assert split.split_oversized(df.limit(0), ["key id"], "content", 400, 40).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(df, ["key id"], "content", 100, 60)
