import pytest

from strataloom.llm import quality as q

PROSE_ZH = "周末我们去河边走了一圈，天气比想象的好。\n\n回来以后他说，下次还是早一点出发，因为路上的人太多了。"
PROSE_EN = "We walked along the river on Sunday, and the weather was better than I had thought.\nOn the way back he said that we should leave earlier next time."


@pytest.mark.parametrize(
    "text,form",
    [
        (PROSE_ZH, "prose"),
        (PROSE_EN, "prose"),
        ("", "prose"),
        ("# 标题\n\n## 1. 某人 · 3\n\n" + PROSE_ZH, "prose"),
        (PROSE_ZH.replace("，", " ").replace("。", " ").replace("\n", " "), "prose"),
        ("- 苹果\n- 梨子的价格\n- 香蕉\n  - 大的香蕉", "list"),
        ("1. bread\n2. butter\n3. milk", "list"),
        ("[ ] 买菜\n[x] 做饭\n[ ] 洗碗", "list"),
        ("apples .... 3\npears ........ 5\nplums ....... 9", "list"),
        ("[河流](https://a.example/1)\n[山](https://a.example/2)\n[云](https://a.example/3)", "list"),
        ("苹果的价格\n梨\n很大的香蕉\n葡萄：酸葡萄\n桃", "list"),
        ("name\tsize\tprice\nbread\t3\t9\nmilk\t\t2", "table"),
        ("名称,数量,价格\n面包,3,9\n牛奶,,2", "table"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", "table"),
        ("名称      数量      价格\n面包      3       9\n牛奶      4       2", "table"),
        ("名称：面包\n数量：3\n价格：9\n名称：牛奶\n数量：4\n价格：2", "table"),
        ("首页 | 登录 | 注册 | 分享 | 下一页 | Privacy", "junk"),
        ("å¹´è½»äººå½\x93æ\x97¶å\x8fªæ\x87\x82å\x8c\x96ç\x9f³", "junk"),
        ("哈" * 60, "junk"),
        ("第 1 页\n====\n第 2 页\n----\nPage 3 of 9", "junk"),
        ("river stone bread engine lamp paper cloud hammer violin carpet", "junk"),
        ("河流 石头 面包 引擎 台灯 纸张 云朵 锤子 提琴 地毯", "junk"),
    ],
)
def test_forms(text, form):
    assert q.form_of(text)[0] == form


def test_majority_decides():
    assert q.form_of(PROSE_ZH + "\n\n- 甲\n- 乙")[0] == "prose"
    assert q.form_of("- 苹果很大\n" * 40 + "\n" + PROSE_ZH)[0] == "list"


def test_statistics_and_reasons(spark):
    rows = [(1, PROSE_EN + "\nA friend of ours had been there with her dog in the spring, when the water was still high.\nIt is a good place to sit and read.", "x"), (2, "", "x"), (3, None, "x"), (4, "- a\n- b\n- c", "x"), (4, "- a\n- b\n- c", "x"), (5, "字" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = {r.doc_id: r for r in q.quality_statistics(df, "doc_id", "text").collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1].failures == [] and got[1].form == "prose" and got[1].stop_words >= 2
    assert "few_words" in got[2].failures and got[2].word_count == 0
    assert "bullet_lines" in got[4].failures and "list_chars" in got[4].failures
    assert "many_words" in got[5].failures and got[5].form == "junk"
    assert q.document_forms(df.limit(0), "doc_id", "text").count() == 0


def test_every_form_has_a_failed_rule():
    texts = [PROSE_ZH, PROSE_EN, "- 苹果\n- 梨子的价格\n- 香蕉", "| a | b |\n| --- | --- |\n| 1 | 2 |", "哈" * 60, "河流 石头 面包 引擎 台灯 纸张 云朵 锤子 提琴 地毯", ""]
    found = q.statistics(texts)
    assert [f == "prose" or bool(x) for f, x in zip(found["form"], found["failures"])] == [True] * len(texts)
    assert found["form"] == ["prose", "prose", "list", "table", "junk", "junk", "prose"]


def test_sentences_that_many_texts_share_are_notices(spark):
    notice = "请先更新您的程序版本。\n这里的内容现在还不能显示。\n稍后再来看看吧，谢谢。"
    rows = [(k, f"{notice}\n编号{k}的页面。") for k in range(6)] + [(10 + k, PROSE_ZH) for k in range(300)] + [(400, notice + "\n\n" + PROSE_ZH * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.form, r.failures) for r in q.document_forms(df, "doc_id", "text").collect()}
    assert all(got[k][0] == "junk" and "junk_chars" in got[k][1] for k in range(6))
    assert all(got[10 + k][0] == "prose" for k in range(300)) and got[400][0] == "prose"
    assert len(q.frequent_lines(df.where("doc_id >= 10"), "text")) == 0  # three hundred copies are one text
