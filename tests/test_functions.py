import pytest
from pyspark.sql import functions as F

from strataloom.functions import html, urls
from strataloom.functions import text as tx


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("a &amp;lt; b", "a &lt; b"),
        ("&#65;&#x42;&#X43;&NBSP;x", "ABC x"),
        ("&#128512;&middot;&copy;", "😀&middot;&copy;"),
        ("&#99999999999;&#xD800;&#1114112;", "&#99999999999;&#xD800;&#1114112;"),
        ("plain & simple", "plain & simple"),
        (None, None),
    ],
)
def test_entities(spark, text, want):
    assert value(spark, tx.decode_entities("t"), text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>a</p><p>b &lt;script&gt;</p>", "a\nb &lt;script&gt;"),
        ("<script>x</script ><STYLE>y</STYLE>z", "z"),
        ("a<br />b<br>c", "a\nb\nc"),
        ("\ufeff a \u3000", "a"),
        (None, ""),
        ("", ""),
    ],
)
def test_strip(spark, text, want):
    assert value(spark, tx.strip_html("t"), text) == want


def test_clean_undoes_the_escape(spark):
    assert value(spark, tx.clean_text("t"), "<p>1 &lt; 2 &amp; 3\x07</p>") == "1 < 2 & 3"


def test_lengths_and_runs(spark):
    assert value(spark, tx.utf16_length("t"), "a😀") == 3
    assert value(spark, tx.longest_backtick_run("t"), "a``b```c") == 3
    assert value(spark, tx.longest_backtick_run("t"), "") == 0
    assert [value(spark, tx.count_lines("t"), x) for x in (None, "", "a", "a\n")] == [0, 0, 1, 2]
    assert value(spark, tx.collapse_whitespace("t"), "\u00a0a \n\t b\u3000") == "a b"


@pytest.mark.parametrize("text,want", [("===", "\\==="), ("  == ", "\u00a0 \\== "), ("    code", "\u00a0   code"), ("a\n\tb", "a\n\u00a0b"), ("== a", "== a")])
def test_lines(spark, text, want):
    assert value(spark, tx.neutralize_lines("t"), text) == want


def test_markdown_escape(spark):
    assert value(spark, tx.escape_markdown("t"), "a_b [c]\x07") == "a\\_b \\[c\\]\ufffd"
    assert html.escape_text("a_b [c]\x07\n  ==") == value(spark, tx.escape_markdown("t"), "a_b [c]\x07\n  ==")


def test_ids_and_numbers(spark):
    assert [value(spark, tx.question_id("t"), x) for x in ("123", "https://qa.example/question/45/answer/6", "question/x", " 7 ")] == ["123", "45", None, "7"]
    assert value(spark, tx.valid_id("t"), "123456789012345678901") is False
    assert [value(spark, tx.numeric_or("t", -1.0), x) for x in (" 12 ", "1e3", "x", None, "Infinity")] == [12.0, 1000.0, -1.0, -1.0, -1.0]


def test_times(spark):
    got = spark.createDataFrame([(0,), (None,), (1700000000,)], "t long").select(tx.format_time("t").alias("x")).collect()
    assert [r.x for r in got] == ["(未知)", "(未知)", "2023/11/15 06:13:20"]


@pytest.mark.parametrize(
    "raw,reason",
    [
        ("https://ok.example/a?b=1#c", "https_public"),
        ("https://例子.example/", "https_public"),
        ("https://8.8.8.8/", "https_public"),
        ("https://link.example/?target=https%3A%2F%2Fok.example%2F", "redirect_target:https_public"),
        ("http://ok.example/", None),
        ("https://u:p@ok.example/", None),
        ("https://localhost./", None),
        ("https://a.localhost/", None),
        ("https://127.0.0.1/", None),
        ("https://0x7f.1/", None),
        ("https://0177.0.0.1/", None),
        ("https://2130706433/", None),
        ("https://192.0.200.1/", None),
        ("https://100.64.0.1/", None),
        ("https://[::1]/", None),
        ("https://[::ffff:7f00:1]/", None),
        ("https://[fc00::1]/", None),
        ("https://link.example/", None),
        ("https://link.example/?target=http%3A%2F%2Fok.example%2F", None),
        ("https://ok.example/\x07", None),
        ("javascript:alert(1)", None),
        ("https://", None),
        ("", None),
        (None, None),
    ],
)
def test_addresses(raw, reason):
    got = urls.classify(raw)
    assert (got and got["reason"]) == reason


def test_bare_addresses():
    spans = urls.tokenize("see (https://a.example/x_(y)), https://b.example。 end")
    assert [t for k, t in spans if k == "url"] == ["https://a.example/x_(y)", "https://b.example"]
    assert "".join(t for _, t in spans) == "see (https://a.example/x_(y)), https://b.example。 end"


def test_images():
    assert urls.classify_image("https://pic1.img.example/a.jpg")["clickable"]
    assert not urls.classify_image("http://pic1.img.example/a.jpg")["clickable"]
    assert urls.classify_image("https://img.example.evil.example/a.jpg")["reason"] == "other_host"
    assert urls.classify_image("data:image/png;base64,xx") is None
    assert urls.classify_image("https://")["reason"] == "unparsable"
    assert urls.safe_destination('https://a.example/(x) "y"') == "https://a.example/%28x%29%20%22y%22"


def test_answer_addresses():
    ok = "https://qa.example/question/1/answer/2"
    assert urls.classify_answer(ok + "/", "1", "2") == "ok"
    assert urls.classify_answer(ok, "1", "3") == "path_mismatch"
    assert urls.classify_answer("https://qa.example.evil.example/question/1/answer/2", "1", "2") == "host_not_site"
    assert urls.classify_answer("https://qa.example:8443/question/1/answer/2", "1", "2") == "port_not_https"
    assert urls.classify_answer("http://qa.example/question/1/answer/2", "1", "2") == "protocol_not_https"
    assert urls.classify_answer(None, "1", "2") == "url_missing"


@pytest.mark.parametrize(
    "source,want",
    [
        ("<p>one</p><p>two</p>", "one\n\ntwo"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<b>x</b><i> y </i>", "**x***y*"),
        ("<h1>t</h1><h6>u</h6>", "### t\n\n###### u"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ('<ol start="9"><li>a<p>b</p></li><li>c</li></ol>', "9. a\n   b\n10. c"),
        ("<blockquote>a<p>b</p></blockquote>", "> a\n>\n> b"),
        ("<pre><code class='language-py'>a\nb</code></pre>", "``` py\na\nb\n```"),
        ("<pre>x ``` y</pre>", "````\nx ``` y\n````"),
        ("<code>a`b</code>", "``a`b``"),
        ("<code></code>", "`  `"),
        ("<a href='https://ok.example/'>here</a>", "原文链接文字：here\n[打开外部链接 · ok.example](https://ok.example/)"),
        ("<a href='javascript:x'>here</a>", "原文链接文字：here"),
        ("<img alt=' cat '><img>", "[图片：cat][图片]"),
        ("<figure><img src='x'><figcaption>cap</figcaption></figure>", "[图片]\n\ncap"),
        ("<script>x</script><iframe>text</iframe>", "text"),
        ("<html><body><p>a</p></body></html>", "a"),
        ("<sup data-numero='1' data-text='n'>[1]</sup>", "\\[1\\]"),
        ("a<hr>b", "a\n\n---\n\nb"),
        ("", ""),
        (None, ""),
    ],
)
def test_markdown(source, want):
    assert html.to_markdown(source) == want


def test_footnotes_are_numbered_per_answer():
    source = "<p>x<sup data-numero='7' data-text='one\ntwo' data-url='https://ok.example/'>[7]</sup><sup data-text='b'>[8]</sup></p>"
    assert html.to_markdown(source, "12") == "x[^a12-r1][^a12-r2]\n\n[^a12-r1]: one two [打开外部链接 · ok.example](https://ok.example/)\n\n[^a12-r2]: b"


def test_assets():
    got = html.assets(
        "<figure><a href='https://ok.example/'><img data-original='https://img.example/1_r.jpg' src='data:x' width='640.5' alt='alt'></a><figcaption>cap</figcaption></figure>"
        "<img data-actualsrc='https://img.example/1_r.jpg'><img src='http://img.example/2.jpg'><img data-original='https://img.example/t.gif' width=1 height=1>"
        "<a href='https://10.0.0.1/'>no</a><a>none</a><sup data-numero='3'></sup><sup>2</sup><pre><code class='lang-js'>a\nb</code></pre><pre></pre>"
    )
    assert [(i["original_url"], i["width"], i["caption"]) for i in got["images"]] == [("https://img.example/1_r.jpg", 640, "cap")]
    assert [(x["clickable"], x["security_class"]) for x in got["links"]] == [(True, "external_unverified"), (False, "rejected")]
    assert got["references"] == [{"source_numero": "3", "text": ""}]
    assert got["code_blocks"] == [{"language": "js", "lines": 2}, {"language": "", "lines": 0}] and got["videos"] == []


def test_columns(spark):
    df = spark.createDataFrame([("<p>a https://ok.example</p><pre><code>x\ny</code></pre>", "1"), (None, None)], "h string, i string")
    rows = df.select(
        html.rich_markdown(F.col("h"), F.col("i")).alias("m"), html.extract_assets(F.col("h")).alias("a"), urls.url_class(F.lit("https://10.1.1.1/")).alias("u"), urls.image_class(F.lit("https://img.example/a")).alias("g")
    ).collect()
    assert rows[0].m.startswith("a [打开") and rows[1].m == "" and rows[0].a.code_blocks[0].lines == 2 and rows[0].u is None and rows[0].g.clickable
    text = df.select(html.project_code(html.rich_markdown(F.col("h"), F.col("i"))).alias("m")).first().m
    assert "[CODE_BLOCK language=unknown lines=2 omitted_by_policy]" in text and "x\ny" not in text


def test_sql_names(spark):
    from strataloom.functions import sql

    sql.register(spark)
    row = spark.sql("select rich_markdown('<b>x</b>', null) m, classify_url('https://ok.example/').display_host h, classify_url('http://ok.example/') n, extract_assets('<pre>a</pre>').code_blocks[0].lines l").first()
    assert (row.m, row.h, row.n, row.l) == ("**x**", "ok.example", None, 1)
    assert [r.text for r in spark.sql("select s.text from values ('aaaa。bb') t(x), lateral split_text(x, 5) s order by s.part").collect()] == ["aaaa。", "bb"]
    assert spark.sql("select s.kind from values ('a https://b.example c') t(x), lateral text_spans(x) s").count() == 3
    framed = "<!-- ARCHIVE_SOURCE_BEGIN a -->\n<!-- ARCHIVE_BODY_CHARS: 2 -->\nhi\n<!-- ARCHIVE_SOURCE_END -->\n"
    df = spark.createDataFrame([(framed,)], "x string")
    df.createOrReplaceTempView("framed")
    assert spark.sql("select s.* from framed, lateral archive_sections(x) s").collect() == [("a", "hi")]
