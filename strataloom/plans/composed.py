"""Queries over markup, addresses and texts composed from every answer's numbers, whose results SQL can say in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import html, urls
from strataloom.plans.corpus import QUERIES, load

#: One piece of markup of each kind; {n} is the answer's number. And what it reads as in Markdown: a blank that begins a
#: piece of text is made unbreakable, so that it indents nothing.
MARKUP = (
    '<h1>T{n}</h1><p>a <b>b{n}</b> <i>c</i> <code>x</code><br>d</p><blockquote><p>q{n}</p><p>r</p></blockquote><ol start="3"><li>i{n}</li><li>j<ul><li>k</li></ul></li></ol>'
    '<pre><code class="language-sql">s{n}</code></pre><figure><img alt="z{n}" src="https://pic.img.example/{n}.png"><figcaption>cap</figcaption></figure><script>bad</script><section>u{n}</section>'
    '<p>n<sup data-numero="1" data-text="ref{n}">[1]</sup></p><p><a href="https://example.org/{n}">w</a></p>'
)
MARKDOWN = (
    "### T{n}\n\na **b{n}**\u00a0*c*\u00a0`x`\nd\n\n> q{n}\n>\n> r\n\n3. i{n}\n4. j\n   - k\n\n``` sql\ns{n}\n```\n\n[图片：z{n}]\n\ncap\n\nu{n}\n\nn[^a{id}-r1]\n\n"
    "原文链接文字：w\n[打开外部链接 · example.org](https://example.org/{n})\n\n[^a{id}-r1]: ref{n}"
)
#: Addresses, whether each may be followed, its class (null if it is refused; a redirect has that of its target) and the place a redirect leads to.
ADDRESSES = (
    ("https://example.org/{n}", True, "external_unverified", None), ("http://example.org/{n}", None, None, None), ("https://user@example.org/{n}", None, None, None),
    ("https://127.0.0.1/{n}", None, None, None), ("https://10.0.0.5/{n}", None, None, None), ("https://[::1]/{n}", None, None, None), ("ftp://example.org/{n}", None, None, None),
    ("javascript:alert({n})", None, None, None), ("https://link.example/?target=https%3A%2F%2Fexample.org%2F{n}", True, "external_unverified", "https://example.org/{n}"),
)
#: Image addresses: whether each is an image at all, and may be followed.
IMAGES = (("https://pic.img.example/{n}.png", True, True), ("http://pic.img.example/{n}.png", True, False), ("https://img.example.other.example/{n}", True, False), ("ftp://img.example/{n}", False, None), ("", False, None))
SENTENCE = "see https://example.org/{n}, (https://a.example/x_({n})) end https://b.example/{n}。"


def query(function):
    QUERIES[function.__name__] = function
    return function


def _filled(pattern: str):
    """The pattern with {n} and {id} replaced."""
    return F.replace(F.replace(F.lit(pattern), F.lit("{n}"), F.col("captureseq").cast("string")), F.lit("{id}"), F.col("id"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "answers").where("captureseq is not null and id is not null").select("captureseq", "id")


def _chosen(patterns: list[str]):
    """One of the patterns by the answer's number."""
    place = F.pmod("captureseq", F.lit(len(patterns)))
    out = F.when(place == 0, _filled(patterns[0]))
    for k, p in enumerate(patterns[1:], 1):
        out = out.when(place == k, _filled(p))
    return out


@query
def rendered_markup(spark, folder):
    """Blocks and inline content, headings, quotes, fences, lists, images, figures, footnotes, links, dropped scripts"""
    rows = _rows(spark, folder).withColumn("source", _filled(MARKUP))
    return rows.select("captureseq", html.rich_markdown(F.col("source"), F.col("id")).alias("markdown"))


@query
def assets_of_markup(spark, folder):
    """Images with captions, links with refused ones, references and code of the markup, in order"""
    rows = _rows(spark, folder).withColumn("source", F.concat(_filled(MARKUP), _filled('<a href="http://10.0.0.1/{n}">v</a><sup>2</sup>')))
    a = rows.select("captureseq", html.extract_assets(F.col("source")).alias("a"))
    return a.select(
        "captureseq", F.col("a.images")[0]["original_url"].alias("image"), F.col("a.images")[0]["caption"].alias("caption"), F.transform("a.links", lambda x: x["original_url"]).alias("links"),
        F.transform("a.links", lambda x: x["clickable"]).alias("clickable"), F.transform("a.references", lambda x: x["text"]).alias("texts"), F.transform("a.code_blocks", lambda x: x["language"]).alias("languages"),
    )


@query
def addresses_by_class(spark, folder):
    """What may be followed, and where redirects lead"""
    rows = _rows(spark, folder).withColumn("url", _chosen([a[0] for a in ADDRESSES]))
    target = F.pandas_udf(lambda v: v.map(urls.redirect_target), "string")(F.col("url"))
    return rows.select("captureseq", "url", urls.url_class(F.col("url")).alias("c"), target.alias("target")).select("captureseq", "url", "c.clickable", "c.security_class", "target")


@query
def images_by_class(spark, folder):
    """Image addresses"""
    rows = _rows(spark, folder).withColumn("url", _chosen([a[0] for a in IMAGES]))
    return rows.select("captureseq", urls.image_class(F.col("url")).alias("c")).select("captureseq", F.col("c").isNotNull().alias("image"), "c.clickable")


@query
def bare_addresses(spark, folder):
    """Addresses in running text without the marks behind them, balanced brackets kept"""
    return _rows(spark, folder).select("captureseq", urls.bare_urls(_filled(SENTENCE)).alias("urls"))


def _sql(pattern: str | bool | None) -> str:
    if pattern is None or isinstance(pattern, bool):
        return "NULL" if pattern is None else str(pattern)
    quoted = pattern.replace("'", "''")
    return f"replace(replace('{quoted}', '{{n}}', CAST(captureseq AS VARCHAR)), '{{id}}', id)"


def _case(values: list) -> str:
    return "CASE captureseq % " + str(len(values)) + "".join(f" WHEN {k} THEN {_sql(v)}" for k, v in enumerate(values)) + " END"


ROWS = "FROM answers WHERE captureseq IS NOT NULL AND id IS NOT NULL"
SQL = {
    "rendered_markup": f"SELECT captureseq, {_sql(MARKDOWN)} AS markdown {ROWS}",
    "assets_of_markup": f"""SELECT captureseq, {_sql("https://pic.img.example/{n}.png")} AS image, 'cap' AS caption, [{_sql("https://example.org/{n}")}, {_sql("http://10.0.0.1/{n}")}] AS links,
      [true, false] AS clickable, [{_sql("ref{n}")}] AS texts, ['sql'] AS languages {ROWS}""",
    "addresses_by_class": "SELECT captureseq, " + ", ".join(f"{_case([a[k] for a in ADDRESSES])} AS {name}" for k, name in enumerate(("url", "clickable", "security_class", "target"))) + f" {ROWS}",
    "images_by_class": "SELECT captureseq, " + ", ".join(f"{_case([a[k] for a in IMAGES])} AS {name}" for k, name in ((1, "image"), (2, "clickable"))) + f" {ROWS}",
    "bare_addresses": f"SELECT captureseq, [{_sql('https://example.org/{n}')}, {_sql('https://a.example/x_({n})')}, {_sql('https://b.example/{n}')}] AS urls {ROWS}",
}
