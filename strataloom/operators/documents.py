"""Readable documents put together from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import html, urls
from strataloom.functions import text as tx
from strataloom.operators.chunking import ANONYMOUS, excerpt
from strataloom.operators.packing import numbered

RULE = "=" * 68


def _joined(order: str, value: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")


def answer_blocks(answers: DataFrame, base: str, link_name: str = "回答", site: urls.Site = urls.Site()) -> DataFrame:
    """The block of each answer with its rank by votes (ties in capture order): ``questionid``, ``rank``, ``block``."""
    named = answers.where(F.col("questionid").isNotNull() & F.col("id").isNotNull())
    # only ids are ranked; the texts join the ranks
    slim = named.select("questionid", "captureseq", "voteupcount")
    ranks = numbered(slim, "questionid", [-F.coalesce("voteupcount", F.lit(0)), F.col("captureseq")]).drop("voteupcount")
    ranked = named.join(ranks, ["questionid", "captureseq"])
    author = tx.escape_markdown(F.when(F.coalesce("author", F.lit("")) == "", ANONYMOUS).otherwise(F.col("author")))
    block = F.concat(
        F.lit("## "), F.col("rank").cast("string"), F.lit(". "), author, F.lit(" — "), F.coalesce("voteupcount", F.lit(0)).cast("string"), F.lit(" 赞 · "),
        F.coalesce("commentcount", F.lit(0)).cast("string"), F.lit(f" 评论\n\n- 链接: [{link_name}]("), tx.answer_url("questionid", "id", base), F.lit(")\n- 创建时间: "),
        tx.format_time("createdtime"), F.lit("\n\n"), html.rich_markdown(F.col("content"), F.col("id"), site=site), F.lit("\n\n---\n"),
    )
    return ranked.select("questionid", "rank", block.alias("block"))


def answers_document(answers: DataFrame, titles: DataFrame, base: str, fetched: str, **options) -> DataFrame:
    """One document a question. A question is one file, so its blocks are gathered; use ``answer_blocks`` where a question has no bound.

    ``titles``: ``questionid``, ``title``, ``answercount``.
    """
    body = answer_blocks(answers, base, **options).groupBy("questionid").agg(_joined("rank", "block").alias("body"), F.count(F.lit(1)).alias("n"))
    rows = body.join(titles, "questionid", "left")
    named = F.coalesce(F.nullif(tx.trim("title"), F.lit("")), F.concat(F.lit("问题 "), "questionid"))
    text = F.concat(
        F.lit("# "), tx.escape_markdown(named), F.lit("\n\n> 问题链接: [问题]("), F.lit(base.rstrip("/") + "/question/"), "questionid", F.lit(f")\n> 抓取时间: {fetched}\n> 问题回答总数: "),
        F.coalesce(F.col("answercount").cast("string"), F.lit("(未知)")), F.lit("，本次抓取到: 共 "), F.col("n").cast("string"), F.lit(" 条回答\n\n---\n\n"), "body",
    )
    return rows.select("questionid", F.col("n").alias("answers"), text.alias("document"))


def digest_document(claims: DataFrame, minority: DataFrame, uncertain: DataFrame, inputs: int | None = None, chunks: int | None = None) -> DataFrame:
    """The digest as one text: numbered claims with their sources, minority views and uncertainties; empty parts are left out.

    A claim of blank text keeps its number but is not shown.
    """
    shown = numbered(claims.withColumn("_all", F.lit("")), "_all", ["first_seq"], "number").withColumn("safe", tx.safe_text("text")).where(F.col("safe") != "")
    sources = F.array_join(F.transform("evidence", lambda s: F.concat(F.lit("["), s, F.lit("]"))), " ")
    sure = tx.safe_text("confidence")
    line = F.concat(
        F.col("number").cast("string"), F.lit(". "), "safe", F.lit("\n   - 来源: "), sources, F.when(sure != "", F.concat(F.lit("（置信度 "), sure, F.lit("）"))).otherwise("")
    )
    parts = shown.select(F.col("number").alias("o"), line.alias("line")).agg(_joined("o", "line").alias("claims"))

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.col("first_seq").alias("o"), F.concat(F.lit("- "), tx.safe_text(column)).alias("line")).agg(_joined("o", "line").alias(name))

    rows = parts.unionByName(listed(minority, "minority_view", "views"), True).unionByName(listed(uncertain, "uncertainty", "doubts"), True)  # one row each
    joined = rows.agg(*[F.any_value(c, True).alias(c) for c in rows.columns])

    def part(title: str, column: str):
        return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), column, F.lit("\n\n"))).otherwise("")

    cover = "" if inputs is None and chunks is None else f"> 覆盖 {'?' if inputs is None else inputs} 条回答 / {'?' if chunks is None else chunks} 个 chunk。\n\n"
    return joined.select(F.concat(F.lit(f"# 语料全覆盖摘要\n\n{cover}"), part("主要观点", "claims"), part("少数观点", "views"), part("不确定性", "doubts")).alias("document"))


def sample_blocks(answers: DataFrame, titles: DataFrame, n: int = 6, max_chars: int = 1300) -> DataFrame:
    """The sample block of each question: header with the number of all its answers, then the best ones. At most ``n`` texts are gathered."""
    order = Window.partitionBy("questionid").orderBy(F.desc(F.coalesce("voteupcount", F.lit(0))), "captureseq")
    named = answers.where(F.col("questionid").isNotNull())
    sizes = named.groupBy("questionid").agg(F.count(F.lit(1)).alias("n"))
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    who = F.when(F.coalesce("author", F.lit("")) == "", ANONYMOUS).otherwise(F.col("author"))
    head = F.concat(
        F.lit("\n--- Top"), F.col("rank").cast("string"), F.lit("  "), who, F.lit("  ["), F.coalesce("voteupcount", F.lit(0)).cast("string"), F.lit("赞 / "), F.coalesce("commentcount", F.lit(0)).cast("string"), F.lit("评] ---\n")
    )
    blocks = best.select("questionid", "rank", F.concat(head, excerpt(tx.strip_html("content"), max_chars)).alias("block"))
    gathered = blocks.groupBy("questionid").agg(_joined("rank", "block").alias("body"))
    title = F.coalesce(F.nullif(tx.trim("title"), F.lit("")), F.col("questionid"))
    text = F.concat(F.lit(f"\n{RULE}\n问题: "), title, F.lit("  ("), F.col("n").cast("string"), F.lit(f" 条回答)\n{RULE}\n"), "body")
    return gathered.join(sizes, "questionid").join(titles, "questionid", "left").select("questionid", F.col("n").alias("answers"), text.alias("block"))
