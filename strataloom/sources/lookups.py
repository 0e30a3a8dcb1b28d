"""Replayed lookups and searches (A11-A14): one recorded response a line, as ``<folder>/<kind>`` in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as tx

INFO = "request string, body struct<id:string,title:string,detail:string,topics:array<struct<id:string,name:string>>,answer_count:bigint>"
COMMENTS = (
    "request string, body struct<data:array<struct<id:string,reply_comment_id:string,reply_root_comment_id:string,content:string,author:struct<name:string>,created_time:bigint>>,"
    "paging:struct<totals:bigint,is_end:boolean>>"
)
SEARCH = "request string, body struct<Code:int,Data:array<struct<Title:string,Url:string,ContentType:string>>>"
#: Fields of an answer that a projection may ask for (A11), and comments kept of one lookup.
FIELDS = ("content", "excerpt", "voteup_count", "comment_count", "created_time", "updated_time", "author")
KEPT = 3


def project(pages: DataFrame, fields: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """The answers of pages with the id and the asked-for ``fields`` only, ``limit`` of them from ``offset`` on, by question."""
    unknown = sorted(set(fields) - set(FIELDS))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    rows = pages.where((F.col("offset") < offset + limit) & (F.col("offset") + F.size("answers") > offset))
    placed = rows.select("question_id", F.col("offset").alias("_base"), F.posexplode("answers").alias("_at", "a")).withColumn("place", F.col("_base") + F.col("_at"))
    return placed.where((F.col("place") >= offset) & (F.col("place") < offset + limit)).select("question_id", "place", "a.id", *[F.col(f"a.{f}") for f in fields])


def question_infos(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each question, by its id; a response for another id than asked for is left out."""
    rows = spark.read.schema(INFO).json(f"{folder}/info")
    return rows.where(F.col("body.id") == F.col("request")).select("body.*")


def top_comments(spark: SparkSession, folder: str) -> DataFrame:
    """The first three comments of an answer in the order of the response; ids that are no single path segment are refused."""
    rows = spark.read.schema(COMMENTS).json(f"{folder}/comments").where(F.col("request").rlike(r"^[0-9A-Za-z_-]+$"))
    one = rows.select(F.col("request").alias("answerid"), F.posexplode(F.slice("body.data", 1, KEPT)).alias("place", "c"))
    return one.select("answerid", "place", F.col("c.id").alias("id"), F.col("c.author.name").alias("authorname"), F.col("c.content").alias("contenthtml"), F.col("c.reply_comment_id").alias("replycommentid"))


def search_items(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    """The items of each search with their place; a response whose code is not 0 is an error."""
    rows = spark.read.schema(SEARCH).json(f"{folder}/search")
    data = F.when(F.col("body.Code") == 0, F.col("body.Data")).otherwise(F.raise_error(F.concat(F.lit("search failed: "), "request")))
    one = rows.select(F.col("request").alias("keyword"), F.posexplode(F.slice(data, 1, limit)).alias("place", "i"))
    return one.select("keyword", "place", F.col("i.Title").alias("title"), F.col("i.Url").alias("url"), F.col("i.ContentType").alias("content_type"), tx.question_id("i.Url").alias("questionid"))
