"""Resumable ingestion of replayed pages as a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataloom.operators.ingest import keep_first
from strataloom.sources.pages import CAP, register

ANSWERS = "id string, questionid string, author string, content string, excerpt string, voteupcount long, commentcount long, createdtime long, updatedtime long, captureseq long"


def answers_of_pages(pages: DataFrame) -> DataFrame:
    """The answers of pages with their place in the capture: offset of the page plus place in it."""
    rows = pages.select("question_id", "offset", F.posexplode("answers").alias("at", "a"))
    return rows.select(
        F.col("a.id").alias("id"), F.col("question_id").alias("questionid"), F.col("a.author").alias("author"), F.col("a.content").alias("content"), F.col("a.excerpt").alias("excerpt"),
        F.col("a.voteup_count").alias("voteupcount"), F.col("a.comment_count").alias("commentcount"), F.col("a.created_time").alias("createdtime"), F.col("a.updated_time").alias("updatedtime"),
        (F.col("offset") + F.col("at")).alias("captureseq"),
    )


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """What has been ingested; empty before the first batch."""
    if "://" not in table and not os.path.isdir(table):
        return spark.createDataFrame([], f"{ANSWERS}, batch long")
    return spark.read.schema(f"{ANSWERS}, batch long").parquet(table)


def merge_batch(table: str):
    """What a batch adds: the first row of each new id of a question; known rows are never updated.

    Each batch owns one folder and looks only at earlier ones, so a batch that is run again gives the same table.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = answers_of_pages(batch).withColumn("key", F.concat_ws("/", "questionid", "id"))
        fresh = keep_first(rows, "key", "captureseq")
        known = read_table(spark, table).where(F.col("batch") < number).select("questionid", "id")
        fresh = fresh.drop("key").join(known, ["questionid", "id"], "left_anti")
        columns = [c.strip().split()[0] for c in ANSWERS.split(",")]
        fresh.select(*columns).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return run


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, cap: int = CAP) -> StreamingQuery:
    """A stream that reads all pages that are there and ends; started again with the same checkpoint it goes on."""
    register(spark)
    pages = spark.readStream.format("replay_pages").option("path", folder).option("cap", cap).load()
    writer = pages.writeStream.foreachBatch(merge_batch(table)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def capture_events(pages: DataFrame) -> DataFrame:
    """What happened to each question: pages, rows, and whether its end was reached."""
    per_page = pages.select("question_id", "page", F.size("answers").alias("n"), "is_end")
    return per_page.groupBy("question_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("rows"), F.bool_or("is_end").alias("done"))
