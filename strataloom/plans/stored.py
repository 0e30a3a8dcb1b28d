"""Queries over stored documents, pages and responses: the driver's tables are written as such and read back by the sources."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators import ingest, packing
from strataloom.plans.corpus import QUERIES, load
from strataloom.shared import shared_folder
from strataloom.sources import files, lookups, pages
from strataloom.streaming import replay

#: Answers of one stored document and of one page.
PART, PAGE = 200, 20


def query(function):
    QUERIES[function.__name__] = function
    return function


def _folder(spark: SparkSession, name: str) -> str:
    base = shared_folder(spark)
    return f"{base.removeprefix('file://').removeprefix('file:')}/strataloom-{name}-{uuid.uuid4().hex}"


def _store(bodies: DataFrame, folder: str) -> str:
    """Writes ``body`` to the file ``name`` below a folder that all executors mount; one file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files.write_json(os.path.join(folder, name), body)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    os.makedirs(folder, exist_ok=True)
    bodies.select("name", "body").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


def _placed(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """Answers with the part of their question they belong to, by the order of their capture (only ids are numbered)."""
    ids = load(spark, folder, "answers").where("questionid is not null and id is not null").select("questionid", "captureseq")
    keys = packing.numbered(ids, "questionid", ["captureseq"], "_place").withColumn("_place", F.col("_place") - 1)
    return load(spark, folder, "answers").join(keys, ["questionid", "captureseq"]).withColumn("part", F.floor(F.col("_place") / size).cast("int"))


def _stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.struct("id", "author", "url", "content", "excerpt", F.col("voteupcount").alias("voteupCount"), F.col("commentcount").alias("commentCount"))
    parts = _placed(spark, folder, PART).groupBy("questionid", "part").agg(F.array_sort(F.collect_list(F.struct("captureseq", answer.alias("a")))).alias("l"))
    answers = F.transform("l", lambda x: x["a"])
    whole = F.to_json(F.struct(F.col("questionid").alias("questionId"), F.concat(F.lit("T"), "questionid").alias("questionTitle"), answers.alias("answers")))
    # every other part is a bare array, and the first part of some questions is cut off: a corrupt file
    body = F.when(F.col("part") % 2 == 1, F.to_json(answers)).when((F.col("part") == 0) & F.col("questionid").endswith("7"), F.lit("{broken")).otherwise(whole)
    return parts.select(F.concat(F.lit("p"), "part", F.lit("/"), "questionid", F.lit("/answers.json")).alias("name"), body.alias("body"))


@query
def stored_questions(spark, folder):
    """Documents of both shapes, with corrupt ones as marked rows, and whether each is the question it should be"""
    place = _store(_stored_documents(spark, folder), _folder(spark, "documents"))
    got = files.question_documents(spark, [place], skip_corrupt=True)
    same = ingest.existing_question(F.col("directory"), F.concat(F.lit("T"), "directory"))
    return got.select(F.regexp_extract("path", "/p([0-9]+)/[^/]+/answers.json$", 1).cast("int").alias("part"), "question_id", "bare_array", "corrupt", F.size("doc.answers").alias("answers"), same.alias("same"))


@query
def stored_answers(spark, folder):
    """The answers of the stored documents"""
    place = _store(_stored_documents(spark, folder), _folder(spark, "documents"))
    rows = files.answers_of(files.question_documents(spark, [place], skip_corrupt=True))
    return rows.groupBy("questionid").agg(F.count(F.lit(1)).alias("n"), F.sum("voteupcount").alias("votes"), F.sum(F.length("content")).alias("chars"))


@query
def stored_texts(spark, folder):
    """A2-A4: whole texts of Markdown files by name; a missing input is skipped"""
    rows = load(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id", F.lit("/answers.md")).alias("name"), F.col("text").alias("body"))
    place = _store(rows, _folder(spark, "texts"))
    got = files.text_documents(spark, [place, f"{place}/missing", place], "answers.md")
    return got.select(F.regexp_extract("path", "/d([0-9]+)/answers.md$", 1).cast("long").alias("doc_id"), F.length("text").alias("chars"))


def _stored_pages(spark: SparkSession, folder: str) -> str:
    answer = F.struct("id", F.struct(F.col("author").alias("name")).alias("author"), "content", "excerpt", F.col("voteupcount").alias("voteup_count"), F.col("commentcount").alias("comment_count"), F.col("createdtime").alias("created_time"), F.col("updatedtime").alias("updated_time"))
    rows = _placed(spark, folder, PAGE)
    last = rows.groupBy("questionid").agg(F.max("part").alias("last"))
    parts = rows.groupBy("questionid", "part").agg(F.array_sort(F.collect_list(F.struct("captureseq", answer.alias("a")))).alias("l")).join(last, "questionid")
    body = F.to_json(F.struct(F.transform("l", lambda x: x["a"]).alias("data"), F.struct((F.col("part") == F.col("last")).alias("is_end")).alias("paging")))
    return _store(parts.select(F.concat("questionid", F.lit("/page-"), "part", F.lit(".json")).alias("name"), body.alias("body")), _folder(spark, "pages"))


def _read_pages(spark: SparkSession, place: str) -> DataFrame:
    pages.register(spark)
    return spark.read.format("replay_pages").option("path", place).option("cap", 1_000_000).load()


@query
def captured_pages(spark, folder):
    """The pages of each question, its rows and whether its end was reached"""
    return replay.capture_events(_read_pages(spark, _stored_pages(spark, folder)))


@query
def captured_answers(spark, folder):
    """A10, B1: the answers of the pages with their place in the capture"""
    rows = replay.answers_of_pages(_read_pages(spark, _stored_pages(spark, folder)))
    return rows.select("questionid", "captureseq", "id", "voteupcount", F.length("content").alias("chars"))


@query
def projected_answers(spark, folder):
    """Five answers of each question from the third on, with two fields"""
    return lookups.project(_read_pages(spark, _stored_pages(spark, folder)), ["voteup_count", "comment_count"], 5, 2)


@query
def streamed_answers(spark, folder):
    """The pages as a stream into a table; the first row of each id of a question stays, and a second run adds nothing"""
    place, table = _stored_pages(spark, folder), _folder(spark, "ingested")
    for _ in range(2):
        replay.ingest(spark, place, table, f"{table}-state", 1_000_000).awaitTermination()
    return replay.read_table(spark, table).select("questionid", "id", "captureseq")


@query
def looked_up_questions(spark, folder):
    """Question lookups by id"""
    place = _folder(spark, "responses")
    last = load(spark, folder, "question").where("id is not null").groupBy("id").agg(F.max("answercount").alias("answer_count"), F.max("title").alias("title"))
    last.select(F.col("id").alias("request"), F.struct("id", "title", "answer_count").alias("body")).write.json(f"{place}/info")
    return lookups.question_infos(spark, place).select("id", "title", "answer_count")


@query
def looked_up_comments(spark, folder):
    """Three comments of each answer in the order of the response"""
    place = _folder(spark, "responses")
    rows = load(spark, folder, "comments").where("answerid is not null and id is not null").groupBy("answerid", "id").agg(F.min("replycommentid").alias("replycommentid"), F.min("contenthtml").alias("contenthtml"), F.min("authorname").alias("authorname"))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("answerid").orderBy("id"))).where(F.col("_n") <= 5)  # a page of five
    comment = F.struct("id", F.col("replycommentid").alias("reply_comment_id"), F.col("contenthtml").alias("content"), F.struct(F.col("authorname").alias("name")).alias("author"))
    body = best.groupBy("answerid").agg(F.array_sort(F.collect_list(F.struct("_n", comment.alias("c")))).alias("l"))
    body.select(F.col("answerid").alias("request"), F.struct(F.transform("l", lambda x: x["c"]).alias("data")).alias("body")).write.json(f"{place}/comments")
    return lookups.top_comments(spark, place).select("answerid", "place", "id", "authorname", "replycommentid")


@query
def searched_items(spark, folder):
    """Search items with the question their address names; one search a source"""
    place = _folder(spark, "responses")
    rows = load(spark, folder, "answers").where("questionid is not null and url is not null and id is not null").groupBy("questionid").agg(F.min("url").alias("Url"))
    placed = rows.withColumn("k", F.substring("questionid", -1, 1)).withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("questionid"))).where(F.col("_n") <= 12)
    item = F.struct(F.col("questionid").alias("Title"), "Url", F.lit("question").alias("ContentType"))
    body = placed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("_n", item.alias("i")))).alias("l"))
    body.select(F.col("k").alias("request"), F.struct(F.lit(0).alias("Code"), F.transform("l", lambda x: x["i"]).alias("Data")).alias("body")).write.json(f"{place}/search")
    return lookups.search_items(spark, place).select("keyword", "place", "title", "questionid")


@query
def stored_chunks(spark, folder):
    """Chunks by file, an unreadable file left out"""
    rows = load(spark, folder, "chunk").where("chunkid is not null").groupBy("chunkid").agg(F.max("text").alias("text"), F.max(F.size("sourceids")).alias("n"))
    body = F.when(F.col("chunkid").endswith("3"), F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("chunkid").alias("chunkId"), "text", F.length("text").cast("long").alias("chars"))))
    place = _store(rows.select(F.concat(F.lit("chunk-"), F.md5("chunkid"), F.lit(".json")).alias("name"), body.alias("body")), _folder(spark, "chunks"))
    return files.chunk_files(spark, place).select(F.col("chunkId").alias("chunkid"), "chars", F.length("text").alias("length"))


@query
def stored_maps(spark, folder):
    """Map results by file, an unreadable file as a marked row"""
    rows = load(spark, folder, "chunk").where("chunkid is not null").select("chunkid").distinct()
    body = F.when(F.col("chunkid").endswith("3"), F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("chunkid").alias("chunkId"), F.array(F.col("chunkid")).alias("themes"))))
    place = _store(rows.select(F.concat(F.lit("map-"), F.md5("chunkid"), F.lit(".json")).alias("name"), body.alias("body")), _folder(spark, "maps"))
    return files.map_files(spark, place).select("file", "corrupt", F.col("chunkId").alias("chunkid"), F.size("themes").alias("themes"))


@query
def stored_manifest(spark, folder):
    """The inputs of a manifest written as one file"""
    ids = sorted(r.source for r in load(spark, folder, "mix_targets").select("source").distinct().collect() if r.source)  # a fixed small table
    path = f"{_folder(spark, 'manifest')}/manifest.json"
    files.write_json(path, {"inputs": [{"path": s, "chars": len(s)} for s in ids]})
    return files.manifest(spark, path).select("path", "chars")


@query
def listed_inputs(spark, folder):
    """One id or address a line, blanks and comments dropped"""
    rows = load(spark, folder, "answers").where("questionid is not null").select("questionid").distinct()
    place = _folder(spark, "inputs")
    line = F.explode(F.array(F.concat(F.lit("  "), "questionid"), F.lit(""), F.concat(F.lit("# "), "questionid")))
    rows.select(line.alias("value")).write.text(place)
    return files.batch_inputs(spark, place).select("input", "question_id")


#: The SQL of the queries above.
PLACED = "SELECT *, row_number() OVER (PARTITION BY questionid ORDER BY captureseq) - 1 AS k FROM answers WHERE questionid IS NOT NULL AND id IS NOT NULL"
PARTS = f"SELECT *, k // {PART} AS part FROM ({PLACED})"
KEPT = f"SELECT * FROM ({PARTS}) WHERE NOT (part = 0 AND questionid LIKE '%7')"
SQL = {
    "stored_questions": f"""SELECT CAST(part AS INTEGER) AS part, questionid AS question_id, part % 2 = 1 AS bare_array, (part = 0 AND questionid LIKE '%7') AS corrupt,
      CAST(CASE WHEN part = 0 AND questionid LIKE '%7' THEN NULL ELSE count(*) END AS INTEGER) AS answers, part % 2 = 0 AND NOT (part = 0 AND questionid LIKE '%7') AS same
      FROM ({PARTS}) GROUP BY questionid, part""",
    "stored_answers": f"SELECT questionid, count(*) AS n, CAST(sum(voteupcount) AS BIGINT) AS votes, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({KEPT}) GROUP BY questionid",
    "stored_texts": "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL",
    "captured_pages": f"SELECT questionid AS question_id, CAST(ceil(count(*) / {PAGE}.0) AS BIGINT) AS pages, count(*) AS rows, true AS done FROM ({PLACED}) GROUP BY questionid",
    "captured_answers": f"SELECT questionid, k AS captureseq, id, coalesce(voteupcount, 0) AS voteupcount, CAST(length(coalesce(content, '')) AS INTEGER) AS chars FROM ({PLACED})",
    "projected_answers": f"SELECT questionid AS question_id, k AS place, id, coalesce(voteupcount, 0) AS voteup_count, coalesce(commentcount, 0) AS comment_count FROM ({PLACED}) WHERE k BETWEEN 2 AND 6",
    "streamed_answers": f"SELECT questionid, id, min(k) AS captureseq FROM ({PLACED}) GROUP BY questionid, id",
    "looked_up_questions": "SELECT id, max(title) AS title, max(answercount) AS answer_count FROM question WHERE id IS NOT NULL GROUP BY id",
    "looked_up_comments": """WITH one AS (SELECT answerid, id, min(replycommentid) AS replycommentid, min(authorname) AS authorname FROM comments WHERE answerid IS NOT NULL AND id IS NOT NULL GROUP BY answerid, id)
      SELECT answerid, CAST(n - 1 AS INTEGER) AS place, id, authorname, replycommentid FROM (SELECT *, row_number() OVER (PARTITION BY answerid ORDER BY id) AS n FROM one) WHERE n <= 3""",
    "searched_items": """WITH one AS (SELECT questionid, min(url) AS url FROM answers WHERE questionid IS NOT NULL AND url IS NOT NULL AND id IS NOT NULL GROUP BY questionid)
      SELECT right(questionid, 1) AS keyword, CAST(n - 1 AS INTEGER) AS place, questionid AS title, nullif(regexp_extract(url, '/question/([0-9]+)', 1), '') AS questionid
      FROM (SELECT *, row_number() OVER (PARTITION BY right(questionid, 1) ORDER BY questionid) AS n FROM one) WHERE n <= 10""",
    "stored_chunks": "SELECT chunkid, CAST(length(max(text)) AS BIGINT) AS chars, CAST(length(max(text)) AS INTEGER) AS length FROM chunk WHERE chunkid IS NOT NULL AND chunkid NOT LIKE '%3' GROUP BY chunkid",
    "stored_maps": """SELECT DISTINCT 'map-' || md5(chunkid) || '.json' AS file, chunkid LIKE '%3' AS corrupt, CASE WHEN chunkid LIKE '%3' THEN NULL ELSE chunkid END AS chunkid,
      CAST(CASE WHEN chunkid LIKE '%3' THEN NULL ELSE 1 END AS INTEGER) AS themes FROM chunk WHERE chunkid IS NOT NULL""",
    "stored_manifest": "SELECT DISTINCT source AS path, CAST(length(source) AS BIGINT) AS chars FROM mix_targets WHERE source IS NOT NULL",
    "listed_inputs": "SELECT DISTINCT questionid AS input, questionid AS question_id FROM answers WHERE questionid IS NOT NULL",
}
