"""Documents in files: discovery, two shapes of question documents, quarantine, state and lists."""

from __future__ import annotations

import json
import os
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.sources import schemas


def _whole(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """A1-A4: whole texts of the files of a name below the given folders, each path once. A missing input is skipped."""
    there = sorted({p if "://" in p else os.path.abspath(p) for p in paths if "://" in p or os.path.exists(p)})
    if not there:
        return spark.createDataFrame([], "path string, text string")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])


def text_documents(spark: SparkSession, paths: list[str], pattern: str = "*.{md,json,txt}") -> DataFrame:
    """A2, A3: ``path`` and ``text`` of Markdown, JSON and text files (``answers.md`` for an archive's input)."""
    return _whole(spark, paths, pattern)


def question_documents(spark: SparkSession, paths: list[str], skip_corrupt: bool = False) -> DataFrame:
    """Question documents in either shape: an object with ``answers``, or a bare array of answers.

    Columns: ``path``, ``directory``, ``question_id`` (else the folder's name), ``title``, ``bare_array``,
    ``corrupt`` and ``doc``. A corrupt file is an error unless ``skip_corrupt`` keeps it as a marked row.
    """
    found = _whole(spark, paths, "answers.json")
    body = tx.trim("text")
    bare = F.startswith(body, F.lit("["))
    wrapped = F.when(bare, F.concat(F.lit('{"answers":'), body, F.lit("}"))).otherwise(body)
    doc = F.from_json(wrapped, f"{schemas.QUESTION_DOC}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = found.select("path", bare.alias("bare_array"), doc.alias("doc"))
    corrupt = F.col("doc").isNull() | F.col("doc._bad").isNotNull()
    if not skip_corrupt:
        checked = F.when(corrupt, F.raise_error(F.concat(F.lit("corrupt document: "), "path"))).otherwise(F.col("doc"))
        rows = rows.withColumn("doc", checked)
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return rows.select(
        "path", folder.alias("directory"), F.coalesce("doc.questionId", folder).alias("question_id"), F.col("doc.questionTitle").alias("title"), "bare_array", corrupt.alias("corrupt"), F.col("doc").dropFields("_bad").alias("doc")
    )


def answers_of(documents: DataFrame) -> DataFrame:
    """The answers of question documents with their place: the rows that the operators read."""
    a = F.posexplode("doc.answers").alias("captureseq", "a")
    rows = documents.where(~F.col("corrupt")).select("question_id", "path", a)
    return rows.select(
        F.col("a.id").alias("id"), F.col("question_id").alias("questionid"), F.col("a.author").alias("author"), F.col("a.url").alias("url"), F.col("a.content").alias("content"), F.col("a.excerpt").alias("excerpt"),
        F.col("a.voteupCount").alias("voteupcount"), F.col("a.commentCount").alias("commentcount"), F.col("a.createdTime").alias("createdtime"), F.col("a.updatedTime").alias("updatedtime"), F.col("captureseq").cast("long").alias("captureseq"), "path",
    )


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by file; an unreadable file is left out."""
    return _json_files(spark, folder, "chunk-*.json", schemas.CHUNK).where(~F.col("corrupt")).drop("corrupt")


def map_files(spark: SparkSession, folder: str) -> DataFrame:
    """Map results by file; an unreadable file stays as a row marked corrupt."""
    return _json_files(spark, folder, "map-*.json", schemas.MAP_RESULT)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's inputs; a missing manifest is an error."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("inputs").alias("i")).select("i.*")


def _json_files(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)).withColumn("corrupt", F.col("_bad").isNotNull()).drop("_bad")


def batch_inputs(spark: SparkSession, path: str) -> DataFrame:
    """One id or address a line; blanks and ``#`` comments are dropped; an empty list is an error."""
    line = tx.trim("value")
    rows = spark.read.text(path).select(line.alias("input")).where((F.col("input") != "") & ~F.col("input").startswith("#"))
    rows = rows.withColumn("question_id", tx.question_id("input"))
    if rows.isEmpty():
        raise ValueError(f"no inputs in {path}")
    return rows


# ---------------------------------------------------------------- single files of the driver


def write_json(path: str, value: Any) -> None:
    """One file, replaced in one step."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.{os.getpid()}.tmp"
    with open(part, "w", encoding="utf-8") as file:
        if isinstance(value, str):
            file.write(value)
        else:
            json.dump(value, file, ensure_ascii=False, indent=2)
    os.replace(part, path)


class CorruptFile(ValueError):
    """A file that could not be read and was moved aside."""


def read_json(path: str) -> Any:
    """A JSON file, None if it is missing; a corrupt one is moved to ``.corrupt-<ms>`` and reported."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as file:
        try:
            return json.load(file)
        except ValueError:
            aside = f"{path}.corrupt-{int(time.time() * 1000)}"
    os.replace(path, aside)
    raise CorruptFile(f"{path} is corrupt; moved to {aside}") from None


class Progress:
    """Offset and end of a capture in a small file beside it."""

    def __init__(self, folder: str) -> None:
        self.path = os.path.join(folder, ".progress.json")

    def load(self) -> tuple[int, bool]:
        value = read_json(self.path)
        if not isinstance(value, dict):
            return 0, False
        offset = value.get("offset")
        return (offset if isinstance(offset, int) and offset >= 0 else 0), value.get("done") is True

    def save(self, offset: int, done: bool) -> None:
        write_json(self.path, {"offset": offset, "done": done})


def relative(path: str, root: str) -> str:
    """A path relative to a root, with forward slashes; one on another volume is an error."""
    try:
        out = os.path.relpath(path, root)
    except ValueError as error:
        raise ValueError("no relative path between volumes") from error
    return out.replace(os.sep, "/")
