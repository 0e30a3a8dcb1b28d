"""Segments, chunks and their manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators.packing import greedy_pack

#: Ends at which a long text is cut, and the share of the limit beyond which such an end is taken.
ENDS = ("\n\n", "。", "！", "？", ". ")
LEAST = 0.6
ANONYMOUS = "(匿名)"
SEPARATOR = "\n\n---\n\n"


def cut(text: str, limit: int) -> int:
    """Where the first part of a longer text ends: after the first character of the last end in the window."""
    last = max(text.rfind(end, 0, limit) for end in ENDS)
    return last + 1 if last > LEAST * limit else limit


def split_text(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters that together are the text."""
    parts = []
    while len(text) > limit:
        end = cut(text, limit)
        parts.append(text[:end])
        text = text[end:]
    return parts + [text] if text or not parts else parts


def split_long(value: Column, limit: int) -> Column:
    """E8 as an array; texts within the limit, the empty one too, stay whole and do not reach Python. Null stays null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else split_text(t, limit) for t in texts], dtype=object)

    return F.coalesce(run(F.when(F.length(value) > limit, value)), F.when(value.isNotNull(), F.array(value)))


def excerpt(value: Column, limit: int) -> Column:
    """F8: a text cut to the limit, at the last end beyond 60 percent of it if there is one."""

    def cutted(text: Column) -> Column:
        window = F.substring(text, 1, limit)

        def last(end: str) -> Column:
            at = F.instr(F.reverse(window), end[::-1])
            return F.when(at > 0, F.length(window) - at - len(end) + 1).otherwise(-1)

        best = F.greatest(*[last(e) for e in ENDS])
        whole = tx.let(best, lambda b: F.when(b > LEAST * limit, F.substring(window, F.lit(1), b + 1)).otherwise(window))
        return F.when(F.length(text) <= limit, text).otherwise(whole)

    return tx.let(value, cutted)


def source_id(question: Column, answer: Column) -> Column:
    """The id of a source; an answer without id is 'unknown'."""
    return F.concat(F.lit("question-"), question, F.lit("-answer-"), F.coalesce(answer, F.lit("unknown")))


def manifest_inputs(answers: DataFrame) -> DataFrame:
    """One row a source with the size (UTF-16 units of the raw text) and hash of its content; null content counts as empty."""
    content = F.coalesce("content", F.lit(""))
    return answers.where(F.col("questionid").isNotNull()).select(
        source_id(F.col("questionid"), F.col("id")).alias("source_id"),
        F.concat("questionid", F.lit("/answers.json")).alias("relative_path"),
        "questionid",
        F.col("id").alias("answer_id"),
        F.coalesce("author", F.lit(ANONYMOUS)).alias("author"),
        tx.utf16_length(content).alias("chars"),
        F.coalesce("voteupcount", F.lit(0)).alias("voteupcount"),
        F.sha2(content, 256).alias("sha256"),
    )


def segments(answers: DataFrame, max_chars: int) -> DataFrame:
    """The segments of the cleaned answers: ``questionid``, ``seq``, ``segment``, ``source_id``, ``chars``, ``text``."""
    rows = answers.where(F.col("questionid").isNotNull()).select(
        "questionid", F.col("captureseq").alias("seq"), source_id(F.col("questionid"), F.col("id")).alias("source_id"), tx.clean_text("content").alias("_clean")
    )
    cutted = rows.select("questionid", "seq", "source_id", F.posexplode(split_long(F.col("_clean"), max_chars)).alias("segment", "text"))
    return cutted.withColumn("chars", F.length("text"))


def chunk_segments(segment_rows: DataFrame, max_chars: int = 24_000, max_segments: int = 40) -> DataFrame:
    """The segments with ``chunk_no`` in their question; texts are not carried through the packing."""
    slim = segment_rows.select("questionid", "seq", "segment", "source_id", "chars")
    return greedy_pack(slim, "questionid", ["seq", "segment"], "chars", max_chars, max_segments)


def chunks(segment_rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Chunks with their sources, text, size, token range and hash.

    A chunk holds at most ``max_segments`` bounded segments, so its group is bounded. A source that is cut into
    several segments of a chunk is listed once.
    """
    keyed = segment_rows.join(placed.select("questionid", "seq", "segment", "chunk_no"), ["questionid", "seq", "segment"])
    part = F.struct("seq", "segment", "source_id", F.concat(F.lit("[SOURCE "), "source_id", F.lit("]\n"), "text").alias("block"))
    rows = keyed.groupBy("questionid", "chunk_no").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("chars").alias("chars"))
    out = rows.select(
        "questionid",
        "chunk_no",
        F.concat(F.lit("chunk-"), F.col("questionid"), F.lit("-"), F.format_string("%04d", F.col("chunk_no"))).alias("chunk_id"),
        F.array_distinct(F.transform("parts", lambda p: p["source_id"])).alias("source_ids"),
        F.array_join(F.transform("parts", lambda p: p["block"]), SEPARATOR).alias("text"),
        "chars",
    )
    out = out.withColumn("estimated_tokens", tx.token_range("chars"))
    return out.withColumn("chunk_hash", F.sha2(F.to_json(F.struct("chunk_id", "source_ids", "text", "chars")), 256))


def source_chunks(chunk_rows: DataFrame) -> DataFrame:
    """The chunk ids of each source, in order."""
    exploded = chunk_rows.select(F.explode("source_ids").alias("source_id"), "chunk_no", "chunk_id")
    ids = F.array_sort(F.collect_set(F.struct("chunk_no", "chunk_id")))
    return exploded.groupBy("source_id").agg(F.transform(ids, lambda x: x["chunk_id"]).alias("chunk_ids"))


def reusable(old_inputs: DataFrame, new_inputs: DataFrame) -> DataFrame:
    """C14: one row: whether the earlier chunks may be used again: the same sources with the same hashes, and as many rows."""
    old = old_inputs.groupBy("source_id").agg(F.min("sha256").alias("a"), F.max("sha256").alias("a2"), F.count(F.lit(1)).alias("na"))
    new = new_inputs.groupBy("source_id").agg(F.min("sha256").alias("b"), F.max("sha256").alias("b2"), F.count(F.lit(1)).alias("nb"))
    joined = old.join(new, "source_id", "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("a2").eqNullSafe(F.col("b2")) & F.col("na").eqNullSafe(F.col("nb"))
    return joined.agg(
        F.coalesce(F.bool_and(same), F.lit(True)).alias("reusable"),
        F.count_if(~same).cast("long").alias("changed_sources"),
        F.count(F.lit(1)).alias("sources"),
    )
