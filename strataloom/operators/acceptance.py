"""Acceptance of captures, status and hand-off."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as tx


def frame_count(markdown: Column) -> Column:
    """Answer headings ``## N.`` outside fenced code. An unclosed fence swallows the rest; a null text has none."""
    state = F.struct(F.lit(0).alias("fence"), F.lit(0).alias("frames"))

    def step(acc: Column, line: Column) -> Column:
        run = F.length(F.regexp_extract(line, r"^(`{3,})", 1))
        opens = line.rlike(r"\A`{3,}[^`]*\z")
        closes = line.rlike(r"\A`{3,}[ \t]*\z") & (run >= acc["fence"])
        fence = F.when(acc["fence"] == 0, F.when(opens, run).otherwise(0)).when(closes, 0).otherwise(acc["fence"])
        heading = (acc["fence"] == 0) & ~opens & line.rlike(r"\A## [0-9]+\.")
        return F.struct(fence.alias("fence"), (acc["frames"] + heading.cast("int")).alias("frames"))

    lines = F.split(F.regexp_replace(F.coalesce(markdown, F.lit("")), "\r\n?", "\n"), "\n")
    return F.aggregate(lines, state, step)["frames"]


#: The warning of each check, in order.
CHECKS = (
    "bare_array", "question_id_missing", "question_id_mismatch", "answers_not_array", "no_answers", "bad_answer_id", "duplicate_ids",
    "progress_missing", "not_done", "markdown_missing", "frame_mismatch", "corrupt_file", "marked_failed",
)


def capture_counts(answers: DataFrame) -> DataFrame:
    """For each question its rows, the rows beyond the first of an id, and the ids that are none (``question_id``, ``id``).

    Counted per id first, so that a question with a third of all rows is spread over its ids.
    """
    per_id = answers.groupBy("question_id", "id").agg(F.count(F.lit(1)).alias("n"))
    bad = ~F.coalesce(tx.valid_id("id"), F.lit(False))
    return per_id.groupBy("question_id").agg(
        F.sum("n").alias("answers"), F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad_ids")
    )


def acceptance(captures: DataFrame) -> DataFrame:
    """For each capture ``valid``, the counts and the ``warnings``.

    ``captures``: ``directory_id``, ``question_id``, ``bare_array``, ``answers`` (null if they are no array),
    ``duplicates``, ``bad_ids`` (see ``capture_counts``), ``reported_count``, ``done`` (null without progress),
    ``markdown`` (null if missing), ``corrupt_files``, ``failed``. A count that differs from the reported one is a
    warning only.
    """
    count = F.coalesce("answers", F.lit(0))
    captures = captures.withColumn("_frames", frame_count(F.col("markdown")))
    frames = F.col("_frames")
    shown = F.coalesce(tx.trim("markdown"), F.lit(""))
    tests = {
        "bare_array": F.coalesce("bare_array", F.lit(False)),
        "question_id_missing": F.coalesce(tx.trim("question_id"), F.lit("")) == "",
        "question_id_mismatch": F.col("question_id").isNotNull() & (F.col("question_id") != F.col("directory_id")),
        "answers_not_array": F.col("answers").isNull(),
        "no_answers": count == 0,
        "bad_answer_id": F.coalesce("bad_ids", F.lit(0)) > 0,
        "duplicate_ids": F.coalesce("duplicates", F.lit(0)) > 0,
        "progress_missing": F.col("done").isNull(),
        "not_done": ~F.coalesce("done", F.lit(True)),
        "markdown_missing": shown == "",
        "frame_mismatch": (count > 0) & (shown != "") & (frames != count),
        "corrupt_file": F.coalesce("corrupt_files", F.lit(0)) > 0,
        "marked_failed": F.coalesce("failed", F.lit(False)),
    }
    mismatch = F.coalesce(F.col("reported_count") != count, F.lit(False))
    listed = F.array_compact(F.array(*[F.when(tests[c], F.lit(c)) for c in CHECKS], F.when(mismatch, F.lit("count_mismatch"))))
    errors = F.array_remove(listed, "count_mismatch")
    return captures.select(
        "directory_id", (F.size(errors) == 0).alias("valid"), count.cast("long").alias("captured"), F.col("reported_count").alias("reported"), mismatch.alias("count_mismatch"),
        F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"), frames.cast("long").alias("frames"), listed.alias("warnings"),
    )


def handoffs(accepted: DataFrame, source_type: str) -> DataFrame:
    """The hand-off document of each valid capture."""
    return accepted.where("valid").select(
        F.lit("digest").alias("task"),
        F.lit(source_type).alias("source_type"),
        F.col("directory_id").alias("question_id"),
        F.concat("directory_id", F.lit("/answers.json")).alias("input_json"),
        F.concat("directory_id", F.lit("/answers.md")).alias("input_markdown"),
        F.lit(True).alias("verified"),
        F.col("captured").alias("answer_count"),
        "warnings",
    )


def status(progress: DataFrame, captured: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row a question with a numeric id: its offset, whether it is done, its rows and whether it was accepted."""
    named = progress.where(tx.valid_id("question_id"))
    counts = captured.groupBy("question_id").agg(F.count(F.lit(1)).alias("answers"))
    valid = accepted.select(F.col("directory_id").alias("question_id"), "valid")
    joined = named.join(counts, "question_id", "left").join(valid, "question_id", "left")
    return joined.select("question_id", "offset", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("answers", F.lit(0)).alias("answers"), F.coalesce("valid", F.lit(False)).alias("valid"))


def batch_summary(results: DataFrame, ok: str = "valid") -> DataFrame:
    """How many succeeded and failed, and whether all did."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return results.agg(F.count_if(good).cast("long").alias("succeeded"), F.count_if(~good).cast("long").alias("failed"), F.coalesce(F.bool_and(good), F.lit(True)).alias("ok"))


# ---------------------------------------------------------------- one document on the driver

#: The keys of a hand-off document (fixed names), the site's type of source being a parameter.
HANDOFF_SCHEMA: dict[str, Any] = {
    "type": "object",
    "additionalProperties": False,
    "required": ["task", "sourceType", "questionId", "inputJson", "inputMarkdown", "verified", "answerCount", "warnings"],
    "properties": {
        "task": {"type": "string", "enum": ["inspect", "digest", "archive"]},
        "sourceType": {"type": "string"},
        "questionId": {"type": "string", "pattern": r"^\d{1,20}$"},
        "inputJson": {"type": "string"},
        "inputMarkdown": {"type": "string"},
        "verified": {"type": "boolean", "const": True},
        "answerCount": {"type": "integer", "minimum": 0},
        "warnings": {"type": "array", "items": {"type": "string"}},
    },
}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (kind == "number" or float(value).is_integer())
    return isinstance(value, {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}[kind])


def schema_issues(schema: Mapping[str, Any], value: Any, at: str = "$") -> list[str]:
    """What breaks a schema of type, enum, const, pattern, minimum, required, properties, additionalProperties and items."""
    if "type" in schema and not _is(value, schema["type"]):
        return [f"{at}: not of type {schema['type']}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not an allowed value")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the fixed value")
    if "pattern" in schema and isinstance(value, str) and not re.search(schema["pattern"].replace(r"\d", "[0-9]").removesuffix("$") + (r"\Z" if schema["pattern"].endswith("$") else ""), value):
        out.append(f"{at}: does not match")
    if "minimum" in schema and _is(value, "number") and value < schema["minimum"]:
        out.append(f"{at}: below {schema['minimum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: not allowed" for k in value if k not in known]
        for k, s in known.items():
            if k in value:
                out += schema_issues(s, value[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += schema_issues(schema["items"], v, f"{at}[{k}]")
    return out


def verify_handoff(path: str, root: str, source_type: str) -> list[str]:
    """The issues of a hand-off file: its schema, then its paths (relative, inside ``root``), then counts and ids.

    Files whose paths fail are not read.
    """
    with open(path, encoding="utf-8") as file:
        try:
            doc = json.load(file)
        except ValueError:
            return ["$: not JSON"]
    schema = {**HANDOFF_SCHEMA, "properties": {**HANDOFF_SCHEMA["properties"], "sourceType": {"type": "string", "const": source_type}}}
    found = schema_issues(schema, doc)
    if found:
        return found
    real_root = os.path.realpath(root)
    for key in ("inputJson", "inputMarkdown"):
        target = os.path.realpath(os.path.join(real_root, doc[key]))
        if os.path.isabs(doc[key]) or re.match(r"[A-Za-z]:[\\/]", doc[key]) or os.path.commonpath([real_root, target]) != real_root:
            found.append(f"$.{key}: outside the root")
        elif not os.path.isfile(target):
            found.append(f"$.{key}: no such file")
    if found:
        return found
    with open(os.path.join(real_root, doc["inputJson"]), encoding="utf-8") as file:
        try:
            source = json.load(file)
        except ValueError:
            return ["$.inputJson: not JSON"]
    answers = source.get("answers") if isinstance(source, dict) else None
    if not isinstance(answers, list):
        return ["$.inputJson: no answers"]
    if len(answers) != doc["answerCount"]:
        found.append("$.answerCount: differs from the file")
    if str(source.get("questionId")) != doc["questionId"]:
        found.append("$.questionId: differs from the file")
    return found


def bounded(name: str, value: Any, low: int, high: int) -> int:
    """A whole number in a range, read from a text or a number."""
    text = str(value).strip()
    if not re.fullmatch(r"[0-9]{1,15}", text) or not low <= int(text) <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return int(text)
