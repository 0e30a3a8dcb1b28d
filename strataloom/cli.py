"""Command line: each command prints one JSON envelope and ends with a stable code.

python -m strataloom.cli stats|sample|digest|archive|verify|ingest|status ...
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators import acceptance, archive, chunking, stats
from strataloom.operators.acceptance import bounded
from strataloom.session import build_session
from strataloom.shared import written
from strataloom.sources import files
from strataloom.sources.pages import PagingError
from strataloom.streaming import replay

#: Exit codes: everything went well, something failed, the call itself was wrong.
OK, FAILED, USAGE = 0, 1, 2


def error_type(error: BaseException) -> str:
    """A stable name of what went wrong."""
    if isinstance(error, PagingError):
        return "paging_error"
    if isinstance(error, files.CorruptFile) or "corrupt document" in str(error):
        return "corrupt_input"
    if isinstance(error, FileNotFoundError):
        return "not_found"
    if isinstance(error, ValueError):
        return "invalid_argument"
    return "internal_error"


def public_message(error: BaseException) -> str:
    """The first line of a message without absolute paths and control characters."""
    line = str(error).strip().split("\n")[0]
    line = "".join(c for c in line if c >= " " and c != "\x7f")
    return re.sub(r"(?:file:)?(?:/[^\s/'\",;()]+){2,}|[A-Za-z]:[\\/][^\s'\",;()]+", "[path]", line)[:300]


def emit(payload: dict[str, Any]) -> None:
    """A31."""
    print(json.dumps(payload, ensure_ascii=False, default=str))


def _answers(spark: SparkSession, inputs: list[str]):
    return files.answers_of(files.question_documents(spark, inputs))


def run_stats(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Sizes of text files."""
    docs = files.text_documents(spark, args.inputs)
    return stats.totals(stats.file_stats(docs, "path", "text")).first().asDict()


def run_sample(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The best answers of each question as text files, one a question."""
    from strataloom.operators.documents import sample_blocks

    docs = files.question_documents(spark, args.inputs, skip_corrupt=True)
    titles = docs.where(~F.col("corrupt")).select(F.col("question_id").alias("questionid"), "title")
    blocks = sample_blocks(files.answers_of(docs), titles, bounded("top", args.top, 1, 100), bounded("max-chars", args.max_chars, 1, 1_000_000))
    blocks = written(blocks, "samples")
    blocks.select("questionid", F.col("block").alias("value")).write.mode("overwrite").partitionBy("questionid").text(args.out)
    return {"questions": blocks.count(), "skipped": docs.where("corrupt").count(), "out": args.out}


def run_digest(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Chunks and manifest of question documents; an unchanged input is not chunked again."""
    answers = written(_answers(spark, args.inputs), "answers")
    inputs = chunking.manifest_inputs(answers)
    config = {"max_chars": bounded("max-chars", args.max_chars, 1000, 1_000_000), "max_answers": bounded("max-answers", args.max_answers, 1, 10_000)}
    state = files.read_json(os.path.join(args.out, "config.json"))
    if state == config and os.path.isdir(os.path.join(args.out, "chunks")):
        if chunking.reusable(spark.read.parquet(os.path.join(args.out, "inputs")), inputs).first().reusable:
            return {"reused": True, "chunks": spark.read.parquet(os.path.join(args.out, "chunks")).count()}
    segments = written(chunking.segments(answers, config["max_chars"]), "segments")
    made = chunking.chunks(segments, chunking.chunk_segments(segments, config["max_chars"], config["max_answers"]))
    made.write.mode("overwrite").parquet(os.path.join(args.out, "chunks"))
    made = spark.read.parquet(os.path.join(args.out, "chunks"))
    inputs.join(chunking.source_chunks(made), "source_id", "left").write.mode("overwrite").parquet(os.path.join(args.out, "inputs"))
    files.write_json(os.path.join(args.out, "config.json"), config)
    return {"reused": False, "chunks": made.count(), "sources": inputs.count()}


def run_archive(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Framed volumes with a manifest, verified after they are written."""
    if args.max_chars and args.by_count:
        raise ValueError("max-chars and by-count exclude each other")
    docs = files.text_documents(spark, args.inputs, "answers.md").withColumn("source", F.regexp_extract("path", "([^/]+/[^/]+)$", 1))
    rows = written(archive.entries(docs, "source", "text"), "entries")
    if args.by_count:
        placed = archive.by_count(rows, bounded("by-count", args.by_count, 1, 10_000_000))
    else:
        placed = archive.by_chars(rows, bounded("max-chars", args.max_chars or 2**31 - 1, 1, 2**31 - 1))
    made = archive.volumes(rows, placed, args.title, args.stamp)
    made.write.mode("overwrite").parquet(args.out)
    verdict = archive.verify(rows, archive.extract_sections(spark.read.parquet(args.out)))
    bad = verdict.where("status <> 'ok'").count()
    return {"valid": bad == 0, "failed": bad, **archive.totals(rows).first().asDict(), "volumes": placed.select("volume").distinct().count()}


def run_verify(spark: SparkSession, args: argparse.Namespace) -> dict:
    """An archive against the documents it was made of."""
    docs = files.text_documents(spark, args.inputs, "answers.md").withColumn("source", F.regexp_extract("path", "([^/]+/[^/]+)$", 1))
    verdict = archive.verify(archive.entries(docs, "source", "text"), archive.extract_sections(spark.read.parquet(args.out)))
    counts = {r.status: r["count"] for r in verdict.groupBy("status").count().collect()}
    return {"valid": set(counts) <= {"ok"}, "counts": counts}


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Replayed pages into a table; goes on where an earlier run stopped."""
    replay.ingest(spark, args.inputs[0], os.path.join(args.out, "table"), os.path.join(args.out, "state")).awaitTermination()
    table = replay.read_table(spark, os.path.join(args.out, "table"))
    return {"answers": table.count(), "questions": table.select("questionid").distinct().count()}


#: Questions that the envelope of ``status`` lists; the table below --out has all.
LISTED = 10_000


def run_status(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The questions below a folder with their answers.

    All rows are counted, and written to ``status`` below --out if that is given; the envelope lists the first LISTED,
    ``truncated`` are the others.
    """
    docs = files.question_documents(spark, args.inputs, skip_corrupt=True)
    rows = docs.where(tx.valid_id("directory")).select("directory", "corrupt", F.coalesce(F.size("doc.answers"), F.lit(0)).alias("answers"))
    made = written(rows, "status")
    if args.out:
        made.write.mode("overwrite").parquet(os.path.join(args.out, "status"))
    total = made.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.count_if("corrupt"), F.lit(0)).alias("corrupt"), F.coalesce(F.sum("answers"), F.lit(0)).alias("answers")).first()
    listed = [r.asDict() for r in made.orderBy("directory").limit(LISTED).collect()]
    return {"questions": listed, "total": total.total, "answers": total.answers, "corrupt": total.corrupt, "truncated": total.total - len(listed)}


COMMANDS = {"stats": run_stats, "sample": run_sample, "digest": run_digest, "archive": run_archive, "verify": run_verify, "ingest": run_ingest, "status": run_status}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strataloom")
    out.add_argument("command", choices=sorted(COMMANDS))
    out.add_argument("inputs", nargs="+")
    out.add_argument("--out", default=None)
    out.add_argument("--master")
    out.add_argument("--top", default=6)
    out.add_argument("--max-chars", default=None)
    out.add_argument("--max-answers", default=40)
    out.add_argument("--by-count", default=None)
    out.add_argument("--title", default="archive")
    out.add_argument("--stamp", default="")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return OK if stop.code in (0, None) else USAGE
    if args.out is None and args.command != "status":
        args.out = "out"
    if args.max_chars is None:
        args.max_chars = {"sample": 1300, "digest": 24_000}.get(args.command)
    try:
        result = COMMANDS[args.command](spark or build_session("strataloom", args.master), args)
    except Exception as error:  # the envelope tells what went wrong
        emit({"ok": False, "command": args.command, "error": {"type": error_type(error), "message": public_message(error)}})
        return USAGE if error_type(error) == "invalid_argument" else FAILED
    ok = bool(result.get("valid", True))
    emit({"ok": ok, "command": args.command, **result})
    return OK if ok else FAILED


if __name__ == "__main__":
    sys.exit(main())
