"""Queries over the captured corpus, each over its whole tables; the numbers are those of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import html, urls
from strataloom.functions import text as tx
from strataloom.operators import acceptance, archive, chunking, documents, evidence, ingest, merge, packing, sampling, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASE = "https://qa.example"
MAX_CHARS, MAX_SEGMENTS = 2000, 8


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- text


@query
def strip_html_answers(spark, folder):
    """H1, H2, H4"""
    return load(spark, folder, "answers").select("captureseq", tx.strip_html("content").alias("text"))


@query
def clean_text_answers(spark, folder):
    """H5"""
    return load(spark, folder, "answers").select("captureseq", tx.clean_text("content").alias("text"))


@query
def decode_entities_answers(spark, folder):
    """H1"""
    return load(spark, folder, "answers").where("content is not null").select("captureseq", tx.decode_entities("content").alias("text"))


@query
def token_range_chunks(spark, folder):
    """H7"""
    return load(spark, folder, "chunk").distinct().select("chunkid", "chars", tx.token_range("chars").alias("t")).select("chunkid", "chars", "t.tokmin", "t.tokmax")


@query
def terminal_safe_documents(spark, folder):
    """H6"""
    return load(spark, folder, "documents").select("doc_id", tx.terminal_safe("text").alias("text"))


@query
def escape_inline_comments(spark, folder):
    """H3"""
    return load(spark, folder, "comments").distinct().select("id", "answerid", tx.escape_inline_markdown("contentmarkdown").alias("text"))


@query
def escape_markdown_documents(spark, folder):
    """H20, H21"""
    return load(spark, folder, "documents").select("doc_id", tx.escape_markdown("text").alias("text"))


@query
def neutralize_lines_documents(spark, folder):
    """H21"""
    return load(spark, folder, "documents").select("doc_id", tx.neutralize_lines("text").alias("text"))


@query
def text_measures_answers(spark, folder):
    """H10, H14, H16, and the UTF-16 length"""
    return load(spark, folder, "answers").select(
        "captureseq", tx.utf16_length("content").alias("units"), tx.longest_backtick_run("content").alias("backticks"), tx.count_lines("content").alias("lines"), tx.normalize_author("author").alias("author")
    )


@query
def safe_lines_questions(spark, folder):
    """H8, H10"""
    return load(spark, folder, "question").select("id", tx.safe_text("title").alias("safe"), tx.collapse_whitespace("title").alias("title")).distinct()


@query
def masked_paths_documents(spark, folder):
    """H13, B17"""
    return archive.leaks(load(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.size("paths").cast("long").alias("leaks"))


@query
def format_time_answers(spark, folder):
    """H60, H62, H65"""
    return load(spark, folder, "answers").select(
        "captureseq", tx.format_time("createdtime").alias("created"), tx.thousands(F.coalesce("voteupcount", F.lit(0))).alias("votes"), tx.answer_url("questionid", "id", BASE).alias("url")
    )


@query
def numeric_props_events(spark, folder):
    """H61, H66"""
    amount = F.get_json_object("props", "$.k")
    return load(spark, folder, "events").select("event_id", tx.numeric_or(amount, -1.0).alias("v"))


@query
def content_hashes_answers(spark, folder):
    """H63"""
    return load(spark, folder, "answers").select("captureseq", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


# ---------------------------------------------------------------- sizes and matching


@query
def file_stats(spark, folder):
    """D7"""
    return stats.file_stats(load(spark, folder, "documents"), "doc_id", "text")


@query
def corpus_totals(spark, folder):
    """D7"""
    return stats.totals(stats.file_stats(load(spark, folder, "documents"), "doc_id", "text"))


@query
def stable_fragments_answers(spark, folder):
    """H9, H11"""
    return load(spark, folder, "answers").select("captureseq", stats.fragments(tx.normalize_html("content")).alias("fragments"))


@query
def content_matched_captures(spark, folder):
    """The first capture of an answer against every later one"""
    rows = load(spark, folder, "answers").where("id is not null").select("id", "captureseq", "content")
    first = ingest.keep_first(rows, "id", "captureseq").select("id", F.col("captureseq").alias("first"), F.col("content").alias("original"))
    later = rows.join(first, "id").where(F.col("captureseq") > F.col("first"))
    return later.select("captureseq", stats.content_matched(F.col("original"), tx.strip_html("content")).alias("matched"))


# ---------------------------------------------------------------- rank and sample


@query
def rank_answers(spark, folder):
    """E1, F1"""
    rows = load(spark, folder, "answers").where("questionid is not null").select("questionid", "captureseq", "voteupcount")
    return sampling.ranked(rows, "questionid", "voteupcount", "captureseq")


@query
def top_n_per_group(spark, folder):
    """F3, J2"""
    rows = load(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return sampling.top_per_group(rows, "source", "n_chars", "doc_id", 6)


@query
def top_lineitems_per_supplier(spark, folder):
    """F3, J2"""
    rows = load(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    window = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return rows.withColumn("rank", F.row_number().over(window)).where("rank <= 6")


@query
def popular_sample(spark, folder):
    """F3, F8, H4"""
    return sampling.popular_sample(load(spark, folder, "documents"), "source", "n_chars", "doc_id", "text")


@query
def excerpts_documents(spark, folder):
    """F8"""
    return load(spark, folder, "documents").select("doc_id", chunking.excerpt(F.col("text"), 300).alias("excerpt"))


@query
def quantile_sample(spark, folder):
    """E9"""
    rows = load(spark, folder, "answers").where("questionid is not null").select("questionid", "captureseq")
    return sampling.place_sample(rows, "questionid", "captureseq")


@query
def top_percent_answers(spark, folder):
    """K2"""
    rows = ingest.keep_first(load(spark, folder, "answers").select("id", "questionid", "voteupcount", "captureseq"), "id", "captureseq").where("questionid is not null")
    return sampling.top_percent(rows, "questionid", "voteupcount", 20).select("questionid", "id", "voteupcount", "group_size")


# ---------------------------------------------------------------- ingestion


@query
def canonical_answers(spark, folder):
    """B1"""
    return ingest.canonical_answers(load(spark, folder, "answers")).drop("content").distinct()


@query
def dedupe_keep_first(spark, folder):
    """E5"""
    return ingest.keep_first(load(spark, folder, "answers").select("id", "questionid", "voteupcount", "captureseq"), "id", "captureseq")


@query
def duplicate_ids(spark, folder):
    """D8"""
    return ingest.duplicate_ids(load(spark, folder, "answers").where("questionid is not null"), "questionid", "id")


@query
def repeated_page_guard(spark, folder):
    """E6"""
    rows = load(spark, folder, "answers").where("questionid is not null").select("questionid", "id", "captureseq")
    return ingest.repeated_pages(rows, "questionid", "id", "captureseq").select("questionid", "page", "repeated")


@query
def merge_insert_only(spark, folder):
    """What was captured by a day, and the later rows merged into it"""
    rows = load(spark, folder, "answers").where("id is not null").select("id", "questionid", "voteupcount", "captureseq", "fetchedat")
    middle = F.lit("2022-04-01 00:00:00").cast("timestamp")
    old = ingest.keep_first(rows.where(F.col("fetchedat") < middle), "id", "captureseq")
    return ingest.merge_insert_only(old, rows.where(F.col("fetchedat") >= middle), "id", "captureseq").drop("fetchedat")


@query
def top10_answers(spark, folder):
    """F2"""
    first = ingest.keep_first(load(spark, folder, "answers").select("id", "questionid", "voteupcount", "captureseq"), "id", "captureseq").where("questionid is not null")
    return ingest.top_answers(first, "questionid", "voteupcount", "captureseq")


@query
def first3_comments(spark, folder):
    """B14, F5"""
    got = ingest.root_comments(load(spark, folder, "comments"))
    return got.select("answerid", "valid", F.coalesce(F.size("comments"), F.lit(-1)).alias("kept"), F.transform("comments", lambda c: c["id"]).alias("ids"))


@query
def comments_upsert(spark, folder):
    """A fetch for the ten best answers of each question fails for odd ids and succeeds for the rest"""
    roots = ingest.root_comments(load(spark, folder, "comments")).select(F.col("answerid").alias("id"), F.transform("comments", lambda c: c["id"]).alias("comments"))
    first = ingest.keep_first(load(spark, folder, "answers").select("id", "questionid", "voteupcount", "captureseq"), "id", "captureseq").where("questionid is not null")
    best = ingest.top_answers(first, "questionid", "voteupcount", "captureseq").select("id")
    ok = F.right("id", F.lit(1)).isin("0", "2", "4", "6", "8")
    fetched = best.select("id", ok.alias("ok"), F.array(F.concat(F.lit("new-"), "id")).alias("new_comments"))
    return ingest.merge_comments(first.select("id").join(roots, "id", "left"), best, fetched)


@query
def first10_distinct(spark, folder):
    """F4"""
    rows = load(spark, folder, "answers").where("questionid is not null").select("questionid", "captureseq", "author")
    return ingest.first_distinct(rows, "questionid", "captureseq").select("questionid", "first_order", "author")


@query
def search_candidates(spark, folder):
    """B4, B10, C13, F4"""
    titles = load(spark, folder, "question").select("id", "title", "answercount")
    found = load(spark, folder, "answers").where("questionid is not null").select(F.col("captureseq").alias("place"), "questionid", F.lit("t").alias("title"))
    return ingest.candidates(found, titles.select(F.col("id").alias("questionid"), "answercount")).drop("title")


@query
def question_metadata(spark, folder):
    """B2, B3"""
    got = ingest.question_metadata(load(spark, folder, "question"))
    return got.select("id", "has_detail", "answercount", F.coalesce(F.size("topics"), F.lit(-1)).alias("topics"))


@query
def question_ids(spark, folder):
    """Ids read from the addresses of answers"""
    return load(spark, folder, "answers").select("captureseq", tx.valid_id("id").alias("valid"), tx.question_id("url").alias("question_id"))


# ---------------------------------------------------------------- chunks


def _segments(spark, folder):
    answers = load(spark, folder, "answers").select("questionid", "id", "captureseq", "content")
    return chunking.segments(answers, MAX_CHARS)


@query
def split_long_text(spark, folder):
    """E8"""
    rows = load(spark, folder, "documents").select("doc_id", F.posexplode(chunking.split_long(F.col("text"), MAX_CHARS)).alias("part", "text"))
    return rows


@query
def greedy_chunks(spark, folder):
    """Documents packed by source"""
    rows = load(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return packing.greedy_pack(rows, "source", ["doc_id"], "n_chars", 24_000, 40)


@query
def answer_chunks(spark, folder):
    """D5, D6, D11, E2, E8"""
    from strataloom.shared import written

    rows = written(_segments(spark, folder), "segments")
    made = chunking.chunks(rows, chunking.chunk_segments(rows, 24_000, 40))
    return made.select("questionid", "chunk_no", "chunk_id", F.size("source_ids").alias("sources"), "chars", "chunk_hash")


@query
def manifest_inputs(spark, folder):
    """B5"""
    return chunking.manifest_inputs(load(spark, folder, "answers")).distinct()


@query
def manifest_reuse(spark, folder):
    """C14: the manifest of first captures against that of last ones"""
    rows = load(spark, folder, "answers").where("id is not null and questionid is not null")
    old = ingest.keep_first(rows, "id", "captureseq")
    new = ingest.keep_first(rows.withColumn("back", -F.col("captureseq")), "id", "back")
    return chunking.reusable(chunking.manifest_inputs(old), chunking.manifest_inputs(new))


@query
def volumes_by_chars(spark, folder):
    """E3"""
    rows = load(spark, folder, "documents").select("doc_id", "n_chars", F.lit("all").alias("g"))
    return packing.greedy_pack(rows, "g", ["doc_id"], "n_chars", 50_000, number="volume").drop("g")


@query
def volumes_by_count(spark, folder):
    """E4"""
    return packing.pack_by_count(load(spark, folder, "documents").select("source", "doc_id"), "source", ["doc_id"], 25)


# ---------------------------------------------------------------- evidence


def _digest(spark, folder):
    """A digest's inputs, chunks and map results derived from the captured chunks; the maps hold known faults.

    Of every chunk the map cites its sources; by the last digits of the chunk's number some maps are stale, lack a
    summary, cite a foreign source, miss a source or are absent.
    """
    made = load(spark, folder, "chunk").where("chunkid is not null").groupBy("chunkid").agg(F.first("sourceids").alias("source_ids"), F.max("chunkhash").alias("chunk_hash"))
    made = made.withColumnRenamed("chunkid", "chunk_id").withColumn("status", F.lit(None).cast("string"))
    n = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long") % 10
    some = made.withColumn("n", n)
    inputs = some.select(F.explode("source_ids").alias("source_id"), "chunk_id").groupBy("source_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    inputs = inputs.withColumn("sha256", F.sha2("source_id", 256))
    cited = F.when(F.col("n") == 3, F.array_append("source_ids", F.lit("question-0-answer-0"))).when(F.col("n") == 4, F.slice("source_ids", 2, 100_000)).otherwise(F.col("source_ids"))
    claim = F.struct(F.concat(F.lit("claim "), F.col("n").cast("string")).alias("claim"), F.slice("source_ids", 1, 2).alias("evidence_source_ids"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("n") % 3 + 1).cast("int")).alias("confidence"))
    bad = F.struct(F.lit(" ").alias("claim"), F.array(F.lit("question-0-answer-0")).alias("evidence_source_ids"), F.lit("sure").alias("confidence"))
    cover = F.transform("source_ids", lambda s: F.struct(s.alias("source_id"), F.lit("seen").alias("summary"), F.lit("substantive").alias("disposition")))
    maps = some.where("n <> 9").select(
        F.concat(F.lit("map-"), "chunk_id", F.lit(".json")).alias("file"),
        "chunk_id",
        F.when(F.col("n") == 1, "old").otherwise(F.col("chunk_hash")).alias("chunk_hash"),
        cited.alias("source_ids"),
        F.when(F.col("n") == 2, " ").otherwise("s").alias("summary"),
        F.when(F.col("n") == 5, F.array(claim, bad)).otherwise(F.array(claim)).alias("claims"),
        F.when(F.col("n") != 6, F.array(F.concat(F.lit("theme "), (F.col("n") % 4).cast("string")), F.lit("shared"))).alias("themes"),
        F.array(F.concat(F.lit(" doubt "), (F.col("n") % 2).cast("string"))).alias("uncertainties"),
        F.when(F.col("n") == 7, F.slice(cover, 1, 1)).otherwise(cover).alias("source_coverage"),
        F.lit(False).alias("corrupt"),
    )
    current = inputs.select("source_id", F.when(F.right("source_id", F.lit(1)) == "7", "changed").otherwise(F.col("sha256")).alias("sha256"))
    return inputs, made, maps, current


@query
def missing_sources(spark, folder):
    """C4: sources of captured answers against the captured chunks"""
    inputs = chunking.manifest_inputs(load(spark, folder, "answers")).select("source_id").distinct()
    listed = load(spark, folder, "chunk").select(F.explode("sourceids").alias("source_id"), F.col("chunkid").alias("chunk_id")).groupBy("source_id").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    joined = inputs.join(listed, "source_id", "left")
    return evidence.missing_sources(joined, load(spark, folder, "chunk").select(F.col("chunkid").alias("chunk_id")))


@query
def unknown_sources(spark, folder):
    """Sources of chunks that were not captured"""
    inputs = chunking.manifest_inputs(load(spark, folder, "answers")).select("source_id")
    made = load(spark, folder, "chunk").distinct().select(F.col("chunkid").alias("chunk_id"), F.col("sourceids").alias("source_ids"), F.col("chunkhash").alias("chunk_hash"))
    return evidence.unknown_sources(made, inputs)


@query
def duplicate_assignments(spark, folder):
    """C5"""
    made = load(spark, folder, "chunk").distinct().select(F.col("chunkid").alias("chunk_id"), F.concat("sourceids", F.slice("sourceids", 1, 1)).alias("source_ids"), F.col("chunkhash").alias("chunk_hash"))
    return evidence.duplicate_assignments(made)


@query
def missing_maps(spark, folder):
    """C2, C3, C18"""
    _, made, maps, _ = _digest(spark, folder)
    return evidence.missing_maps(evidence.gated_maps(maps, made), made)


@query
def map_gates(spark, folder):
    """C2, C18, D4"""
    _, made, maps, _ = _digest(spark, folder)
    return evidence.gated_maps(maps, made).select("file", "gate", "registered")


@query
def map_issues(spark, folder):
    """C6, C7, C8, G2, G3"""
    _, made, maps, _ = _digest(spark, folder)
    return evidence.map_content(evidence.gated_maps(maps, made)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def stale_hashes(spark, folder):
    """C17"""
    inputs, _, _, current = _digest(spark, folder)
    return evidence.stale_hashes(inputs, current)


@query
def coverage_report(spark, folder):
    """D4"""
    return evidence.coverage_report(evidence.issues(*_digest(spark, folder)))


@query
def set_hash_chunks(spark, folder):
    """D10"""
    made = load(spark, folder, "chunk").distinct().groupBy("chunkid").agg(F.max("text").alias("text"))
    return evidence.set_hash(made, "chunkid", "text")


def _claims(spark, folder):
    _, _, maps, _ = _digest(spark, folder)
    seq = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long")
    return maps.select(seq.alias("m"), F.posexplode("claims").alias("at", "c")).select(
        (F.col("m") * 100 + F.col("at")).alias("seq"), F.col("c.claim").alias("claim"), F.col("c.evidence_source_ids").alias("evidence"), F.col("c.confidence").alias("confidence")
    )


def _sources(spark, folder):
    rows = load(spark, folder, "chunk").distinct().select(F.col("chunkid").alias("k"), F.posexplode("sources").alias("at", "s"))
    seq = F.regexp_extract("k", r"(\d+)$", 1).cast("long") * 10_000 + F.col("at")
    return rows.select(seq.alias("seq"), F.col("s.sourceid").alias("source_id"), F.coalesce("s.voteupcount", F.lit(0)).alias("votes"))


@query
def theme_counts(spark, folder):
    """The topics of questions as themes"""
    rows = load(spark, folder, "question").select("id", F.posexplode("topics").alias("at", "t"))
    seq = F.col("id").cast("decimal(20,0)") * 100 + F.col("at")
    return merge.theme_counts(rows.select(seq.alias("seq"), F.col("t.topicname").alias("theme"))).select("theme", "occurrences")


@query
def merge_claims(spark, folder):
    """C1, D2, G1"""
    return merge.merge_claims(_claims(spark, folder), _sources(spark, folder)).select("text", F.array_sort("evidence").alias("evidence"), "confidence", "occurrences", "first_seq")


@query
def high_vote_sources(spark, folder):
    """B12, C1"""
    return merge.high_votes(_claims(spark, folder), _sources(spark, folder))


@query
def low_confidence(spark, folder):
    """B11"""
    return merge.low_confidence(merge.merge_claims(_claims(spark, folder), _sources(spark, folder))).select("text", "occurrences")


@query
def uncertainties_in_order(spark, folder):
    """D3, G4"""
    _, _, maps, _ = _digest(spark, folder)
    seq = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long")
    return merge.distinct_in_order(maps.select(seq.alias("seq"), F.explode("uncertainties").alias("uncertainty")), "uncertainty")


@query
def final_evidence_check(spark, folder):
    """C9, D16"""
    inputs, _, _, _ = _digest(spark, folder)
    claims = _claims(spark, folder).select(F.col("seq").alias("claim_no"), F.col("claim").alias("text"), F.col("evidence").alias("evidence_source_ids"), "confidence")
    return evidence.final_report(claims, inputs)


# ---------------------------------------------------------------- acceptance


def _captures(spark, folder):
    """A capture for each question, as its directory would hold it, with the text of its document."""
    rows = load(spark, folder, "answers").where("questionid is not null").select(F.col("questionid").alias("question_id"), "id", "captureseq")
    counts = acceptance.capture_counts(rows).join(rows.groupBy("question_id").agg(F.max("captureseq").alias("last")), "question_id")
    reported = ingest.question_metadata(load(spark, folder, "question")).select(F.col("id").alias("question_id"), "answercount")
    frame = "## 1. x\n\n```\n## 9. no\n```\n"
    return counts.join(reported, "question_id", "left").select(
        F.col("question_id").alias("directory_id"),
        F.when(F.col("last") % 11 == 0, "0").otherwise(F.col("question_id")).alias("question_id"),
        F.lit(False).alias("bare_array"),
        "answers",
        "duplicates",
        "bad_ids",
        F.col("answercount").alias("reported_count"),
        F.when(F.col("last") % 7 != 0, F.col("last") % 5 != 0).alias("done"),
        F.concat(F.lit("# t\n"), F.repeat(F.lit(frame), F.col("answers").cast("int"))).alias("markdown"),
        F.lit(0).alias("corrupt_files"),
        F.lit(False).alias("failed"),
    )


@query
def acceptance_report(spark, folder):
    """C16, D9, D15"""
    return acceptance.acceptance(_captures(spark, folder)).withColumn("warnings", F.array_join("warnings", ","))


@query
def frame_count_documents(spark, folder):
    """D9"""
    return load(spark, folder, "documents").select("doc_id", acceptance.frame_count(F.col("text")).cast("long").alias("frames"))


@query
def handoff_rows(spark, folder):
    """A32"""
    return acceptance.handoffs(acceptance.acceptance(_captures(spark, folder)), "qa-answers").drop("warnings")


@query
def status_rows(spark, folder):
    """B8, B13"""
    rows = load(spark, folder, "answers").where("questionid is not null")
    progress = rows.groupBy(F.col("questionid").alias("question_id")).agg(F.count(F.lit(1)).alias("offset"), (F.max("captureseq") % 5 != 0).alias("done"))
    return acceptance.status(progress, rows.select(F.col("questionid").alias("question_id")), acceptance.acceptance(_captures(spark, folder)))


@query
def batch_summary(spark, folder):
    """D13, D14"""
    return acceptance.batch_summary(acceptance.acceptance(_captures(spark, folder)))


# ---------------------------------------------------------------- archive


@query
def archive_entries(spark, folder):
    """A27, A28"""
    return archive.entries(load(spark, folder, "documents"), "doc_id", "text").drop("body")


@query
def archive_totals(spark, folder):
    """D12"""
    return archive.totals(archive.entries(load(spark, folder, "documents"), "doc_id", "text"))


@query
def archive_round_trip(spark, folder):
    """Documents written to framed volumes, read again and compared"""
    rows = archive.entries(load(spark, folder, "documents"), "doc_id", "text")
    made = archive.volumes(rows, archive.by_chars(rows, 100_000), "archive", "2024-01-01T00:00:00Z")
    return archive.verify(rows, archive.extract_sections(made))


# ---------------------------------------------------------------- HTML and addresses


@query
def render_markdown_answers(spark, folder):
    """H30-H42"""
    return load(spark, folder, "answers").select("captureseq", html.rich_markdown(F.col("content"), F.col("id")).alias("markdown"))


@query
def render_comments(spark, folder):
    """H30-H42"""
    return load(spark, folder, "comments").distinct().select("id", "answerid", html.rich_markdown(F.col("contenthtml"), F.lit(None).cast("string")).alias("markdown"))


@query
def code_projection_answers(spark, folder):
    """K1"""
    return load(spark, folder, "answers").where(F.contains(F.lower("content"), F.lit("<pre"))).select("captureseq", html.project_code(html.rich_markdown(F.col("content"), F.col("id"))).alias("text"))


@query
def extract_assets_answers(spark, folder):
    """H15, H50-H56, K4"""
    return load(spark, folder, "answers").where(F.contains(F.lower("content"), F.lit("<"))).select("captureseq", html.extract_assets(F.col("content")).alias("a")).select("captureseq", "a.*")


@query
def image_counts_answers(spark, folder):
    """H51, H52"""
    got = load(spark, folder, "answers").where(F.contains(F.lower("content"), F.lit("<img"))).select("captureseq", html.extract_assets(F.col("content")).alias("a"))
    return got.select("captureseq", F.size("a.images").alias("images"), F.size(F.filter("a.images", lambda x: x["clickable"])).alias("clickable"))


@query
def code_blocks_answers(spark, folder):
    """H15, H55"""
    got = load(spark, folder, "answers").where(F.contains(F.lower("content"), F.lit("<pre"))).select("captureseq", html.extract_assets(F.col("content")).alias("a"))
    return got.select("captureseq", F.size("a.code_blocks").alias("blocks"), F.aggregate("a.code_blocks", F.lit(0).cast("long"), lambda n, c: n + c["lines"]).alias("lines"))


@query
def classify_answer_urls(spark, folder):
    """H27"""
    return load(spark, folder, "answers").select("captureseq", urls.answer_check(F.col("url"), F.col("questionid"), F.col("id")).alias("verdict"))


@query
def classify_urls_documents(spark, folder):
    """H22, H23, H24"""
    rows = load(spark, folder, "documents").where(F.contains(F.lower("text"), F.lit("http"))).select("doc_id", F.explode(urls.bare_urls(F.col("text"))).alias("url"))
    got = rows.select("doc_id", "url", urls.url_class(F.col("url")).alias("c"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.coalesce("c.clickable", F.lit(False))).cast("long").alias("clickable"))


# ---------------------------------------------------------------- documents


@query
def answer_documents(spark, folder):
    """The blocks of all answers, as hashes"""
    got = documents.answer_blocks(load(spark, folder, "answers"), BASE)
    return got.select("questionid", "rank", F.sha2("block", 256).alias("sha256"))


@query
def digest_document(spark, folder):
    """B7, H70"""
    _, _, maps, _ = _digest(spark, folder)
    seq = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long")
    merged = merge.merge_claims(_claims(spark, folder), _sources(spark, folder))
    doubts = merge.distinct_in_order(maps.select(seq.alias("seq"), F.explode("uncertainties").alias("uncertainty")), "uncertainty")
    views = doubts.where(F.lit(False)).withColumnRenamed("uncertainty", "minority_view")
    return documents.digest_document(merged, views, doubts, 10, 2)


@query
def sample_documents(spark, folder):
    """H71"""
    titles = ingest.question_metadata(load(spark, folder, "question")).select(F.col("id").alias("questionid"), "title")
    got = documents.sample_blocks(load(spark, folder, "answers"), titles)
    return got.select("questionid", "answers", F.sha2("block", 256).alias("sha256"))
