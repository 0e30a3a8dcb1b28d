"""Queries of the training-data problems over the driver's tables; ``oracles`` has the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm import mixing, neardup, packing, pii, quality, split, subjects, topn
from strataloom.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

TOP = 10


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    first = topn.first_captures(table(spark, folder, "answers"))
    return topn.top_n_per_group(first, "questionid", "voteupcount", "captureseq", TOP).select("questionid", "id", "place")


FREE_TEXTS = (("answers", "content"), ("comments", "contentmarkdown"))


def _common(spark: SparkSession, folder: str) -> pii.Commonness:
    texts = [table(spark, folder, tab).select(F.col(column).alias("t")) for tab, column in FREE_TEXTS]
    return pii.commonness(texts[0].unionByName(texts[1]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    common = _common(spark, folder)
    parts = [
        pii.personal_items(table(spark, folder, tab), ["id"], column, common).select(F.lit(tab).alias("tab"), F.col("id").alias("rec_id"), "kind", "start_pos")
        for tab, column in FREE_TEXTS
    ]
    return parts[0].unionByName(parts[1]).where(F.col("rec_id").isNotNull()).distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with placeholders, as hash, and the kinds of what was replaced."""
    common = _common(spark, folder)
    parts = [
        pii.redact(table(spark, folder, tab), ["id"], column, common).select(F.lit(tab).alias("tab"), F.col("id").alias("rec_id"), F.sha2("clean", 256).alias("clean_sha"), "kinds")
        for tab, column in FREE_TEXTS
    ]
    return parts[0].unionByName(parts[1])


def _subject_rules(spark: SparkSession, folder: str) -> subjects.Rules:
    texts = table(spark, folder, "answers").where("content is not null").select(F.col("content").alias("text"))
    titles = table(spark, folder, "question").where("title is not null").select(F.col("title").alias("text"))
    areas = [r.subject for r in table(spark, folder, "subjects").orderBy("subject").collect()]  # the fixed table of areas
    return subjects.fit_rules(spark, table(spark, folder, "subject_samples"), texts.unionByName(titles), areas)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rules = _subject_rules(spark, folder)
    parts = [
        subjects.subject_areas(table(spark, folder, tab), ["id"], column, rules, title).select(F.lit(tab).alias("tab"), F.col("id").alias("rec_id"), "subject")
        for tab, column, title in (("answers", "content", False), ("question", "title", True))
    ]
    return parts[0].unionByName(parts[1]).where(F.col("rec_id").isNotNull()).distinct()


def p3_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many answers and titles each area has."""
    return p3_found(spark, folder).groupBy("tab", "subject").agg(F.count(F.lit(1)).alias("items"))


def _limits(spark: SparkSession, folder: str, tab: str, column: str) -> tuple[int, int]:
    """The limits of one field from the fixed table of limits (one row a field)."""
    row = table(spark, folder, "split_limits").where((F.col("tab") == tab) & (F.col("colname") == column)).first()
    return row.max_units, row.overlap_units


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for tab, key, column in (("answers", "id", "content"), ("chunk", "chunkid", "text")):
        most, overlap = _limits(spark, folder, tab, column)
        pieces = split.split_oversized(table(spark, folder, tab), [key], column, most, overlap, with_text=False, only_over=True)
        need = F.when(F.col("longest_run") > most, F.array(F.lit("over"), F.lit("hard"))).otherwise(F.array(F.lit("over")))
        found = pieces.where((F.col("piece") == 0) & (F.col("pieces") > 1)).select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), F.explode(need).alias("need"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of both fields, the text of each as its hash and size."""
    out = None
    for tab, key, column in (("answers", "id", "content"), ("chunk", "chunkid", "text")):
        most, overlap = _limits(spark, folder, tab, column)
        pieces = split.split_oversized(table(spark, folder, tab).dropDuplicates([key, column]), [key], column, most, overlap)
        found = pieces.withColumn("piece_sha", F.sha2("piece_text", 256)).drop("piece_text").withColumnRenamed(key, "rec_id").withColumn("tab", F.lit(tab))
        out = found if out is None else out.unionByName(found)
    return out


def _kinds(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The fixed table of containers."""
    return [(r.bin_kind, r.capacity_tokens) for r in table(spark, folder, "pack_bins").orderBy("capacity_tokens", "bin_kind").collect()]


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", _kinds(spark, folder))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, folder), table(spark, folder, "pack_bins"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each kind of container the documents placed, and how many containers are over-full or documents cut that would fit whole."""
    packed = p6_packed(spark, folder)
    bins = packed.groupBy("bin_kind", "container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("held"))
    docs = packed.groupBy("bin_kind", "doc_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("size"), F.count(F.lit(1)).alias("pieces"))
    kinds = table(spark, folder, "pack_bins")
    over = bins.join(kinds, "bin_kind").groupBy("bin_kind").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("over_full"))
    cut = docs.join(kinds, "bin_kind").groupBy("bin_kind").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("cut_needlessly"))
    return kinds.join(over, "bin_kind", "left").join(cut, "bin_kind", "left").select("bin_kind", "capacity_tokens", "documents", "over_full", "cut_needlessly")


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source whether it is reached, keeps its cap and comes to its target within half a percent of the mix, or one document of its own where a table is small."""
    got = p7_shares(spark, folder)
    near = F.greatest(F.lit(0.005) * F.sum("tokens").over(Window.partitionBy()), F.col("largest"))  # one row a source
    return got.select("source", "max_repeats", (F.col("tokens") > 0).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("tokens") - F.col("aimed_tokens")) <= near).alias("at_target"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_forms(table(spark, folder, "documents"), "doc_id", "text").where("form <> 'prose'").select("doc_id", "form")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_statistics(table(spark, folder, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts among the statistics that SQL can say too."""
    return p8_statistics(spark, folder).select("doc_id", "word_count", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("alpha_words", 6).alias("alpha_words"), "stop_words", F.round("common_share", 6).alias("common_share"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, folder, "answers"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, folder, "answers"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_redacted, p3_found, p3_composition, p4_found, p4_pieces, p5_found, p5_groups, p6_packed, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_statistics, p8_counts)}
