"""Merging of map results over all chunks.

Order columns (``seq``) say what comes first; they must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as tx

HIGH_VOTES = 1000


def theme_counts(themes: DataFrame) -> DataFrame:
    """How often each theme occurs (``seq``, ``theme``); a theme named twice counts twice, blank ones are dropped."""
    named = themes.withColumn("theme", tx.trim("theme")).where(F.col("theme") != "")
    return named.groupBy("theme").agg(F.count(F.lit(1)).alias("occurrences"), F.min("seq").alias("first_seq"))


def high_votes(claims: DataFrame, sources: DataFrame, least: int = HIGH_VOTES) -> DataFrame:
    """For each claim row its cited sources of at least ``least`` votes, in cited order.

    ``claims``: ``seq``, ``evidence`` array; ``sources``: ``seq``, ``source_id``, ``votes``, of which the last row of an id counts.
    """
    last = sources.groupBy("source_id").agg(F.max_by("votes", "seq").alias("votes"))
    cited = claims.select("seq", F.posexplode("evidence").alias("at", "source_id"))
    good = cited.join(last, "source_id").where(F.col("votes") >= least)
    return good.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_id"))), lambda x: x["source_id"]).alias("high_vote_sources"))


def merge_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims of equal trimmed text merged (``seq``, ``claim``, ``evidence``, ``confidence``).

    Evidence is the distinct union in order of appearance; the highest confidence holds, an unknown one counts
    as low. ``high_vote_sources`` is that of the first occurrence only, ``high_vote_sources_all`` of the whole
    evidence. Blank texts are dropped. Evidence is made distinct per (text, source) before it is gathered, so a
    text that is repeated in a third of all rows gathers no more than its sources.
    """
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    named = claims.withColumn("text", tx.trim("claim")).where(F.col("text") != "").withColumn("rank", rank)
    heads = named.groupBy("text").agg(F.min("seq").alias("first_seq"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("occurrences"))
    cited = named.select("text", "seq", F.posexplode("evidence").alias("at", "source_id"))
    distinct = cited.groupBy("text", "source_id").agg(F.min(F.struct("seq", "at")).alias("o"))
    last = sources.groupBy("source_id").agg(F.max_by("votes", "seq").alias("votes"))
    listed = distinct.join(last, "source_id", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("o", "source_id", "votes"))).alias("e"))
    loud = F.filter("e", lambda x: x["votes"] >= HIGH_VOTES)
    joined = heads.join(listed, "text", "left")
    first = high_votes(named.join(heads.select(F.col("first_seq").alias("seq")), "seq", "left_semi").select("seq", "evidence"), sources)
    none = F.array().cast("array<string>")
    return joined.join(first.withColumnRenamed("seq", "first_seq"), "first_seq", "left").select(
        "text",
        F.coalesce(F.transform("e", lambda x: x["source_id"]), none).alias("evidence"),
        F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("confidence"),
        F.coalesce("high_vote_sources", none).alias("high_vote_sources"),
        F.coalesce(F.transform(loud, lambda x: x["source_id"]), none).alias("high_vote_sources_all"),
        "occurrences",
        "first_seq",
    )


def distinct_in_order(values: DataFrame, column: str) -> DataFrame:
    """D3: distinct trimmed values with the place of their first appearance; blank ones are dropped."""
    named = values.withColumn(column, tx.trim(column)).where(F.col(column) != "")
    return named.groupBy(column).agg(F.min("seq").alias("first_seq"))


def low_confidence(merged: DataFrame) -> DataFrame:
    """Merged claims that are not better than low."""
    return merged.where(F.col("confidence") == "low")


def final_document(merged: DataFrame, minority: DataFrame, uncertain: DataFrame, inputs: int, chunks: int) -> DataFrame:
    """The final document as one row of arrays, in order of first appearance. Its size is that of the digest."""

    def listed(df: DataFrame, value, name: str) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", value.alias("v")))), lambda x: x["v"]).alias(name))

    claims = listed(merged, F.struct("text", F.col("evidence").alias("evidence_source_ids"), "confidence"), "claims")
    views = listed(minority, F.col("minority_view"), "minority_views")
    doubts = listed(uncertain, F.col("uncertainty"), "uncertainties")
    rows = claims.unionByName(views, True).unionByName(doubts, True)  # one row each
    return rows.agg(*[F.any_value(c, True).alias(c) for c in rows.columns]).select(
        F.lit(1).alias("schema_version"), F.lit(inputs).alias("input_count"), F.lit(chunks).alias("chunk_count"), "*"
    )


def merge_levels(claims: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """K3: claims merged within each group of chunks first and then over all, with the lineage of every merged claim.

    ``claims``: also ``chunk_id``; ``groups``: ``chunk_id``, ``group_id``. The result is that of ``merge_claims`` with
    ``lineage``, the groups the claim came from in order; a chunk without a group forms its own.
    """
    named = claims.join(groups, "chunk_id", "left").withColumn("group_id", F.coalesce("group_id", "chunk_id")).withColumn("text", tx.trim("claim")).where(F.col("text") != "")
    lower = named.groupBy("text", "group_id").agg(F.min("seq").alias("seq"))
    lineage = lower.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "group_id"))), lambda x: x["group_id"]).alias("lineage"))
    return merge_claims(claims.drop("chunk_id"), sources).join(lineage, "text")
