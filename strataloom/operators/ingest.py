"""From captured rows to canonical answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators.packing import numbered

SAFE_INTEGER = 2**53 - 1
#: Pages per question, comments kept per answer, answers whose comments are read.
PAGE_CAP, COMMENTS_KEPT, COMMENTED_ANSWERS = 300, 3, 10


def canonical_answers(raw: DataFrame) -> DataFrame:
    """B1: canonical answers: missing texts are empty, missing counts 0, missing times null."""
    return raw.select(
        "id",
        "questionid",
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("excerpt", F.lit("")).alias("excerpt"),
        F.coalesce("voteupcount", F.lit(0)).alias("voteupcount"),
        F.coalesce("commentcount", F.lit(0)).alias("commentcount"),
        "createdtime",
        "updatedtime",
    )


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """E5: of each key the row of lowest order. Aggregates before it shuffles, so a hot key stays small; null keys are left out."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_first.*")


def merge_insert_only(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The old rows unchanged, and of the new ones the first of each unknown key."""
    fresh = keep_first(new, key, order).join(old.select(key).distinct(), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def duplicate_ids(df: DataFrame, group: str, key: str) -> DataFrame:
    """For each group the rows, the distinct keys and the occurrences beyond the first of a key."""
    per_key = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(group).agg(F.sum("n").alias("answers"), F.count(key).alias("ids"), F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"))


def repeated_pages(df: DataFrame, group: str, key: str, order: str, page_size: int = 20) -> DataFrame:
    """Pages of a capture whose first five ids are those of the page before."""
    place = F.col("_place") - 1
    paged = numbered(df, group, [order], "_place").withColumn("page", F.floor(place / page_size).cast("long")).withColumn("_slot", place % page_size)
    first = paged.where(F.col("_slot") < 5).groupBy(group, "page").agg(F.array_sort(F.collect_list(F.struct("_slot", F.col(key).alias("k")))).alias("_head"))
    mark = first.select(group, "page", F.array_join(F.transform("_head", lambda x: x["k"]), ",", "").alias("fingerprint"))
    before = F.lag("fingerprint").over(Window.partitionBy(group).orderBy("page"))
    return mark.withColumn("repeated", F.coalesce(F.col("fingerprint") == before, F.lit(False)))


def top_answers(df: DataFrame, group: str, score: str, order: str, most: int = COMMENTED_ANSWERS) -> DataFrame:
    """The ``most`` best of each group with their rank; ties keep capture order."""
    window = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc(order))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def first_distinct(df: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """the first distinct keys in order, each with the values of its last row (§1.4-8)."""
    rest = [c for c in df.columns if c not in (key, order)]
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_order"), F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return firsts.orderBy("first_order").limit(most).select(key, "first_order", "_last.*")


def root_comments(comments: DataFrame, group: str = "answerid", order: str = "createdtime") -> DataFrame:
    """The first three comments of an answer, if all three are well-formed root comments; otherwise none.

    One row an answer: ``answerid``, ``valid`` and ``comments`` (null where a violation voids the answer).
    """
    columns = ["id", "replycommentid", "replyrootcommentid", "contenthtml", "authorname"]
    distinct = comments.where(F.col(group).isNotNull()).select(group, F.col(order).alias("_o"), *columns).distinct()
    # the rank filter keeps three rows of an answer per partition before anything is gathered
    place = F.row_number().over(Window.partitionBy(group).orderBy("_o", *columns))
    first = distinct.withColumn("_place", place).where(F.col("_place") <= COMMENTS_KEPT)
    some = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_place", *columns))).alias("c"))

    def good(c: Column) -> Column:
        return F.coalesce((c["replycommentid"] == "0") & ((c["replyrootcommentid"] == c["id"]) | (c["replyrootcommentid"] == "0")) & c["contenthtml"].isNotNull(), F.lit(False))

    valid = F.forall("c", good)
    kept = F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["contenthtml"].alias("contenthtml"), c["authorname"].alias("authorname")))
    return some.select(F.col(group), valid.alias("valid"), F.when(valid, kept).alias("comments"))


def merge_comments(answers: DataFrame, selected: DataFrame, fetched: DataFrame) -> DataFrame:
    """Comment lists after a fetch.

    ``answers``: ``id``, ``comments`` (the earlier list or null); ``selected``: ``id``; ``fetched``: ``id``,
    ``ok``, ``new_comments``. A success replaces (an empty list too); a failure keeps an earlier list of at most
    three, else drops it; what was not selected stays.
    """
    joined = answers.join(selected.select("id", F.lit(True).alias("_asked")), "id", "left").join(fetched, "id", "left")
    compatible = F.size("comments") <= COMMENTS_KEPT
    return joined.select(
        "id",
        F.when(F.col("_asked").isNull(), F.col("comments")).when(F.coalesce("ok", F.lit(False)), F.col("new_comments")).when(compatible, F.col("comments")).alias("comments"),
    )


def existing_question(question_id: Column, title: Column) -> Column:
    """Whether a stored document (``doc``, ``corrupt``, as ``sources.files`` reads them) is a question's own one.

    It must be readable, an object with answers, name the same id, and have the same title; a missing title is no match.
    """
    same = (F.col("doc.questionId") == question_id) & (F.col("doc.questionTitle") == title) & F.col("doc.answers").isNotNull()
    return F.coalesce(~F.col("corrupt") & ~F.col("bare_array") & same, F.lit(False))


def topics(value: Column) -> Column:
    """Topics that have both an id and a name; null stays null."""
    return F.filter(value, lambda t: t["topicid"].isNotNull() & t["topicname"].isNotNull())


def question_metadata(questions: DataFrame) -> DataFrame:
    """B2: the metadata of each question from its last row; missing (null) differs from empty (kept)."""
    last = keep_last(questions, "id", "fetchedat")
    return last.select(
        "id",
        F.coalesce(tx.trim("title"), F.lit("")).alias("title"),
        F.col("detail").isNotNull().alias("has_detail"),
        F.when(F.col("detail").isNotNull(), tx.clean_text("detail")).alias("detail_text"),
        topics(F.col("topics")).alias("topics"),
        safe_count(F.col("answercount")).alias("answercount"),
    )


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of highest order; of equal ones the largest row by its values."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_last")).select(key, *[F.col("_last")[c].alias(c) for c in rest])


def safe_count(value: Column) -> Column:
    """A count that is a whole number in the safe range, else null."""
    number = value.cast("double")
    return F.when((number >= 0) & (number == F.floor(number)) & (number <= SAFE_INTEGER), value.cast("long"))


def candidates(found: DataFrame, infos: DataFrame, most: int = 10) -> DataFrame:
    """The first distinct questions of a search with their answer counts; order kept, unknown counts null.

    ``found``: ``place``, ``questionid``, ``title``; ``infos``: ``questionid``, ``answercount``.
    """
    first = first_distinct(found, "questionid", "place", most)
    counts = infos.groupBy("questionid").agg(F.max(safe_count(F.col("answercount"))).alias("answercount"))
    return first.join(counts, "questionid", "left").select("questionid", "first_order", "title", "answercount")
