"""Sizes of texts, and agreement of two versions of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as tx


def file_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Characters (UTF-16 units), bytes, lines and estimated tokens of each text; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    chars = tx.utf16_length(value)
    tokens = tx.token_range(chars)
    lines = (F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return df.select(
        F.col(key), chars.alias("chars"), F.octet_length(value).cast("long").alias("bytes"), lines.alias("lines"), tokens["tokmin"].alias("tokmin"), tokens["tokmax"].alias("tokmax")
    )


def totals(stats: DataFrame) -> DataFrame:
    """The sums over all texts."""
    zero = F.lit(0).cast("long")
    return stats.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), zero).alias(c) for c in ("chars", "bytes", "lines", "tokmin", "tokmax")])


def fragments(normal: Column) -> Column:
    """Up to three parts of a text (front, middle, end) by sentences, without addresses, each of at least 20 characters."""
    parts = F.split(tx.collapse_whitespace(normal), r"(?<=[。！？!?])")


    def clean_sentence(s: Column) -> Column:
        without = tx.collapse_whitespace(F.regexp_replace(s, r"(?i)https?://\S+", " "))
        return F.when(F.contains(F.lower(s), F.lit("http")), without).otherwise(tx.trim(s))

    clean = F.transform(parts, clean_sentence)

    def grouped(some: Column) -> Column:
        n = F.size(some)
        third = F.ceil(n / 3).cast("int")
        three = F.array(F.slice(some, F.lit(1), third), F.slice(some, third + 1, F.greatest(n - 2 * third, F.lit(0))), F.slice(some, n - third + 1, third))
        return F.transform(F.when(n >= 3, three).otherwise(F.array(some)), lambda g: tx.trim(F.array_join(g, " ")))

    groups = tx.let(F.filter(clean, lambda s: s != ""), grouped)
    return F.filter(F.array_distinct(groups), lambda s: F.length(s) >= 20)


def content_matched(original: Column, shown: Column) -> Column:
    """Whether enough fragments of an HTML text occur in the text that is shown.

    One of up to two, two thirds of three; a text without fragments must occur whole and have 8 characters.
    """
    hay = tx.collapse_whitespace(F.coalesce(shown, F.lit("")))

    def judged(x: Column) -> Column:
        found, size = x["found"], F.size(x["found"])
        hits = F.size(F.filter(found, lambda f: F.contains(x["hay"], f)))
        need = F.when(size <= 2, 1).otherwise(F.ceil(size * 2 / 3))
        whole = tx.collapse_whitespace(F.regexp_replace(x["normal"], r"(?i)https?://\S+", " "))
        short = (F.length(whole) >= 8) & F.contains(x["hay"], whole)
        return F.when(x["normal"] == "", F.lit(False)).when(size == 0, short).otherwise(hits >= need)

    parts = tx.let(tx.normalize_html(original), lambda n: F.struct(n.alias("normal"), fragments(n).alias("found"), hay.alias("hay")))
    return tx.let(parts, judged)
