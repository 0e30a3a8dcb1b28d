"""Samples by rank and by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators.chunking import excerpt
from strataloom.operators.packing import numbered

#: The places of a sample as shares of the rows.
PLACES = (0.0, 0.25, 0.5, 0.75, 1.0)


def ranked(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The rank of each row in its group; null scores last, ties in ``order``. No task holds a whole group."""
    return numbered(df, group, [F.col(score).isNull(), -F.col(score), F.col(order)])


def top_per_group(df: DataFrame, group: str, score: str, order: str, n: int = 6) -> DataFrame:
    """The ``n`` rows of highest ``score`` (any numeric column) of each group.

    The rank filter lets Spark keep only ``n`` rows of a group per partition before it shuffles.
    """
    if not 1 <= n <= 100:
        raise ValueError("n must be from 1 to 100")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc(order)))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def popular_sample(df: DataFrame, group: str, score: str, order: str, text: str, n: int = 6, max_chars: int = 1300) -> DataFrame:
    """The visible text of the best rows of each group, cut to ``max_chars``. Texts are cleaned after the selection."""
    best = top_per_group(df.select(group, score, order, text), group, score, order, n)
    return best.select(group, "rank", F.col(order).alias("key"), F.col(score).alias("score"), excerpt(tx.strip_html(text), max_chars).alias("sample"))


def place_sample(df: DataFrame, group: str, order: str, k: int = 5) -> DataFrame:
    """Rows at 0, 25, 50, 75 and 100 percent of each group in order.

    Fewer than five take the first places, more fill up from the front; a group of fewer rows comes out whole.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.array_distinct(F.array(*[F.floor((F.col("_n") - 1) * p) for p in PLACES[: max(1, min(k, 5))]]))
    filled = F.array_union(wanted, F.filter(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n") - 1, F.lit(k + 5).cast("long"))), lambda x: ~F.array_contains(wanted, x)))
    chosen = sizes.select(F.col(group).alias("_g"), F.slice(filled, 1, k).alias("_chosen"))
    placed = numbered(df, group, [order], "_place").withColumn("place", F.col("_place") - 1).drop("_place")
    return placed.join(chosen, F.col(group).eqNullSafe(F.col("_g"))).where(F.array_contains("_chosen", F.col("place"))).drop("_g", "_chosen")


def top_percent(df: DataFrame, group: str, score: str, percent: int) -> DataFrame:
    """K2: the best ``percent`` percent of each group, at least one row, ties included (own choice among the open ones)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    # the score that the last row within the share has decides; only counts by score are ranked
    counts = df.groupBy(group, F.coalesce(score, F.lit(0)).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    down = Window.partitionBy(group).orderBy(F.desc("_s"))
    total = F.sum("_c").over(Window.partitionBy(group))
    before = F.sum("_c").over(down) - F.col("_c")
    bar = counts.select(group, "_s", before.alias("_b"), total.alias("_n")).where(F.col("_b") < F.greatest(F.lit(1), F.ceil(F.col("_n") * percent / 100)))
    low = bar.groupBy(group).agg(F.min("_s").alias("_low"), F.max("_n").alias("group_size"))
    return df.join(low, group).where(F.coalesce(score, F.lit(0)) >= F.col("_low")).drop("_low")
