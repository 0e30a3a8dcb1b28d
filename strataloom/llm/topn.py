"""Top N rows of every group by partition lower bounds (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _local_best(n: int):
    """Keeps, batch by batch, the n best rows of each group of one partition and adds the n-th score as a bound."""

    def best_of(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("_group", "ascending"), ("_score", "descending"), ("_tie", "ascending")])
        rows = rows.take(order)
        group = rows.column("_group").combine_chunks()
        if not len(group):
            return rows.append_column("_place", pa.array([], pa.int64()))
        import numpy as np

        code = np.asarray(group.dictionary_encode().indices.to_numpy(zero_copy_only=False))
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
        keep = place < n
        return rows.filter(pa.array(keep)).append_column("_place", pa.array(place[keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= 65_536 and (kept is None or size >= kept.num_rows):
                fresh = pa.Table.from_batches(waiting)
                joined = fresh if kept is None else pa.concat_tables([kept, fresh])
                kept, waiting, size = best_of(joined).drop_columns(["_place"]), [], 0
        if waiting:
            fresh = pa.Table.from_batches(waiting)
            kept = fresh if kept is None else pa.concat_tables([kept, fresh])
        if kept is None or not kept.num_rows:
            return
        final = best_of(kept)
        full = pc.equal(final.column("_place"), n - 1)
        nothing = pa.scalar(None, pa.int64())
        final = final.append_column("_bound_score", pc.if_else(full, final.column("_score"), nothing))
        final = final.append_column("_bound_tie", pc.if_else(full, final.column("_tie"), nothing))
        yield from final.drop_columns(["_place"]).to_batches()

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, tie: str, n: int, place: str = "place") -> DataFrame:
    """The ``n`` rows of highest ``score`` of every ``group``, with their ``place`` from 1 (problem 1).

    Method: each partition's own n-th best row is a lower bound of what a group's n-th best row can be. A
    partition keeps only rows that are no worse than its own bound; the largest bound of a group over all
    partitions is joined to the survivors and removes what is below it; only the rest is ranked. A group
    sends at most ``n`` rows per partition, however large it is, so a hot group needs no salt.

    ``score`` and ``tie`` are integers. Order: ``score`` descending, then ``tie`` ascending; ``tie`` should be
    unique within a group, otherwise equal rows keep an unspecified order. Null scores count as 0, null ties
    come last, rows with a null group are left out, fewer than ``n`` rows give fewer places, an empty table
    gives an empty result. Other columns pass through unchanged, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    carried = df.columns
    rows = df.where(F.col(f"`{group}`").isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"),
        F.col(f"`{group}`").cast("string").alias("_group"),
        F.coalesce(F.col(f"`{score}`").cast("long"), F.lit(0)).alias("_score"),
        F.coalesce(F.col(f"`{tie}`").cast("long"), F.lit(2**63 - 1)).alias("_tie"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("_bound_score", T.LongType()), T.StructField("_bound_tie", T.LongType())])
    local = rows.mapInArrow(_local_best(n), schema).repartition(F.col("_group"))
    bounds = (
        local.where(F.col("_bound_score").isNotNull())
        .groupBy(F.col("_group").alias("_bound_group"))
        .agg(F.max(F.struct(F.col("_bound_score").alias("s"), (-F.col("_bound_tie")).alias("t"))).alias("_bound"))
    )
    alive = local.join(bounds, F.col("_group") == F.col("_bound_group"), "left").where(
        F.col("_bound").isNull() | (F.struct(F.col("_score").alias("s"), (-F.col("_tie")).alias("t")) >= F.col("_bound"))
    )
    ranked = alive.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(F.desc("_score"), F.asc("_tie"))))
    return ranked.where(F.col("_rank") <= n).select("_row.*", F.col("_rank").cast("int").alias(place))


def first_captures(answers: DataFrame) -> DataFrame:
    """Of each answer id the row of lowest ``captureseq``; rows without an id are left out."""
    wanted = F.struct("captureseq", "questionid", "voteupcount")
    return (
        answers.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min_by(wanted, F.coalesce("captureseq", F.lit(2**63 - 1))).alias("r"))
        .select("id", "r.questionid", "r.voteupcount", "r.captureseq")
    )
