"""Greedy packing in a fixed order, in parallel also inside one group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.shared import written

#: Rows of a block; a block is what one task holds.
BLOCK_ROWS = 1_000_000
#: Rows from which another block is worth its task.
SMALL_BLOCK = 5_000
UNLIMITED = 2**31 - 1


def following(prefix: np.ndarray, most: int, items: int) -> np.ndarray:
    """For a chunk that opens at each position, where the next one opens."""
    n = len(prefix) - 1
    at = np.arange(n)
    by_size = np.searchsorted(prefix, prefix[:n] + most, side="right") - 1
    return np.minimum(np.maximum(by_size, at + 1), at + items)


def first_cut(lengths: np.ndarray, chars: int, count: int, most: int, items: int) -> int:
    """The position at which an open chunk of ``chars`` and ``count`` is closed; the number of lengths if it isn't."""
    if not count:
        return 0
    prefix = np.r_[0, np.cumsum(lengths)]
    by_size = int(np.searchsorted(prefix, most - chars, side="right")) - 1 if chars <= most else 0
    return max(0, min(len(lengths), by_size, items - count))


def _runs(table: pa.Table) -> list[tuple[int, int]]:
    code = np.asarray(table.column("_group").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    return list(zip(starts, np.r_[starts[1:], len(code)]))


def _summaries(most: int, items: int):
    """What a block does to its first and last group, for every position at which the open chunk may be closed.

    Other groups lie in one block as a whole, so a block yields two rows at most.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        out: dict[str, list] = {c: [] for c in ("_group", "_block", "n", "heads", "chunks", "chars", "counts")}
        lengths = table.column("_length").to_numpy()
        runs = _runs(table)
        for a, b in dict.fromkeys(runs[:1] + runs[-1:]):
            size = lengths[a:b]
            n = b - a
            prefix = np.r_[0, np.cumsum(size)]
            after = following(prefix, most, items)
            # an open chunk ends within these positions, or the whole run belongs to it
            heads = int(min(n, items, np.searchsorted(prefix, most, side="right") + 1))
            chunks, chars, counts = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for k in range(n - 1, -1, -1):
                j = after[k]
                if j >= n:
                    chunks[k], chars[k], counts[k] = 1, prefix[n] - prefix[k], n - k
                else:
                    chunks[k], chars[k], counts[k] = chunks[j] + 1, chars[j], counts[j]
            out["_group"].append(table.column("_group")[int(a)].as_py())
            out["_block"].append(table.column("_block")[int(a)].as_py())
            out["n"].append(n)
            out["heads"].append(size[:heads].tolist())
            for name, values in (("chunks", chunks), ("chars", chars), ("counts", counts)):
                out[name].append(values[: heads + 1].tolist())
        longs = pa.list_(pa.int64())
        kinds = {"_group": pa.string(), "_block": pa.int32(), "n": pa.int64(), "heads": longs, "chunks": longs, "chars": longs, "counts": longs}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


_SUMMARY = "_group string, _block int, n long, heads array<long>, chunks array<long>, chars array<long>, counts array<long>"


def _states(most: int, items: int):
    """The open chunk with which each block of a group begins."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_block"])
        done, chars, count = 0, 0, 0
        out = []
        for r in rows:
            out.append((r["_group"], r["_block"], done, chars, count))
            cut = first_cut(np.array(r["heads"], dtype=np.int64), chars, count, most, items)
            if cut >= len(r["heads"]) and r["n"] == len(r["heads"]):
                chars, count = chars + sum(r["heads"]), count + r["n"]
            else:
                done, chars, count = done + r["chunks"][cut], r["chars"][cut], r["counts"][cut]
        return pa.table({c: [r[k] for r in out] for k, c in enumerate(("_group", "_block", "done", "chars", "count"))}, schema=pa.schema([("_group", pa.string()), ("_block", pa.int32()), ("done", pa.int64()), ("chars", pa.int64()), ("count", pa.int64())]))

    return run


def _assign(most: int, items: int):
    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        state, fresh = {r["_group"]: r for r in states.to_pylist()}, {"done": 0, "chars": 0, "count": 0}
        lengths = table.column("_length").to_numpy()
        number = np.zeros(table.num_rows, dtype=np.int64)
        for a, b in _runs(table):
            s = state.get(table.column("_group")[int(a)].as_py(), fresh) if a == 0 or b == table.num_rows else fresh
            size = lengths[a:b]
            cut = first_cut(size, s["chars"], s["count"], most, items)
            opens = np.zeros(b - a, dtype=np.int64)
            if items == 1:
                opens[cut:] = 1
            else:
                after = following(np.r_[0, np.cumsum(size)], most, items)
                while cut < b - a:
                    opens[cut] = 1
                    cut = int(after[cut])
            number[a:b] = s["done"] + np.cumsum(opens)
        return table.append_column("_number", pa.array(number))

    return run


def greedy_pack(df: DataFrame, group: str, order: list[str | Column], length: str | Column, max_chars: int, max_items: int = UNLIMITED, number: str = "chunk_no") -> DataFrame:
    """``df`` with the number, from 1 in each group, of the chunk each row falls into.

    In ``order`` a row opens a new chunk if there is none, if the open one would exceed ``max_chars`` or already
    holds ``max_items`` rows; a row longer than the limit has a chunk of its own. ``order`` must be unique in a
    group; null lengths count as 0, a null group is a group.

    The result is that of one pass over each group, but no group is held by one task: rows are laid out in
    blocks by group and order; as an open chunk can only end within the first rows of a block, each block tells
    what follows from every such end; these short summaries are chained along the blocks of a group, then every
    block numbers its own rows. Carry ids and lengths here rather than texts.
    """
    if max_chars < 1 or max_items < 1:
        raise ValueError("limits must be at least 1")
    laid = _laid(df, group, order, F.coalesce(_column(length).cast("long"), F.lit(0)).alias("_length"))
    slim = laid.select("_group", "_block", "_pos", "_length")
    summary = slim.groupBy("_block").applyInArrow(_summaries(max_chars, max_items), _SUMMARY)
    states = summary.groupBy("_group").applyInArrow(_states(max_chars, max_items), "_group string, _block int, done long, chars long, count long")
    schema = T.StructType([*laid.schema.fields, T.StructField("_number", T.LongType())])
    numbered = laid.groupBy("_block").cogroup(states.groupBy("_block")).applyInArrow(_assign(max_chars, max_items), schema)
    return numbered.select("_row.*", F.col("_number").alias(number))


def _laid(df: DataFrame, group: str, order: list[str | Column], *more: Column) -> DataFrame:
    """Rows (``_row``) laid out once by ranges of group and order: ``_group``, ``_block`` and, ascending in a block, ``_pos``."""
    name = F.coalesce(F.col(group).cast("string"), F.lit("\x00")).alias("_group")
    rows = df.select(F.struct(*df.columns).alias("_row"), name, *more, *[_column(c).alias(f"_order{k}") for k, c in enumerate(order)])
    ranked = [F.col(f"_order{k}") for k in range(len(order))]
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.count()
    blocks = max(1, -(-size // BLOCK_ROWS), min(parallel, -(-size // SMALL_BLOCK)))
    laid = rows.repartitionByRange(blocks, "_group", *ranked).sortWithinPartitions("_group", *ranked)
    laid = laid.withColumn("_block", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()).drop(*[f"_order{k}" for k in range(len(order))])
    return written(laid, "blocks")


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pack_by_count(df: DataFrame, group: str, order: list[str | Column], size: int, number: str = "volume_no") -> DataFrame:
    """Volumes of ``size`` rows each, in ``order``; the last one may hold fewer."""
    return greedy_pack(df, group, order, F.lit(0), 1, size, number)


def numbered(df: DataFrame, group: str, order: list[str | Column], number: str = "rank") -> DataFrame:
    """The place of each row in its group, from 1, without one task for a group.

    Rows are laid out in blocks by group and order, so a group's rows in a block stand one after another: a row's place is its
    distance from the first of them plus the rows of the group in the blocks before. Only one row for each group of
    a block is shuffled to know those. ``order`` must be unique in a group; a null group is a group.
    """
    laid = _laid(df, group, order)
    part = laid.groupBy("_group", "_block").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = F.coalesce(F.sum("_rows").over(Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = part.withColumn("_before", earlier).drop("_rows")
    return laid.join(places, ["_group", "_block"]).select("_row.*", (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias(number))
