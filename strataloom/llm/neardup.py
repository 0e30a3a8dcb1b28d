"""Near-duplicate texts by tensored banding (problem 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import chars
from strataloom.llm.tables import written

#: Documented parameters. WIDTH, THRESHOLD, SHORTEST: the definition of the pairs. SIDE bands of ROWS minhashes
#: in either collection, so SIDE * SIDE tables from 2 * SIDE * ROWS minhashes. A true pair at similarity s is
#: missed with probability of about 2 * (1 - s**ROWS)**SIDE.
WIDTH, THRESHOLD, SHORTEST = 10, 0.6, 80
SIDE, ROWS = 20, 3
#: Tables with more rows than this are joined by Spark instead of within one task; nothing is dropped.
IN_TASK = 1500
#: Classes of exact copies up to this size come out as all their pairs; of larger ones each copy is paired with
#: the representative (the smallest id), which keeps every link between different texts.
EXPAND = 1000
#: Sets of ids up to this size are broadcast (about 40 bytes an id), larger ones are joined by shuffle.
BROADCAST_IDS = 300_000


def _coefficients() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**32, size=(2 * SIDE * ROWS, 2), dtype=np.uint64).astype(np.uint32) | np.array([1, 0], dtype=np.uint32)


def minhashes(codes: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One row of 2 * SIDE * ROWS minhashes for each text; every text must have at least ``width`` codes."""
    n = len(offsets) - 1
    out = np.empty((n, 2 * SIDE * ROWS), dtype=np.uint32)
    coefficients = _coefficients()
    for low, high in chars.slices(np.diff(offsets), 200_000):
        part = chars.shingles(codes[offsets[low] : offsets[high]], width)
        sizes = np.diff(offsets[low : high + 1])
        windows = sizes - width + 1
        # positions whose window stays inside its text
        first = offsets[low:high] - offsets[low]
        inside = np.ones(len(part), dtype=bool)
        for k in range(1, width):
            cut = first[1:] - k
            inside[cut[cut < len(part)]] = False
        x = (part[inside] >> np.uint64(32)).astype(np.uint32)
        starts = np.r_[0, np.cumsum(windows)[:-1]]
        y = np.empty_like(x)
        for k, (a, b) in enumerate(coefficients):
            np.multiply(x, a, out=y)
            np.add(y, b, out=y)
            out[low:high, k] = np.minimum.reduceat(y, starts)
    return out


def bands(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two small collections: SIDE 64-bit keys of the first, SIDE 16-bit keys of the second."""
    n = len(signatures)
    words = signatures.reshape(n, 2 * SIDE, ROWS).astype(np.uint64)
    key = np.full((n, 2 * SIDE), 0x51ED270B, dtype=np.uint64)
    for r in range(ROWS):
        key = chars.mix64(key * np.uint64(0x9E3779B97F4A7C15) + words[:, :, r])
    first = chars.mix64(key[:, :SIDE] + np.arange(SIDE, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return first, (key[:, SIDE:] >> np.uint64(48)).astype(np.uint16)


def _sign(width: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in chars.slices(np.array([len(t) for t in texts])):
                codes, offsets = chars.bare(texts[low:high])
                sizes = np.diff(offsets)
                good = np.flatnonzero(sizes >= max(shortest, width))
                if not len(good):
                    continue
                keep = np.repeat(sizes >= max(shortest, width), sizes)
                codes, offsets = codes[keep], np.r_[0, np.cumsum(sizes[good])]
                raw = codes.tobytes()
                digest = [hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                first, second = bands(minhashes(codes, offsets, width))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[low + k] for k in good], pa.string()),
                        pa.array(digest, pa.binary()),
                        pa.array([row.tobytes() for row in first], pa.binary()),
                        pa.array([row.tobytes() for row in second], pa.binary()),
                    ],
                    names=["id", "digest", "first", "second"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
        row = pa.array(np.repeat(np.arange(n), SIDE))
        yield pa.RecordBatch.from_arrays(
            [pa.array(first), batch.column(0).take(row), batch.column(2).take(row)], names=["key", "cid", "second"]
        )


def _run_pairs(run_start: np.ndarray, run_size: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside runs of a sorted order, size by size without a loop over runs, at most some millions at once."""
    for size in np.unique(run_size):
        at = run_start[run_size == size]
        a, b = np.triu_indices(size, 1)
        step = max(1, 2_000_000 // len(a))
        for low in range(0, len(at), step):
            part = at[low : low + step, None]
            yield order[(part + a).ravel()], order[(part + b).ravel()]


def _collide(key: np.ndarray, cid: np.ndarray, second: np.ndarray, in_task: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one stretch of whole first-collection buckets, and (table key, cid) rows of tables too large for a task."""
    in_task = IN_TASK if in_task is None else in_task
    change = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[change, len(key)])
    shared = np.repeat(sizes > 1, sizes)
    key, cid, second = key[shared], cid[shared], second[shared]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    base = key.astype(np.uint64)
    pairs = waiting = np.zeros((0, 2), np.int64)
    later = []
    for column in range(SIDE):
        # one column of tables at a time: near copies share most tables, and their pairs are the same in each
        table_key = _table_keys(base, second[:, column], column)
        order = np.argsort(table_key, kind="stable")
        in_order = table_key[order]
        start = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
        size = np.diff(np.r_[start, len(order)])
        small = (size > 1) & (size <= in_task)
        for a, b in _run_pairs(start[small], size[small], order):
            a, b = cid[a], cid[b]
            differ = a != b
            waiting = np.concatenate([waiting, np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], axis=1)])
            if len(waiting) > 1_000_000:
                pairs, waiting = _distinct(np.concatenate([pairs, waiting])), waiting[:0]
        if column == SIDE - 1:
            pairs = _distinct(np.concatenate([pairs, waiting]))
        big = np.repeat(size > in_task, size)
        later.append(np.stack([in_order[big].astype(np.int64), cid[order[big]]], axis=1))
    return pairs[:, 0], pairs[:, 1], np.concatenate(later)


def _table_keys(key: np.ndarray, second: np.ndarray, column: int | np.ndarray) -> np.ndarray:
    """The key of a table: a band of the first collection with one of the second."""
    place = (np.asarray(column, dtype=np.uint64) << np.uint64(16)) + np.uint64(1)
    return chars.mix64(key ^ chars.mix64(place + second.astype(np.uint64)))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]]


def _all_tables(key: np.ndarray, second: np.ndarray, cid: np.ndarray) -> pa.RecordBatch:
    """(table key, cid) rows of documents whose bucket is too large for a task."""
    tables = _table_keys(key.astype(np.uint64)[:, None], second, np.arange(SIDE, dtype=np.uint64))
    return pa.RecordBatch.from_arrays(
        [pa.array(tables.ravel().astype(np.int64)), pa.array(np.repeat(cid, SIDE)), pa.array(np.ones(tables.size, bool))], names=["a", "b", "later"]
    )


def _bands_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SIDE)


def _tables(batches: Iterator[pa.RecordBatch], in_task: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key come in; whole buckets of the first collection are split into tables by the second."""

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        a, b, later = _collide(key, rows.column("cid").to_numpy(), _bands_of(rows.column("second")), in_task)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[a, later[:, 0]]), pa.array(np.r_[b, later[:, 1]]), pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(later), bool)])],
            names=["a", "b", "later"],
        )

    held: list[pa.RecordBatch] = []
    size, open_key, step = 0, None, 100_000
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < step:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield from emit(rows.slice(0, cut))
        rest = rows.slice(cut)
        if open_key == key[-1] and not cut and len(key) >= 400_000:
            # one bucket fills the task: its rows go on to Spark's join, table by table
            yield _all_tables(key, _bands_of(rest.column("second")), rest.column("cid").to_numpy())
            # the bucket stays open: its other rows are sent the same way
            yield from _send_rest(batches, key[-1], in_task)
            return
        open_key = key[-1]
        held, size = rest.to_batches(), rest.num_rows
        step = max(100_000, 2 * size)
    if held:
        yield from emit(pa.Table.from_batches(held))


def _send_rest(batches: Iterator[pa.RecordBatch], hot: int, in_task: int | None = None) -> Iterator[pa.RecordBatch]:
    """Goes on after a bucket that fills a task: its further rows go to Spark's join, the rest is handled as usual."""
    rest = iter(batches)
    for batch in rest:
        n = int(np.searchsorted(batch.column(0).to_numpy(), hot, side="right"))
        if n:
            part = batch.slice(0, n)
            yield _all_tables(part.column(0).to_numpy(), _bands_of(part.column(2)), part.column(1).to_numpy())
        if n < batch.num_rows:

            def chained(first: pa.RecordBatch = batch.slice(n)) -> Iterator[pa.RecordBatch]:
                yield first
                yield from rest

            yield from _tables(chained(), in_task)
            return


def _bare_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, digest, content) -> (cid, text) where the content is the text of that digest."""
    for batch in batches:
        cid, digest, texts = (batch.column(k).to_pylist() for k in range(3))
        for low, high in chars.slices(np.array([len(t) for t in texts])):
            codes, offsets = chars.bare(texts[low:high])
            raw = codes.tobytes()
            parts = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:])]
            same = [k for k, p in enumerate(parts) if hashlib.blake2b(p, digest_size=16).digest() == digest[low + k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cid[low + k] for k in same], pa.int64()), pa.array([parts[k].decode("utf-32-le") for k in same], pa.string())],
                names=["cid", "text"],
            )


def _similar(width: int, threshold: float):
    """Exact check of candidate pairs: keeps those whose share of common windows reaches the threshold."""

    def windows(text: str) -> np.ndarray:
        return np.unique(chars.shingles(chars.flat(text), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            good = []
            for k in range(len(a)):
                if len(known) > 5000:
                    known.clear()
                if (x := known.get(a[k])) is None:
                    x = known[a[k]] = windows(ta[k])
                if (y := known.get(b[k])) is None:
                    y = known[b[k]] = windows(tb[k])
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= threshold * max(len(x), len(y)) else 0
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    good.append(k)
            chosen = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["a", "b"])

    return run


class NearDuplicates:
    """Members of classes of equal texts, and the pairs of classes that are nearly the same.

    ``members``: ``id``, ``cid``. ``pairs``: ``a`` < ``b``, both ``cid``. Texts are compared without tags, with
    entities decoded, in lower case, letters and digits only; shorter ones than ``shortest`` are left out.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "content", width: int = WIDTH, threshold: float = THRESHOLD, shortest: int = SHORTEST, in_task: int = IN_TASK) -> None:
        source = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("content")
        )
        source = source.where(F.length("content") >= min(shortest, 80) // 8)  # an entity may stand for many letters, not for hundreds
        signed = source.mapInArrow(_sign(width, shortest), "id string, digest binary, first binary, second binary")
        signed = written(signed.withColumn("cid", F.xxhash64("digest")), "signed")
        self.members = signed.select("id", "cid").distinct()
        classes = signed.groupBy("digest").agg(F.min_by(F.struct("cid", "first", "second", "id"), "id").alias("r")).select("digest", "r.*")
        classes = written(classes, "classes")
        keyed = classes.select("cid", "first", "second").mapInArrow(_keys, "key long, cid long, second binary")
        found = written(
            keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _tables(batches, in_task), "a long, b long, later boolean").distinct(), "candidates"
        )
        later = found.where("later").select(F.col("a").alias("t"), F.col("b").alias("cid"))
        hot = (
            later.alias("x")
            .join(later.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.cid") < F.col("y.cid")))
            .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        )
        candidates = found.where(~F.col("later")).select("a", "b").unionByName(hot).distinct()
        ends = candidates.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        wanted = written(classes.join(ends, "cid").select("id", "cid", "digest"), "wanted")
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = (
            source.join(wanted, "id").select("cid", "digest", "content").mapInArrow(_bare_texts, "cid long, text string").dropDuplicates(["cid"])
        )
        texts = written(texts, "texts")
        joined = (
            candidates.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb")
        )
        self.pairs = written(joined.mapInArrow(_similar(width, threshold), "a long, b long"), "pairs")


def near_duplicate_pairs(docs: DataFrame, id_col: str = "id", text_col: str = "content", expand: int | None = EXPAND, **options) -> DataFrame:
    """Pairs of ids whose texts are nearly the same: ``id_a`` < ``id_b`` (problem 5).

    Method: tensored banding. Two collections of SIDE bands of ROWS minhashes each are computed once; a table
    key is a pair of one band of either collection, so 2 * SIDE bands serve SIDE * SIDE tables. Rows are shuffled
    by the first band only and carry the second collection as 16-bit keys; the tables are built inside the
    bucket. Every candidate is checked exactly.

    Equal texts form one class first. Classes of up to ``expand`` ids come out as all their pairs, larger ones as
    pairs with the representative (the smallest id), within the class and towards other classes; so no link
    between different texts is lost and a huge group of copies stays linear. ``expand=None`` gives all pairs of all classes,
    ``near_duplicate_members`` the class of every id. Nulls, empty and short texts give
    no row; repeated rows of an id count once; an id is never paired with itself; an empty table gives none.
    """
    found = NearDuplicates(docs, id_col, text_col, **options)
    most = F.lit(2**62 if expand is None else expand)
    sized = found.members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"))
    grouped = found.members.join(sized.where("n > 1"), "cid")
    small = grouped.where(F.col("n") <= most).select("cid", "id")
    within = small.alias("x").join(small.alias("y"), F.col("x.cid") == F.col("y.cid")).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
    star = grouped.where(F.col("n") > most).select(F.col("head").alias("p"), F.col("id").alias("q"))
    speakers = found.members.join(sized.where(F.col("n") > most), "cid", "left").where(F.col("n").isNull() | (F.col("id") == F.col("head"))).select("cid", "id")
    across = (
        found.pairs.join(speakers.select(F.col("cid").alias("a"), F.col("id").alias("p")), "a")
        .join(speakers.select(F.col("cid").alias("b"), F.col("id").alias("q")), "b")
        .select("p", "q")
    )
    every = within.unionByName(star).unionByName(across).where(F.col("p") != F.col("q"))
    return every.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()


def near_duplicate_members(docs: DataFrame, id_col: str = "id", text_col: str = "content", **options) -> DataFrame:
    """One row per id of a compared text: ``id`` and ``head``, the smallest id with an equal text (after normalisation)."""
    members = NearDuplicates(docs, id_col, text_col, **options).members
    return members.join(members.groupBy("cid").agg(F.min("id").alias("head")), "cid").select("id", "head")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: ``node`` and the smallest node of its component as ``head``.

    Alternates large-star and small-star steps until nothing changes; every step is a written table, so nothing
    gathers on the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*")
        e = written(small.where("u <> v").distinct(), "star")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    heads = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("head"))
    return heads.unionByName(heads.select(F.col("head").alias("node"), "head").distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "id", text_col: str = "content", **options) -> DataFrame:
    """One row per id of a compared text: ``id``, ``group_id``, ``links`` (other classes it is close to) and ``keep``.

    ``group_id`` is the smallest id of the group; ``keep`` marks that id. Ids without a partner form their own
    group. An id that occurs with several different texts belongs to the group of its smallest class.
    """
    found = NearDuplicates(docs, id_col, text_col, **options)
    ends = found.pairs.unionByName(found.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.groupBy(F.col("a").alias("cid")).agg(F.count(F.lit(1)).alias("links"))
    heads = components(found.pairs).select(F.col("node").alias("cid"), "head")
    placed = (
        found.members.join(heads, "cid", "left")
        .join(links, "cid", "left")
        .groupBy("id")
        .agg(F.min_by(F.struct(F.coalesce("head", "cid").alias("head"), F.coalesce("links", F.lit(0)).alias("links")), "cid").alias("r"))
    )
    first = placed.groupBy(F.col("r.head").alias("head")).agg(F.min("id").alias("group_id"))
    return placed.select("id", F.col("r.head").alias("head"), F.col("r.links").alias("links")).join(first, "head").select(
        "id", "group_id", "links", (F.col("id") == F.col("group_id")).alias("keep")
    )
