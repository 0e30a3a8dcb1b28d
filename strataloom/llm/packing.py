"""Containers of fixed capacity filled by lexical retrieval (problem 6)."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import lexical
from strataloom.llm.tables import written

#: Published BM25 constants, the number of a seed's heaviest terms that form its query, tokens of a shard.
K1, B = 1.2, 0.75
QUERY_TERMS = 12
SHARD_TOKENS = 2_000_000


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << lexical.BUCKET_BITS, dtype=np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total[np.frombuffer(raw, dtype=np.int32)] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


class Shard:
    """The BM25 inverted index of one shard, and the containers filled from it."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, average: float) -> None:
        self.size = len(buckets)
        length = np.array([len(b) for b in buckets])
        doc = np.repeat(np.arange(self.size), length)
        bucket = np.concatenate(buckets) if self.size else np.zeros(0, np.int32)
        tf = np.concatenate(counts).astype(np.float64) if self.size else np.zeros(0)
        total = np.bincount(doc, weights=tf, minlength=self.size)
        norm = K1 * (1 - B + B * total / max(average, 1e-9))
        weight = idf[bucket] * tf * (K1 + 1) / (tf + norm[doc])
        edge = np.r_[0, np.cumsum(length)]
        self.queries = []
        for k in range(self.size):
            w = weight[edge[k] : edge[k + 1]]
            best = np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS] if len(w) > QUERY_TERMS else np.arange(len(w))
            self.queries.append(bucket[edge[k] : edge[k + 1]][best])
        order = np.argsort(bucket, kind="stable")
        names, self.start = np.unique(bucket[order], return_index=True)
        self.end = np.r_[self.start[1:], len(order)]
        self.place = {int(b): k for k, b in enumerate(names)}
        self.doc, self.weight = doc[order], weight[order]

    def neighbours(self, k: int, fits: np.ndarray) -> np.ndarray:
        """Documents that share a query term of document ``k`` and may be used, best score first."""
        at = [self.place[int(b)] for b in self.queries[k]]
        if not at:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.doc[self.start[j] : self.end[j]] for j in at])
        score = np.bincount(docs, weights=np.concatenate([self.weight[self.start[j] : self.end[j]] for j in at]), minlength=self.size)
        score[~fits] = 0.0
        some = np.flatnonzero(score)
        return some[np.argsort(-score[some], kind="stable")]

    def fill(self, sizes: np.ndarray, capacity: int) -> list[list[int]]:
        """Containers of documents: the largest unused one is the seed, its neighbours fill the window greedily by score,
        what is still free takes the largest unused documents that fit."""
        unused = sizes > 0
        by_size = sorted((int(s), k) for k, s in enumerate(sizes) if s > 0)
        out = []

        def take(k: int) -> None:
            unused[k] = False
            by_size.pop(bisect.bisect_left(by_size, (int(sizes[k]), k)))

        while by_size:
            seed = by_size[-1][1]
            take(seed)
            content, free = [seed], capacity - int(sizes[seed])
            if by_size and by_size[0][0] <= free:
                least = by_size[0][0]
                for k in self.neighbours(seed, unused & (sizes <= free)):
                    if sizes[k] <= free:
                        content.append(int(k))
                        take(int(k))
                        free -= int(sizes[k])
                        if free < least:
                            break
                while by_size and by_size[0][0] <= free:
                    k = by_size[bisect.bisect_right(by_size, (free, len(sizes))) - 1][1]
                    content.append(k)
                    take(k)
                    free -= int(sizes[k])
            out.append(content)
        return out


def _pack(kinds: list[tuple[str, int]], idf: np.ndarray, average: float):
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("c0").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
        ids, tokens, cuts = rows.column("c0").to_pylist(), rows.column("tokens").to_numpy(), rows.column("cuts").to_pylist()
        index = Shard(
            [np.frombuffer(x, dtype=np.int32) for x in rows.column("buckets").to_pylist()],
            [np.frombuffer(x, dtype=np.uint32) for x in rows.column("counts").to_pylist()],
            idf,
            average,
        )
        out: dict[str, list] = {c: [] for c in ("kind", "container", "doc", "piece", "pieces", "start", "end")}

        def put(kind: str, number: int, k: int, piece: int, pieces: int, start: int, end: int) -> None:
            for c, v in zip(out, (kind, f"{kind}-{shard:06d}-{number:06d}", ids[k], piece, pieces, start, end)):
                out[c].append(v)

        for j, (kind, capacity) in enumerate(kinds):
            number = 0
            # the last piece of a longer document is packed like a document, the others fill a container each
            first = np.zeros(len(ids), dtype=np.int64)
            for k, points in enumerate(cuts):
                edges = [0, *points[j]]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    put(kind, number, k, p, len(edges), a, b)
                    number += 1
                first[k] = edges[-1]
            for content in index.fill(tokens - first, capacity):
                for k in content:
                    pieces = len(cuts[k][j]) + 1
                    put(kind, number, k, pieces - 1, pieces, int(first[k]), int(tokens[k]))
                number += 1
            for k in np.flatnonzero(tokens == 0):  # an empty document takes no room
                put(kind, 0, int(k), 0, 1, 0, 0)
        return pa.table(
            {
                "bin_kind": pa.array(out["kind"], pa.string()),
                "container": pa.array(out["container"], pa.string()),
                "doc_id": pa.array(out["doc"], pa.int64()),
                "piece": pa.array(out["piece"], pa.int32()),
                "pieces": pa.array(out["pieces"], pa.int32()),
                "start_token": pa.array(out["start"], pa.int32()),
                "end_token": pa.array(out["end"], pa.int32()),
            }
        )

    return run


def pack(docs: DataFrame, key: str, text: str, kinds: list[tuple[str, int]], folder: str = lexical.TOKENIZERS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The container of each document or piece, for every kind of container (problem 6).

    Method: lexical retrieval packing. Documents are spread by hash over shards of about ``shard_tokens`` tokens,
    each with a BM25 inverted index (document frequencies are counted over all documents, in 2**18 term buckets).
    The largest unused document seeds a container; the unused documents the index returns for it fill the window
    greedily by score; what stays free takes the largest unused document that fits, as long as one does.

    Rows: ``bin_kind``, ``container``, ``doc_id`` (``key``, a long), ``piece`` of ``pieces``, ``start_token``,
    ``end_token``. A document is cut, between characters, only if it alone exceeds the capacity; then all its
    pieces but the last fill a container each. Null texts are left out; an empty text takes no room and lies in
    the shard's first container; equal texts are packed each.
    """
    profile = written(lexical.profiles(docs, [key], text, tuple(c for _, c in kinds), folder), "profiles")
    rows, tokens, terms = profile.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.octet_length("counts")), F.lit(0))).first()
    counted = profile.select("buckets").mapInArrow(_document_frequency, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << lexical.BUCKET_BITS)
    frequency[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log(1 + (rows - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shards = max(1, -(-int(tokens) // shard_tokens))
    spread = profile.withColumn("shard", F.pmod(F.xxhash64("c0"), F.lit(shards)).cast("int")).withColumn("c0", F.col("c0").cast("long"))
    schema = "bin_kind string, container string, doc_id long, piece int, pieces int, start_token int, end_token int"
    return spread.groupBy("shard").applyInArrow(_pack(kinds, idf, terms / max(1, rows)), schema)


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Containers, tokens and share of room in use of every kind."""
    used = packed.groupBy("bin_kind").agg(F.countDistinct("container").alias("containers"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"))
    return used.join(F.broadcast(kinds), "bin_kind").select(
        "bin_kind", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
