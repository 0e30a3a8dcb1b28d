"""Sizes in tokens of a public tokenizer, and lexical terms in a bounded number of buckets."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import chars

#: The tokenizer's file; the folder is a parameter.
TOKENIZERS = os.environ.get("STRATALOOM_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The public pattern that parts a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_BITS = 18


@functools.lru_cache(maxsize=2)
def tokenizer(folder: str = TOKENIZERS):
    import tiktoken

    with open(os.path.join(folder, RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, folder: str = TOKENIZERS) -> list[int]:
    return tokenizer(folder).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() and any(0xD800 <= ord(c) < 0xE000 for c in text) else text)


def cut_points(ids: list[int], capacity: int, folder: str = TOKENIZERS) -> list[int]:
    """Token positions that part a longer text into pieces of at most ``capacity`` tokens, between characters."""
    if len(ids) <= capacity:
        return []
    parts = tokenizer(folder).decode_tokens_bytes(ids)
    out, start = [], 0
    while len(ids) - start > capacity:
        cut = start + capacity
        # a token that begins with a continuation byte goes on with a character of the token before
        while cut > start + 1 and 0x80 <= parts[cut][0] < 0xC0:
            cut -= 1
        if cut == start + 1 and capacity > 1 and 0x80 <= parts[cut][0] < 0xC0:
            cut = start + capacity
        out.append(cut)
        start = cut
    return out


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the texts' terms: words in lower case and pairs of neighbouring ideographs."""
    codes = chars.flat(chars.join(texts).lower()).astype(np.int64)
    kind = chars.kinds()[codes]
    row = np.cumsum(codes == 0)
    both = np.flatnonzero((kind[:-1] == 2) & (kind[1:] == 2))
    hashes = [chars.mix64((codes[both].astype(np.uint64) << np.uint64(21)) ^ codes[both + 1].astype(np.uint64))]
    rows = [row[both]]
    at = np.flatnonzero(kind == 1)
    if len(at):
        first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))
        offset = (at - at[first][run]).astype(np.uint64)
        value = chars.mix64(codes[at].astype(np.uint64) + (offset << np.uint64(32)) + np.uint64(1))
        hashes.append(chars.mix64(np.add.reduceat(value, first)))
        rows.append(row[at[first]])
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key, count = np.unique((np.concatenate(rows) << BUCKET_BITS) | bucket, return_counts=True)
    return key >> BUCKET_BITS, (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32), count.astype(np.uint32)


def _profile(carried: int, capacities: tuple[int, ...], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(carried).to_pylist()
            for low, high in chars.slices(np.array([len(t) for t in texts]), 1_000_000):
                part = texts[low:high]
                sizes, cuts = [], []
                for t in part:
                    ids = encode(t, folder)
                    sizes.append(len(ids))
                    cuts.append([cut_points(ids, c, folder) for c in capacities])
                row, bucket, count = terms(part)
                edge = np.searchsorted(row, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(low, high - low) for c in range(carried)]
                    + [
                        pa.array(sizes, pa.int32()),
                        pa.array(cuts, pa.list_(pa.list_(pa.int32()))),
                        pa.array([bucket[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                        pa.array([count[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                    ],
                    names=[f"c{c}" for c in range(carried)] + ["tokens", "cuts", "buckets", "counts"],
                )

    return run


def profiles(df: DataFrame, keys: list[str], text: str, capacities: tuple[int, ...] = (), folder: str = TOKENIZERS) -> DataFrame:
    """``keys`` (as c0, c1, ...), ``tokens``, ``cuts`` for each capacity, and the terms as packed arrays; null texts are left out."""
    column = F.col(f"`{text}`")
    rows = df.where(column.isNotNull()).select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keys)], column.alias("_text"))
    schema = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keys)))
    return rows.mapInArrow(_profile(len(keys), capacities, folder), f"{schema}, tokens int, cuts array<array<int>>, buckets binary, counts binary")
