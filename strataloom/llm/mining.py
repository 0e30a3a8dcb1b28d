"""Frequent terms of a corpus and the transactions of its sentences, counted in arrays over all texts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import chars
from strataloom.llm.quality import COMMON_EN
from strataloom.llm.tables import written

#: Longest run of ideographs counted, and buckets (as a power of two) of the first count.
LONGEST = 6
BITS, SLICES = 20, 64
#: Largest share of the two most frequent neighbours of a term on either side.
VARIETY = 0.85
#: A sentence of more characters is also cut at blanks, and then every CUT characters.
LONG, CUT = 200, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)

_INLINE = re.compile(r"</?(?:b|i|em|strong|a|span|code|u|s|sup|sub|small|font|mark)\b[^>\x00]*>", re.I)
_TAG = re.compile(r"<[^>\x00]*>")


def plain(text: str) -> str:
    """Visible text in lower case, blocks on their own lines."""
    if "<" in text:
        text = _TAG.sub("\n", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return text.lower()


def _end_flags() -> np.ndarray:
    flags = np.zeros(0x110000, dtype=bool)
    flags[[ord(x) for x in "。！？!?；;…\n\r\x00"]] = True
    return flags


_END = _end_flags()


def _word_hash(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    first = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = chars.mix64(codes[np.repeat(starts, lengths) + offset].astype(np.uint64) + (offset.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    return chars.mix64(np.add.reduceat(value, first)) if len(starts) else np.zeros(0, np.uint64)


def _hash_words(words) -> np.ndarray:
    text = "".join(words)
    lengths = np.array([len(w) for w in words])
    return _word_hash(chars.flat(text), np.cumsum(lengths) - lengths, lengths)


_COMMON = np.sort(_hash_words(sorted(COMMON_EN)))


class Sentences:
    """The sentences of a batch of texts and every term in them: runs of ideographs, words, and pairs of words."""

    def __init__(self, texts: list[str]) -> None:
        self.low = plain(chars.join(texts))
        self.codes = c = chars.flat(self.low)
        self.row = np.cumsum(c == 0, dtype=np.int32)
        following = np.r_[c[1:], 0]
        end = _END[c] | ((c == 46) & ((following == 32) | (following == 10) | (following == 0)))
        han = (c >= 0x3400) & (c <= 0x9FFF)
        sentence = np.cumsum(end, dtype=np.int32)
        size = np.bincount(sentence)
        if len(c) and size.max() > LONG:
            wide = (size > LONG) & (np.bincount(sentence, weights=han) > 0.2 * size)
            blank = (c == 32) | (c == 9) | (c == 0x3000)
            end = end | (wide[sentence] & blank)
            sentence = np.cumsum(end, dtype=np.int32)
            size = np.bincount(sentence)
            wide = (size > LONG) & (np.bincount(sentence, weights=han) > 0.2 * size)
            if wide.any():
                place = np.arange(len(c)) - np.searchsorted(sentence, sentence)
                end = end | (wide[sentence] & (place % CUT == CUT - 1) & (place > 0))
                sentence = np.cumsum(end, dtype=np.int32)
        self.sentence, self.han = sentence, han
        self.count = int(sentence[-1]) + 1 if len(c) else 0

    def terms(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, lengths, hashes) of the terms of each size; a term never crosses a sentence's end."""
        c = self.codes
        at = np.flatnonzero(self.han)
        h = c[at].astype(np.uint64)
        for size in range(2, LONGEST + 1):
            last = at + size - 1
            keep = last < len(c)
            at, h, last = at[keep], h[keep], last[keep]
            keep = self.han[last] & (self.sentence[last] == self.sentence[at])
            at, h = at[keep], h[keep] * _STEP + c[last[keep]]
            yield at, np.full(len(at), size, dtype=np.int32), h * _STEP
        letter = (c >= 97) & (c <= 122)
        joiner = np.isin(c, np.array([39, 0x2019, 45], dtype=np.uint32))
        inside = letter | (joiner & np.r_[False, letter[:-1]] & np.r_[letter[1:], False]) if len(c) else letter
        where = np.flatnonzero(inside)
        if not len(where):
            return
        head = np.flatnonzero(np.r_[True, np.diff(where) > 1])
        start, length = where[head], np.diff(np.r_[head, len(where)])
        h = _word_hash(c, start, length)
        rare = ~np.isin(h, _COMMON)
        good = rare & (length > 1)
        yield start[good], length[good].astype(np.int32), h[good]
        stop = start + length
        pair = np.flatnonzero(rare[:-1] & rare[1:] & (start[1:] == stop[:-1] + 1) & (c[np.minimum(stop[:-1], len(c) - 1)] == 32))
        yield start[pair], (stop[pair + 1] - start[pair]).astype(np.int32), chars.mix64(h[pair] * _STEP + h[pair + 1])


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def _parts(texts: list[str]) -> Iterator[Sentences]:
    for low, high in chars.slices(np.array([len(t) for t in texts]), 500_000):
        yield Sentences(texts[low:high])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> counts of terms by bucket in SLICES packed parts, and the number of sentences as part -1."""
    total, sentences = np.zeros(1 << BITS, dtype=np.int64), 0
    for batch in batches:
        for part in _parts(batch.column(0).to_pylist()):
            sentences += part.count
            for _, _, h in part.terms():
                total += np.bincount(_bucket(h).astype(np.int64), minlength=1 << BITS)
    cut = total.reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, SLICES), pa.int32()), pa.array([np.array([sentences]).tobytes()] + [x.tobytes() for x in cut], pa.binary())], names=["part", "counts"]
    )


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw, dtype=np.int64) for raw in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _exact(mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(mask).astype(bool)
        table: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v in table.values()], pa.string()), pa.array([v[1] for v in table.values()], pa.int64())], names=["term", "n"])

        for batch in batches:
            for part in _parts(batch.column(0).to_pylist()):
                for start, length, h in part.terms():
                    keep = known[_bucket(h)]
                    value, first, n = np.unique(h[keep], return_index=True, return_counts=True)
                    start, length = start[keep][first].tolist(), length[keep][first].tolist()
                    for x, a, size, times in zip(value.tolist(), start, length, n.tolist()):
                        if (row := table.get(x)) is None:
                            table[x] = [part.low[a : a + size], times]
                        else:
                            row[1] += times
                if len(table) > 500_000:
                    yield flush()
                    table.clear()
        yield flush()

    return run


class Vocabulary:
    """Frequent terms whose neighbours vary, in alphabetical order, with their frequencies."""

    def __init__(self, terms: list[str], frequency: np.ndarray, sentences: int) -> None:
        self.terms, self.frequency, self.sentences = terms, frequency, sentences
        self.place = {t: k for k, t in enumerate(terms)}
        self.hashes, self.order = self._hash()

    def _hash(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(self.terms), dtype=np.uint64)
        for k, t in enumerate(self.terms):
            for start, length, h in Sentences([t]).terms():
                hit = np.flatnonzero((start == 0) & (length == len(t)))
                if len(hit):
                    out[k] = h[hit[0]]
        order = np.argsort(out, kind="stable")
        return out[order], order.astype(np.int32)


def vocabulary(texts: DataFrame, support: float, least: int) -> Vocabulary:
    """Terms (column ``text``) in at least the share ``support`` of the number of sentences, and ``least``, of all texts.

    A first pass counts every term into 2**BITS buckets, whose sums bound the counts from above; a second pass counts
    exactly the terms of buckets that reach the support. What comes to the driver is bounded by terms a sentence
    divided by ``support``. Terms whose two most frequent neighbours on a side make up more than VARIETY are parts of longer
    ones and left out.
    """
    texts = texts.where("text is not null and text <> ''").select("text")
    parts = texts.mapInArrow(_sketch, "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary").collect()
    sums = {r.part: np.frombuffer(r.counts, dtype=np.int64) for r in parts}
    if -1 not in sums:
        return Vocabulary([], np.zeros(0, np.int64), 0)
    sentences = int(sums[-1][0])
    needed = max(least, support * sentences)
    mask = np.packbits(np.concatenate([sums[k] for k in range(SLICES)]) >= needed)
    counted = texts.mapInArrow(_exact(mask), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= needed)
    counted = written(counted, "terms")
    latin = F.ascii("term") < 128
    size = F.length("term")
    two = F.aggregate(F.slice(F.sort_array(F.collect_list("n"), False), 1, 2), F.lit(0).cast("long"), lambda a, x: a + x)
    han = counted.where(~latin)
    right = han.select(F.col("term").substr(F.lit(1), size - 1).alias("term"), "n").groupBy("term").agg(two.alias("right"))
    left = han.select(F.col("term").substr(F.lit(2), size).alias("term"), "n").groupBy("term").agg(two.alias("left"))
    varied = (size < LONGEST) & (F.coalesce("right", F.lit(0)) <= VARIETY * F.col("n")) & (F.coalesce("left", F.lit(0)) <= VARIETY * F.col("n"))
    rows = counted.join(right, "term", "left").join(left, "term", "left").where(latin | varied).select("term", "n").orderBy("term").collect()
    return Vocabulary([r.term for r in rows], np.array([r.n for r in rows], dtype=np.int64), sentences)


@dataclass
class Block:
    """Sentences with known terms: for each its label and number of terms, for each term its place in the vocabulary, start and size."""

    label: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def packed(self) -> list[bytes]:
        return [x.astype(t).tobytes() for x, t in zip((self.label, self.lengths, self.items, self.starts, self.sizes), _KINDS)]

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> Block:
        return cls(*(np.frombuffer(x, dtype=t).astype(np.int32) for x, t in zip(raw, _KINDS)))


#: Stored widths of a block's arrays.
_KINDS = (np.int16, np.int32, np.int32, np.int32, np.int32)
_FIELDS = ("label", "lengths", "items", "starts", "sizes")


def _transactions(known: np.ndarray, order: np.ndarray):
    mask = np.zeros(1 << BITS, dtype=bool)
    mask[_bucket(known).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for low, high in chars.slices(np.array([len(t) for t in texts]), 500_000):
                part = Sentences(texts[low:high])
                found = []
                for start, length, h in part.terms():
                    keep = mask[_bucket(h)]
                    start, length, h = start[keep], length[keep], h[keep]
                    spot = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                    hit = known[spot] == h if len(known) else np.zeros(len(h), bool)
                    found.append((start[hit], length[hit], order[spot[hit]]))
                start, length, item = (np.concatenate([x[k] for x in found]) for k in range(3))
                if not len(start):
                    continue
                sentence = part.sentence[start].astype(np.int64)
                # each term once a sentence, in order of its place, the longer first
                _, first = np.unique((sentence << 32) | item, return_index=True)
                start, length, item, sentence = start[first], length[first], item[first], sentence[first]
                turn = np.argsort((start.astype(np.int64) << 16) - length, kind="stable")
                start, length, item, sentence = start[turn], length[turn], item[turn], sentence[turn]
                head = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
                many = np.diff(np.r_[head, len(sentence)])
                label = labels[low:high][part.row[start[head]]]
                block = Block(label, many, item, start - np.repeat(start[head], many), length)
                yield pa.RecordBatch.from_arrays([pa.array([bool((label >= 0).any())])] + [pa.array([raw], pa.binary()) for raw in block.packed()], names=["taught", *_FIELDS])

    return run


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks in rows of ``transactions``."""
    for batch in batches:
        columns = [batch.column(f) for f in _FIELDS]
        for k in range(batch.num_rows):
            yield Block.unpacked([c[k].as_py() for c in columns])


def transactions(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """The known terms of every sentence of ``text`` (with ``label``), a packed ``Block`` of at most some 500,000 characters' sentences a row.

    ``taught`` tells whether a block has labelled sentences.
    """
    rows = texts.where("text is not null").select(F.col("label").cast("int"), "text")
    return rows.mapInArrow(_transactions(words.hashes, words.order), "taught boolean, " + ", ".join(f"{f} binary" for f in _FIELDS))
