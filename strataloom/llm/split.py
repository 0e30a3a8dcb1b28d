"""Oversized texts cut at natural boundaries by content-defined chunking (problem 4)."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm import chars

#: Rolling-hash window, in code points.
WINDOW = 32
#: Ranks of a boundary.
INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
#: The characters (besides whitespace) after which a text may be cut at a word end.
BREAKS = "。！？；，、…>.!?;,"
SENTENCE_ENDS = "。！？…!?；;"
CLOSERS = "”’」』）)》】\"'"

_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
_BLOCK_END = re.compile(r"</(?:p|div|li|ul|ol|h[1-6]|blockquote|pre|table|tr|figure)\s*>", re.I)
_LINE_TAG = re.compile(r"<br\s*/?>|<hr\s*/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")


@functools.cache
def _gear() -> np.ndarray:
    return chars.mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(77))


@functools.cache
def _flags() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: may not start a piece; whitespace; break character."""
    glued, space, stop = (np.zeros(0x110000, dtype=bool) for _ in range(3))
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c)[0] == "M":
            glued[code] = True
        if c.isspace():
            space[code] = True
    glued[[0x200D, 0xFE0E, 0xFE0F]] = True
    glued[0x1F3FB:0x1F400] = True
    glued[0xE0020:0xE0080] = True
    for c in BREAKS:
        stop[ord(c)] = True
    return glued, space, stop


def rolling(codes: np.ndarray) -> np.ndarray:
    """At every position the gear hash of the last WINDOW codes, by doubling."""
    h = _gear()[codes]
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint64(span)
        h = h + shifted
        span *= 2
    return h


def boundaries(text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position 0..n the rank of a cut before it, and whether a cut there splits no character."""
    glued, space, stop = _flags()
    n = len(codes)
    rank = np.zeros(n + 1, dtype=np.int8)
    is_space, is_stop = space[codes], stop[codes]
    after = np.flatnonzero((is_space | is_stop)) + 1
    rank[after] = WORD
    ends = np.flatnonzero(np.isin(codes, np.array([ord(c) for c in SENTENCE_ENDS], dtype=np.uint32))) + 1
    rank[ends] = SENTENCE
    dots = np.flatnonzero(codes == ord(".")) + 1
    dots = dots[(dots < n)]
    rank[dots[is_space[dots]]] = SENTENCE
    closers = np.isin(codes, np.array([ord(c) for c in CLOSERS], dtype=np.uint32))
    moved = ends[(ends < n)]
    moved = moved[closers[moved]]
    rank[moved], rank[moved + 1] = INSIDE, SENTENCE
    lines = np.flatnonzero((codes == 10) | (codes == 0x2028) | ((codes == 13) & (np.r_[codes[1:], 0] != 10))) + 1
    rank[lines] = LINE
    blank = np.flatnonzero(codes == 0x2029) + 1
    rank[blank] = PARAGRAPH
    for m in re.finditer(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*", text):
        rank[m.end()] = PARAGRAPH
    if "<" in text:
        for m in _TAG.finditer(text):
            rank[m.start() + 1 : m.end()] = INSIDE
        for m in _BLOCK_END.finditer(text):
            rank[m.end()] = PARAGRAPH
        for m in _LINE_TAG.finditer(text):
            rank[m.end()] = LINE
    safe = np.ones(n + 1, dtype=bool)
    safe[:n] = ~glued[codes]
    joiner = np.flatnonzero(codes == 0x200D) + 1
    safe[joiner] = False
    flags = (codes >= 0x1F1E6) & (codes <= 0x1F1FF)
    if flags.any():
        run = np.flatnonzero(flags)
        start = np.r_[0, np.flatnonzero(np.diff(run) > 1) + 1]
        place = np.arange(len(run)) - np.repeat(start, np.diff(np.r_[start, len(run)]))
        safe[run[place % 2 == 1]] = False
    pair = np.flatnonzero((codes[:-1] == 13) & (codes[1:] == 10)) + 1
    safe[pair] = False
    if "&" in text:
        for m in _ENTITY.finditer(text):
            safe[m.start() + 1 : m.end()] = False
            rank[m.start() + 1 : m.end()] = INSIDE
    safe[[0, n]] = True
    rank[~safe] = INSIDE
    return rank, safe


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of one text as (start, end, rank of the end), in code points; at most ``most`` UTF-16 units each."""
    if not text:
        return [(0, 0, PARAGRAPH)]
    codes = chars.flat(text)
    n = len(codes)
    units = np.r_[0, np.cumsum(1 + (codes > 0xFFFF))].astype(np.int64)
    if units[n] <= most:
        return [(0, n, PARAGRAPH)]
    rank, safe = boundaries(text, codes)
    bits = max(1, int(np.log2(max(2, most // 8))))
    landmark = np.flatnonzero((rolling(codes) >> np.uint64(64 - bits)) == 0) + 1
    named = [np.flatnonzero(rank >= r) for r in range(5)]
    safe_at = np.flatnonzero(safe)

    def at_units(value: int) -> int:
        """The last position of at most ``value`` units."""
        return int(np.searchsorted(units, value, side="right")) - 1

    def nearest(places: np.ndarray, target: int, low: int, high: int) -> int | None:
        a, b = np.searchsorted(places, low, "left"), np.searchsorted(places, high, "right")
        if a >= b:
            return None
        k = int(np.searchsorted(places[a:b], target)) + a
        near = [places[j] for j in (k - 1, k) if a <= j < b]
        return int(min(near, key=lambda p: (abs(p - target), p)))

    pieces, start, last_cut = [], 0, 0
    while units[n] - units[start] > most:
        limit = at_units(int(units[last_cut]) + most - (2 * overlap if pieces else 0))
        limit = min(limit, at_units(int(units[start]) + most))
        low = at_units(int(units[last_cut]) + most // 2)
        if low >= limit:
            low = last_cut + 1
        k = int(np.searchsorted(landmark, low))
        target = int(landmark[k]) if k < len(landmark) and landmark[k] <= limit else limit
        near = max(8, most // 16)
        cut = None
        for r in (PARAGRAPH, LINE, SENTENCE):
            if (cut := nearest(named[r], target, max(low, target - near), min(limit, target + near))) is not None:
                break
        if cut is None:
            for r in (SENTENCE, WORD):
                if (cut := nearest(named[r], target, low, limit)) is not None:
                    break
        if cut is None:
            cut = nearest(named[WORD], low, last_cut + 1, low)
        if cut is None or cut <= start:
            b = int(np.searchsorted(safe_at, limit, "right")) - 1
            cut = int(safe_at[b])
            if cut <= max(start, last_cut):  # one character is longer than the limit: only then is it split
                cut = max(limit, start + 1, last_cut + 1)
        pieces.append((start, cut, int(rank[cut])))
        last_cut = cut
        if overlap:
            back = max(start + 1, at_units(int(units[cut]) - overlap))
            least = max(start + 1, at_units(int(units[cut]) - 2 * overlap + overlap // 2))
            most_back = max(least, at_units(int(units[cut]) - overlap // 2))
            following = None
            for r in (SENTENCE, WORD):
                if (following := nearest(named[r], back, least, min(most_back, cut - 1))) is not None:
                    break
            if following is None:
                b = int(np.searchsorted(safe_at, back, "right")) - 1
                following = int(safe_at[b])
                if following <= start:
                    following = cut
            start = following
        else:
            start = cut
    pieces.append((start, n, PARAGRAPH))
    return pieces


def longest_run(codes: np.ndarray) -> int:
    """UTF-16 units of the longest stretch without whitespace and break characters."""
    _, space, stop = _flags()
    units = np.r_[0, np.cumsum(1 + (codes > 0xFFFF))]
    edge = np.flatnonzero(space[codes] | stop[codes])
    left = np.r_[0, edge + 1]
    right = np.r_[edge, len(codes)]
    return int((units[right] - units[left]).max()) if len(left) else 0


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


NAMES = {INSIDE: "forced", WORD: "word", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph"}


def _pieces(most: int, overlap: int, with_text: bool, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(places).to_pylist()
            for low, high in chars.slices(np.array([len(t) for t in texts])):
                out: dict[str, list] = {k: [] for k in ("row", "piece", "pieces", "start", "end", "cut", "run", "text")}
                for k in range(low, high):
                    text = texts[k]
                    codes = chars.flat(text)
                    units = np.r_[0, np.cumsum(1 + (codes > 0xFFFF))]
                    parts, longest = cuts(text, most, overlap), longest_run(codes)
                    for j, (a, b, r) in enumerate(parts):
                        out["row"].append(k)
                        out["piece"].append(j)
                        out["pieces"].append(len(parts))
                        out["start"].append(int(units[a]))
                        out["end"].append(int(units[b]))
                        out["cut"].append("end" if j == len(parts) - 1 else NAMES[r])
                        out["run"].append(longest)
                        out["text"].append(text[a:b] if with_text else None)
                carried = [batch.column(c).take(pa.array(out["row"], pa.int64())) for c in range(places)]
                yield pa.RecordBatch.from_arrays(
                    carried
                    + [pa.array(out[c], pa.int32()) for c in ("piece", "pieces", "start", "end")]
                    + [pa.array(out["cut"], pa.string()), pa.array(out["run"], pa.int32()), pa.array(out["text"], pa.string())],
                    names=[f"c{c}" for c in range(places)] + ["piece", "pieces", "start_unit", "end_unit", "cut", "longest_run", "piece_text"],
                )

    return run


def split_oversized(df: DataFrame, keys: list[str], text: str, max_units: int, overlap_units: int, with_text: bool = True, only_over: bool = False) -> DataFrame:
    """The ordered pieces of every text, none of more than ``max_units`` UTF-16 units (problem 4).

    Method: content-defined chunking. A rolling hash over the last 32 characters marks landmarks (about one in
    ``max_units / 8``); the first landmark at least half the limit after the last cut is snapped to the nearest
    paragraph, line, sentence or word end, in this order within a sixteenth of the limit, else the nearest
    sentence or word end between half and the whole limit, else any before it. Only without any boundary is a
    cut forced, and then between characters (surrogate pairs, combining marks, joined emoji, flags, CRLF and
    entities stay whole). As cuts depend on nearby text, an edit alters the neighbouring pieces only.

    Rows: ``keys``, ``piece`` from 0, ``pieces``, ``start_unit`` and ``end_unit`` (UTF-16 units; consecutive
    pieces share about ``overlap_units``), ``cut`` (``paragraph``, ``line``, ``sentence``, ``word``, ``forced``,
    ``end``), ``longest_run`` (units of the longest stretch without whitespace or break character; null for a
    text within the limit) and ``piece_text``. A text within the limit, an empty one too, is one piece; null
    texts give no row; repeated rows are each split. ``only_over`` leaves texts within the limit out. Only
    texts above the limit reach Python.
    """
    if max_units < 4 or overlap_units < 0 or overlap_units * 4 > max_units:
        raise ValueError("max_units must be at least 4 and four times the overlap")
    content = F.col(f"`{text}`")
    rows = df.where(content.isNotNull()).select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keys)], content.alias("_text"))
    over = (F.octet_length("_text") > max_units) & (utf16_units(F.col("_text")) > max_units)
    fields = [T.StructField(f"c{i}", rows.schema[f"c{i}"].dataType) for i in range(len(keys))]
    fields += [T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "start_unit", "end_unit")]
    fields += [T.StructField("cut", T.StringType()), T.StructField("longest_run", T.IntegerType()), T.StructField("piece_text", T.StringType())]
    cut = rows.where(over).mapInArrow(_pieces(max_units, overlap_units, with_text, len(keys)), T.StructType(fields))
    if not only_over:
        whole = rows.where(~over).select(
            *[f"c{i}" for i in range(len(keys))],
            F.lit(0).alias("piece"),
            F.lit(1).alias("pieces"),
            F.lit(0).alias("start_unit"),
            utf16_units(F.col("_text")).alias("end_unit"),
            F.lit("end").alias("cut"),
            F.lit(None).cast("int").alias("longest_run"),
            (F.col("_text") if with_text else F.lit(None).cast("string")).alias("piece_text"),
        )
        cut = cut.unionByName(whole)
    return cut.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], "piece", "pieces", "start_unit", "end_unit", "cut", "longest_run", "piece_text")
