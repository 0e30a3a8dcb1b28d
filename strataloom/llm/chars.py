"""Batches of texts as flat code-point arrays, and hashes over them."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

TAG = re.compile(r"<[^>\x00]*>")


@functools.cache
def letter_digit() -> np.ndarray:
    """For every code point whether it is a Unicode letter or number."""
    flags = np.zeros(0x110000, dtype=bool)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] in "LN":
            flags[code] = True
    return flags


@functools.cache
def kinds() -> np.ndarray:
    """For every code point 2 for an ideograph or kana, 1 for another letter or digit, 0 for the rest."""
    out = letter_digit().astype(np.uint8)
    for low, high in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)):
        out[low : high + 1] = np.where(out[low : high + 1] > 0, 2, 0)
    return out


def slices(lengths: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters; a longer text forms its own range."""
    start, total = 0, 0
    for k, size in enumerate(lengths):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += int(size)
    if start < len(lengths):
        yield start, len(lengths)


def flat(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def join(texts: list[str]) -> str:
    """One string with a NUL between texts; a text's own NULs become U+FFFD."""
    if any("\x00" in t for t in texts):
        texts = [t.replace("\x00", "�") for t in texts]
    return "\x00".join(texts)


def bare(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the texts without tags, entities decoded, lower case: codes and offsets."""
    joined = html.unescape(TAG.sub("", join(texts))).lower()
    codes = flat(joined)
    row = np.cumsum(codes == 0, dtype=np.int32)
    keep = letter_digit()[codes]
    kept, row = codes[keep], row[keep]
    return kept, np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))].astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (the public SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` codes (windows also cross texts; the caller drops those)."""
    base = 0x9E3779B97F4A7C15
    unit = mix64(codes.astype(np.uint64) + np.uint64(0x1234567))
    done: np.ndarray | None = None
    covered, power, span = 0, unit, 1
    rest = width
    while rest:
        if rest & 1:
            if done is None:
                done = power
            else:
                n = len(unit) - covered - span + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                done = done[:n] * np.uint64(pow(base, span, 1 << 64)) + power[covered : covered + n]
            covered += span
        rest >>= 1
        if rest:
            n = len(power) - span
            if n <= 0:
                return np.zeros(0, np.uint64)
            power = power[:n] * np.uint64(pow(base, span, 1 << 64)) + power[span:]
            span *= 2
    return mix64(done)
