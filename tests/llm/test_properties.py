"""Properties over arbitrary texts."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import chars, pii, quality, split, subjects

texts = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=400)
rough = st.lists(st.sampled_from(["字", "a", " ", "\n", "\r\n", "。", ". ", "😀", "é", "<p>", "</p>", "&amp;", "🇨🇳", "👨‍👩‍👧", "x" * 9, "1. ", "- ", "\t", "|"]), max_size=120).map("".join)


def units(text):
    return len(text.encode("utf-16-le")) // 2


@settings(max_examples=300, deadline=None)
@given(st.one_of(texts, rough), st.integers(8, 200), st.integers(0, 4))
def test_pieces(text, most, quarter):
    overlap = most * quarter // 20
    parts = split.cuts(text, most, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(parts, parts[1:]):
        assert a < c <= b < d
    glued = False
    for a, b, rank in parts:
        assert units(text[a:b]) <= most
        if 0 < b < len(text):
            # a combining mark begins a piece only if one character alone exceeds the limit
            glued = glued or unicodedata.category(text[b])[0] == "M"
    if glued:
        assert any(unicodedata.category(c)[0] == "M" for c in text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(texts, rough), max_size=8))
def test_batches_equal_single_texts(batch):
    assert quality.forms_of(batch) == [quality.forms_of([t])[0] for t in batch]
    together = quality.statistics(batch)
    for k, t in enumerate(batch):
        alone = quality.statistics([t])
        assert all(together[c][k] == alone[c][0] for c in together)
    codes, offsets = chars.bare(batch)
    for k, t in enumerate(batch):
        one, _ = chars.bare([t])
        assert codes[offsets[k] : offsets[k + 1]].tolist() == one.tolist()


@settings(max_examples=200, deadline=None)
@given(st.one_of(texts, rough))
def test_nothing_breaks(text):
    found = pii.find_in(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found)
    assert isinstance(pii.replaced(text, found), str)
    parts = subjects.spans(subjects.plain(text))
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 0x10FFFF).filter(lambda c: not 0xD800 <= c < 0xE000), max_size=40), st.integers(1, 12))
def test_shingles_are_a_function_of_the_window(codes, width):
    import numpy as np

    array = np.array(codes, dtype=np.uint32)
    got = chars.shingles(array, width) if len(codes) >= width else []
    assert len(got) == max(0, len(codes) - width + 1)
    for k, value in enumerate(got):
        assert chars.shingles(array[k : k + width], width)[0] == value
