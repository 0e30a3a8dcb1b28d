"""Text statistics per document and the form of a document by fixed thresholds (problem 8)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import chars
from strataloom.llm.tables import written


#: Frequent function words of English and frequent characters of Chinese.
COMMON_EN = frozenset(
    """a about after again all almost an and any are as at be because been before but by can could do each few for
    from get had has have he her here him his how i if in into is it its just like many me more most much must my no
    not now of off often on one only or other our out over same say she should since so some still such than that the
    their them then there these they this those to too under up us very was we were what when which while who why will
    with without would you your""".split()
)
COMMON_ZH = frozenset(
    "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然"
    "家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实把被让给见向比更最很"
    "先再换次间候或者及与且若则虽即将已曾至每第几两几何谁哪怎什"
)
#: The eight English stop words of the published rule, and the Chinese characters used in their place.
STOP_EN = frozenset(("the", "be", "to", "of", "and", "that", "have", "with"))
STOP_ZH = frozenset("的了是在和有不会")

#: Published thresholds for natural text (word count, mean word length, symbol to word ratio, bullet and ellipsis
#: lines, words with a letter, stop words, repeated lines and most frequent word pair; punctuated line ends).
WORDS = (50, 100_000)
MEAN_WORD = (3.0, 10.0)
SYMBOLS = 0.10
BULLET_LINES = 0.90
ELLIPSIS_LINES = 0.30
ALPHA_WORDS = 0.80
STOPS = 2
REPEATED_LINES = 0.30
TOP_PAIR = 0.20
PUNCTUATED_LINES = 0.12
COMMON = 0.08
#: A form that holds more than this share of the characters decides.
MAJORITY = 0.5
#: Thresholds of a line: broken characters, least share of letters and digits.
BROKEN_SHARE, LETTER_SHARE = 0.25, 0.3
#: A sentence on a line of its own, of fewer characters than SHORT_LINE, is a notice if more than FREQUENT of the
#: distinct texts have it, and at least FREQUENT_LEAST.
SHORT_LINE, FREQUENT, FREQUENT_LEAST = 60, 0.001, 3

# ---------------------------------------------------------------- vectorised statistics

#: Characters that end a line, that part clauses, that end sentences, that stand for a symbol, and bullets.
_ENDS = ".!?。！？…;；:：\"'”’」』)）》】"
_CLAUSE_ENDS = "，。！？；"
_STOPS = "。！？!?；;…"
_SYMBOLS = "#…|│\ufffd¬¦§"
_BULLETS = "-*+•·◦‣▪●○■□◆◇➢➤✓✔☐☑☒"
_NUMERALS = "一二三四五六七八九十"
_RULES = "-=_+|:*#~│┌┐└┘├┤┬┴┼─━ \t"
#: Characters that UTF-8 read as another encoding leaves behind, beside U+0080 to U+00FF and the private area.
_BROKEN = "ŒœŠšŽžŸƒˆ˜€™\ufffd"

LETTER, HAN, DIGIT, SPACE, BREAK = 1, 2, 4, 8, 16
END_MARK, CLAUSE, SYMBOL, BULLET, COMMON_CHAR, STOP, STRANGE, RULE = 32, 64, 128, 256, 512, 1024, 2048, 4096
#: Kinds of lines.
FORMS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK, NEUTRAL, RULED = range(6)


@functools.cache
def _classes() -> np.ndarray:
    """For every code point the flags above."""
    out = np.zeros(0x110000, dtype=np.uint16)
    letters = chars.letter_digit()
    kind = chars.kinds()
    out[letters & (kind != 2)] |= LETTER
    out[0x3400:0x9FFF + 1] |= HAN
    for code in np.flatnonzero(letters & (kind != 2)):
        if chr(code).isnumeric():
            out[code] = DIGIT
    for code in range(0x3100):
        if chr(code).isspace():
            out[code] |= SPACE
    out[[0, 10, 13]] |= BREAK | SPACE
    out[0xFEFF] |= SPACE
    for flag, text in ((END_MARK, _ENDS), (CLAUSE, _CLAUSE_ENDS), (SYMBOL, _SYMBOLS), (BULLET, _BULLETS), (COMMON_CHAR, "".join(COMMON_ZH)), (STOP, _STOPS), (STRANGE, _BROKEN), (RULE, _RULES)):
        out[[ord(c) for c in text]] |= flag
    out[0x80:0x100] |= STRANGE
    out[0xA0] &= ~np.uint16(STRANGE)
    out[0xE000:0xF900] |= STRANGE
    return out


def _codes(text: str) -> np.ndarray:
    return np.array([ord(x) for x in text], dtype=np.uint32)


def _word_hash(words) -> np.ndarray:
    """The hashes that ``Lines`` gives to words in lower case."""
    out = []
    for w in words:
        codes = np.array([ord(c) for c in w], dtype=np.uint64)
        out.append(int(np.add.reduce(chars.mix64(codes + (np.arange(len(codes), dtype=np.uint64) << np.uint64(32)) + np.uint64(1)))))
    return np.array(out, dtype=np.uint64)


def _within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A value's hash within its group (a line or a text of the batch): 24 bits of the group before 40 of the hash."""
    return (group.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24))


class Lines:
    """Lines and words of a batch of texts as arrays; blank lines are left out."""

    def __init__(self, texts: list[str]) -> None:
        self.rows = len(texts)
        low = chars.join(texts).lower()
        self.codes = c = chars.flat(low)
        self.cls = k = _classes()[c]
        self.row = np.cumsum(c == 0)
        n = len(c)
        start = np.r_[0, np.flatnonzero(k & BREAK) + 1]
        end = np.r_[start[1:] - 1, n]
        filled = np.flatnonzero((k & SPACE) == 0)
        a, b = np.searchsorted(filled, start), np.searchsorted(filled, end)
        some = b > a
        self.start, self.end = start[some], end[some]
        self.first, self.last = (filled[a[some]], filled[b[some] - 1]) if some.any() else (np.zeros(0, int), np.zeros(0, int))
        self.line_row = self.row[self.first] if some.any() else np.zeros(0, int)
        # words: runs of letters and runs of digits, and each ideograph
        alpha = (k & LETTER) > 0
        at = np.flatnonzero(alpha)
        self.word_at, self.word_hash = np.zeros(0, int), np.zeros(0, np.uint64)
        if len(at):
            head = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(at)]))
            offset = (at - at[head][run]).astype(np.uint64)
            self.word_hash = np.add.reduceat(chars.mix64(c[at].astype(np.uint64) + (offset << np.uint64(32)) + np.uint64(1)), head)
            self.word_at = at[head]
        self.letters = at

    def per_line(self, at: np.ndarray) -> np.ndarray:
        """How many of the sorted positions fall into each line."""
        return np.searchsorted(at, self.end) - np.searchsorted(at, self.start)

    def per_row(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=self.rows)

    def at(self, offset: int) -> np.ndarray:
        """The character so many places after each line's first one; 0 behind the line's end."""
        place = self.first + offset
        return np.where(place <= self.last, self.codes[np.minimum(place, len(self.codes) - 1)], 0)

    def _run_end(self, outside: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each start the next position whose character is ``outside`` of a class (or the end of the text)."""
        where = np.r_[np.flatnonzero(outside), len(self.codes)]
        return where[np.searchsorted(where, start)]

    def begins(self, mark: str) -> np.ndarray:
        out = self.last + 1 - self.first >= len(mark)
        for k, ch in enumerate(mark):
            out &= self.at(k) == ord(ch)
        return out

    def bullets(self) -> np.ndarray:
        """Lines that begin with a bullet, a box, a number or numeral before a stop, a circled or bracketed number, or a chapter's number."""
        c, k = np.r_[self.codes, 0, 0], np.r_[self.cls, 0, 0]
        one, two, three = self.at(0), self.at(1), self.at(2)
        plain = ((k[self.first] & BULLET) > 0) & (two == 32)
        box = (one == ord("[")) & np.isin(two, _codes(" xX✓")) & (three == ord("]"))
        box |= np.isin(one, _codes("-*+")) & (two == ord("["))
        opening = np.isin(one, _codes("(（"))
        start = self.first + opening
        digit_end = self._run_end((self.cls & DIGIT) == 0, start)
        numeral = np.isin(self.codes, _codes(_NUMERALS + "百0123456789"))
        numeral_end = self._run_end(~numeral, start)
        mark = c[digit_end]
        numbered = (digit_end > start) & (digit_end - start <= 3) & np.isin(mark, _codes(".)、．）")) & ((k[np.minimum(digit_end + 1, len(c) - 1)] & DIGIT) == 0)
        chinese = (numeral_end > start) & (numeral_end - start <= 3) & np.isin(c[numeral_end], _codes("、.．")) & ~((k[start] & DIGIT) > 0)
        bracketed = opening & (numeral_end > start) & (numeral_end - start <= 3) & np.isin(c[numeral_end], _codes(")）"))
        letter = ((k[self.first] & LETTER) > 0) & np.isin(two, _codes(".)")) & (three == 32)
        circled = (one >= 0x2460) & (one <= 0x2473)
        after = self._run_end(~numeral, np.minimum(self.first + 1, len(self.codes)))
        chapter = (one == ord("第")) & (after > self.first + 1) & np.isin(c[after], _codes("章节条部回"))
        return plain | box | numbered | chinese | bracketed | letter | circled | chapter

    def _parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line the number of the sorted positions inside it, and the length of the longest part between them."""
        inside = self.per_line(at)
        line = np.repeat(np.arange(len(self.first)), inside)
        low = np.searchsorted(at, self.start)
        own = at[np.repeat(low - np.r_[0, np.cumsum(inside)[:-1]], inside) + np.arange(len(line))]
        edge = np.concatenate([self.first - 1, own, self.last + 1])
        which = np.concatenate([np.arange(len(self.first)), line, np.arange(len(self.first))])
        order = np.lexsort((edge, which))
        edge, which = edge[order], which[order]
        longest = np.zeros(len(self.first), dtype=np.int64)
        same = which[1:] == which[:-1]
        np.maximum.at(longest, which[1:][same], (edge[1:] - edge[:-1] - 1)[same])
        return inside, longest

    def _near(self, offset: int, value: np.ndarray, outside) -> np.ndarray:
        """The value of the line so many lines on, in the same text; ``outside`` beyond it."""
        out = np.full(len(value), outside, dtype=value.dtype)
        n = len(value)
        if 0 < abs(offset) < n:
            here, there = (slice(0, n - offset), slice(offset, n)) if offset > 0 else (slice(-offset, n), slice(0, n + offset))
            out[here] = np.where(self.line_row[here] == self.line_row[there], value[there], outside)
        return out

    def kinds(self, frequent: np.ndarray | None = None) -> np.ndarray:
        """The kind of each line by fixed thresholds on its measures (``frequent``: sorted hashes of lines that many texts share)."""
        n = len(self.first)
        if not n:
            return np.zeros(0, dtype=np.int8)
        c, k = self.codes, self.cls
        following, before = np.r_[c[1:], 0], np.r_[0, c[:-1]]
        inside = np.zeros(len(c) + 1, dtype=np.int32)
        np.add.at(inside, self.first, 1)
        np.add.at(inside, self.last + 1, -1)
        inside = np.cumsum(inside)[:-1] > 0

        def count(mask: np.ndarray) -> np.ndarray:
            return self.per_line(np.flatnonzero(mask))

        size = self.last + 1 - self.first
        han, digits, words = count(k & HAN), count(k & DIGIT), self.per_line(self.word_at)
        alnum = han + digits + self.per_line(self.letters)
        solid = count((k & SPACE) == 0)
        latin_stop = (c == 46) & ((following == 32) | (following == 10) | (following == 13) | (following == 0))
        stops = count(((k & STOP) > 0) | latin_stop)
        commas = count((c == ord("，")) | ((c == 44) & (following == 32)))
        single = np.zeros(n, dtype=np.int8)  # prose unless a test below says otherwise; the first test that holds decides
        open_ = np.ones(n, dtype=bool)

        def decide(mask: np.ndarray, kind: int) -> None:
            single[open_ & mask] = kind
            open_[mask] = False

        # broken encodings
        triple = (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:]) & np.isin(c[:-2], _codes("烫屯")) if len(c) > 2 else np.zeros(0, bool)
        lost = count((c == ord("锟")) & (following == ord("斤"))) + count(np.r_[triple, np.zeros(len(c) - len(triple), bool)])
        odd = count(k & STRANGE)
        decide((odd >= BROKEN_SHARE * size) | ((odd >= 3) & (odd >= 0.1 * size)) | (lost > 0), JUNK)
        hashes = np.zeros(n, dtype=bool)
        for depth in range(1, 7):
            hashes |= self.begins("#" * depth + " ")
        heading = hashes | self.begins("[source ")
        decide(heading, NEUTRAL)
        decide(count(((k & RULE) > 0) & inside) == size, RULED)
        # page marks and lines without letters
        colon = (c == 58) | (c == ord("："))
        bullet = self.bullets()
        numbers = count(((k & DIGIT) > 0) & ((np.r_[0, k[:-1]] & DIGIT) == 0))
        space = (c == 32) | (c == 0x3000)
        gap = space & (np.r_[False, space[1:] & (c[1:] == c[:-1])]) & ~((following == c) & space) & inside
        mark = np.isin(c, _codes(":：\t,，;；|│┃")) | gap
        decide(~bullet & (numbers > 0) & (numbers <= 3) & (han + words <= 2) & (size <= 20) & (count(mark) == 0) & (stops == 0), JUNK)
        dots = c == 46
        decide((alnum == 0) | (alnum < LETTER_SHARE * (solid - count(dots))), JUNK)
        # links and leader dots
        link = (count((c == ord("]")) & (following == ord("("))) > 0) & np.isin(c[self.last], _codes(")。.;；")) & ((c[self.first] == ord("[")) | bullet)
        leading = dots & ((following == 46) | ((following == 32) & (np.r_[c[2:], 0, 0] == 46)[: len(c)]))
        leader = ((k[self.last] & DIGIT) > 0) & ((count(leading) >= 3) | (count((c == 0x2026) | (c == 0xB7)) >= 2))
        decide(link | leader, LIST)
        # rows of cells: the same separator about as often in a line nearby
        quotes = count(c == 34)
        comma = np.flatnonzero(((c == 44) & (following != 32)) | (c == ord("，")))
        n_comma, long_comma = self._parts(comma)
        wide_comma = count(c == ord("，"))
        kinds = [
            (count(c == 9), True), (count(((c == 0x2502) | (c == 0x2503)) & inside), True), (count((c == ord("|")) & inside), True), (count(gap), stops == 0),
            (count(((c == 59) | (c == ord("；"))) & (following != 32) & inside), None),
            (n_comma, (long_comma <= 30) & ~(((k[self.last] & STOP) > 0) | (c[self.last] == 46)) & ((wide_comma == 0) | (long_comma <= 8))),
        ]
        sep, cells = np.zeros(n, dtype=np.int8), np.ones(n, dtype=np.int64)
        for code, (times, allowed) in enumerate(kinds, 1):
            if allowed is None:
                allowed = (times >= 2) | (quotes >= 2 * np.maximum(times, 1))
            hit = (sep == 0) & (times > 0) & allowed
            sep[hit], cells[hit] = code, times[hit] + 1
        loose = sep >= 4  # cells may be missing where separators are blanks, semicolons or commas
        aligned = np.zeros(n, dtype=bool)
        for step in (-3, -2, -1, 1, 2, 3):
            aligned |= (self._near(step, sep, 0) == sep) & (np.abs(self._near(step, cells, -9) - cells) <= loose)
        # a row of short parts that no other row stands under
        marks = np.flatnonzero(np.isin(c, _codes("|│·/>»")) & inside)
        n_mark, long_mark = self._parts(marks)
        decide((n_mark >= 2) & (long_mark <= 26) & ~((sep > 0) & aligned) & ~bullet, JUNK)
        decide((sep > 0) & aligned & ~(bullet & (sep >= 4)), TABLE)
        decide(bullet, LIST)
        # keys with short values beside others
        where = np.flatnonzero(colon)
        place = np.searchsorted(where, self.first)
        at = np.where(place < len(where), np.r_[where, 0][place], 0)
        has = (place < len(where)) & (at > self.first) & (at <= self.last) & (at - self.first <= 24)
        value = self.last - at
        ended = (stops > 0) & ~((stops == 1) & (((k[self.last] & STOP) > 0) | (c[self.last] == 46)))
        key = has & (value <= 42) & ~ended & (commas == 0) & ~heading
        window, near = np.ones(n, dtype=np.int64), key.astype(np.int64)
        for step in (-3, -2, -1, 1, 2, 3):
            window += self._near(step, np.ones(n, dtype=np.int64), 0)
            near += self._near(step, key.astype(np.int64), 0)
        name = np.where(key, self._hash(self.first, np.where(key, at, self.first)), 0).astype(np.uint64)
        _, back, times = np.unique(_within(self.line_row, name), return_inverse=True, return_counts=True)
        again = times[back.ravel()]
        decide(key & (((near >= 3) & (near >= 0.8 * window)) | ((again >= 2) & (near >= 0.6 * window))), TABLE)
        # lines that many texts share, and lines that fill their own text
        line_hash = self._hash(self.first, self.last + 1)
        if frequent is not None and len(frequent):
            spot = np.minimum(np.searchsorted(frequent, line_hash), len(frequent) - 1)
            decide((frequent[spot] == line_hash) & self.whole_sentences(stops), JUNK)
        # runs of short phrases of uneven length
        brief = np.where(han > 0, han <= 16, words <= 8) & (size <= 60)
        body_stop = stops - (((k[self.last] & STOP) > 0) | (c[self.last] == 46))
        marked = count(np.isin(c, _codes("，,、|│\t")))
        item = brief & (body_stop <= 0) & (marked == 0) & ~heading & (alnum > 0)
        head = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (self.line_row[1:] != self.line_row[:-1])])
        run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, n]))
        runs = np.bincount(run)
        mean = np.bincount(run, weights=size) / runs
        spread = np.sqrt(np.maximum(0, np.bincount(run, weights=size.astype(float) ** 2) / runs - mean**2))
        decide(item & ((runs >= 4) & (spread >= 0.15 * mean))[run], LIST)
        _, back, times = np.unique(_within(self.line_row, line_hash), return_inverse=True, return_counts=True)
        lines = self.per_row(self.line_row)
        decide((times[back.ravel()] >= 4) & (lines[self.line_row] >= 6) & (size < 60), JUNK)
        # repeated words and pairs, unconnected tokens, and text without common words
        total = han + words + numbers
        top_word, top_pair = self._tops()
        decide((total >= 12) & (((top_word >= 6) & (top_word > 0.25 * total)) | (top_pair >= np.maximum(5, TOP_PAIR * total / 2))), JUNK)
        scattered = np.zeros(n, dtype=bool)
        for mark in "_,、 ":
            times, longest = self._parts(np.flatnonzero((c == ord(mark)) & inside))
            scattered |= (times >= 7) & (size - times <= 5.5 * (times + 1)) & (longest <= 14)
        decide(scattered & (han > 2 * words) & (stops == 0), JUNK)
        common = count(k & COMMON_CHAR) + self.per_line(self.word_at[np.isin(self.word_hash, _word_hash(sorted(COMMON_EN)))])
        decide((alnum >= 20) & (common < COMMON * np.maximum(1, han + words)), JUNK)
        # a ruled line belongs to the table around it, otherwise to nothing unless such lines fill the text
        ruled = single == RULED
        if ruled.any():
            up, down = self._near(-1, single, NEUTRAL), self._near(1, single, NEUTRAL)
            beside = (up == TABLE) | (down == TABLE)
            many = self.per_row(self.line_row[ruled])[self.line_row]
            fills = (many >= 3) & ((many >= 0.4 * lines[self.line_row]) | (up == JUNK) | (down == JUNK))
            single[ruled] = np.where(beside, TABLE, np.where(fills, JUNK, NEUTRAL))[ruled]
        return single

    def whole_sentences(self, stops: np.ndarray | None = None) -> np.ndarray:
        """Lines of at least six letters that end as a sentence does, without a bullet."""
        end = self.codes[self.last]
        return (self.last - self.first >= 6) & (((self.cls[self.last] & STOP) > 0) | (end == 46) | (end == ord("）")) | ((self.cls[self.last] & LETTER) > 0))

    def _hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A hash of the characters of each stretch [low, high); empty ones give 0."""
        length = high - low
        out = np.zeros(len(low), dtype=np.uint64)
        some = np.flatnonzero(length > 0)
        if len(some):
            length = length[some]
            first = np.cumsum(length) - length
            offset = np.arange(int(length.sum())) - np.repeat(first, length)
            value = chars.mix64(self.codes[np.repeat(low[some], length) + offset].astype(np.uint64) + (offset.astype(np.uint64) << np.uint64(32)) + np.uint64(7))
            out[some] = np.add.reduceat(value, first)
        return out

    def _tops(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the most frequent word that is no common one, and the most frequent pair of words, occur in each line."""
        at, value = self._words()
        line = np.searchsorted(self.start, at, side="right") - 1
        word, pair = np.zeros(len(self.first), dtype=np.int64), np.zeros(len(self.first), dtype=np.int64)
        if not len(at):
            return word, pair
        long = np.bincount(line, minlength=len(self.first)) >= 12
        keep = long[line]
        line, value, at = line[keep], value[keep], at[keep]
        if len(line):
            rare = ~((self.cls[at] & COMMON_CHAR) > 0) & ~np.isin(value, _word_hash(sorted(COMMON_EN)))
            for into, who, what in ((word, line[rare], value[rare]), (pair, line[:-1][line[:-1] == line[1:]], self._paired(value)[line[:-1] == line[1:]])):
                if len(who):
                    seen, times = np.unique(_within(who, what), return_counts=True)
                    np.maximum.at(into, (seen >> np.uint64(40)).astype(np.int64), times)
        return word, pair

    @staticmethod
    def _paired(value: np.ndarray) -> np.ndarray:
        return chars.mix64(value[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[1:])

    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of words and ideographs in order."""
        han = np.flatnonzero(self.cls & HAN)
        at = np.r_[self.word_at, han]
        value = np.r_[self.word_hash, chars.mix64(self.codes[han].astype(np.uint64) + np.uint64(99))]
        order = np.argsort(at, kind="stable")
        return at[order], value[order]

    def shares(self, frequent: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """The share of each text's characters in lines of each kind; neutral lines count for nothing."""
        kinds = self.kinds(frequent)
        size = self.last + 1 - self.first
        held = {f: np.bincount(self.line_row[kinds == code], weights=size[kinds == code], minlength=self.rows) for code, f in enumerate(FORMS)}
        total = np.maximum(sum(held.values()), 1)
        return {f"{f}_chars": held[f] / total for f in FORMS}

    def measures(self) -> dict[str, np.ndarray]:
        """The statistics of each text."""
        c, k, n = self.codes, self.cls, self.rows
        han = np.flatnonzero(k & HAN)
        digit = np.flatnonzero(k & DIGIT)
        number = digit[np.r_[True, np.diff(digit) > 1]] if len(digit) else digit
        latin, ideographs, numbers = self.per_row(self.row[self.word_at]), self.per_row(self.row[han]), self.per_row(self.row[number])
        words = latin + ideographs + numbers
        safe = np.maximum(words, 1)
        lines = self.per_row(self.line_row)
        many = np.maximum(lines, 1)
        dots = c == 46
        three = np.flatnonzero(dots[:-2] & dots[1:-1] & dots[2:] & ~np.r_[False, dots[:-3]]) if len(c) > 2 else np.zeros(0, int)
        symbols = self.per_row(self.row[np.flatnonzero(k & SYMBOL)]) + self.per_row(self.row[three])
        last, before = c[self.last], np.maximum(self.last - 2, 0)
        long = self.last - self.first >= 2
        ellipsis = (last == 0x2026) | (long & (last == 46) & (c[before] == 46) & (c[np.maximum(self.last - 1, 0)] == 46))
        bullet = self.bullets()
        common = self.per_row(self.row[np.flatnonzero(k & COMMON_CHAR)]) + self.per_row(self.row[self.word_at[np.isin(self.word_hash, _word_hash(sorted(COMMON_EN)))]])
        stops = np.zeros(n, dtype=np.int64)
        for h in _word_hash(sorted(STOP_EN)):
            stops += self.per_row(self.row[self.word_at[self.word_hash == h]]) > 0
        for ch in STOP_ZH:
            stops += self.per_row(self.row[np.flatnonzero(c == ord(ch))]) > 0
        return {
            "word_count": words.astype(np.int32),
            "mean_word_length": self.per_row(self.row[self.letters]) / np.maximum(latin, 1),
            "symbol_ratio": np.where(words > 0, symbols / safe, (symbols > 0).astype(float)),
            "punctuated_lines": self.per_row(self.line_row[(k[self.last] & END_MARK) > 0]) / many,
            "bullet_lines": self.per_row(self.line_row[bullet]) / many,
            "ellipsis_lines": self.per_row(self.line_row[ellipsis]) / many,
            "alpha_words": np.where(words > 0, (latin + ideographs) / safe, 0.0),
            "stop_words": stops.astype(np.int32),
            "common_share": common / safe,
            "repeated_lines": self._repeated(many),
            "top_pair": self._top_pair(safe),
            "_mostly_latin": latin > ideographs,
        }

    def _repeated(self, many: np.ndarray) -> np.ndarray:
        """Share of lines that repeat an earlier line of their text."""
        if not len(self.start):
            return np.zeros(self.rows)
        pairs = np.unique(_within(self.line_row, self._hash(self.first, self.last + 1)))
        return (self.per_row(self.line_row) - self.per_row((pairs >> np.uint64(40)).astype(np.int64))) / many

    def _top_pair(self, safe: np.ndarray) -> np.ndarray:
        """Share of the words that the most frequent pair of neighbouring words makes up."""
        at, value = self._words()
        row = self.row[at]
        out = np.zeros(self.rows)
        same = np.flatnonzero(row[:-1] == row[1:]) if len(row) > 1 else np.zeros(0, int)
        if len(same):
            pairs, times = np.unique(_within(row[same], self._paired(value)[same]), return_counts=True)
            np.maximum.at(out, (pairs >> np.uint64(40)).astype(np.int64), times)
        return out * 2 / safe


COLUMNS = (
    ("word_count", "int"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("punctuated_lines", "double"),
    ("bullet_lines", "double"), ("ellipsis_lines", "double"), ("alpha_words", "double"), ("stop_words", "int"),
    ("common_share", "double"), ("repeated_lines", "double"), ("top_pair", "double"), ("list_chars", "double"), ("table_chars", "double"), ("junk_chars", "double"),
    ("form", "string"), ("failures", "array<string>"),
)


def statistics(texts: list[str], frequent: np.ndarray | None = None) -> dict[str, list]:
    """The values of COLUMNS for a batch of texts: measures, the form they tell and the names of the failed rules."""
    lines = Lines(texts)
    m = lines.measures()
    held = lines.shares(frequent)
    m.update({name: held[name] for name in ("list_chars", "table_chars", "junk_chars")})
    n, mean, latin = m["word_count"], m["mean_word_length"], m.pop("_mostly_latin")
    rules = (
        ("few_words", n < WORDS[0]),
        ("many_words", n > WORDS[1]),
        ("mean_word_length", latin & ((mean < MEAN_WORD[0]) | (mean > MEAN_WORD[1]))),
        ("symbol_ratio", m["symbol_ratio"] > SYMBOLS),
        ("bullet_lines", m["bullet_lines"] > BULLET_LINES),
        ("ellipsis_lines", m["ellipsis_lines"] > ELLIPSIS_LINES),
        ("alpha_words", m["alpha_words"] < ALPHA_WORDS),
        ("stop_words", m["stop_words"] < STOPS),
        ("repeated_lines", m["repeated_lines"] > REPEATED_LINES),
        ("top_pair", m["top_pair"] > TOP_PAIR),
        ("punctuated_lines", m["punctuated_lines"] < PUNCTUATED_LINES),
        ("common_share", m["common_share"] < COMMON),
        *((name, m[name] > MAJORITY) for name in ("list_chars", "table_chars", "junk_chars")),
    )
    failures: list[list[str]] = [[] for _ in texts]
    for name, failed in rules:
        for k in np.flatnonzero(failed):
            failures[k].append(name)
    # the form that holds the most characters, which decides with more than half of them; without it prose if prose holds half
    table = np.stack([held[f"{f}_chars"] for f in FORMS], axis=1) if texts else np.zeros((0, 4))
    best = table.argmax(axis=1)
    best[(table.sum(axis=1) == 0) | ((table[np.arange(len(best)), best] <= MAJORITY) & (table[:, PROSE] >= MAJORITY))] = PROSE
    return {**{c: v.tolist() for c, v in m.items()}, "form": [FORMS[k] for k in best], "failures": failures}


def forms_of(texts: list[str], frequent: np.ndarray | None = None) -> list[str]:
    """The form of each text by its statistics."""
    return statistics(texts, frequent)["form"]


def form_of(text: str) -> tuple[str, list[str]]:
    """The form of one text and its failed rules."""
    found = statistics([text])
    return found["form"][0], found["failures"][0]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    return chars.slices(np.array([len(t) for t in texts]), 1_000_000)


# ---------------------------------------------------------------- lines that many texts share


def _sentence_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (hash of the text, hash of a line of one short sentence), each pair once, and a row of 0 for the text."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for low, high in _parts(texts):
            lines = Lines(texts[low:high])
            row, line, whole = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(high - low, np.uint64)
            if len(lines.first):
                own = lines._hash(lines.first, lines.last + 1)
                np.add.at(whole, lines.line_row, chars.mix64(own + np.arange(len(own), dtype=np.uint64) - np.searchsorted(lines.line_row, lines.line_row).astype(np.uint64)))
                short = lines.whole_sentences() & (lines.last - lines.first < SHORT_LINE)
                pairs = np.unique(np.stack([lines.line_row[short].astype(np.uint64), own[short]], axis=1), axis=0)
                row, line = pairs[:, 0].astype(np.int64), pairs[:, 1]
            text = np.r_[whole[row], whole].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(text), pa.array(np.r_[line, np.zeros(len(whole), np.uint64)].view(np.int64))], names=["text", "line"])


def frequent_lines(df: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of the short lines that more than FREQUENT of the distinct texts, and at least FREQUENT_LEAST, hold.

    Counted over all texts, copies of a text once; at most 1 / FREQUENT lines a text of average length reach the driver.
    """
    rows = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    counted = written(rows.mapInArrow(_sentence_lines, "text long, line long").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")), "lines")
    whole = counted.where("line = 0").first()
    least = max(FREQUENT_LEAST, FREQUENT * (whole.n if whole else 0))
    got = counted.where((F.col("line") != 0) & (F.col("n") >= least)).select("line").toArrow().column("line").to_numpy()
    return np.sort(got.view(np.uint64))


# ---------------------------------------------------------------- operator


def _measured(frequent: np.ndarray):
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _parts(texts):
                found = statistics(texts[low:high], frequent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low)] + [pa.array(found[c], kinds[k]) for c, k in COLUMNS], names=["key", *(c for c, _ in COLUMNS)]
                )

    return run


def quality_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Statistics, form and failed rules of each text (problem 8).

    Words are Latin words, numbers and single Chinese characters. Every measure is counted over whole batches in
    arrays. The published fixed thresholds for natural text are applied to them, and each failed rule is named in
    ``failures``. For the form each line is told by thresholds on its own measures (bullets and numbers at its
    beginning, separators that recur in the lines around, keys before short values, share of letters, of broken
    characters and of common words, repeated words and pairs, repeated lines, and short sentences that many texts
    share); ``list_chars``, ``table_chars`` and ``junk_chars`` are the shares of characters in such lines, headings
    counting for nothing. A share of more than half fails the rule of that name and is the form; without one the
    largest share is, prose if it holds half. Every text that is not prose without a majority has failed rules of
    its measures. Null texts give no row; an empty text has zeros and is prose; repeated rows come out repeatedly.
    """
    frequent = frequent_lines(df, text)
    rows = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in COLUMNS)
    return rows.mapInArrow(_measured(frequent), schema).withColumnRenamed("key", key)


def document_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``form`` (prose, list, table, junk) and ``failures`` of each row, from ``quality_statistics``."""
    return quality_statistics(df, key, text).select(key, "form", "failures")
