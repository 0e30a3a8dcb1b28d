"""Subject areas of texts by class-association rules (problem 3)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import mining
from strataloom.llm.mining import plain
from strataloom.llm.tables import written

#: Documented parameters. SAMPLE_ROWS bounds the labelled samples, of which every HELD_OUT-th calibrates; SUPPORT is the
#: least share of sentences of a term or rule, MIN_SUPPORT the least number; CHANCE bounds the probability that a first rule's
#: sentences share their area by chance.
SAMPLE_ROWS, HELD_OUT = 20_000, 8
SUPPORT, MIN_SUPPORT = 1e-4, 8
ROUNDS = 3
CONFIDENCE = 0.8
CHANCE = 0.12
#: In a round a term must be told its area by others at least EARLY times as often as the median one; one that more frequent
#: matches overlap in at least the share EXPLAINED of its sentences is a fragment of theirs.
EARLY, EXPLAINED = 0.4, 0.9
#: An area counts if at least this share of the sentences about any area are about it.
SHARE = 1 / 3
#: Least evidence (log odds) for a sentence, and for an area of a title.
SENTENCE_EVIDENCE, TITLE_EVIDENCE = 1.2, 1.6
#: A term of an area stands beside others of it at least this often, relative to the median term.
COMPANY = 0.85

_END = re.compile(r"[。！？!?；;…\n\r]+|\.(?=\s|$)")


def spans(text: str) -> list[tuple[int, int]]:
    """Sentences as (start, end); a stretch of more than 240 characters without an end is cut at blanks, else every 40."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    cut = []
    for a, b in out:
        latin = b - a and text[a : min(b, a + 400)].isascii()
        if b - a <= (600 if latin else 160):
            cut.append((a, b))
            continue
        last = a
        for k in range(a, b):
            if k - last >= (160 if latin else 40) or (text[k] in " \t" and not latin and k - last >= 24):
                cut.append((last, k))
                last = k
        cut.append((last, b))
    return cut


def overlapping(a: str, b: str) -> bool:
    """Whether two terms may be parts of each other or share an end."""
    if a in b or b in a:
        return True
    if " " in a or " " in b:
        return bool(set(a.split()) & set(b.split()))
    return any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(1, min(len(a), len(b))))


class Matcher:
    """Finds terms in a text; Latin terms at word ends only, longest first where terms overlap."""

    def __init__(self, terms: list[str]) -> None:
        self.auto = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            self.auto.add_word(t, (k, len(t), t[0].isascii()))
        if terms:
            self.auto.make_automaton()
        self.empty = not terms

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, term) without overlaps."""
        if self.empty or not text:
            return []
        found = []
        size = len(text)
        for last, (k, length, latin) in self.auto.iter(text):
            start, end = last - length + 1, last + 1
            if latin:
                if start and text[start - 1].isalnum() and text[start - 1].isascii():
                    continue
                if end < size and text[end].isalnum() and text[end].isascii():
                    # a plural still is the word
                    if not (text[end] == "s" and (end + 1 == size or not text[end + 1].isalnum())):
                        continue
            if found and found[-1][1] > start:
                while found and found[-1][0] >= start:
                    found.pop()
                if found and found[-1][1] > start:
                    if found[-1][1] - found[-1][0] >= end - start:
                        continue
                    found.pop()
            found.append((start, end, k))
        return found


@dataclass
class Rules:
    """Terms, and for every rule (one or two terms) the area and its calibrated evidence."""

    areas: list[str]
    terms: list[str]
    single: dict[int, tuple[int, float]]
    double: dict[tuple[int, int], tuple[int, float]]

    def matcher(self) -> Matcher:
        return Matcher(self.terms)


def _place(found: list[tuple[int, int, int]], parts: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Terms by sentence."""
    by: dict[int, list[int]] = defaultdict(list)
    j = 0
    for start, end, k in found:
        while j < len(parts) and parts[j][1] <= start:
            j += 1
        if j < len(parts) and parts[j][0] <= start and end <= parts[j][1]:
            by[j].append(k)
    return by


def evidence(rules: Rules, terms: list[int]) -> np.ndarray:
    """Summed evidence of the matching rules; a rule of two terms replaces those of its terms."""
    score = np.zeros(len(rules.areas))
    seen = sorted(set(terms))
    covered: set[int] = set()
    if len(seen) > 1 and rules.double:
        for x in range(len(seen)):
            for y in range(x + 1, len(seen)):
                hit = rules.double.get((seen[x], seen[y]))
                if hit:
                    score[hit[0]] += hit[1]
                    covered.update((seen[x], seen[y]))
    for k in seen:
        if k not in covered and (hit := rules.single.get(k)):
            score[hit[0]] += hit[1]
    return score


def areas_of(rules: Rules, matcher: Matcher, text: str) -> list[int]:
    """Areas of at least a third of the sentences that are about any."""
    low = plain(text)
    found = matcher(low)
    if not found:
        return []
    count: Counter[int] = Counter()
    for terms in _place(found, spans(low)).values():
        score = evidence(rules, terms)
        best = int(score.argmax())
        if score[best] >= SENTENCE_EVIDENCE:
            count[best] += 1
    total = sum(count.values())
    return sorted(k for k, n in count.items() if n >= SHARE * total - 1e-9)


def title_areas(rules: Rules, matcher: Matcher, text: str) -> list[int]:
    """Every area a title speaks of."""
    low = plain(text)
    score = evidence(rules, [k for _, _, k in matcher(low)])
    return [int(k) for k in np.flatnonzero(score >= TITLE_EVIDENCE)]


# ---------------------------------------------------------------- fitting


def _core(chosen: dict[str, int], counts: dict[str, int]) -> dict[str, int]:
    """Without terms that always are part of a longer one, nor longer terms that a shorter one already explains."""
    closed = dict(chosen)
    for t in chosen:
        parts = t.split() if " " in t else [t[k : k + size] for size in range(1, len(t)) for k in range(len(t) - size + 1)]
        for p in parts:
            if p in closed and closed[p] == chosen[t] and counts[p] <= 1.1 * counts[t]:
                closed.pop(p)
    core = {}
    for t, area in closed.items():
        pieces = t.split() if " " in t else [t[k : k + size] for size in range(1, len(t)) for k in range(len(t) - size + 1)]
        if not any(p in closed and closed[p] == area for p in pieces):
            core[t] = area
    return core


_LONGER = 1 << 20


def judged(block: mining.Block, area_of: np.ndarray, frequency: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items, sentence of each, area of each sentence or -1, whether the area may be told to the item, whether a match explains it).

    A labelled sentence has its label. Another one has the area of the rules (``area_of`` each term, or -1) that match
    in it, if they all name the same. Where only one rule matches, it tells nothing to itself or to terms over its
    characters: every term is judged by others. A match over characters of a rarer term explains that term.
    """
    items, start, size, label = block.items, block.starts, block.sizes, block.label
    n = len(label)
    sentence = np.repeat(np.arange(n), block.lengths)
    end = start + size
    area = area_of[items] if len(items) else np.zeros(0, np.int32)
    known = np.flatnonzero(area >= 0)
    # a match inside a longer one is no match; terms are in order of their place, the longer first
    reach = end[known].astype(np.int64) + sentence[known].astype(np.int64) * _LONGER
    before = np.r_[-1, np.maximum.accumulate(reach)[:-1]] if len(reach) else reach
    firm = known[before < reach]
    matches = np.bincount(sentence[firm], minlength=n)
    told = np.zeros(n, dtype=np.int64)
    np.bitwise_or.at(told, sentence[firm], np.int64(1) << area[firm].astype(np.int64))
    one = (told > 0) & (told & (told - 1) == 0)
    of = np.where(one, np.log2(np.maximum(told, 1)).astype(np.int32), -1)
    of = np.where(label >= 0, label, of)
    low, high = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    low[sentence[firm]], high[sentence[firm]] = start[firm], end[firm]
    alone = (matches == 1) & (label < 0)
    own = alone[sentence] & (start < high[sentence]) & (end > low[sentence])
    explained = np.zeros(len(items), dtype=bool)
    if frequency is not None and len(firm):
        # the frequency of the most frequent match over each character, then over each term's characters
        width = np.zeros(n, dtype=np.int64)
        np.maximum.at(width, sentence, end)
        base = np.cumsum(width) - width
        over = np.zeros(int(width.sum()), dtype=np.int64)
        np.maximum.at(over, _spread(base[sentence[firm]] + start[firm], size[firm]), np.repeat(frequency[items[firm]], size[firm]))
        first = np.cumsum(size) - size
        explained = np.maximum.reduceat(over[_spread(base[sentence] + start, size)], first) > frequency[items]
    return items, sentence, of, (of[sentence] >= 0) & ~own, explained


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of each stretch, one stretch after another."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def _counted(area_of: np.ndarray, areas: int, frequency: np.ndarray):
    """Sentences of each (term, area told by others), under ``areas`` where none is told; under the next those where a match explains it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(area_of), areas + 2), dtype=np.int64)
        sentences = np.zeros(areas, dtype=np.int64)
        for block in mining.blocks(batches):
            items, sentence, of, may, explained = judged(block, area_of, frequency)
            np.add.at(total, (items, np.where(may, of[sentence], areas)), 1)
            np.add.at(total, (items[explained], areas + 1), 1)
            sentences += np.bincount(of[of >= 0], minlength=areas)
        r, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[r, np.full(areas, -1)].astype(np.int32)), pa.array(np.r_[c, np.arange(areas)].astype(np.int32)), pa.array(np.r_[total[r, c], sentences])], names=["item", "area", "n"]
        )

    return run


def _bases(area_of: np.ndarray, order: np.ndarray, classes: int):
    """Conditional pattern bases of one task, counted: (term, -1, area, n) and (term, more frequent term beside it, area, n).

    ``order`` is the place of each frequent term in the list by falling frequency, -1 for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = int(order.max()) + 1 if len(order) else 0
        one = np.zeros((frequent, classes), dtype=np.int64)
        keys, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            some, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            both, back = np.unique(np.r_[keys, some], return_inverse=True)
            return both, np.bincount(back, weights=np.r_[counts, n], minlength=len(both)).astype(np.int64)

        for block in mining.blocks(batches):
            items, sentence, of, may, _ = judged(block, area_of)
            place = order[items] if len(items) else items
            keep = may & (place >= 0)
            place, sentence = place[keep].astype(np.int64), sentence[keep]
            np.add.at(one, (place, of[sentence]), 1)
            step = 1
            while step < len(place) and (same := np.flatnonzero(sentence[:-step] == sentence[step:])).size:
                low, high = np.minimum(place[same], place[same + step]), np.maximum(place[same], place[same + step])
                waiting.append((high * frequent + low) * classes + of[sentence[same]])
                held += len(same)
                step += 1
            if held > 2_000_000:
                keys, counts = merged()
                waiting, held = [], 0
        keys, counts = merged()
        if len(keys) > 0 or one.any():
            term, area = np.nonzero(one)
            pair = keys // classes
            columns = (np.r_[term, pair // max(1, frequent)], np.r_[np.full(len(term), -1), pair % max(1, frequent)], np.r_[area, keys % classes])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns] + [pa.array(np.r_[one[term, area], counts])], names=["suffix", "prefix", "area", "n"])

    return run


def mine(rows: DataFrame, area_of: np.ndarray, frequency: np.ndarray, chosen: list[int], classes: int, support: int) -> dict[tuple[int, ...], np.ndarray]:
    """Class counts of frequent sets of one or two terms with an area, by parallel frequent-pattern growth.

    The terms ``chosen`` after the parallel count are ordered by falling frequency; every sentence is cut to them and to
    its area. Each task grows patterns from the conditional pattern bases of its sentences (a term, the more frequent
    terms beside it, the area); only their counts are shuffled and added. Growth ends at two terms, so no sentence makes
    more patterns than pairs. Sets of fewer than ``support`` sentences are dropped; their number is bounded by pairs a
    sentence divided by the relative support.
    """
    if not chosen:
        return {}
    ranked = np.array(sorted(chosen, key=lambda k: (-frequency[k], k)))
    order = np.full(len(frequency), -1, dtype=np.int32)
    order[ranked] = np.arange(len(ranked))
    counted = rows.mapInArrow(_bases(area_of, order, classes), "suffix int, prefix int, area int, n long").groupBy("suffix", "prefix", "area").agg(F.sum("n").alias("n"))
    sets = counted.groupBy("suffix", "prefix").agg(F.collect_list(F.struct("area", "n")).alias("by"), F.sum("n").alias("whole")).where(F.col("whole") >= support).select("suffix", "prefix", "by").collect()
    found: dict[tuple[int, ...], np.ndarray] = {}
    for r in sets:
        body = (int(ranked[r.suffix]),) if r.prefix < 0 else tuple(sorted((int(ranked[r.suffix]), int(ranked[r.prefix]))))
        row = found.setdefault(body, np.zeros(classes))
        for x in r.by:
            row[x.area] = x.n
    return found


class Learner:
    """Class-association rules from the transactions of labelled and of all other sentences."""

    def __init__(self, rows: DataFrame, words: mining.Vocabulary, classes: int) -> None:
        self.rows, self.words, self.classes = rows, words, classes

    def counts(self, area_of: np.ndarray, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first step of pattern growth: sentences of each term by area, of each area, and the share in which a match explains the term."""
        got = rows.mapInArrow(_counted(area_of, self.classes, self.words.frequency), "item int, area int, n long").groupBy("item", "area").agg(F.sum("n").alias("n")).toArrow()
        item, area, n = (got.column(k).to_numpy() for k in range(3))
        table, total = np.zeros((len(self.words.terms), self.classes + 2)), np.zeros(self.classes)
        table[item[item >= 0], area[item >= 0]] = n[item >= 0]
        total[area[item < 0]] = n[item < 0]
        return table[:, :-1], total, table[:, -1] / np.maximum(1, table[:, :-1].sum(axis=1))

    def grown(self, area_of: np.ndarray, rows: DataFrame, chosen: list[int], support: int) -> dict[tuple[int, ...], np.ndarray]:
        return mine(rows, area_of, self.words.frequency, chosen, self.classes, support)

    def _area_of(self, sets: dict[tuple[int, ...], np.ndarray]) -> np.ndarray:
        out = np.full(len(self.words.terms), -1, dtype=np.int32)
        for body, row in sets.items():
            if len(body) == 1 and row.max() >= CONFIDENCE * row.sum():
                out[body[0]] = row.argmax()
        return out

    def _pruned(self, chosen: dict[int, int], counts: np.ndarray) -> list[int]:
        terms = self.words.terms
        core = _core({terms[k]: area for k, area in chosen.items()}, {terms[k]: counts[k] for k in chosen})
        return [self.words.place[t] for t in core]

    def first(self) -> np.ndarray:
        """Rules of the labelled samples alone."""
        nothing = np.full(len(self.words.terms), -1, dtype=np.int32)
        rows = self.rows.where("taught")
        table, total, _ = self.counts(nothing, rows)
        n = table[:, :-1].sum(axis=1)
        best = table[:, :-1].argmax(axis=1)
        top = table[np.arange(len(n)), best]
        # the chance that all occurrences of a term fall into one area
        chance = (total[best] / max(1.0, total.sum())) ** np.maximum(n - 1, 0)
        good = np.flatnonzero((top >= 2) & (top >= 0.95 * n) & (chance <= CHANCE))
        sets = self.grown(nothing, rows, self._pruned({int(k): int(best[k]) for k in good}, n), 2)
        return self._area_of(sets)

    def spread(self, area_of: np.ndarray, last: bool = False) -> tuple[np.ndarray, dict[tuple[int, ...], np.ndarray], np.ndarray]:
        """Rules of all sentences, each labelled by the rules so far: the areas of terms, the mined sets, and how often each term is told an area."""
        table, total, explained = self.counts(area_of, self.rows)
        told, whole = table[:, :-1].sum(axis=1), table.sum(axis=1)
        best = table[:, :-1].argmax(axis=1)
        top = table[np.arange(len(told)), best]
        support = max(MIN_SUPPORT, int(SUPPORT * total.sum()))
        share = told / np.maximum(1, whole)
        good = (told >= support) & (top >= CONFIDENCE * told) & (explained < EXPLAINED)
        good &= share >= EARLY * (np.median(share[good]) if good.any() else 0.0)
        chosen = {int(k): int(best[k]) for k in np.flatnonzero(good)}
        # known rules that others cannot judge yet stay
        for k in np.flatnonzero((area_of >= 0) & (told < support) & (whole < 10 * support) & (explained < EXPLAINED)):
            chosen.setdefault(int(k), int(area_of[k]))
            whole[k] = max(whole[k], 1)
        core = self._pruned(chosen, whole)
        extra = self._ambiguous(table[:, :-1], support, {self.words.terms[k] for k in core}) if last else []
        sets = self.grown(area_of, self.rows, core + extra, support)
        return self._area_of(sets), sets, share

    def _ambiguous(self, table: np.ndarray, support: int, known: set[str]) -> list[int]:
        """Frequent terms that stand in a few areas only: of use in rules of two terms."""
        n = table.sum(axis=1)
        top = np.sort(table, axis=1)[:, ::-1]
        good = np.flatnonzero((n >= 5 * support) & (top[:, :3].sum(axis=1) >= 0.9 * n) & (top[:, 0] < CONFIDENCE * n))
        keep: list[int] = []
        for k in sorted(good, key=lambda k: (-len(self.words.terms[k]), k)):
            t = self.words.terms[k]
            if not any(t in x or x in t for x in known) and not any(t in self.words.terms[j] for j in keep):
                keep.append(int(k))
        return keep


def fit_rules(spark: SparkSession, samples: DataFrame, texts: DataFrame, areas: list[str]) -> Rules:
    """Rules from labelled ``samples`` (``text``, ``subjects``) and unlabelled ``texts`` (one column ``text``).

    1. ``mining.vocabulary`` counts the terms of all texts, ``mining.transactions`` writes the terms of every sentence.
    2. Parallel FP-growth over the labelled sentences mines the first rules (a term and an area).
    3. Over ROUNDS rounds every sentence of all texts is labelled by the rules that match in it, and FP-growth over these
       transactions mines the rules of the next round; a term is judged by the other terms of its sentences.
    4. Redundant rules are pruned: terms that only are parts of longer ones, longer terms that a shorter one explains,
       and sets of two terms that are no surer than one of them. Rules below CONFIDENCE, and terms that stand beside
       others of their area much more seldom than most, are dropped.
    5. A rule's evidence is its smoothed log odds over the mined counts, calibrated on samples that were held out.

    At most SAMPLE_ROWS labelled samples are used, every HELD_OUT-th for the calibration; nothing else is sampled.
    """
    code = {a: k for k, a in enumerate(areas)}
    some = samples.where(F.col("text").isNotNull() & (F.size("subjects") >= 1)).select("text", "subjects")
    rows = some.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS).collect()
    held = [(r.text, {code[x] for x in r.subjects if x in code}) for r in rows[::HELD_OUT]]
    taught = [(r.text, code[r.subjects[0]]) for k, r in enumerate(rows) if k % HELD_OUT and len(r.subjects) == 1 and r.subjects[0] in code]
    every = texts.select("text", F.lit(-1).alias("label")).unionByName(spark.createDataFrame(taught, "text string, label int"))
    words = mining.vocabulary(every, SUPPORT, MIN_SUPPORT)
    if not words.terms:
        return Rules(areas, [], {}, {})
    learner = Learner(written(mining.transactions(every, words), "transactions"), words, len(areas))
    area_of = learner.first()
    sets: dict[tuple[int, ...], np.ndarray] = {}
    share = np.zeros(len(words.terms))
    for k in range(ROUNDS):
        area_of, sets, share = learner.spread(area_of, k == ROUNDS - 1)
    one = [k for k in range(len(words.terms)) if area_of[k] >= 0]
    often = [share[k] for k in one if sets[k,].sum() >= MIN_SUPPORT]
    least = COMPANY * float(np.median(often)) if often else 0.0
    single = {k: (int(area_of[k]), weight) for k in one if share[k] >= least and (weight := _log_odds(sets[k,])) > 0.0}
    double = {}
    for body, row in sets.items():
        if len(body) == 2 and row.max() >= CONFIDENCE * row.sum() and not overlapping(words.terms[body[0]], words.terms[body[1]]):
            parts = [sets[t,] for t in body if (t,) in sets]
            if row.max() / row.sum() >= max((p.max() / p.sum() for p in parts), default=0.0) + 0.03 and (weight := _log_odds(row)) >= 1.0:
                double[body] = (int(row.argmax()), weight)
    used = sorted(set(single) | {k for body in double for k in body})
    place = {k: j for j, k in enumerate(used)}
    rules = Rules(areas, [words.terms[k] for k in used], {place[k]: v for k, v in single.items()}, {(place[a], place[b]): v for (a, b), v in double.items()})
    return calibrated(rules, held)


def _log_odds(row: np.ndarray) -> float:
    best = row.max()
    return float(min(5.0, np.log((best + 0.5) / (row.sum() - best + 0.5))))


def calibrated(rules: Rules, held: list[tuple[str, set[int]]]) -> Rules:
    """Evidence no surer than rules of like evidence are on the held-out samples.

    The rules are put into bins of their evidence; the log odds of right to wrong matches in a bin's held-out samples, plus
    one of each, cap the evidence of its rules. Bins with fewer than 20 matches stay as they are.
    """
    matcher = rules.matcher()
    right, wrong = np.zeros(6), np.zeros(6)
    for text, subjects in held:
        for k in {k for _, _, k in matcher(plain(text))}:
            if hit := rules.single.get(k):
                (right if hit[0] in subjects else wrong)[int(hit[1])] += 1
    cap = np.where(right + wrong >= 20, np.log((right + 1) / (wrong + 1)), 5.0)
    fitted = {k: (area, float(min(weight, cap[int(weight)]))) for k, (area, weight) in rules.single.items()}
    return Rules(rules.areas, rules.terms, {k: v for k, v in fitted.items() if v[1] > 0}, rules.double)


# ---------------------------------------------------------------- operator


def _score(rules: Rules, carried: int, title: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = rules.matcher()
        judge = title_areas if title else areas_of
        for batch in batches:
            row, area = [], []
            for k, text in enumerate(batch.column(carried).to_pylist()):
                for a in judge(rules, matcher, text):
                    row.append(k)
                    area.append(rules.areas[a])
            keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(carried)]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(area, pa.string())], names=[f"c{c}" for c in range(carried)] + ["subject"])

    return run


def subject_areas(df: DataFrame, keys: list[str], text: str, rules: Rules, title: bool = False) -> DataFrame:
    """``keys`` and ``subject``, one row per area of each text (problem 3); texts about no area have no row.

    Each sentence goes to the area of the most rule evidence; an area counts if it has at least a third of the
    sentences about any. A title counts for each area with enough evidence. Null and empty texts give no row,
    repeated rows repeated rows; whole texts are read.
    """
    column = F.col(f"`{text}`")
    rows = df.where(column.isNotNull()).select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keys)], column.alias("_text"))
    schema = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keys)))
    found = rows.mapInArrow(_score(rules, len(keys), title), f"{schema}, subject string")
    return found.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], "subject")
