"""A mix of sources at target shares by soft membership and projected-gradient rates (problem 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm import lexical
from strataloom.llm.tables import written

#: Buckets of the classifier, smoothing of its counts, and the temperatures tried for its posteriors.
CLASS_BITS = 14
SMOOTHING = 2.0
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0)
#: One labelled document in HELD_OUT (by a hash of its key) chooses the temperature and tells the accuracy.
HELD_OUT = 8
#: Most rounds of the projected gradient, the error it stops at, and the one that is no fit.
ROUNDS, TOLERANCE, FAILED = 60, 1e-4, 0.01
#: Where STALL rounds do not halve the error, the size of the mix shrinks by the factor SHRINK.
STALL, SHRINK = 4, 0.8
#: Bins of the step that turns rates into whole copies.
STEPS = 4000

#: Marks of a line's beginning that tell how a text was laid out.
_LAYOUT = re.compile(r"^(#+ |\[SOURCE|[-*•+] |\d{1,3}[.)、] |-{3,}|={3,}|>|\||﻿|[^\s：:]{1,16}[：:])", re.M)


def _layout(text: str) -> list[int]:
    marks = set()
    for m in _LAYOUT.findall(text):
        marks.add("key" if m[-1] in "：:" else m[:2])
    marks.add(f"size{len(text).bit_length()}")
    marks.add("blank" if "\n\n" in text else "one")
    marks.add("cr" if "\r" in text else "lf")
    return [int.from_bytes(x.encode("utf-8")[:8].ljust(8, b"\0"), "little") % ((1 << CLASS_BITS) - 1) for x in sorted(marks)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, source, text) -> (key, source, tokens, feature buckets); a bucket counts once a text."""
    from strataloom.llm import chars

    for batch in batches:
        texts = batch.column(2).to_pylist()
        for low, high in chars.slices(np.array([len(t) for t in texts]), 1_000_000):
            part = texts[low:high]
            row, bucket, _ = lexical.terms(part)
            edge = np.searchsorted(row, np.arange(len(part) + 1))
            bucket = bucket >> (lexical.BUCKET_BITS - CLASS_BITS)
            found = [np.unique(np.r_[bucket[a:b], np.array(_layout(t), dtype=np.int32)]).astype(np.int32).tobytes() for a, b, t in zip(edge[:-1], edge[1:], part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array([len(lexical.encode(t)) for t in part], pa.int32()), pa.array(found, pa.binary())],
                names=["key", "source", "tokens", "features"],
            )


def _class_counts(sources: list[str]):
    code = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sources), (1 << CLASS_BITS) + 1), dtype=np.int64)
        for batch in batches:
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (k := code.get(source)) is not None:
                    total[k, np.frombuffer(raw, dtype=np.int32)] += 1
                    total[k, -1] += 1
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["s", "b", "n"])

    return run


class Classifier:
    """Bernoulli naive Bayes over hashed features; log-odds of present features, posteriors at a temperature."""

    def __init__(self, counts: np.ndarray) -> None:
        rows = counts[:, -1]
        # smoothed towards the rate over all sources, so that a small source is not charged for buckets it never had
        overall = (counts[:, :-1].sum(axis=0) + 1e-3) / (rows.sum() + 1.0)
        rate = np.clip((counts[:, :-1] + SMOOTHING * overall) / (rows[:, None] + SMOOTHING), 1e-7, 1 - 1e-4)
        self.present = (np.log(rate) - np.log1p(-rate)).astype(np.float32)
        self.base = np.log((rows + SMOOTHING) / (rows.sum() + SMOOTHING * len(rows))) + np.log1p(-rate).sum(axis=1)
        self.known = rows > 0

    def logits(self, features: np.ndarray) -> np.ndarray:
        out = self.present[:, features].sum(axis=1) + self.base
        out[~self.known] = -np.inf
        return out


def posterior(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    z = z - z.max(axis=-1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=-1, keepdims=True)


def _losses(sources: list[str], model: Classifier):
    code = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, hits, rows = np.zeros(len(TEMPERATURES)), 0, 0
        for batch in batches:
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (k := code.get(source)) is None:
                    continue
                z = model.logits(np.frombuffer(raw, dtype=np.int32))
                hits += int(z.argmax() == k)
                rows += 1
                for j, t in enumerate(TEMPERATURES):
                    loss[j] -= np.log(max(posterior(z, t)[k], 1e-12))
        yield pa.RecordBatch.from_arrays([pa.array([loss.tolist()], pa.list_(pa.float64())), pa.array([hits], pa.int64()), pa.array([rows], pa.int64())], names=["loss", "hits", "n"])

    return run


def _membership(sources: list[str], repeats: np.ndarray, model: Classifier, temperature: float, trust: float):
    code = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p_out, domain, cap = [], [], []
            for source, raw in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                p = np.zeros(len(sources))
                named = code.get(source) if source is not None else None
                if (source is None or (named is not None and trust < 1)) and model.known.any():
                    p = posterior(model.logits(np.frombuffer(raw, dtype=np.int32)), temperature)
                if named is not None:
                    p = (1 - trust) * p
                    p[named] += trust
                k = int(p.argmax())
                p_out.append(p.tolist())
                domain.append(k if p[k] > 0 else -1)
                cap.append(int(repeats[k]) if p[k] > 0 else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(p_out, pa.list_(pa.float64())), pa.array(domain, pa.int32()), pa.array(cap, pa.int32())],
                names=["key", "source", "tokens", "p", "domain", "cap"],
            )

    return run


def rates(p: np.ndarray, cap: np.ndarray, start: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """The rate of each document after the projected moves so far; a move has a step for each domain."""
    x = np.minimum(cap, p @ start)
    for move in moves:
        x = np.clip(x - p @ move, 0.0, cap)
    return x


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, width)


def _achieved(width: int, start: np.ndarray, moves: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slack = np.zeros(width), np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            p, cap, t = _matrix(batch, "p", width), batch.column("cap").to_numpy().astype(float), batch.column("tokens").to_numpy().astype(float)
            x = rates(p, cap, start, moves)
            total += (x * t) @ p
            slack += (((x > 0) & (x < cap)) * t) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total), pa.array(slack)], names=["k", "n", "slack"])

    return run


def _rated(width: int, start: np.ndarray, moves: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rates(_matrix(batch, "p", width), batch.column("cap").to_numpy().astype(float), start, moves)
            else:
                x = np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "source", "tokens", "domain", "cap")] + [pa.array(x)], names=["key", "source", "tokens", "domain", "cap", "rate"])

    return run


class Mix:
    """The fitted mix: ``copies`` (a row a document) and ``targets`` (sources with their target, cap and reach)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, trust: float = 1.0) -> None:
        spark: SparkSession = docs.sparkSession
        aims = targets.where(F.col("source").isNotNull()).orderBy("source").collect()  # a fixed small table
        self.sources = [r.source for r in aims]
        share = np.array([r.target_share for r in aims], dtype=float)
        repeats = np.array([r.max_repeats for r in aims], dtype=float)
        width = len(self.sources)
        rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
        kind = rows.schema["key"].dataType.simpleString()
        if not width:  # no source is wanted
            self.aim = share
            self.copies = rows.where(F.lit(False)).select(
                "key", "source", F.col("source").alias("domain"), F.lit(0).alias("tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies")
            )
            return
        self.base = written(rows.mapInArrow(_features, f"key {kind}, source string, tokens int, features binary"), "features")
        labelled = self.base.where(F.col("source").isin(self.sources)).withColumn("fold", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(HELD_OUT)))
        taught, held = (labelled.where(c).select("source", "features") for c in ("fold > 0", "fold = 0"))
        counts = np.zeros((width, (1 << CLASS_BITS) + 1))
        got = taught.mapInArrow(_class_counts(self.sources), "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("s").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
        model = Classifier(counts)
        losses = held.mapInArrow(_losses(self.sources, model), "loss array<double>, hits long, n long")
        total = losses.select(F.posexplode("loss").alias("j", "x"), "hits", "n").groupBy("j").agg(F.sum("x").alias("x"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).orderBy("j").collect()
        self.temperature = TEMPERATURES[int(np.argmin([r.x for r in total]))] if total and total[0].n else 1.0
        self.accuracy = total[0].hits / max(1, total[0].n) if total else 0.0
        member = self.base.mapInArrow(_membership(self.sources, repeats, model, self.temperature, trust), f"key {kind}, source string, tokens int, p array<double>, domain int, cap int")
        member = written(member, "membership")

        named = member.where(F.col("source").isNotNull() & (F.col("domain") >= 0)).groupBy("domain").agg(F.sum(F.col("tokens").cast("long") * F.col("cap")).alias("n")).collect()
        sure = np.zeros(width)  # tokens of the labelled documents at their caps: the mix is sized by them alone
        for r in named:
            sure[r.domain] = r.n

        def achieved(start: np.ndarray, moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            out, slack = np.zeros(width), np.zeros(width)
            sums = member.select("p", "cap", "tokens").mapInArrow(_achieved(width, start, moves), "k int, n double, slack double")
            for r in sums.groupBy("k").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")).collect():
                out[r.k], slack[r.k] = r.n, r.slack
            return out, slack

        most = achieved(repeats, [])[0] if width else np.zeros(0)  # all documents at their caps
        able = (sure > 0) & (share > 0)
        size = float(np.min(sure[able] / share[able])) if able.any() else 0.0
        aim = np.where(able, share * size, 0.0)
        start = np.where(able, 1.0, 0.0)  # every document once
        moves: list[np.ndarray] = []
        reached = np.zeros(width)
        before = np.inf
        for k in range(ROUNDS if able.any() else 0):
            reached, slack = achieved(start, moves)
            error = np.divide(reached - aim, aim, out=np.zeros(width), where=able)
            if np.abs(error).max() <= TOLERANCE:
                break
            if k == ROUNDS - 1 and np.abs(error).max() > FAILED:
                raise RuntimeError(f"no rates reach the targets after {ROUNDS} rounds: {dict(zip(self.sources, error.round(4).tolist()))}")
            if k % STALL == STALL - 1:
                if np.abs(error).max() > 0.5 * before:
                    # memberships that overlap reach the shares at a smaller size only
                    size *= SHRINK
                    aim = aim * SHRINK
                    error = np.divide(reached - aim, aim, out=np.zeros(width), where=able)
                before = np.abs(error).max()
            # gradient of the squared relative errors, scaled by the tokens that can still move
            room = np.where(slack > 0, slack, most / np.maximum(repeats, 1))
            moves.append(np.divide(error * aim, room, out=np.zeros(width), where=able & (room > 0)))
        self.rounds, self.expected, self.aim, self.share, self.repeats, self.able = len(moves), reached, aim, share, repeats, able
        self.size = size
        rated = member.mapInArrow(_rated(width, start, moves), f"key {kind}, source string, tokens int, domain int, cap int, rate double").where("domain >= 0 and cap > 0")
        draw = (F.pmod(F.xxhash64("key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        rated = rated.withColumn("draw", draw)
        self.scale = scale = self._scales(rated, aim) if trust >= 1 else np.ones(width)
        factor = F.element_at(F.array(*[F.lit(float(x)) for x in scale] or [F.lit(1.0)]), F.col("domain") + 1)
        copies = F.least(F.col("cap").cast("long"), F.floor(F.col("rate") * factor + F.col("draw")).cast("long"))
        names = F.array(*[F.lit(s) for s in self.sources] or [F.lit("")])
        self.copies = rated.select("key", "source", F.element_at(names, F.col("domain") + 1).alias("domain"), "tokens", "rate", copies.cast("int").alias("copies"))

    def _scales(self, rated: DataFrame, aim: np.ndarray) -> np.ndarray:
        """For each domain the factor on its rates at which whole copies come closest to the target.

        A document's c-th copy appears at the factor (c - draw) / rate; tokens by binned factor are all that
        reaches the driver (at most STEPS values a domain).
        """
        width = len(aim)
        at = rated.where("rate > 0").select("domain", "tokens", F.explode(F.sequence(F.lit(1), F.col("cap"))).alias("c"), "rate", "draw")
        factor = (F.col("c") - F.col("draw")) / F.col("rate")
        binned = at.select("domain", "tokens", F.least(F.lit(STEPS), F.ceil(factor * (STEPS / 2))).cast("int").alias("bin"))
        out = np.ones(width)
        table = np.zeros((width, STEPS + 1))
        for r in binned.groupBy("domain", "bin").agg(F.sum("tokens").alias("n")).collect():
            table[r.domain, max(0, r.bin)] += r.n
        for k in range(width):
            if aim[k] > 0:
                total = np.cumsum(table[k, :STEPS])
                out[k] = (int(np.argmin(np.abs(total - aim[k])))) * 2.0 / STEPS
        return out


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", trust: float = 1.0) -> DataFrame:
    """The documents of the mix: ``key``, ``source``, ``domain``, ``tokens``, ``rate`` and ``copies`` (at least 1).

    Method: soft-membership mixing. A classifier (naive Bayes over hashed terms and layout marks) is trained on the
    documents that name a source of ``targets``, but for one in HELD_OUT, which choose the temperature of its
    posteriors. A document without a source belongs to the sources by its posterior; one that names a source belongs to it
    with the weight ``trust`` and by its posterior with the rest. The shares asked for are shares of the named sources, so
    ``trust`` is 1 unless the names are doubtful. A projected gradient then fits a rate between 0 and the allowed
    repeats for each document, beginning with every document once, so that the expected tokens of each source meet its
    target; every round is one pass over the documents, only sums by source reach the driver. It ends at TOLERANCE and
    raises if FAILED is not reached in ROUNDS. The size of the mix is the largest that lets every source that has
    documents meet its share. Rates become whole copies by a fixed draw from the key; where names are trusted a factor for
    each source makes up for what rounding moved.

    Sources that ``targets`` does not name are left out; a named source without documents reaches 0 (see
    ``shares``). Null texts are left out, empty ones have no tokens; equal texts count each.
    """
    return Mix(docs, targets, key, text, source, trust).copies.where("copies >= 1").withColumnRenamed("key", key)


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For each source its target share, the documents, tokens and share really reached, the tokens aimed at, and those of its largest document."""
    fitted = Mix(docs, targets, key, text, source)
    spark = docs.sparkSession
    reached = fitted.copies.where("copies >= 1").groupBy(F.col("domain").alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    aims = spark.createDataFrame(
        [(s, float(a), int(r), float(t)) for s, a, r, t in zip(fitted.sources, fitted.share, fitted.repeats, fitted.aim)],
        "source string, target_share double, max_repeats int, aimed_tokens double",
    )
    sizes = fitted.copies.groupBy(F.col("domain").alias("source")).agg(F.max("tokens").alias("largest"))
    joined = aims.join(reached, "source", "left").join(sizes, "source", "left").na.fill(0)
    whole = F.sum("tokens").over(Window.partitionBy())  # one row a source
    return joined.select(
        "source", "target_share", (F.col("tokens") / F.greatest(whole, F.lit(1))).alias("reached_share"), "aimed_tokens", "tokens", "documents", "most_copies", "max_repeats", "largest"
    )
