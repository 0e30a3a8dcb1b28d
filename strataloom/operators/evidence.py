"""Coverage of chunks by map results, and of claims by sources.

Every rule is a small DataFrame of issues ``(kind, item)``; the report counts them. Shapes:

- inputs: ``source_id``, ``chunk_ids`` array, ``sha256``
- chunks: ``chunk_id``, ``chunk_hash``, ``source_ids`` array, ``status``
- maps: ``file``, ``chunk_id``, ``chunk_hash``, ``source_ids``, ``summary``, ``claims`` array of (claim,
  evidence_source_ids, confidence), ``themes``, ``uncertainties``, ``source_coverage`` array of (source_id,
  summary, disposition), ``corrupt``
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as tx

CONFIDENCE = ("high", "medium", "low")
DISPOSITION = ("substantive", "duplicate", "unclear")
KINDS = (
    "missing_sources", "failed_chunks", "duplicate_assignments", "invalid_evidence_refs", "malformed_maps", "duplicate_maps",
    "stale_maps", "cross_chunk_evidence", "missing_mapped_sources", "missing_map_results", "stale_hashes",
)


def _issue(df: DataFrame, kind: str, item: Column | str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"))


def blank(value: Column) -> Column:
    return F.coalesce(tx.trim(value), F.lit("")) == ""


def missing_sources(inputs: DataFrame, chunks: DataFrame) -> DataFrame:
    """C4: inputs in no chunk, and references to chunks that do not exist."""
    empty = inputs.where(F.coalesce(F.size("chunk_ids"), F.lit(0)) <= 0)
    refs = inputs.select("source_id", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return _issue(empty, "missing_sources", "source_id").unionByName(_issue(refs, "missing_sources", F.concat_ws(" ", "source_id", "chunk_id")))


def failed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks marked as failed, without a hash, or without a source list."""
    marked = chunks.where(F.col("status") == "failed")
    bare = chunks.where(blank(F.col("chunk_hash")) | F.col("source_ids").isNull())
    return _issue(marked, "failed_chunks", "chunk_id").unionByName(_issue(bare, "failed_chunks", "chunk_id"))


def _whole(chunks: DataFrame) -> DataFrame:
    return chunks.where(~blank(F.col("chunk_hash")) & F.col("source_ids").isNotNull())


def duplicate_assignments(chunks: DataFrame) -> DataFrame:
    """An issue for each repetition of a source within a chunk."""
    repeats = _whole(chunks).withColumn("n", F.size("source_ids") - F.size(F.array_distinct("source_ids"))).where("n > 0")
    return _issue(repeats.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n")))), "duplicate_assignments", "chunk_id")


def unknown_sources(chunks: DataFrame, inputs: DataFrame) -> DataFrame:
    """Sources of chunks that no input has."""
    refs = _whole(chunks).select("chunk_id", F.explode("source_ids").alias("source_id"))
    return _issue(refs.join(inputs.select("source_id").distinct(), "source_id", "left_anti"), "invalid_evidence_refs", F.concat_ws(" ", "chunk_id", "source_id"))


def gated_maps(maps: DataFrame, chunks: DataFrame) -> DataFrame:
    """Maps with their chunk's sources, ``gate`` (the kind of the first gate they fail, or null) and ``registered``."""
    one = chunks.groupBy("chunk_id").agg(F.first("chunk_hash", True).alias("current_hash"), F.first("source_ids", True).alias("chunk_sources")).withColumn("known", F.lit(True))
    joined = maps.join(one, "chunk_id", "left")
    named = F.col("file") == F.concat(F.lit("map-"), "chunk_id", F.lit(".json"))
    usable = ~F.coalesce("corrupt", F.lit(False)) & F.coalesce("known", F.lit(False)) & named
    # of the well-named maps of a chunk the first registers; null ids never compete
    place = F.row_number().over(Window.partitionBy("chunk_id", usable).orderBy("file", F.coalesce("chunk_hash", F.lit(""))))
    staged = joined.withColumn("usable", usable).withColumn("place", F.when(F.col("usable"), place))
    gate = (
        F.when(F.coalesce("corrupt", F.lit(False)), "malformed_maps")
        .when(~F.coalesce("known", F.lit(False)), "invalid_evidence_refs")
        .when(~named, "malformed_maps")
        .when(F.col("place") > 1, "duplicate_maps")
        .when(blank(F.col("chunk_hash")) | ~F.col("chunk_hash").eqNullSafe(F.col("current_hash")), "stale_maps")
        .when(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, "malformed_maps")
        .when(blank(F.col("summary")), "malformed_maps")
        .when(F.col("claims").isNull(), "malformed_maps")
    )
    return staged.select("*", gate.alias("gate"), (F.col("usable") & (F.col("place") == 1)).alias("registered")).drop("usable", "place")


def missing_maps(gated: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without a registered map; a stale one counts as registered."""
    have = gated.where("registered").select("chunk_id").distinct()
    return _issue(chunks.select("chunk_id").distinct().join(have, "chunk_id", "left_anti"), "missing_map_results", "chunk_id")


def map_content(gated: DataFrame) -> DataFrame:
    """The rules on what is in a map that passed all gates."""
    ok = gated.where(F.col("gate").isNull()).withColumn("have", F.coalesce("chunk_sources", F.array().cast("array<string>")))

    def outside(ids: Column) -> Column:
        return F.filter(ids, lambda s: ~F.array_contains(F.col("have"), s))

    def text_of(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    bad_claim = F.filter(
        "claims",
        lambda c: blank(c["claim"]) | (F.coalesce(F.size(c["evidence_source_ids"]), F.lit(0)) <= 0) | ~F.coalesce(c["confidence"].isin(*CONFIDENCE), F.lit(False)),
    )
    good_claim = F.filter(
        "claims", lambda c: ~blank(c["claim"]) & (F.coalesce(F.size(c["evidence_source_ids"]), F.lit(0)) > 0) & F.coalesce(c["confidence"].isin(*CONFIDENCE), F.lit(False))
    )
    cited = F.flatten(F.transform(good_claim, lambda c: c["evidence_source_ids"]))
    rows = F.coalesce("source_coverage", F.array().cast(dict(gated.dtypes)["source_coverage"]))
    named = F.filter(rows, lambda s: ~blank(s["source_id"]))
    ids = F.transform(named, lambda s: s["source_id"])
    # the first entry of each id is judged, later ones are repetitions
    firsts = F.transform(F.array_distinct(ids), lambda i: F.element_at(named, F.array_position(ids, i).cast("int")))
    inside = F.filter(firsts, lambda s: F.array_contains(F.col("have"), s["source_id"]))

    def items(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), F.concat_ws(" ", F.col("chunk_id"), x).alias("item")))

    def one_if(condition: Column, name: str) -> Column:
        return F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    def source(s: Column) -> Column:
        return s["source_id"]

    repeats = F.size(ids) - F.size(F.array_distinct(ids))
    strange = F.filter(inside, lambda s: ~blank(s["summary"]) & s["disposition"].isNotNull() & ~s["disposition"].isin(*DISPOSITION))
    foreign = F.filter(firsts, lambda s: ~F.array_contains(F.col("have"), s["source_id"]))
    uncovered = F.when(F.size(rows) > 0, F.filter("have", lambda s: ~F.array_contains(ids, s))).otherwise(F.array().cast("array<string>"))
    # every rule yields a list for its row, so the maps are read once
    found = F.concat(
        items("cross_chunk_evidence", outside(F.col("source_ids"))),
        items("missing_mapped_sources", F.filter("have", lambda s: ~F.array_contains(F.col("source_ids"), s))),
        items("malformed_maps", F.transform(bad_claim, lambda c: text_of(c["claim"]))),
        items("cross_chunk_evidence", outside(cited)),
        items("malformed_maps", one_if(F.col("themes").isNull(), "themes")),
        items("malformed_maps", one_if(F.col("uncertainties").isNull(), "uncertainties")),
        items("malformed_maps", one_if(F.size(rows) <= 0, "source_coverage")),
        items("malformed_maps", F.transform(F.filter(rows, lambda s: blank(s["source_id"])), lambda s: F.lit("entry"))),
        items("malformed_maps", F.array_repeat(F.lit("repeated"), repeats)),
        items("cross_chunk_evidence", F.transform(foreign, source)),
        items("malformed_maps", F.transform(F.filter(inside, lambda s: blank(s["summary"])), source)),
        items("malformed_maps", F.transform(strange, source)),
        items("missing_mapped_sources", uncovered),
    )
    return ok.select(F.explode(found).alias("x")).select("x.kind", "x.item")


def stale_hashes(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """C17: inputs whose content is gone or has another hash now (``current``: ``source_id``, ``sha256``)."""
    now = current.groupBy("source_id").agg(F.collect_set("sha256").alias("now"))
    joined = inputs.join(now, "source_id", "left")
    return _issue(joined.where(~F.coalesce(F.array_contains("now", F.col("sha256")), F.lit(False))), "stale_hashes", "source_id")


def issues(inputs: DataFrame, chunks: DataFrame, maps: DataFrame, current: DataFrame) -> DataFrame:
    """All issues as (kind, item) rows."""
    gated = gated_maps(maps, chunks)
    gates = gated.where(F.col("gate").isNotNull()).select(F.col("gate").alias("kind"), F.col("file").alias("item"))
    parts = [
        missing_sources(inputs, chunks), failed_chunks(chunks), duplicate_assignments(chunks), unknown_sources(chunks, inputs), gates,
        map_content(gated), missing_maps(gated, chunks), stale_hashes(inputs, current),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage_report(found: DataFrame) -> DataFrame:
    """One row with the eleven counters and ``valid`` (all are zero)."""
    counts = [F.count_if(F.col("kind") == k).cast("long").alias(k) for k in KINDS]
    return found.agg(*counts).withColumn("valid", reduce(lambda a, b: a & b, [F.col(k) == 0 for k in KINDS]))


def set_hash(df: DataFrame, name: str, body: str) -> DataFrame:
    """One hash of a set of named texts, independent of their order: the hash of the sums of the members' hashes.

    Sums need no sorted list of all members, so nothing is gathered.
    """
    member = df.select(F.sha2(F.concat(F.col(name), F.lit(":"), F.sha2(F.col(body), 256)), 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"p{k}") for k in range(4)]
    sums = member.agg(*parts, F.count(F.lit(1)).alias("members"))
    return sums.select(F.sha2(F.concat_ws(":", "p0", "p1", "p2", "p3", F.col("members").cast("string")), 256).alias("set_hash"), "members")


def final_report(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: claims, claims without text or evidence, evidence known and unknown, bad confidences, ``valid``.

    ``claims``: ``claim_no``, ``text``, ``evidence_source_ids``, ``confidence`` (null is allowed). No claims at all is invalid.
    """
    has_text = ~blank(F.col("text"))
    cites = F.coalesce(F.size("evidence_source_ids"), F.lit(0)) > 0
    refs = claims.where(has_text & cites).select("claim_no", F.explode("evidence_source_ids").alias("source_id"))
    known = inputs.select("source_id").distinct().withColumn("known", F.lit(True))
    judged = refs.join(known, "source_id", "left").select(
        F.lit(0).alias("claims"), F.lit(0).alias("claims_without_evidence"), F.lit(0).alias("bad_confidence"), F.col("known").isNotNull().cast("int").alias("valid_refs"), F.col("known").isNull().cast("int").alias("invalid_refs")
    )
    unsure = has_text & F.col("confidence").isNotNull() & ~F.col("confidence").isin(*CONFIDENCE)
    shape = claims.select(
        F.lit(1).alias("claims"), (~has_text | ~cites).cast("int").alias("claims_without_evidence"), unsure.cast("int").alias("bad_confidence"), F.lit(0).alias("valid_refs"), F.lit(0).alias("invalid_refs")
    )
    both = shape.unionByName(judged)
    sums = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in both.columns])
    return sums.withColumn("valid", (F.col("claims") > 0) & (F.col("claims_without_evidence") == 0) & (F.col("bad_confidence") == 0) & (F.col("invalid_refs") == 0))


def run_map(chunks: DataFrame, function: Callable, schema: str) -> DataFrame:
    """The map stage: ``function`` reads pandas frames of chunks and yields frames of map results."""
    return chunks.mapInPandas(function, schema)
