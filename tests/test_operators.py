import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import acceptance, archive, chunking, documents, evidence, ingest, merge, packing, sampling, stats


def greedy(lengths, most, items):
    out, number, chars, count = [], 0, 0, 0
    for n in lengths:
        if not number or chars + n > most or count >= items:
            number, chars, count = number + 1, 0, 0
        chars, count = chars + n, count + 1
        out.append(number)
    return out


@pytest.mark.parametrize("most,items", [(100, 7), (100, packing.UNLIMITED), (1, 3), (10_000, 40)])
def test_greedy_pack_in_blocks_is_that_of_one_pass(spark, monkeypatch, most, items):
    monkeypatch.setattr(packing, "SMALL_BLOCK", 100)
    rng = random.Random(most + items % 97)
    rows = [(k, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([0, 1, 5, 30, 90, 250])) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, g string, n int").withColumn("chunk_no_", F.lit(1)).repartition(9)
    got = {r.k: r.chunk_no for r in packing.greedy_pack(df, "g", ["k"], "n", most, items).collect()}
    for g in ("hot", "a", "b", None):
        mine = [r for r in rows if r[1] == g]
        assert [got[r[0]] for r in mine] == greedy([r[2] for r in mine], most, items)


def test_numbers_and_counts(spark):
    df = spark.createDataFrame([(k, "x" if k % 3 else "y") for k in range(500)], "k int, g string").repartition(7)
    got = packing.numbered(df, "g", [-F.col("k")]).collect()
    for g in "xy":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and [r.k for r in mine] == sorted((r.k for r in mine), reverse=True)
    assert packing.pack_by_count(df.limit(0), "g", ["k"], 3).count() == 0
    with pytest.raises(ValueError):
        packing.pack_by_count(df, "g", ["k"], 0)


def test_split_is_lossless_and_keeps_to_the_limit():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab。！ .\n😀") for _ in range(rng.randint(0, 400)))
        parts = chunking.split_text(text, 50)
        assert "".join(parts) == text and all(len(p) <= 50 for p in parts) and parts


def test_excerpt_matches_the_split(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab。！ .\n") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(chunking.excerpt(F.col("t"), 50).alias("x")).collect()]
    assert got == [t if len(t) <= 50 else t[: chunking.cut(t, 50)] for t in texts]


def answers(spark, rows):
    return spark.createDataFrame(rows, "id string, questionid string, author string, content string, voteupcount long, captureseq long")


def test_chunks_hold_every_source_once(spark):
    rows = [(str(k), "q1" if k % 4 else "q2", "n", f"<p>{'句子。' * (k * 7)}</p>", k, k) for k in range(60)] + [("90", "q1", None, None, None, 90), ("91", None, None, "x", 1, 91)]
    df = answers(spark, rows)
    segments = chunking.segments(df, 100)
    made = chunking.chunks(segments, chunking.chunk_segments(segments, 300, 4)).collect()
    assert {s for r in made for s in r.source_ids} == {f"question-{r[1]}-answer-{r[0]}" for r in rows if r[1]}
    assert all(r.chars <= 300 and r.text.count("[SOURCE ") <= 4 and len(set(r.source_ids)) == len(r.source_ids) for r in made)
    assert all(r.chunk_id == f"chunk-{r.questionid}-{r.chunk_no:04d}" for r in made)
    back = chunking.source_chunks(spark.createDataFrame(made)).collect()
    assert len(back) == 61
    inputs = chunking.manifest_inputs(df)
    assert chunking.reusable(inputs, inputs).first().reusable
    assert not chunking.reusable(inputs, chunking.manifest_inputs(df.where("id <> '5'"))).first().reusable


def test_ingestion(spark):
    df = spark.createDataFrame([("1", "q", 5, 3), ("1", "q", 9, 7), ("2", "q", None, 4), (None, "q", 1, 5), ("3", None, 2, 6)], "id string, questionid string, votes long, seq long")
    assert {(r.id, r.votes) for r in ingest.keep_first(df, "id", "seq").collect()} == {("1", 5), ("2", None), ("3", 2)}
    merged = ingest.merge_insert_only(df.where("seq = 7").select("id", "questionid", "votes", "seq"), df, "id", "seq")
    assert {(r.id, r.votes) for r in merged.collect()} == {("1", 9), ("2", None), ("3", 2)}
    assert ingest.duplicate_ids(df, "questionid", "id").where("questionid = 'q'").first().duplicates == 1
    first = ingest.first_distinct(df, "id", "seq", 2).collect()
    assert [(r.id, r.votes) for r in first] == [("1", 9), ("2", None)]


def test_repeated_pages(spark):
    ids = [f"{k}" for k in range(40)] + [f"{k}" for k in range(20, 40)]
    df = spark.createDataFrame([("q", i, n) for n, i in enumerate(ids)], "q string, id string, seq int")
    assert [(r.page, r.repeated) for r in ingest.repeated_pages(df, "q", "id", "seq").orderBy("page").collect()] == [(0, False), (1, False), (2, True)]


def test_root_comments(spark):
    rows = [("a", "1", "0", "1", "x", "n", 1), ("a", "2", "0", "0", "y", None, 2), ("b", "3", "9", "9", "x", "n", 1), ("c", "4", "0", "4", None, "n", 1), (None, "5", "0", "5", "x", "n", 1)]
    df = spark.createDataFrame(rows, "answerid string, id string, replycommentid string, replyrootcommentid string, contenthtml string, authorname string, createdtime long")
    got = {r.answerid: r.comments and len(r.comments) for r in ingest.root_comments(df).collect()}
    assert got == {"a": 2, "b": None, "c": None}


def test_merge_comments(spark):
    had = spark.createDataFrame([("1", ["x"]), ("2", ["a", "b", "c", "d"]), ("3", ["y"]), ("4", ["z"])], "id string, comments array<string>")
    asked = spark.createDataFrame([("1",), ("2",), ("4",)], "id string")
    got = ingest.merge_comments(had, asked, spark.createDataFrame([("1", True, []), ("2", False, None), ("4", False, None)], "id string, ok boolean, new_comments array<string>"))
    assert {r.id: r.comments for r in got.collect()} == {"1": [], "2": None, "3": ["y"], "4": ["z"]}


def test_samples(spark):
    df = spark.createDataFrame([("q", k, k % 7) for k in range(41)] + [("s", 100, None)], "q string, k int, v int")
    assert sorted(r.k for r in sampling.place_sample(df, "q", "k").where("q = 'q'").collect()) == [0, 10, 20, 30, 40]
    assert sorted(r.k for r in sampling.place_sample(df, "q", "k", 7).where("q = 'q'").collect()) == [0, 1, 2, 10, 20, 30, 40]
    assert sorted(r.k for r in sampling.place_sample(df, "q", "k", 2).where("q = 'q'").collect()) == [0, 10]
    assert [r.k for r in sampling.place_sample(df, "q", "k").where("q = 's'").collect()] == [100]
    top = sampling.top_percent(df, "q", "v", 10).where("q = 'q'").collect()
    assert {r.v for r in top} == {6} and len(top) == 5
    ranked = sampling.ranked(df, "q", "v", "k").where("q = 'q'").orderBy("rank").limit(3).collect()
    assert [r.k for r in ranked] == [6, 13, 20]


def maps(spark, rows):
    schema = (
        "file string, chunk_id string, chunk_hash string, source_ids array<string>, summary string, claims array<struct<claim:string,evidence_source_ids:array<string>,confidence:string>>,"
        "themes array<string>, uncertainties array<string>, source_coverage array<struct<source_id:string,summary:string,disposition:string>>, corrupt boolean"
    )
    return spark.createDataFrame(rows, schema)


def test_coverage(spark):
    inputs = spark.createDataFrame([("s1", ["c1"], "h"), ("s2", ["c1", "gone"], "h"), ("s3", [], "h"), ("s4", ["c2"], "old")], "source_id string, chunk_ids array<string>, sha256 string")
    chunks = spark.createDataFrame([("c1", "k1", ["s1", "s2", "s2", "s9"], None), ("c2", None, ["s4"], "failed"), ("c3", "k3", ["s1"], None), ("c4", "k4", ["s1"], None)], "chunk_id string, chunk_hash string, source_ids array<string>, status string")
    good = ("map-c1.json", "c1", "k1", ["s1", "s2", "s7"], "s", [("c", ["s1", "s8"], "high"), (" ", ["s1"], "low"), ("d", [], "low"), ("e", ["s1"], "sure")], None, [], [("s1", "ok", None), ("s1", "ok", None), ("s2", " ", None), ("x", "ok", None), (None, "ok", None)], False)
    rows = [
        good,
        ("map-c1.json", "c1", "k1", ["s1"], "s", [], [], [], [("s1", "ok", None)], False),
        ("map-c3.json", "c3", "stale", ["s1"], "s", [], [], [], [], False),
        ("map-x.json", "c4", "k4", ["s1"], "s", [], [], [], [], False),
        ("map-u.json", "unknown", "k", ["s1"], "s", [], [], [], [], False),
        ("map-bad.json", None, None, None, None, None, None, None, None, True),
    ]
    current = spark.createDataFrame([("s1", "h"), ("s2", "h"), ("s3", "h"), ("s4", "new")], "source_id string, sha256 string")
    # the first registered map of c1 is the one that sorts first; make the broken one sort first
    found = evidence.issues(inputs, chunks, maps(spark, rows), current)
    got = evidence.coverage_report(found).first().asDict()
    assert got.pop("valid") is False
    assert got["missing_sources"] == 2 and got["failed_chunks"] == 2 and got["duplicate_assignments"] == 1 and got["stale_hashes"] == 1
    assert got["duplicate_maps"] == 1 and got["stale_maps"] == 1 and got["missing_map_results"] == 2 and got["invalid_evidence_refs"] == 2
    content = evidence.map_content(evidence.gated_maps(maps(spark, [good]), chunks)).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in content} == {"cross_chunk_evidence": 3, "missing_mapped_sources": 2, "malformed_maps": 7}
    assert evidence.coverage_report(found.limit(0)).first().valid


def test_final_report(spark):
    inputs = spark.createDataFrame([("s1",)], "source_id string")
    claims = spark.createDataFrame([(1, "a", ["s1"], "high"), (2, " ", ["s1"], None), (3, "b", ["s1", "x"], None), (4, "c", [], "sure")], "claim_no int, text string, evidence_source_ids array<string>, confidence string")
    got = evidence.final_report(claims, inputs).first()
    assert (got.claims, got.claims_without_evidence, got.bad_confidence, got.valid_refs, got.invalid_refs, got.valid) == (4, 2, 1, 2, 1, False)
    assert evidence.final_report(claims.where("claim_no = 1"), inputs).first().valid
    assert not evidence.final_report(claims.limit(0), inputs).first().valid


def test_merged_claims(spark):
    claims = spark.createDataFrame([(1, " a ", ["s2", "s1"], "low"), (2, "a", ["s1", "s3"], "high"), (3, "b", [], "odd"), (4, " ", ["s1"], "high")], "seq long, claim string, evidence array<string>, confidence string")
    sources = spark.createDataFrame([(1, "s1", 5000), (2, "s3", 2000), (3, "s1", 1000), (4, "s2", 1)], "seq long, source_id string, votes long")
    got = {r.text: r for r in merge.merge_claims(claims, sources).collect()}
    assert set(got) == {"a", "b"} and got["a"].evidence == ["s2", "s1", "s3"] and got["a"].confidence == "high" and got["b"].confidence == "low" and got["b"].evidence == []
    assert got["a"].high_vote_sources == ["s1"] and got["a"].high_vote_sources_all == ["s1", "s3"]
    levels = merge.merge_levels(claims.withColumn("chunk_id", F.concat(F.lit("c"), "seq")), sources, spark.createDataFrame([("c1", "g1"), ("c3", "g1")], "chunk_id string, group_id string"))
    assert {r.text: r.lineage for r in levels.collect()} == {"a": ["g1", "c2"], "b": ["g1"]}
    themes = spark.createDataFrame([(1, "x"), (2, " x "), (3, "y"), (4, " ")], "seq long, theme string")
    assert [(r.theme, r.occurrences) for r in merge.theme_counts(themes).orderBy("first_seq").collect()] == [("x", 2), ("y", 1)]
    views = spark.createDataFrame([(1, "v")], "first_seq long, minority_view string")
    doubts = spark.createDataFrame([], "first_seq long, uncertainty string")
    merged = merge.merge_claims(claims, sources)
    final = merge.final_document(merged, views, doubts, 3, 1).first()
    assert [c.text for c in final.claims] == ["a", "b"] and final.minority_views == ["v"] and final.uncertainties == []
    text = documents.digest_document(merged, views, doubts, 3, 1).first().document
    assert "1. a\n   - 来源: [s2] [s1] [s3]（置信度 high）" in text and "## 少数观点\n- v" in text and "不确定性" not in text


def test_archive_round_trip(spark):
    bodies = ["# T\nplain", "no title 😀", "# T\n<!-- ARCHIVE_SOURCE_END -->\n<!-- ARCHIVE_SOURCE_BEGIN x -->", "", "\ufeff# B\nbody"]
    docs = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)] + [(9, None)], "k int, text string")
    rows = archive.entries(docs, "k", "text")
    assert {r.source: r.title for r in rows.collect()} == {"0": "T", "1": "1", "2": "T", "3": "3", "4": "4"}
    made = archive.volumes(rows, archive.by_chars(rows, 40), "all", "now")
    got = archive.extract_sections(made)
    assert {r.source: r.body for r in got.collect()} == {r.source: r.body for r in rows.collect()}
    assert {r.status for r in archive.verify(rows, got).collect()} == {"ok"}
    broken = got.where("source <> '0'").withColumn("body_sha256", F.when(F.col("source") == "1", "x").otherwise(F.col("body_sha256")))
    assert {r.source: r.status for r in archive.verify(rows, broken).collect() if r.status != "ok"} == {"0": "missing", "1": "changed"}
    assert archive.by_count(rows, 2).groupBy("volume").count().count() == 3
    assert archive.leaks(spark.createDataFrame([(1, "see /home/x/y and C:\\a"), (2, "https://a.example/home")], "k int, t string"), "k", "t").first().paths == ["/home/x/y", "C:\\a"]


@pytest.mark.parametrize(
    "text,frames",
    [
        ("## 1. a\n## 2. b", 2),
        ("```\n## 1. a\n```\n## 2. b", 1),
        ("```py\n## 1. a\n````\n## 2. b", 1),
        ("````\n```\n## 1. a\n````\n## 2. b", 1),
        ("```\n## 1. a", 0),
        ("## 1. a\r\n```\r\n## 2. x\r\n```\r\n## 3. b", 2),
        ("``` a`b\n## 1. a", 1),
        (None, 0),
    ],
)
def test_frames(spark, text, frames):
    assert spark.createDataFrame([(text,)], "t string").select(acceptance.frame_count(F.col("t")).alias("n")).first().n == frames


def test_acceptance(spark):
    schema = "directory_id string, question_id string, bare_array boolean, answers long, duplicates long, bad_ids long, reported_count long, done boolean, markdown string, corrupt_files int, failed boolean"
    df = spark.createDataFrame([("1", "1", False, 1, 0, 0, 5, True, "## 1. x", 0, False), ("2", "3", True, 2, 1, 1, None, None, " ", 1, True), ("4", None, False, None, None, None, None, False, "x", 0, None)], schema)
    got = {r.directory_id: r for r in acceptance.acceptance(df).collect()}
    assert got["1"].valid and got["1"].warnings == ["count_mismatch"]
    assert got["2"].warnings == ["bare_array", "question_id_mismatch", "bad_answer_id", "duplicate_ids", "progress_missing", "markdown_missing", "corrupt_file", "marked_failed"]
    assert got["4"].warnings == ["question_id_missing", "answers_not_array", "no_answers", "not_done"]
    assert [r.question_id for r in acceptance.handoffs(acceptance.acceptance(df), "t").collect()] == ["1"]


def test_handoff(tmp_path):
    import json

    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "answers.json").write_text('{"questionId":"7","answers":[{}]}')
    (tmp_path / "7" / "answers.md").write_text("x")
    doc = {"task": "digest", "sourceType": "t", "questionId": "7", "inputJson": "7/answers.json", "inputMarkdown": "7/answers.md", "verified": True, "answerCount": 1, "warnings": []}

    def issues(**change):
        (tmp_path / "h.json").write_text(json.dumps({k: v for k, v in {**doc, **change}.items() if v is not ...}))
        return acceptance.verify_handoff(str(tmp_path / "h.json"), str(tmp_path), "t")

    assert issues() == []
    assert issues(answerCount=2) and issues(inputJson="../x") and issues(inputJson="/etc/passwd") and issues(extra=1) and issues(task=...) and issues(verified=False) and issues(questionId="x")
    assert issues(answerCount=True) and issues(warnings=[1])
    with pytest.raises(ValueError):
        acceptance.bounded("n", "1.5", 1, 3)
    assert acceptance.bounded("n", " 2 ", 1, 3) == 2


def test_stats_and_matching(spark):
    df = spark.createDataFrame([(1, "a😀\nb"), (2, None), (3, "")], "k int, t string")
    got = {r.k: (r.chars, r.bytes, r.lines) for r in stats.file_stats(df, "k", "t").collect()}
    assert got == {1: (5, 7, 2), 2: (0, 0, 1), 3: (0, 0, 1)}
    assert stats.totals(stats.file_stats(df.limit(0), "k", "t")).first().chars == 0
    # parts are joined by blanks, so sentences must be parted by blanks on both sides
    long = "这是第一句话，说了很多很多的内容在里面。 " * 2 + "中间的句子也有足够的长度可以用来比较内容。 " + "最后一句话同样说了很多很多的内容在里面呢。"
    pairs = spark.createDataFrame([(f"<p>{long}</p>", long + " more", True), (f"<p>{long}</p>", "other", False), ("<b>short text</b>", "a short text b", True), ("tiny", "tiny", False), ("", "x", False)], "a string, b string, w boolean")
    assert all(r.m == r.w for r in pairs.select(stats.content_matched(F.col("a"), F.col("b")).alias("m"), "w").collect())


def test_documents(spark):
    df = spark.createDataFrame([("1", "9", "a_b", "<p>x</p>", 3, 1, 0, 1), ("2", "9", None, None, None, None, 5, 2)], "id string, questionid string, author string, content string, voteupcount long, commentcount long, createdtime long, captureseq long")
    titles = spark.createDataFrame([("9", "t*", 7)], "questionid string, title string, answercount long")
    text = documents.answers_document(df, titles, "https://qa.example", "now").first().document
    assert text.startswith("# t\\*\n") and "## 1. a\\_b — 3 赞 · 1 评论" in text and "## 2. \\(匿名\\) — 0 赞" in text or "## 2. (匿名)" in text
    assert "回答总数: 7，本次抓取到: 共 2 条" in text
    block = documents.sample_blocks(df, titles, 1).first()
    assert block.answers == 2 and "Top1  a_b  [3赞 / 1评]" in block.block and "Top2" not in block.block
