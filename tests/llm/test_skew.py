"""A third of all rows in one group, under one source or as copies of one text."""

import random

from strataloom.llm import mixing, neardup, packing, subjects, topn

WORDS = ["river", "stone", "bread", "lamp", "cloud", "violin", "carpet", "engine", "winter", "garden"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def test_hot_question(spark):
    rows = [(f"{k}", "hot" if k % 3 == 0 else f"q{k % 50}", k % 11, k) for k in range(6000)]
    df = spark.createDataFrame(rows, "id string, questionid string, voteupcount long, captureseq long").repartition(12)
    got = topn.top_n_per_group(df, "questionid", "voteupcount", "captureseq", 10).where("questionid = 'hot'").orderBy("place").collect()
    want = sorted((r for r in rows if r[1] == "hot"), key=lambda r: (-r[2], r[3]))[:10]
    assert [r.id for r in got] == [r[0] for r in want]


def test_a_third_are_copies(spark):
    rng = random.Random(1)
    same, close = words(rng, 60), None
    close = same + " and three more words"
    rows = [(f"{k:04d}", same if k % 3 == 0 else words(rng, 60)) for k in range(900)] + [("9000", close)]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("cid", neardup.F.lit(1)).withColumn("a", neardup.F.lit(2))
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, expand=20).collect()}
    assert {("0000", f"{k:04d}") for k in range(3, 900, 3)} | {("0000", "9000")} == got
    whole = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, expand=None).collect()}
    assert len(whole) == 300 * 299 // 2 + 300
    heads = {r.id: r["head"] for r in neardup.near_duplicate_members(df).collect()}
    assert heads["0300"] == "0000" and heads["0001"] == "0001" and heads["9000"] == "9000"
    groups = {r.id: r for r in neardup.near_duplicate_groups(df).collect()}
    assert {groups[f"{k:04d}"].group_id for k in range(0, 900, 3)} == {"0000"} and groups["9000"].group_id == "0000" and groups["0001"].group_id == "0001"


def test_one_bucket_larger_than_a_task():
    import numpy as np
    import pyarrow as pa

    def batches(sizes):
        cid = 0
        for key, n in sizes:
            second = np.zeros((n, neardup.SIDE), dtype=np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key, dtype=np.int64)), pa.array(np.arange(cid, cid + n)), pa.array([r.tobytes() for r in second], pa.binary())], names=["key", "cid", "second"])
            cid += n

    out = list(neardup._tables(batches([(1, 2), (2, 150_000), (2, 300_000), (2, 20_000), (3, 3), (4, 1)])))
    rows = pa.Table.from_batches(out)
    later = rows.filter(rows.column("later"))
    assert later.num_rows == 470_000 * neardup.SIDE
    assert set(later.column("b").to_pylist()[:: neardup.SIDE]) == set(range(2, 470_002))
    import pyarrow.compute as pc

    pairs = rows.filter(pc.invert(rows.column("later")))
    assert set(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())) == {(0, 1), (470_002, 470_003), (470_002, 470_004), (470_003, 470_004)}


def test_packing_and_mixing_of_copies(spark):
    rng = random.Random(2)
    text = words(rng, 40)
    rows = [(k, text if k % 3 == 0 else words(rng, rng.randint(5, 80)), "big" if k % 3 == 0 else rng.choice(["x", "y"])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = packing.pack(df, "doc_id", "text", [("small", 512)], shard_tokens=20_000)
    assert packed.select("doc_id").distinct().count() == 600
    fill = packing.fill_report(packed, spark.createDataFrame([("small", 512)], "bin_kind string, capacity_tokens int")).first().fill
    assert fill > 0.9
    aims = spark.createDataFrame([("big", 0.2, 1), ("x", 0.4, 2), ("y", 0.4, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r.reached_share for r in mixing.shares(df, aims).collect()}
    assert abs(got["big"] - 0.2) < 0.02 and abs(got["x"] - 0.4) < 0.02


def test_one_subject_holds_most(spark):
    rng = random.Random(3)
    pairs = {"sea": ["coral", "lighthouse", "harbour"], "farm": ["tractor", "paddy", "barn"]}

    def sentence(area):
        a, b = rng.sample(pairs[area], 2)
        return rng.choice([f"My friend thinks the {a} is better than the {b}. ", f"Keep the {a} away from the {b}, he said. "])

    samples = [(k, sentence(area), [area]) for k in range(60) for area in pairs]
    texts = ["".join(sentence("sea" if k % 3 else "farm") for _ in range(3)) for k in range(200)]
    rules = subjects.fit_rules(
        spark, spark.createDataFrame(samples, "sample_id long, text string, subjects array<string>"), spark.createDataFrame([(t,) for t in texts], "text string"), ["farm", "sea"]
    )
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {r.id: r.subject for r in subjects.subject_areas(df, ["id"], "content", rules).collect()}
    assert len(got) == 200 and all(got[k] == ("sea" if k % 3 else "farm") for k in got)


def test_a_long_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long")
    assert {r["head"] for r in neardup.components(edges).collect()} == {0}
