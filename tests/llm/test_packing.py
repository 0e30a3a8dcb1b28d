import random

import numpy as np
import pytest

from strataloom.llm import lexical, packing


def test_terms_count_words_and_pairs():
    row, bucket, count = lexical.terms(["river stone River", "", "河流河流", None or "a"])
    assert list(row) == [0, 0, 2, 2, 3] and sorted(count.tolist()) == [1, 1, 1, 2, 2]
    again = lexical.terms(["stone river river"])
    assert set(again[1]) == set(bucket[row == 0])


def test_cut_points_lie_between_characters():
    text = "漢字と𠮷😀" * 300
    ids = lexical.encode(text)
    cuts = lexical.cut_points(ids, 64)
    edges = [0, *cuts, len(ids)]
    assert max(np.diff(edges)) <= 64
    assert "".join(lexical.tokenizer().decode_bytes(ids[a:b]).decode("utf-8") for a, b in zip(edges, edges[1:])) == text


def test_retrieval_is_bm25():
    rng = random.Random(2)
    words = [rng.sample(range(60), rng.randint(3, 20)) for _ in range(80)]
    buckets = [np.array(sorted(w), dtype=np.int32) for w in words]
    counts = [np.array([rng.randint(1, 4) for _ in w], dtype=np.uint8) for w in words]
    df = np.zeros(1 << lexical.BUCKET_BITS)
    for b in buckets:
        df[b] += 1
    idf = np.log(1 + (80 - df + 0.5) / (df + 0.5))
    average = sum(int(c.sum()) for c in counts) / 80
    shard = packing.Shard(buckets, counts, idf, average)
    got = shard.neighbours(0, np.ones(80, bool))
    query = set(shard.queries[0].tolist())

    def score(k):
        dl = counts[k].sum()
        return sum(idf[b] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / average)) for b, c in zip(buckets[k].tolist(), counts[k].astype(float)) if b in query)

    want = sorted((k for k in range(80) if score(k) > 0), key=lambda k: -score(k))
    assert np.allclose([score(k) for k in got], [score(k) for k in want])


def test_pack(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["river", "stone", "bread", "lamp", "cloud"]) for _ in range(rng.randint(1, 90)))) for k in range(400)]
    rows += [(900, "word " * 1000), (901, ""), (902, None), (903, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", packing.F.lit(1)).repartition(5)
    kinds = [("small", 64), ("large", 256)]
    out = packing.pack(df, "doc_id", "text", kinds, shard_tokens=6000).collect()
    for kind, capacity in kinds:
        mine = [r for r in out if r.bin_kind == kind]
        room = {}
        for r in mine:
            room[r.container] = room.get(r.container, 0) + r.end_token - r.start_token
        assert max(room.values()) <= capacity
        assert sum(room.values()) / (len(room) * capacity) > 0.9
        by = {}
        for r in mine:
            by.setdefault(r.doc_id, []).append((r.start_token, r.end_token))
        assert set(by) == {r[0] for r in rows if r[1] is not None}
        for doc, parts in by.items():
            parts.sort()
            assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert len(parts) == 1 or parts[-1][1] > capacity
    again = packing.pack(df.repartition(3), "doc_id", "text", kinds, shard_tokens=6000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", [("small", 64)]).count() == 0
