import random
import zlib

import numpy as np

from queuelake.llm import sharding as S


def test_place_equals_plain():
    rnd = random.Random(5)
    for _ in range(20):
        items = [[rnd.randint(1, 90), rnd.randint(1, 90), 1] for _ in range(rnd.randint(1, 60))]
        total = [sum(c) for c in zip(*items)]
        share = [[x / t * 4 for x, t in zip(r, total)] for r in items]
        room, want = [[1.0] * 3 for _ in range(4)], [0] * len(items)
        for i in sorted(range(len(items)), key=lambda i: -sum(share[i])):
            dots = [sum(a * b * w for a, b, w in zip(share[i], r, S.WEIGHTS)) for r in room]
            want[i] = k = max(range(4), key=lambda k: (round(dots[k], 9), -k))
            room[k] = [a - b for a, b in zip(room[k], share[i])]
        assert S.place(np.array(items, float), 4).tolist() == want


def test_query(spark, tmp_path):
    rnd = random.Random(6)
    texts = ["hot text " * 20] * 700 + [None] * 3 + [""] * 3 + [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(rnd.randint(1, 80))) for _ in range(1400)]
    rnd.shuffle(texts)
    rows = [(None if i % 500 == 7 else i // 2 * 2, t, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op2_sharding(spark, str(tmp_path)).collect()
    key = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id or -1, r["size"], r.text_crc32) for r in got)) == sorted((i or -1, *key(t)) for i, t, _ in rows)
    by = {k: [r for r in got if r.shard == k] for k in range(8)}
    assert sum(map(len, by.values())) == len(rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    counts = [len(own) for own in by.values()]
    assert max(sizes) / min(sizes) < 1.05 and max(counts) / min(counts) < 1.3, (sizes, counts)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = S.op2_sharding(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op2_sharding(spark, f"{tmp_path}/none").count() == 0


def test_equal_texts_stay_together(spark):
    df = spark.createDataFrame([(i, f"text {i % 900} " + "x" * (i % 900 % 37)) for i in range(4000)], "doc_id long, text string")
    at = {}
    for r in S.sharded(df).collect():
        at.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in at.values())


def test_groups_below_a_fair_part_stay_whole(spark):
    texts = ["copy " * 9] * 120 + [f"own text {i} " + "y" * (i % 41) for i in range(3880)] + ["z" * 300] * 900
    at, n = {}, {}
    for r in S.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        at.setdefault(r.text_crc32, set()).add(r.shard)
        n[r.shard] = n.get(r.shard, 0) + r["size"]
    split = {k for k, x in at.items() if len(x) > 1}
    assert split == {zlib.crc32(b"z" * 300)} and max(n.values()) < 1.15 * min(n.values()), n  # a third of the rows has most of the bytes
