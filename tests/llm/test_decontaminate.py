import random

from queuelake.llm import decontaminate as D

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt labore dolore magna aliquyam".split()


def distance(pattern, text):
    """Least edit distance of pattern to any part of text, by the full matrix."""
    col = list(range(len(pattern) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, col[i] + 1, col[i - 1] + (p != c)))
        col = new
        best = min(best, col[-1])
    return best


def test_myers_equals_matrix():
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        masks = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in p}
        assert D.myers(masks, len(p), t)[0] == distance(p, t)


def say(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edit(rnd, s, n):
    for _ in range(n):
        i = rnd.randrange(len(s))
        s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "x" + s[i + 1 :]])
    return s


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    rnd = random.Random(2)
    items = [(i, say(rnd, rnd.choice([1, 4, 12, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    docs = [(None, None, 1), (1, "", 1), (2, "..", 1)]
    for k in range(80):
        t = say(rnd, rnd.randint(0, 60))
        if k % 2:
            item = rnd.choice(items[:12])[1]
            t += " " + (edit(rnd, item, rnd.randint(0, 16)).upper() if len(item) > 20 else item) + "!\n" + say(rnd, 9)
        docs.append((k + 3 if k != 5 else 3, t, 1))
    want = set()
    for i, t, _ in docs:
        for j, b in items:
            n, m = D.normal(t), D.normal(b)
            if n and m and distance(m, n) <= D.budget(m):
                want.add((i, j, distance(m, n)))
    spark.createDataFrame(docs, "doc_id long, text string, item_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.op6_decontamination(spark, str(tmp_path))
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and len(want) > 20
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bad = {w[0] for w in want}
    left = D.kept(own, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert left.columns == own.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad or d[0] == 3 and not {w for w in want if w[0] == 3} or False)
    assert D.contaminated(own.limit(0), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
    assert D.contaminated(own, spark.createDataFrame([], "item_id long, text string")).count() == 0
