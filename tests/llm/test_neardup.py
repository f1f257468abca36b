import random
import re

import numpy as np

from queuelake.llm import neardup as N
from queuelake.llm.components import components


def brute_components(edges):
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        at[b] = a
    return {x: root(x) for x in list(at)}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(500, x) for x in range(501, 700)] + [(rnd.randrange(1000, 1300), rnd.randrange(1000, 1300)) for _ in range(150)] + [(7, 7), (2000, 2000)]
    want = {k: v for k, v in brute_components(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    again = components(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 1), (9, 9), (8, 7), (None, 4), (4, None)], "u long, v long")).collect()  # stars from the start
    assert sorted((r.node, r.component) for r in again) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    edges = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    comp = brute_components(edges)
    return sorted((str(i), len(s), str(None if i is None else comp.get(i, i)), i is None or comp.get(i, i) == i) for i, s in sets)


def corpus(seed, big):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    change = lambda w, n: [word() if i in set(rnd.sample(range(len(w)), n)) else x for i, x in enumerate(w)]
    out = [None, "", " \t\n", "one", "One", "a b c d", "A b\tc d", "a b c e"]
    for _ in range(25):
        w = text(rnd.choice([6, 40, 150, 400]))
        out += [" ".join(change(w, rnd.randint(0, max(1, len(w) // 30)))) for _ in range(rnd.choice([1, 2, 4]))]
    hub, passage = text(200), text(60)
    out += [" ".join(change(hub, rnd.randint(1, 4))) for _ in range(big)] + [" ".join(hub)] * big
    out += [" ".join(text(40) + passage + text(30)) for _ in range(40)] + [" ".join(change(passage, 1)) for _ in range(5)]
    rnd.shuffle(out)
    return out


def test_equals_brute_force(spark, tmp_path):
    texts = corpus(2, 60)
    rows = [(None if k % 97 == 13 else 1000 - k, t) for k, t in enumerate(texts)] + [(1000, texts[0]), (None, " ".join(["n"] * 9))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = N.op5_minhash(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows)
    kept = N.kept(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert N.op5_minhash(spark, f"{tmp_path}/none").count() == 0


def test_group_on_both_sides(spark):
    """One hub and its copies, many of which have no link at all, some links by a shorter partner, and a second hub not far from it."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(2))
    hub = [word() for _ in range(150)]
    second = hub[:118] + [word() for _ in range(32)]

    def copy(w, changes, cut):
        w = list(w)
        for i in rnd.sample(range(len(w)), changes):
            w[i] = word()
        return " ".join(w[: len(w) - cut])

    texts = [copy(hub, rnd.randint(1, 9), rnd.choice([0, 0, 0, rnd.randint(1, 40)])) for _ in range(280)]
    texts += [copy(second, rnd.randint(1, 7), 0) for _ in range(120)]
    rows = list(enumerate(texts))
    out = N.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.doc_id == r.component_id) for r in out.collect())
    assert got == brute(rows) and 30 < sum(r[3] for r in got) < 250


def test_minima():
    rnd = np.random.default_rng(3)
    x = np.unique(rnd.integers(0, 2**63, 900, np.uint64))
    y = np.concatenate([x[:700], np.unique(rnd.integers(0, 2**63, 200, np.uint64))])
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((N.minima(x) == N.minima(y)).mean() - true) < 0.1
    assert N.minima(x).tolist() == [min((int(a) * int(v >> np.uint64(32)) + int(b)) % 2**32 for v in x) for a, b in zip(N._A, N._B)]


def test_kept_judges_rows(spark):
    rnd = random.Random(5)
    text = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(3)) for _ in range(120))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " more"
    # 5 has a near copy of 1 and a text of its own, whose group it leads; 2 is repeated whole; 3 has two texts of one group
    rows = [(1, a), (5, near(a)), (5, b), (6, near(b)), (7, near(near(b))), (2, c), (2, c), (2, c), (8, near(c)), (3, d), (3, near(d)), (9, e), (None, e), (None, e), (4, ""), (4, ""), (4, None)]
    got = N.kept(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, copy int"))
    assert got.columns == ["doc_id", "text", "copy"]
    left = [(r.doc_id, r.text) for r in got.collect()]
    three = [r for r in left if r[0] == 3]
    assert len(three) == 1 and three[0][1] in (d, near(d))
    want = [(1, a), (5, b), (2, c), (9, e), (None, e), (None, e), (4, ""), (4, ""), (4, None)]
    assert sorted(map(str, left)) == sorted(map(str, want + three))
