import hashlib
import random

import numpy as np

from queuelake.llm import spotsigs as S

WORDS = "the of der la kette haus baum lauf tanz rede wort bild licht nacht".split()


def brute_signatures(text):
    words = S.WORD.findall(text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in S.ANCHORS][: S.CHAIN]
            if chain:
                out.add((w, *chain))
    return out


def test_signatures():
    rnd = random.Random(1)
    for _ in range(100):
        t = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 60)))
        if want := brute_signatures(t):
            assert len(S.signatures(t)) == len(want)
    assert S.decoded(S.encoded(S.signatures("the kette haus"))).tolist() == S.signatures("the kette haus").tolist()
    assert S.jaccard(S.signatures(""), S.signatures("")) == 1.0 and S.jaccard(S.signatures(""), S.signatures("!!!")) == 0.0


def test_near_pairs_equals_all_pairs():
    rnd = random.Random(2)
    base = [rnd.sample(range(400), rnd.randint(1, 40)) for _ in range(30)]
    sets = {i: np.unique(np.array([x if rnd.random() > 0.08 else rnd.randrange(400) for x in rnd.choice(base)], np.uint32)) for i in range(150)} | {200: np.array([], np.uint32), 201: np.array([], np.uint32)}
    want = {(a, b) for a in sets for b in sets if a < b and S.jaccard(sets[a], sets[b]) >= 0.75}
    assert {tuple(sorted(p)) for p in S.near_pairs(sets, 0.75)} == want and len(want) > 50


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS_A_CHUNK", 7)
    rnd = random.Random(3)
    rows = [(i * 3 % 211, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 8, 90]))), 1) for i in range(120)] + [(None, "null id", 1), (5, None, 1), (9, "the é𝄞 wort", 1), (9, "the é𝄞 wort", 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = S.edited(t, nxt)
        a, b, c = map(S.signatures, (t, e, nxt))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), S.encoded(a), S.encoded(b), S.jaccard(a, b), S.jaccard(a, c)))
    got = [tuple(r) for r in S.op10_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op10_fingerprints(spark, f"{tmp_path}/none").count() == 0
    df.limit(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert S.op10_fingerprints(spark, f"{tmp_path}/one").first().near_next == 1.0
