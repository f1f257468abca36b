import re
import time

from queuelake.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """Every rule on every text, without the gate; suppression by comparing all pairs."""
    w = words_of(text)
    norm = "".join(" " + x for x in w) + " " if w else ""
    places = [(label, i) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    hits = []
    for k, r in enumerate(L.rules()):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            a = norm.count(" ", 0, m.start()) - 1
            hits.append((a, a + len(m[0].split(" ")), r.priority, k, r.label))
    better = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and ((e[1] - e[0]) > (d[1] - d[0]) or e[:2] == d[:2] and e[3] < d[3]))
    kept = [d for d in hits if not any(better(e, d) for e in hits)]
    return len(w), places, sorted((d[0], d[1], d[2], d[3]) for d in kept)


CASES = [
    None, "", "... !!!", "plain words only", "Licensed under CC BY-NC 4.0.", "CC-BY cc by cc by", "xcc by", "ccby", "This work is licensed under the GNU General Public License, version 3",
    "All rights reserved.", "ALL  RIGHTS\nreserved all rights reserved", "SPDX-License-Identifier: Apache-2.0 and MIT License", "Licensed under the Apache License, Version 2.0", "Copyright (c) 2020 Some",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. MIT license. GNU Lesser General Public License version 2.1", "éà cc by ü", "the public domain " * 300, "cc by " * 3000,
    "licensed under the terms of the bsd 3 clause license or the gnu affero general public license version 3.0 dual licensed under mit license",
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(CASES)], "doc_id long, text string, norm int, keywords string")
    rows = L.scan(df)
    assert rows.columns == [*df.columns, "n_words", "places", "detections"]
    for r in rows.collect():
        assert (r.norm, r.keywords) == (1, "x")
        n, places, kept = brute(CASES[r.doc_id])
        assert r.n_words == n
        assert sorted((p.label, p.start) for p in r.places) == sorted(places)
        assert sorted((d.start, d.end, d.priority, d.rule) for d in r.detections) == kept, CASES[r.doc_id][:60]


def test_rules():
    got = L.rules()
    assert len(got) > 300
    for r in got:
        assert re.search(rf"(?<![a-z0-9]){r.keyword}(?![a-z0-9])", r.pattern), r


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, "cc by"), (4, CASES[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op4_licenses(spark, str(tmp_path)).collect()}
    r = got[CASES.index("Licensed under CC BY-NC 4.0.")]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 0.9)
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == "" and got[0].score == 0
    assert got[CASES.index("cc by " * 3000)].n_base == 3000
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert L.op4_licenses(spark, f"{tmp_path}/none").count() == 0


def alternatives(parsed):
    """Texts of a parsed pattern, one for each way through its branches and optional parts."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name == "IN":
            first = arg[0]
            ways = [chr(first[1] if str(first[0]) == "LITERAL" else first[1][0])]
        elif name == "BRANCH":
            ways = [w for b in arg[1] for w in alternatives(b)]
        elif name == "SUBPATTERN":
            ways = alternatives(arg[-1])
        else:
            assert name == "MAX_REPEAT", name
            least, most, what = arg
            ways = [w * least for w in alternatives(what)] + [w * min(int(most), least + 1) for w in alternatives(what)]
        out = [a + w for a in out for w in dict.fromkeys(ways)]
    return out


def test_every_alternative_holds_its_keyword():
    for r in L.rules():
        for text in alternatives(re._parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, text) and r.keyword in text.split(), (r, text)


def test_names_of_other_words(spark):
    texts = {"Released under the FreeBSD license": "bsd-2-clause", "zero clause BSD license": "0bsd", "freebsd": "bsd-2-clause", "licensed under the Zero-Clause BSD": "0bsd", "0BSD": "0bsd",
             "SPDX-License-Identifier: BSD-2-Clause-FreeBSD": "bsd-2-clause"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(df).collect():
        assert sorted((d.start, d.end, d.priority, d.rule) for d in r.detections) == brute(r.text)[2]
        assert {d.label for d in r.detections} == {texts[r.text]}, r.text


def test_many_hits_in_one_text(spark):
    """Twice the hits take about twice the time, not four times."""
    texts = {n: "cc by licensed under cc by nc 4 0 " * n for n in (5_000, 20_000)}
    took = {}
    for n, t in texts.items():
        df = spark.createDataFrame([(n, t)], "doc_id long, text string")
        at = time.time()
        (r,) = L.scan(df).select("places", "detections").collect()
        took[n] = time.time() - at
        assert len(r.places) == 2 * n and [d.start for d in r.detections] == sorted(d.start for d in r.detections)
    assert took[20_000] < 10 * took[5_000] + 5, took
