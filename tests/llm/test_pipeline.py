import zlib

import numpy as np
from test_neardup import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from queuelake.llm import decontaminate, langid, packing, secrets


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    judged = zip(rows, *langid.predict(model, [r.text for r in rows.values()]))
    left = [i for i, lang, score in judged if not langid.rejected(rows[i].text, lang, score)]
    gone = {i for i, _, c, kept in brute([(i, rows[i].text) for i in left]) if not kept}
    left = [i for i in left if str(i) not in gone]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in left if not any(t in decontaminate.normal(rows[i].text) for t in items)]  # items are planted whole here
    forest = secrets.trained()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: t.encode(secrets.redact(forest, rows[i].text, rows[i].source), add_special_tokens=False).ids + [1] for i in left}
    got = C.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want) and len(want) < len(rows)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "benchmark", "secrets", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "the cat " * 9, "en", None, 72), (2, "the cat " * 9, "en", None, 72)], docs.schema)
    for _, stage in C.STAGES:
        stage(spark, odd, sf).collect()
