import zlib

import numpy as np

from queuelake.llm import langid as L


def test_look_ups_equal_plain_convolution():
    m = L.train([b"the cat and the dog", b"der hund und die katze"] * 4, ["en", "de"] * 4, epochs=2)
    x, _ = L.windows(L.folded("The quick bröwn fox 12".encode() * 20))
    got = m.log_probs(x, m.tables())
    for row, want in zip(x, got):
        h = []
        for w in L.WIDTHS:
            r = [[sum(float(m.embed[row[p + j]] @ m.filters[w][j][:, f]) for j in range(w)) for f in range(L.FILTERS)] for p in range(L.WINDOW - w + 1)]
            h += np.max(r, axis=0).tolist()
        z = np.maximum(np.array(h) + m.bias, 0) @ m.dense + m.dense_bias
        assert np.allclose(z - np.log(np.exp(z).sum()), want, atol=1e-3)


def test_windows_cover_whole_texts():
    for n in (0, 1, L.WINDOW - 1, L.WINDOW, L.WINDOW + 1, 5 * L.WINDOW + 3):
        data = np.arange(n).astype(np.uint8)
        x, held = L.windows(data)
        assert held.sum() == n and x.reshape(-1)[:n].tolist() == data.tolist()


def test_held_out_accuracy(spark):
    rows = L.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, tmp_path):
    texts = [None, "", "123 !!! ...", "the cat and the dog", "der hund und die katze", "x" * 50000, "the " * 9000]
    rows = [(i, t, "de" if i == 4 else "en", 1.0) for i, t in enumerate(texts)] + [(None, "the cat", None, 1.0), (3, texts[3], "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op8_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in range(3)] == ["und"] * 3 and by[0].score == 0 and by[None].held_out is False
    assert L.predicted(df, None).filter("lang_pred = 'und'").count() == len(rows)
    assert L.kept(df, L.fit(df)).columns == df.columns and L.kept(df, L.fit(df)).count() == len(rows) - 3
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert L.op8_language_id(spark, f"{tmp_path}/none").count() == 0


def test_clashing_columns_and_null_ids(spark):
    rows = [(None if i % 2 else i, f"the cat and the house number {i}" if i % 3 else f"der hund und das haus nummer {i}", "en" if i % 3 else "de", 0.5, 1, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, share double, rank int, part string")
    model = L.fit(docs, most=10)
    assert model.langs == ["de", "en"]
    assert L.kept(docs, model).columns == docs.columns
    assert {r.lang_pred for r in L.predicted(docs, model).collect()} <= {"de", "en"}


def test_rejected():
    assert L.rejected(None, "und", 0.0) and L.rejected("As " * 90, "en", 0.49)
    assert not L.rejected("As " * 90, "en", 0.5) and not L.rejected("short", "en", 0.3)
