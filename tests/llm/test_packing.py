import random
import unicodedata
import zlib

import numpy as np
from tokenizers import Tokenizer

from queuelake.llm import packing as P


def test_encoder_equals_library():
    t = Tokenizer.from_file(P.tokenizer_path())
    texts = ["", " ", "  ", "a  b", "a   b ", " lead", "a\n b", "a \tb", "a\t \tb", "don't  stop", "x" * 200 + " y", "é ü 𝄞  z", "<|endoftext|> 12 34", "a b  c", "tail  ", "\n\n a", "a b c " * 500]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("ab '\n\t.1é  ") for _ in range(60)) for _ in range(400)]
    e = P.Encoder(P.tokenizer_path())
    for _ in range(2):
        got = e.encode(texts)
        assert [g.tolist() for g in got] == [x.ids + [1] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_first_fit_decreasing_equals_plain():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 80))]
        rooms, want = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            at = next((k for k, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
            rooms += [50] * (at == len(rooms))
            rooms[at] -= lengths[i]
            want[i] = at
        assert P.first_fit_decreasing(lengths, 50) == want


def check(pieces, lengths, room):
    by = {}
    for d, start, n, seq, off in pieces:
        assert n > 0
        by.setdefault(seq, []).append((off, n))
    for rows in by.values():
        at = 0
        for off, n in sorted(rows):
            assert off == at
            at += n
        assert at <= room
    for d, length in enumerate(lengths):
        at = 0
        for s, n in sorted((p[1], p[2]) for p in pieces if p[0] == d):
            assert s == at
            at += n
        assert at == length
    assert sum(sum(n for _, n in rows) < room for rows in by.values()) <= 1


def test_pack():
    rnd = random.Random(3)
    for _ in range(200):
        lengths = [rnd.choice([1, rnd.randint(1, 30), rnd.randint(1, 300)]) for _ in range(rnd.randint(0, 40))]
        check(P.pack(lengths, 32), lengths, 32)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", "same text"] + ["same text"] * 5 + [" ".join(rnd.choice(["alpha", "beta", "Gamma,", "12", "é"]) for _ in range(rnd.choice([3, 50, 9000]))) for _ in range(30)]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.packed(spark.read.parquet(f"{tmp_path}/documents.parquet"), P.tokenizer_path(), keep_ids=True).collect()
    t = Tokenizer.from_file(P.tokenizer_path())
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048
    assert "ids" not in P.op3_packing(spark, str(tmp_path)).columns
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.op3_packing(spark, f"{tmp_path}/none").count() == 0


def test_ids_of_all_assigned_code_points():
    encoder = P.Encoder(P.tokenizer_path())
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{c} {c}1{c}{c} " for c in chars[k : k + 100]) for k in range(0, len(chars), 100)]
    want = [e.ids + [P.END_ID] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
