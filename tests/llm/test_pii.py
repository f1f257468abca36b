import time
import hashlib
import re

from pyspark.sql import functions as F

from queuelake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(only(m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


CASES = [
    None, "", "no data", "a@b.c", "a@b.c_x@d.e.f", "x@y", "@a.b", "a.b@c.d.", "ü a@b.de 𝄞 1.2.3.4 ß", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4 0000255.1.1.1", "99999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "41111111111111111111111", "+49 (30) 123-4567.", "+1 2", "+12345678+12345678", "++4930123456789",
    "9" * 30000, "a" * 30000 + "@", "1.2." * 3000, "4 " * 9000, "a@b.c," * 400, "+1" + "()" * 5000, "iban DE89 3704 0044 0532 0130 00 end", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "ref 123-45-6789",
]


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_clash string")
    got = pii.with_spans(df).select("doc_id", *[F.col(f"pii_{k}").alias(k) for k in pii.KINDS]).collect()
    return {r.doc_id: r for r in got}


def test_base_equals_python(spark):
    got = rows(spark, CASES)
    for i, t in enumerate(CASES):
        assert [f"{s.kind}:{s.start}:{s.end}" for k in pii.BASE for s in got[i][k]] == brute(t or ""), t and t[:60]


def test_method_adds(spark):
    got = rows(spark, CASES)
    by = lambda k: [i for i in got if got[i][k]]
    assert [CASES[i] for i in by("iban")] == ["iban DE89 3704 0044 0532 0130 00 end"]
    assert [CASES[i] for i in by("ssn")] == ["ssn 123-45-6789"]
    assert got[CASES.index("iban DE89 3704 0044 0532 0130 00 end")]["iban"][0].score > 0.9


def test_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@b.de", 1), (None, None, 2), (1, "mail a@b.de", 1)], "doc_id long, text string, spans int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert got[1].n_email == 1 and got[1].spans == "email:5:11" and got[1].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert got[None].spans == "" and got[None].base_sha256 == hashlib.sha256(b"").hexdigest()
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op9_pii(spark, f"{tmp_path}/none").count() == 0


def test_many_matches_in_one_text(spark):
    took = {}
    for n in (5_000, 20_000):
        df = spark.createDataFrame([(1, "see 10.0.0.1 " * n)], "doc_id long, text string")
        at = time.time()
        (r,) = pii.with_spans(df).select("pii_ip").collect()
        took[n] = time.time() - at
        assert [s.start for s in r.pii_ip] == [13 * i + 4 for i in range(n)]
    assert took[20_000] < 10 * took[5_000] + 5, took
