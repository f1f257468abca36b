import duckdb
import pytest

from queuelake.llm import url_filter as U

PAGES = "page_id long, url string, host string, n int"
LABELS = "doc_id long, quality int, toxic int, bound double"


def pages():
    hosts = ["a.example.com", "www.example.com", "Shop.Example.COM:8080", "user@b.co.uk", "c.co.uk", "co.uk", "1.2.3.4", "5.6.7.8:80", "x.y.z.net", "plain", "deep.a.b.org", ""]
    urls = [f"https://{h}/{p}/{100 * i + k}" for i, h in enumerate(hosts) for k, p in enumerate(["en", "es", "fr", "blog"] * 4)]
    urls += [None, "", "no scheme", "http://", "http://net/es/1", "ftp://example.com/en?x=1", "http://x.com#f", "http://b.net/fr", "http://a://b/en/7", "HTTP://WWW.EXAMPLE.COM/EN/5", "x" * 9000 + "://long.net/es/" + "y" * 9000]
    rows = [(None if i % 40 == 9 else i, u, "clash", 1) for i, u in enumerate(urls)]
    return rows + rows[:5]


def labels():
    ids = [100 * i + k for i in range(12) for k in range(16)]
    return [(d, None if d % 7 == 0 else int(d % 100 > 9 or d // 100 % 3), None if d % 5 == 0 else int(d % 11 == 0), 0.5) for d in ids] + [(None, 0, 1, 0.0), (101, 0, 1, 0.0), (101, 0, 1, 0.0)]


def run(spark, at, rows, marks):
    spark.createDataFrame(rows, PAGES).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{at}/labels.parquet")
    got = sorted(tuple(map(str, r)) for r in U.op1_url_filter(spark, str(at)).collect())
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return got, sorted(tuple(map(str, r)) for r in con.execute(U.ORACLE).fetchall())


@pytest.mark.parametrize("case", ["all", "no labels", "no pages"])
def test_equals_its_sql(spark, tmp_path, case):
    rows, marks = ([] if case == "no pages" else pages()), ([] if case == "no labels" else labels())
    got, want = run(spark, tmp_path, rows, marks)
    assert got == want and len(got) == len(rows)
    if case == "all":
        assert {r[4] for r in got} == {"allow", "block"} and "net/es/" in {r[3] for r in got}


def test_domains(spark):
    want = {
        "a.example.com": ("example.com", "com"), "b.co.uk": ("b.co.uk", "co.uk"), "x.c.co.uk": ("c.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "1.2.3.4": ("1.2.3.4", "(ip)"), "u@h.net:80": ("h.net", "net"),
        "plain": ("plain", "plain"), "": ("", ""),
    }
    got = U.with_parents(spark.createDataFrame([(h,) for h in want], "host string")).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == want
