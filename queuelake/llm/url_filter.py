"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted by host. The counts are shrunk through beta-binomial priors: the suffix towards the
whole corpus, the registered domain towards its suffix, the host towards its registered domain. How strongly is learnt at each level by the
method of moments, from how much the children differ from their parents beyond binomial noise. A host is blocked if the lower bound of its
posterior bad rate is above a threshold, so a few bad pages on an unknown host don't block it, and many do.

Everything is aggregation and equi-joins: counts are combined on the map side, so a host with a third of all pages is one row per task in
the shuffle; the join back to the pages is split by AQE where a host is hot. Nothing is collected.

Defined results: a null url, or one without ``://``, has an empty host and path, and is judged as the host ''. Hosts without outcomes get
their parents' rate. Repeated rows are judged alike; repeated labels count as so many outcomes; labels of which both marks are null are no
outcome. An empty table gives an empty result. Further columns of pages and labels are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

HOST_PATH = r"://([^/?#]*)([^?#]*)"
#: The page generator writes the id of the document behind a page as the last number of its path.
PAGE_DOC = r"://[^/?#]*/[a-z]+/([0-9]{1,18})"


#: Public suffixes of two labels. Any other host's suffix is its last label.
SUFFIXES = (
    "ac.cn ac.id ac.il ac.in ac.jp ac.kr ac.nz ac.th ac.uk ac.za co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.eg com.es com.hk com.mx com.my "
    "com.pe com.ph com.pl com.sa com.sg com.tr com.tw com.ua com.ve com.vn ed.jp edu.ar edu.au edu.br edu.cn edu.es edu.hk edu.mx edu.pl edu.sg edu.tr edu.tw go.id go.jp go.kr go.th gob.ar "
    "gob.es gob.mx gouv.fr gov.au gov.br gov.cn gov.il gov.in gov.pl gov.sg gov.tr gov.tw gov.uk gov.za govt.nz gr.jp id.au lg.jp ltd.uk me.uk ne.jp net.au net.br net.cn net.in net.nz net.pl "
    "net.uk net.za nhs.uk or.id or.jp or.kr or.th org.ar org.au org.br org.cn org.es org.hk org.il org.in org.mx org.nz org.pl org.sg org.tr org.tw org.uk org.za plc.uk sch.uk school.nz"
).split()
NUMERIC = r"^[0-9]+(\.[0-9]+){3}$"
LAST, LAST_TWO, LAST_THREE = r"[^.]*$", r"([^.]*\.)?[^.]*$", r"([^.]*\.)?([^.]*\.)?[^.]*$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HOST_PATH, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. Rules are configuration: a list in the driver, compiled into one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_parents(hosts: DataFrame) -> DataFrame:
    """host -> its public suffix, and its registered domain: the suffix and the label before it. Ports and user names are no part of them.

    A numeric address is a domain of its own; all of them have the suffix ``(ip)``.
    """
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    part = lambda pattern: F.regexp_extract(name, pattern, 0)
    numeric, two = name.rlike(NUMERIC), part(LAST_TWO).isin(SUFFIXES)
    domain = F.when(numeric, name).when(two, part(LAST_THREE)).otherwise(part(LAST_TWO))
    return hosts.withColumns({"domain": domain, "suffix": F.when(numeric, "(ip)").when(two, part(LAST_TWO)).otherwise(part(LAST))})


def shrunk(level: DataFrame, parents: DataFrame, key: str, parent: str, least_rho: float, most_rho: float) -> DataFrame:
    """(key, n, k) and its parents' (parent, mean): the level's beta posterior a, b and mean. One strength for the level, by moments."""
    rows = level.join(parents.select(parent, F.col("mean").alias("m")), parent)
    var = F.col("n") * F.col("m") * (1 - F.col("m"))
    over = F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), F.lit(2.0)) - var)
    room = F.sum(var * (F.col("n") - 1))
    rho = rows.agg(F.least(F.greatest(F.coalesce(over / F.nullif(room, F.lit(0.0)), F.lit(least_rho)), F.lit(least_rho)), F.lit(most_rho)).alias("rho"))
    strength = 1 / F.col("rho") - 1
    return (
        rows.crossJoin(F.broadcast(rho))  # one row
        .withColumns({"a": strength * F.col("m") + F.col("k"), "b": strength * (1 - F.col("m")) + F.col("n") - F.col("k")})
        .withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        .drop("m", "rho")
    )


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, least_rho: float = 0.001, most_rho: float = 0.5) -> DataFrame:
    """hosts (host), outcomes (host, bad 0/1) -> host, n, k, a, b, mean, bound: the lower posterior bound of the bad rate, z deviations below the mean."""
    counted = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    level = with_parents(
        hosts.groupBy("host").agg(F.lit(0.0).alias("none")).join(counted, "host", "left").select("host", F.coalesce("n", "none").alias("n"), F.coalesce("k", "none").alias("k"))
    )
    level = materialize(level, "hosts")  # each level reads it twice: a plan without it doubles with every level
    by_domain = level.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = by_suffix.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mean")).withColumn("root", F.lit(""))
    suffixes = shrunk(by_suffix.withColumn("root", F.lit("")), whole, "suffix", "root", least_rho, most_rho)
    domains = materialize(shrunk(by_domain, suffixes, "domain", "suffix", least_rho, most_rho).select("domain", "mean"), "domains")
    out = shrunk(level, domains, "host", "domain", least_rho, most_rho)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return out.withColumn("bound", F.col("mean") - z * sd).select("host", "n", "k", "a", "b", "mean", "bound")


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, most_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages (page_id, url), outcomes (host, bad) -> page_id, host, path, rule, verdict, bad_bound."""
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = host_reputation(rows.select("host"), outcomes, z=z).select("host", "bound")
    fit = rows.join(seen, "host").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_bound = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return fit.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_bound).alias("verdict"), F.round("bound", 6).alias("bad_bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page is bad if the document behind it is labelled toxic or of low quality."""
    ref = F.regexp_extract("url", PAGE_DOC, 1)
    of_page = pages.select(url_host(F.col("url")).alias("host"), F.when(ref != "", ref.cast("long")).alias("doc_id"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select("doc_id", bad.cast("int").alias("bad"))
    return of_page.join(marks, "doc_id").select("host", "bad")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels")))


_LEVEL = """{name}_m AS (SELECT c.*, p.mean AS m FROM {rows} c JOIN {parents} p ON c.{parent} = p.{parent}),
{name}_r AS (SELECT least(greatest(coalesce(sum(pow(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.001), 0.001), 0.5) AS rho FROM {name}_m),
{name} AS (SELECT *, a / (a + b) AS mean FROM (SELECT x.* EXCLUDE (m), (1 / rho - 1) * m + k AS a, (1 / rho - 1) * (1 - m) + n - k AS b FROM {name}_m x, {name}_r))"""

ORACLE = rf"""
WITH pg AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{HOST_PATH}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '{HOST_PATH}', 2), '') AS path, nullif(regexp_extract(url, '{PAGE_DOC}', 1), '')::BIGINT AS doc_id FROM pages),
marks AS (SELECT doc_id, (coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
counted AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM pg JOIN marks USING (doc_id) GROUP BY host),
named AS (SELECT h.host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, regexp_replace(regexp_replace(h.host, '^.*@', ''), ':[0-9]*$', '') AS name
    FROM (SELECT DISTINCT host FROM pg) h LEFT JOIN counted c ON h.host = c.host),
lv AS (SELECT host, n, k, CASE WHEN regexp_matches(name, '{NUMERIC}') THEN name WHEN two IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) THEN regexp_extract(name, '{LAST_THREE}', 0) ELSE two END AS domain,
    CASE WHEN regexp_matches(name, '{NUMERIC}') THEN '(ip)' WHEN two IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) THEN two ELSE regexp_extract(name, '{LAST}', 0) END AS suffix
    FROM (SELECT *, regexp_extract(name, '{LAST_TWO}', 0) AS two FROM named)),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM lv GROUP BY ALL),
sx AS (SELECT suffix, '' AS root, sum(n) AS n, sum(k) AS k FROM dm GROUP BY ALL),
al AS (SELECT '' AS root, (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM sx),
{_LEVEL.format(name="fs", rows="sx", parents="al", parent="root")},
{_LEVEL.format(name="fd", rows="dm", parents="fs", parent="suffix")},
{_LEVEL.format(name="fh", rows="lv", parents="fd", parent="domain")},
bd AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (a + b + 1)) AS bound FROM fh),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}) t(verdict, rhost, rpath)),
best AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM pg) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, x.rule, coalesce(x.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bad_bound
FROM pg p JOIN bd USING (host) LEFT JOIN best x ON p.page_id IS NOT DISTINCT FROM x.page_id AND p.host = x.host AND p.path = x.path
"""
