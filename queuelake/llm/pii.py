"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-in functions only.

Base kinds: email, ip, card (Luhn), phone. The method adds iban (mod 97) and ssn (kept only beside a context word). Patterns are written so
that Java's matcher neither recurses nor backtracks over long runs: quantifiers are possessive where nothing that follows could match what
they hold, and a run is tried from its start alone. Positions are code points of the whole text.

The plan is one projection over the scan: no shuffle, no join, no state. A row costs time in proportion to its own length; n matches, n log n.

Defined results: a null text is empty and has no spans; repeated rows each get theirs; further columns are ignored by ``scan`` and kept by
``with_spans``; an empty table gives an empty result. doc_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import found

LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"

#: kind -> (score of a confirmed span, words that raise it by CONTEXT_GAIN when within CONTEXT code points before it, and behind the match before)
KINDS = {
    "email": (0.85, "mail|contact|kontakt|correo|courriel|address"),
    "ip": (0.6, "ip|host|server|address|client|login"),
    "card": (0.75, "card|visa|credit|debit|karte|carte|tarjeta|payment"),
    "phone": (0.55, "phone|tel|call|mobile|fax|telefon|handy|appel"),
    "iban": (0.8, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (0.3, "ssn|social|security|tax"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT, CONTEXT_GAIN, LEAST = 40, 0.15, 0.4
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of digits: every second digit from the right counts as the digit sum of its double."""
    backwards = F.split(F.reverse(number), "")
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.translate(d, "0123456789", "0246813579").cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters go to the end, letters count from A = 10; the remainder is taken digit by digit."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda ch: F.when(ch >= "A", F.ascii(ch) - 55).otherwise(ch.cast("int"))
    step = lambda a, ch: F.when(ch == "", a).otherwise((a * F.when(ch >= "A", 100).otherwise(10) + value(ch)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        # leading zeros go, then by length: a part of any number of digits is judged without a number too large for its type
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(plain(p)) < 3) | ((F.length(plain(p)) == 3) & (plain(p) <= "255")))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}[kind]
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ssn": F.contains(text, F.lit("-"))}.get(kind, F.lit(True))
    score, words = KINDS[kind]

    def scored(s: Column) -> Column:
        raised = F.when(F.lower(s["before"]).rlike(rf"(?<![a-z])(?:{words})"), min(1.0, score + CONTEXT_GAIN)).otherwise(score)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), raised.cast("double").alias("score"))

    spans = F.transform(F.filter(found(text, pattern, beside=CONTEXT), lambda s: _valid(kind, s["hit"])), scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST)
    return F.when(gate, spans).otherwise(F.array().cast(SPANS))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one array of spans (kind, start, end, score) for each kind, in columns named ``pii_<kind>``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({f"pii_{kind}": kind_spans(whole, kind) for kind in KINDS})


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = _listed(F.concat(*(F.col(f"pii_{k}") for k in BASE)))
    every = _listed(F.concat(*(F.col(f"pii_{k}") for k in KINDS)))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
