"""License scan: ordered signature rules over whole texts, gated by keywords. Built-in functions only.

A text becomes its words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), joined by single spaces. Every rule has a keyword, one
word that any match of it holds; only the rules of keywords that are among a text's words run on it, so a text without such a word costs
one split and one set intersection. Each hit is a detection (label, priority, interval of words). Detections are walked by start, longer
first, higher priority first: one that lies within the interval of a detection of the same or a higher priority is suppressed, so
``cc by`` within ``cc by nc 4 0`` goes, and a bare name within a grant goes.

The plan is one projection over the scan: no shuffle, join or state; a row's cost grows with its own length.

Defined results: a null text is empty: no words, no labels, score 0. Ties of equal intervals go to the higher priority, then to the rule
listed first. Repeated rows each get their result; extra columns stay, but for n_words, places and detections, which are the result's; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .spans import SPANS, bound, found, running

#: Fixed values of the contract: phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Priority -> strength of the evidence; a base phrase counts BASE_WEIGHT.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.6, 4: 0.4}
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


#: label, keyword (a word of any match of the name), pattern of its SPDX id in words (None: another row has it), pattern of its name in words.
LICENSES = [
    ("apache-1.1", "apache", "apache 1 1", "apache (?:software )?licen[sc]e v(?:ersion )?1 1"),
    ("apache-2.0", "apache", "apache 2 0", "apache (?:software )?licen[sc]e (?:v|version )?2(?: 0)?"),
    ("apache", "apache", "apache", "apache (?:software )?licen[sc]e"),
    ("mit", "mit", "mit", "mit(?: x11| expat)? licen[sc]e"),
    ("mit-0", "mit", "mit 0", "mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", "x11", "x11 licen[sc]e"),
    ("isc", "isc", "isc", "isc licen[sc]e"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "freebsd", "bsd 2 clause freebsd", "freebsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("0bsd", "0bsd", "0bsd", "0bsd(?: licen[sc]e)?"),
    ("0bsd", "zero", None, "zero clause bsd(?: licen[sc]e)?"),
    ("bsd", "bsd", "bsd", "bsd (?:style )?licen[sc]e"),
    ("gpl-1.0", "general", "gpl 1 0(?: only| or later)?", "(?:gnu )?general public licen[sc]e v(?:ersion )?1(?: 0)?"),
    ("gpl-2.0", "general", "gpl 2 0(?: only| or later)?", "(?:gnu )?general public licen[sc]e (?:v|version )2(?: 0)?"),
    ("gpl-3.0", "general", "gpl 3 0(?: only| or later)?", "(?:gnu )?general public licen[sc]e (?:v|version )3(?: 0)?"),
    ("gpl", "general", "gpl", "(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", "gpl v?[123]", "gnu gpl(?: v ?[123])?"),
    ("lgpl-2.1", "lesser", "lgpl 2 1(?: only| or later)?", "(?:gnu )?lesser general public licen[sc]e (?:v|version )2 1"),
    ("lgpl-3.0", "lesser", "lgpl 3 0(?: only| or later)?", "(?:gnu )?lesser general public licen[sc]e (?:v|version )3(?: 0)?"),
    ("lgpl", "lesser", "lgpl", "(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", "library", "lgpl 2 0(?: only| or later)?", "(?:gnu )?library general public licen[sc]e"),
    ("agpl-3.0", "affero", "agpl 3 0(?: only| or later)?", "(?:gnu )?affero general public licen[sc]e (?:v|version )3(?: 0)?"),
    ("agpl", "affero", "agpl", "(?:gnu )?affero general public licen[sc]e"),
    ("gfdl", "documentation", "gfdl 1 [123](?: only| or later)?", "(?:gnu )?free documentation licen[sc]e"),
    ("mpl-1.1", "mozilla", "mpl 1 1", "mozilla public licen[sc]e (?:v|version )1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", "mozilla public licen[sc]e (?:v|version )?2(?: 0)?"),
    ("mpl", "mozilla", "mpl", "mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", "epl 1 0", "eclipse public licen[sc]e (?:v|version )?1 0"),
    ("epl-2.0", "eclipse", "epl 2 0", "eclipse public licen[sc]e (?:v|version )?2 0"),
    ("edl-1.0", "eclipse", "edl 1 0", "eclipse distribution licen[sc]e"),
    ("cddl-1.0", "cddl", "cddl 1 [01]", "cddl (?:v|version )?1 [01]"),
    ("cddl", "distribution", "cddl", "common development and distribution licen[sc]e"),
    ("cpl-1.0", "common", "cpl 1 0", "common public licen[sc]e"),
    ("ipl-1.0", "ibm", "ipl 1 0", "ibm public licen[sc]e"),
    ("eupl-1.2", "european", "eupl 1 [012]", "european union public licen[sc]e"),
    ("artistic-1.0", "artistic", "artistic 1 0", "artistic licen[sc]e (?:v|version )?1 0"),
    ("artistic-2.0", "artistic", "artistic 2 0", "artistic licen[sc]e (?:v|version )?2 0"),
    ("artistic", "artistic", "artistic", "artistic licen[sc]e"),
    ("bsl-1.0", "boost", "bsl 1 0", "boost software licen[sc]e"),
    ("busl-1.1", "business", "busl 1 1", "business source licen[sc]e"),
    ("sspl-1.0", "server", "sspl 1 0", "server side public licen[sc]e"),
    ("elastic-2.0", "elastic", "elastic 2 0", "elastic licen[sc]e"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "(?:the )?wtfpl"),
    ("beerware", "beerware", "beerware", "beerware licen[sc]e"),
    ("ms-pl", "microsoft", "ms pl", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", "ms rl", "microsoft reciprocal licen[sc]e"),
    ("afl-3.0", "academic", "afl 3 0", "academic free licen[sc]e"),
    ("osl-3.0", "open", "osl 3 0", "open software licen[sc]e"),
    ("ofl-1.1", "sil", "ofl 1 1", "sil open font licen[sc]e"),
    ("ncsa", "ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[sc]e"),
    ("python-2.0", "python", "psf 2 0|python 2 0", "python software foundation licen[sc]e"),
    ("ruby", "ruby", "ruby", "ruby licen[sc]e"),
    ("php-3.01", "php", "php 3 01?", "php licen[sc]e"),
    ("openssl", "openssl", "openssl", "openssl licen[sc]e"),
    ("vim", "vim", "vim", "vim licen[sc]e"),
    ("cc0-1.0", "cc0", "cc0 1 0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "nd", "cc by nc nd (?:[1-4] 0)", "(?:creative commons|cc) by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "sa", "cc by nc sa (?:[1-4] 0)", "(?:creative commons|cc) by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "nc", "cc by nc (?:[1-4] 0)", "(?:creative commons|cc) by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "nd", "cc by nd (?:[1-4] 0)", "(?:creative commons|cc) by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "sa", "cc by sa (?:[1-4] 0)", "(?:creative commons|cc) by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", "cc by (?:[1-4] 0)", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "sharealike", "cc by sa", "creative commons attribution sharealike(?: [1-4] 0)?"),
    ("cc-by-nc", "noncommercial", "cc by nc", "creative commons attribution noncommercial(?: [1-4] 0)?"),
    ("cc-by", "attribution", "cc by", "creative commons attribution(?: [1-4] 0)?(?: international)?"),
    ("cc", "creative", "cc pdm 1 0", "creative commons licen[sc]e"),
    ("odbl", "odbl", "odbl 1 0", "odbl(?: licen[sc]e)?"),
    ("odc-by", "data", "odc by 1 0", "open data commons attribution licen[sc]e"),
    ("pddl", "dedication", "pddl 1 0", "public domain dedication and licen[sc]e"),
]
#: How a text says that a license holds; {name} is the pattern of a name.
GRANTS = [
    r"(?:dual |multi )?licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}",
    r"(?:re)?(?:released|distributed|published|provided|available|offered|covered|governed) (?:by|under) (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}",
    r"(?:redistribute|modify|use|copy) (?:it|this [a-z]+) under the terms of (?:the )?(?:gnu )?{name}",
]
#: Signatures of texts and notices that name no license, or that say that there is none.
NOTICES = [
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 1),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 1),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this (?:software|work)", 1),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software", 1),
    ("gpl", "foundation", "as published by the free software foundation either version [123]", 1),
    ("gpl-2.0", "version", "either version 2 of the licen[sc]e or at your option any later version", 1),
    ("gpl-3.0", "version", "either version 3 of the licen[sc]e or at your option any later version", 1),
    ("zlib", "freely", "to alter it and redistribute it freely subject to the following restrictions", 1),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1),
    ("bsl-1.0", "boost", "distributed under the boost software licen[sc]e", 1),
    ("warranty-disclaimer", "warranty", "provided as is without warranty of any kind", 2),
    ("warranty-disclaimer", "merchantability", "implied warranty of merchantability", 2),
    ("public-domain", "domain", "(?:released into|dedicated to|placed in|in) the public domain", 2),
    ("public-domain", "domain", "public domain", 4),
    ("reserved", "reserved", "all rights reserved", 3),
    ("reserved", "reserved", "some rights reserved", 4),
    ("proprietary", "proprietary", "proprietary and confidential", 2),
    ("proprietary", "confidential", "confidential and proprietary", 2),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction)[a-z ]{0,40} is (?:strictly )?prohibited", 2),
    ("proprietary", "permission", "(?:may not|must not|not to) be (?:reproduced|copied|distributed)[a-z ]{0,60} without (?:the )?(?:prior |express )?(?:written )?permission", 2),
    ("no-train", "training", "may not be used (?:for|in) (?:the )?training of [a-z ]{0,40}models?", 2),
    ("no-train", "mining", "text and data mining (?:is )?(?:not (?:allowed|permitted)|prohibited|reserved)", 2),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 4),
]


def rules() -> list[Rule]:
    """In order: earlier is preferred among equals. An SPDX line is priority 1, a grant 2, a bare name 3, a weak notice 4."""
    out = [Rule(label, "spdx", f"spdx licen[sc]e identifier (?:{spdx})", 1) for label, _, spdx, _ in LICENSES if spdx]
    out += [Rule(*n) for n in NOTICES]
    out += [Rule(label, kw, g.format(name=f"(?:{name})"), 2) for label, kw, _, name in LICENSES for g in GRANTS]
    return out + [Rule(label, kw, name, 3) for label, kw, _, name in LICENSES]


DETECTIONS = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"


def normal(text: Column) -> Column:
    """' w1 w2 ... ': a space before, between and after the words; '' if there are none."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def detections(norm: Column, keywords: Column, chosen: list[Rule]) -> Column:
    """All hits of the rules whose keyword is among keywords, sorted by start, longer first, higher priority first, rule."""
    listed = F.array(*(F.struct(F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("rx"), F.lit(r.priority).alias("priority"), F.lit(i).alias("rule"), F.lit(r.label).alias("label")) for i, r in enumerate(chosen)))
    due = F.filter(listed, lambda r: F.array_contains(keywords, r["keyword"]))
    hits = F.flatten(F.transform(due, lambda r: F.transform(found(norm, r["rx"], words=True), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))))
    ordered = F.array_sort(hits)  # structs compare field by field
    return F.transform(ordered, lambda d: F.struct(d["start"].alias("start"), (-d["last"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))


def unsuppressed(found_: Column) -> Column:
    """Without those within an interval of the same or a higher priority that was kept or not: who lies in it lies in its holder too.

    ends[p-1] is the furthest end of priority p or higher so far; starts only grow, so a detection lies in an earlier one iff it ends no later.
    """
    levels = sorted(WEIGHTS)

    def ends(d: Column, p: int) -> Column:
        return F.transform(d, lambda x: F.when(x["priority"] <= p, x["end"]).otherwise(0))

    def kept(d: Column) -> Column:
        furthest = [running(ends(d, p), F.greatest) for p in levels]
        # level by level: of each detection of this priority, the furthest end before it
        outer = [F.concat(F.array(F.lit(0)), f) for f in furthest]
        marked = F.arrays_zip(d.alias("d"), *(o.alias(f"e{p}") for p, o in zip(levels, outer, strict=True)))
        free = lambda m: F.coalesce(*(F.when(m["d"]["priority"] == p, m[f"e{p}"] < m["d"]["end"]) for p in levels), F.lit(False))
        return F.transform(F.filter(marked, free), lambda m: m["d"])

    return bound(found_, kept)


def _places(norm: Column, phrase: str, label: str) -> Column:
    hits = F.when(F.contains(norm, F.lit(f" {phrase} ")), found(norm, f"(?<= ){phrase}(?= )", words=True)).otherwise(F.array().cast(SPANS))
    return F.transform(hits, lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text", chosen: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, places (label, start, end: base phrases) and detections (those not suppressed); intervals in words, end exclusive."""
    chosen = rules() if chosen is None else chosen
    gate = F.array(*(F.lit(k) for k in sorted({r.keyword for r in chosen})))
    none = F.array().cast(DETECTIONS)
    norm, keywords = (f"{'_' * (1 + max(map(len, docs.columns)))}{name}" for name in ("norm", "keywords"))  # longer than any column of docs
    out = docs.withColumn(norm, normal(F.col(text)))
    out = out.withColumn(keywords, F.array_intersect(F.split(norm, " "), gate))
    places = F.concat(*(_places(F.col(norm), phrase, label) for phrase, label in BASE.items()))
    hits = F.when(F.size(keywords) > 0, unsuppressed(detections(F.col(norm), F.col(keywords), chosen))).otherwise(none)
    words = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return out.withColumns({"n_words": F.greatest(words - 1, F.lit(0)).cast("long"), "places": places, "detections": hits}).drop(norm, keywords)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    base = F.transform("places", lambda p: p["label"])
    every = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    weight = F.create_map(*(F.lit(x) for p, w in WEIGHTS.items() for x in (p, w)))
    best = F.array_max(F.transform("detections", lambda d: weight[d["priority"]]))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, BASE_WEIGHT).otherwise(0.0))
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(every).alias("labels"), score.cast("double").alias("score"))
