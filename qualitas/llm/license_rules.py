"""Operator 11: license scans by ordered signature rules, in DataFrame functions only.

A text becomes its words (runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case), each
between two blanks of its own: `` under  the  mit  license ``.  Rules are regular expressions over that form, so a
match begins and ends at word borders and punctuation and line breaks don't matter.  A rule has a label, a weight
and a keyword, a literal that every match of it contains.

1. Few anchors, one of which is in every keyword, decide whether a text is looked at further at all.
2. Of the rules those run whose keyword the text contains.
3. Detections are word intervals.  One that lies within another (the longer one, or of equal ones the earlier rule's)
   is suppressed.  Of what is left, read from left to right, an interval that overlaps the one kept before it
   replaces it if its rule comes earlier, and is dropped otherwise.

Rules come in the order of their trust: phrases given by the caller (base), texts of licenses, identifiers,
addresses, notices, names with a version, names.  Base detections are reported in any case.

Null texts and texts without words have no words and no detections.  Rows are handled one by one, so repeated rows
and ids, null ids and the order of rows don't matter, and columns other than the id and the text are ignored.  An
empty table gives an empty result.
"""
from __future__ import annotations

import functools
import json
import re
import string
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that separates words, in texts whose letters are still of both cases.
NOT_WORDS = r"[\x00-/:-@\[-`{-\x7f]++"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is written with one blank between words; ``keyword`` is part of every text that it matches
    (with a leading blank: at the beginning of a word)."""

    label: str
    keyword: str
    pattern: str
    weight: float
    base: bool = False


def spaced(pattern: str) -> str:
    """A pattern for words that have a blank of their own on either side."""
    return f" {pattern.replace(' ', '  ')} "


# The phrases that op11 reports in any case, and their labels.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

_LICENSE = "licen[cs]e"
#: Families with versions: label, name, keyword of the name, short name (or None), versions.
VERSIONED = (
    ("apache", rf"apache(?: software)?(?: {_LICENSE})?", "apache", None, ("1", "1.1", "2")),
    ("gpl", rf"(?:gnu )?general public {_LICENSE}", "general public licen", "gpl", ("1", "2", "3")),
    ("lgpl", rf"(?:gnu )?(?:lesser|library)(?: general)? public {_LICENSE}", "public licen", "lgpl", ("2", "2.1", "3")),
    ("agpl", rf"(?:gnu )?affero(?: general)? public {_LICENSE}", "public licen", "agpl", ("1", "3")),
    ("gfdl", rf"(?:gnu )?free documentation {_LICENSE}", "free documentation licen", None, ("1.1", "1.2", "1.3")),
    ("mpl", rf"mozilla public {_LICENSE}", "mozilla public licen", " mpl", ("1", "1.1", "2")),
    ("epl", rf"eclipse public {_LICENSE}", "eclipse public licen", " epl", ("1", "2")),
    ("eupl", rf"european union public {_LICENSE}", "european union public licen", " eupl", ("1", "1.1", "1.2")),
    ("cddl", rf"common development and distribution {_LICENSE}", "common development and distribution licen", " cddl",
     ("1", "1.1")),
    ("cpl", rf"common public {_LICENSE}", "common public licen", None, ("1",)),
    ("ipl", rf"ibm public {_LICENSE}", "ibm public licen", None, ("1",)),
    ("osl", rf"open software {_LICENSE}", "open software licen", None, ("1", "2", "2.1", "3")),
    ("afl", rf"academic free {_LICENSE}", "academic free licen", None, ("1.1", "1.2", "2", "2.1", "3")),
    ("artistic", rf"artistic {_LICENSE}", "artistic licen", None, ("1", "2")),
    ("php", rf"php {_LICENSE}", "php licen", None, ("3", "3.01")),
    ("python", rf"python(?: software foundation)? {_LICENSE}", "licen", None, ("2", "2.0.1")),
    ("zpl", rf"zope public {_LICENSE}", "zope public licen", None, ("1.1", "2", "2.1")),
    ("lppl", rf"latex project public {_LICENSE}", "latex project public licen", None, ("1", "1.1", "1.2", "1.3")),
    ("ofl", rf"(?:sil )?open font {_LICENSE}", "open font licen", None, ("1", "1.1")),
    ("bsl", rf"boost software {_LICENSE}", "boost software licen", None, ("1",)),
    ("busl", rf"business source {_LICENSE}", "business source licen", None, ("1", "1.1")),
    ("sspl", rf"server side public {_LICENSE}", "server side public licen", None, ("1",)),
    ("elastic", rf"elastic {_LICENSE}", "elastic licen", None, ("1", "2")),
    ("odbl", rf"(?:odc )?open database {_LICENSE}", "open database licen", None, ("1",)),
    ("odc-by", rf"open data commons attribution {_LICENSE}", "attribution licen", None, ("1",)),
    ("pddl", rf"public domain dedication and {_LICENSE}", "public domain dedication", None, ("1",)),
    ("cecill", rf"cecill(?: free software {_LICENSE}(?: agreement)?)?", "cecill", None, ("1", "1.1", "2", "2.1")),
    ("ms-pl", rf"microsoft public {_LICENSE}", "microsoft public licen", None, ()),
    ("ms-rl", rf"microsoft reciprocal {_LICENSE}", "microsoft reciprocal licen", None, ()),
    ("apsl", rf"apple public source {_LICENSE}", "apple public source licen", None, ("1", "1.1", "2")),
    ("qpl", rf"q public {_LICENSE}", "q public licen", None, ("1",)),
    ("nosa", r"nasa open source agreement", "nasa open source agreement", None, ("1.3",)),
    ("upl", rf"universal permissive {_LICENSE}", "universal permissive licen", None, ("1",)),
    ("ecl", rf"educational community {_LICENSE}", "educational community licen", None, ("1", "2")),
    ("ncsa", rf"(?:university of illinois )?ncsa open source {_LICENSE}", "ncsa open source licen", None, ()),
    ("wtfpl", rf"do what the fuck you want to public {_LICENSE}", "want to public licen", None, ("1", "2")),
    ("mit", rf"(?:mit|expat|mit expat|mit x11|x11) {_LICENSE}", "licen", None, ()),
    ("mit-0", rf"mit no attribution {_LICENSE}", "no attribution licen", None, ()),
    ("isc", rf"isc {_LICENSE}", "isc licen", None, ()),
    ("zlib", rf"zlib(?: libpng)? {_LICENSE}", "licen", None, ()),
    ("unlicense", r"the unlicense", "the unlicense", None, ()),
    ("0bsd", rf"(?:zero clause|bsd zero clause|0 clause|free public) bsd {_LICENSE}", "bsd licen", None, ()),
    ("bsd-2-clause", rf"(?:2 clause|two clause|simplified|freebsd) bsd(?: {_LICENSE})?", " bsd", None, ()),
    ("bsd-3-clause", rf"(?:3 clause|three clause|new|modified|revised) bsd {_LICENSE}", "bsd licen", None, ()),
    ("bsd-4-clause", rf"(?:4 clause|four clause|original) bsd {_LICENSE}", "bsd licen", None, ()),
    ("bsd", rf"bsd(?: style)? {_LICENSE}", "licen", None, ()),
    ("postgresql", rf"postgresql {_LICENSE}", "postgresql licen", None, ()),
    ("openssl", rf"openssl {_LICENSE}", "openssl licen", None, ()),
    ("curl", rf"curl {_LICENSE}", "curl licen", None, ()),
    ("vim", rf"vim {_LICENSE}", "vim licen", None, ()),
    ("ruby", rf"ruby(?: s)? {_LICENSE}", "licen", None, ()),
    ("json", rf"json {_LICENSE}", "json licen", None, ()),
    ("beerware", rf"beer ?ware {_LICENSE}", "ware licen", None, ()),
)

#: Identifiers without a version, as words, after "SPDX-License-Identifier:" or in an address of the license's text.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("0bsd", "0bsd"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"),
    ("postgresql", "postgresql"), ("openssl", "openssl"), ("curl", "curl"), ("vim", "vim"), ("ruby", "ruby"),
    ("json", "json"), ("beerware", "beerware"), ("ncsa", "ncsa"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"),
    ("wtfpl", "wtfpl"), ("x11", "x11"), ("ntp", "ntp"), ("hpnd", "hpnd"), ("fair", "fair"), ("blueoak-1", "blueoak 1 0 0"),
)

#: Elements of the Creative Commons licenses, their long names, and their versions.
CC_ELEMENTS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s"),
               ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
               ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
CC_VERSIONS = ("1", "2", "2.5", "3", "4")

#: Sentences out of the licenses' own texts.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of"
     r" this software and associated documentation files"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be"
     r" included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any"
     r" purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any"
     r" purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its"
     r" documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without"
     r" modification are permitted"),
    ("bsd-2-clause", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright"
     r" notice this list of conditions and the following disclaimer in the documentation and or other materials provided"
     r" with the distribution this software is provided"),
    ("bsd-3-clause", "derived from this software", r"neither the name of(?: \S+){1,8} may be used to endorse or promote"
     r" products derived from this software"),
    ("bsd-4-clause", "use of this software", r"all advertising materials mentioning features or use of this"
     r" software must display the following acknowledge?ment"),
    ("gpl", "public licen", r"you can redistribute it and or modify it under the terms of the gnu general"
     r" public licen[cs]e as published by the free software foundation"),
    ("gpl-2", "of the licen", r"either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3", "of the licen", r"either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl", "public licen", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e as"
     r" published by the free software foundation"),
    ("agpl", "public licen", r"under the terms of the gnu affero general public licen[cs]e as published by the"
     r" free software foundation"),
    ("gpl", "general public licen", r"you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", "general public licen", r"you should have received a copy of the gnu lesser general public licen[cs]e"
     r" along with"),
    ("agpl", "general public licen", r"you should have received a copy of the gnu affero general public licen[cs]e"
     r" along with"),
    ("gfdl", "free documentation licen", r"permission is granted to copy distribute and or modify this"
     r" document under the terms of the gnu free documentation licen[cs]e"),
    ("apache-2", "except in compliance with the license", r"you may not use this file except in compliance with the license"
     r" you may obtain a copy of the license at(?: https?)?(?: www)? apache org licenses license 2 0"),
    ("apache-2", "apache license", r"licensed under the apache license version 2 0 the license"),
    ("mpl-2", "mozilla public licen", r"this source code form is subject to the terms of the mozilla"
     r" public licen[cs]e v 2 0"),
    ("mpl-1.1", "mozilla public licen", r"the contents of this file are subject to the mozilla public"
     r" licen[cs]e version 1 1"),
    ("epl-1", "eclipse public licen", r"this program and the accompanying materials are made available"
     r" under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2", "eclipse public licen", r"this program and the accompanying materials are made available"
     r" under the terms of the eclipse public licen[cs]e(?: v)? (?:v )?2 0"),
    ("bsl-1", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization"
     r" obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("zlib", "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose"
     r" including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:placed in|released into|dedicated to|is in|are in) the public domain"),
    ("cc0-1", "public domain dedication", r"cc0 1 0 universal(?: cc0 1 0)? public domain dedication"),
    ("cc0-1", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("ofl-1.1", "open font licen", r"this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("artistic-2", "of this licen", r"everyone is permitted to copy and distribute verbatim copies of this"
     r" licen[cs]e document but changing it is not allowed"),
    ("upl-1", "universal permissive licen", r"the universal permissive licen[cs]e upl version 1 0"),
    ("ncsa", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of"
     r" this software and associated documentation files the software to deal with the software without restriction"),
    ("json", "used for good not evil", r"the software shall be used for good not evil"),
    ("cc-by", "creative commons", r"this work is licensed under(?: the)? creative commons attribution"
     r" international licen[cs]e"),
)

#: Addresses of licenses, as words.
ADDRESSES = (
    ("apache-2", "apache org licenses", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache org licenses", r"apache org licenses license 1 1"),
    ("gpl-2", "gnu org", r"gnu org (?:old )?licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", "gnu org", r"gnu org (?:licenses gpl|copyleft gpl|licenses gpl 3 0)"),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) lgpl"),
    ("agpl-3", "gnu org", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl"),
    ("mpl-2", "mozilla org", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", r"mozilla org (?:en us )?mpl(?: mpl)? 1 1"),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10"),
    ("epl-2", "eclipse org", r"eclipse org legal epl (?:v20|2 0)"),
    ("cc0-1", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("bsl-1", "boost org license", r"boost org license 1 0"),
    ("ofl-1.1", "scripts sil org", r"scripts sil org ofl"),
    ("odbl-1", "opendatacommons org licenses", r"opendatacommons org licenses odbl"),
    ("odc-by-1", "opendatacommons org licenses", r"opendatacommons org licenses by"),
    ("pddl-1", "opendatacommons org licenses", r"opendatacommons org licenses pddl"),
    ("eupl", "ec europa eu", r"joinup ec europa eu(?: \S+){0,6} eupl"),
    ("cecill", "cecill", r"cecill info licen[cs]es"),
    ("wtfpl", " wtfpl", r"wtfpl net"),
    ("zlib", "zlib license", r"zlib net zlib license"),
    ("php", "php net license", r"php net license"),
    ("python", "org 3 license", r"docs python org 3 license"),
)

_NOTICE = (r"(?:licen[cs]ed|released|distributed|available|published|provided|covered)(?: \S+){0,2} under(?: the)?"
           r"(?: terms(?: and conditions)? of)?(?: the)?")


def version_words(version: str) -> str:
    """A version as words: "2" also as "2.0"."""
    return f"{version}(?: 0)?" if "." not in version else version.replace(".", " ")


def base_rules(phrases=BASE_PHRASES) -> list[Rule]:
    return [Rule(label, phrase, phrase, 0.9, base=True) for label, phrase in phrases]


@functools.cache
def signature_rules() -> tuple[Rule, ...]:
    """All rules in the order of their priority."""
    texts = [Rule(label, keyword, pattern, 1.0) for label, keyword, pattern in TEXTS]
    ids = [Rule(label, "spdx licen", rf"spdx {_LICENSE} identifier {words}", 1.0) for label, words in IDENTIFIERS]
    sites = [Rule(label, keyword, pattern, 0.95) for label, keyword, pattern in ADDRESSES]
    sites += [Rule(label, "org licenses", rf"opensource org licenses {words}", 0.95) for label, words in IDENTIFIERS]
    names, plain = [], []

    def named(label, keyword, pattern, weight):
        return [Rule(label, keyword, f"{_NOTICE} {pattern}", 0.9), Rule(label, keyword, pattern, weight)]

    for label, name, keyword, short, versions in VERSIONED:
        for version in versions:
            said, words = f"{label}-{version}", version_words(version)
            later = "(?: only| or later| plus)?"
            ids.append(Rule(said, "spdx licen", rf"spdx {_LICENSE} identifier {label.replace('-', ' ')} {words}{later}", 1.0))
            sites.append(Rule(said, "org licenses", f"opensource org licenses {label.replace('-', ' ')} {words}", 0.95))
            names += named(said, keyword, f"{name}(?: version| ver| v)? v?{words}{later}", 0.8)
            if short:
                name_of = short.strip()
                names += named(said, short, f"(?:{name_of}(?: version| v| {_LICENSE}| {_LICENSE} version)? v?|{name_of}v)"
                                            f"{words}{later}", 0.6)
        if label != "apache":                                  # alone it is the name of much else
            plain += named(label, keyword, name, 0.5)
        else:
            plain += named(label, keyword, rf"apache(?: software)? {_LICENSE}", 0.5)
    for element, name in CC_ELEMENTS:
        words = element.replace("-", " ")
        for version in CC_VERSIONS:
            said, at = f"cc-{element}-{version}", version_words(version)
            ids.append(Rule(said, "spdx licen", rf"spdx {_LICENSE} identifier cc {words} {at}", 1.0))
            sites.append(Rule(said, "creativecommons org", rf"creativecommons org licenses {words} {at}", 0.95))
            names += named(said, f"cc {words.split()[0]}", rf"cc {words} {at}", 0.8)
            names += named(said, "creative commons", rf"creative commons {name}(?: licen[cs]e)?(?: version| v)? {at}", 0.8)
        plain += named(f"cc-{element}", f"cc {words.split()[0]}", f"cc {words}", 0.6)
        plain += named(f"cc-{element}", "creative commons", f"creative commons {name}", 0.6)
    plain.append(Rule("cc0-1", "cc0", r"cc0(?: 1 0)?", 0.6))
    return (*base_rules(), *texts, *ids, *sites, *names, *plain)


def literal(keyword: str) -> str:
    """A keyword as it stands in a text whose words have blanks of their own; a leading blank begins a word."""
    return (" " if keyword.startswith(" ") else "") + keyword.strip().replace(" ", "  ")


def anchors(rules) -> list[str]:
    """Literals, one of which is in every keyword: "licen", and the shortest of the keywords without it."""
    rest = {literal(r.keyword) for r in rules if "licen" not in r.keyword}
    return ["licen", *sorted(k for k in rest if not any(other != k and other in k for other in rest))]


def _gates(rules) -> Column:
    """The rules by keyword, as one constant."""
    by: dict[str, list] = {}
    for i, r in enumerate(rules):
        rule = asdict(r) | {"rule": i, "pattern": spaced(r.pattern)}
        by.setdefault(literal(r.keyword), []).append({k: v for k, v in rule.items() if k != "keyword"})
    rows = [{"keyword": k, "rules": v} for k, v in by.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,rules:array<struct<rule:int,label:string,"
                                                "pattern:string,weight:double,base:boolean>>>>")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(text: Column, pattern: Column) -> Column:
    """Word intervals ``start, end`` (exclusive) of all matches: blanks before them and within them, counted by halves."""
    steps = F.zip_with(F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda before, match: F.struct(_blanks(before).alias("before"), _blanks(match).alias("within")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(done, s):
        first = done["at"] + s["before"]
        last = first + F.coalesce(s["within"], F.lit(0))
        found = F.struct(F.shiftright(first, 1).alias("start"), F.shiftright(last, 1).alias("end"))
        return F.struct(last.alias("at"), F.when(s["within"].isNull(), done["out"]).otherwise(
            F.concat(done["out"], F.array(found))).alias("out"))

    return F.aggregate(steps, start, step, lambda done: done["out"])


#: A detection, in the order in which they are sorted: by start, longest first, earliest rule first.
DETECTION = "struct<start:long,less:long,rule:int,label:string,weight:double,base:boolean>"


def _detections(text: Column, gates: Column) -> Column:
    fired = F.flatten(F.transform(F.filter(gates, lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    return F.array_sort(F.flatten(F.transform(fired, lambda r: F.transform(
        _places(text, r["pattern"]), lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("less"), r["rule"].alias("rule"), r["label"].alias("label"),
            r["weight"].alias("weight"), r["base"].alias("base"))))))


def _kept(detections: Column) -> Column:
    """Sorted detections without those that others suppress."""
    none = F.array().cast(f"array<{DETECTION}>")
    start = F.struct(F.lit(0).cast("long").alias("reach"), none.alias("kept"))

    def step(done, d):
        last = F.try_element_at(done["kept"], F.lit(-1))
        apart = last.isNull() | (d["start"] >= -last["less"])
        kept = (F.when(-d["less"] <= done["reach"], done["kept"])
                .when(apart, F.concat(done["kept"], F.array(d)))
                .when(d["rule"] < last["rule"], F.concat(F.slice(done["kept"], F.lit(1), F.size(done["kept"]) - 1),
                                                        F.array(d)))
                .otherwise(done["kept"]))
        return F.struct(F.greatest(done["reach"], -d["less"]).alias("reach"), kept.alias("kept"))

    return F.aggregate(detections, start, step, lambda done: done["kept"])


def scan(docs: DataFrame, rules=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, base, detections`` of every row: all base detections, and those that stay, by start.

    A detection has ``start, end, rule, label, weight, base``; words are counted from 0 and ends are exclusive.
    """
    rules = signature_rules() if rules is None else rules
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), NOT_WORDS, "  "))
    read = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    size = F.when(F.col("words") == "", F.lit(0)).otherwise(F.shiftright(_blanks(F.col("words")), 1) + 1)
    framed = F.concat(F.lit(" "), "words", F.lit(" "))
    gate = functools.reduce(Column.__or__, [F.contains(F.col("framed"), F.lit(a)) for a in anchors(rules)])
    lower = F.translate(framed, string.ascii_uppercase, string.ascii_lowercase)
    gated = (read.select("doc_id", size.cast("long").alias("n_words"), lower.alias("framed"))
             .select("doc_id", "n_words", F.when(gate, F.col("framed")).alias("text")))
    found = gated.select("doc_id", "n_words", F.when(
        F.col("text").isNotNull(), _detections(F.col("text"), _gates(rules))).alias("found"))
    shown = lambda ds: F.transform(ds, lambda d: F.struct(
        d["start"].alias("start"), (-d["less"]).alias("end"), d["rule"].alias("rule"), d["label"].alias("label"),
        d["weight"].alias("weight"), d["base"].alias("base")))
    none = F.array().cast(f"array<{DETECTION}>")
    return found.select(
        "doc_id", "n_words",
        shown(F.coalesce(F.filter("found", lambda d: d["base"]), none)).alias("base"),
        shown(F.coalesce(F.when(F.size("found") > 0, _kept(F.col("found"))), none)).alias("detections"))


def labels(detections: Column) -> Column:
    """The distinct labels of detections, sorted."""
    return F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"])))


def matches(rules, words: list[str]):
    """The rules' definition on plain words, for tests: ``(start, end, rule)`` of all detections, unresolved."""
    text = "".join(f" {w} " for w in words)
    for i, r in enumerate(rules):
        for m in re.finditer(spaced(r.pattern), text):
            yield text[:m.start()].count(" ") // 2, text[:m.end()].count(" ") // 2, i
