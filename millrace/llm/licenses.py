"""Licence scans by ordered signature rules, in SQL functions only.

A text is reduced to its words in lower case, joined by single spaces.  Each
rule is a regular expression over that form with a label, keywords, a priority and
a weight.  A rule's expression runs only where one of its keywords stands; texts
without any keyword or base phrase skip all of them.  Detections are intervals of
words.  One is suppressed when another contains its interval and has a higher
priority, or the same priority and more words, or the same interval and an
earlier rule.  What remains gives the labels.

Rules are of two kinds.  Written ones (`NOTICES`) are signatures of single
licences: opening and telling sentences of their texts, their addresses, and
general notices.  The others are made from families of licences (`FAMILIES`,
22 names without a version and 36 with one) in the phrasings in which notices name them
(`PHRASINGS`), and versions also by their bare names.

A text's work grows as its length, and as the number of its detections to 1.5.

Base phrases (`BASE`) are found apart from the rules and never suppressed.

Everything happens inside a row, so the scan needs no shuffle, and no group of
rows can be too large for a task.

Defined results: null or empty text has no words, no places and score 0; null
keys, repeated rows and extra columns are of no account; an empty table gives
no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: phrase: label
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Family(NamedTuple):
    """A licence or a version of one: its label, how it is named, words of which every naming has one (by |)."""

    label: str
    name: str
    keywords: str


class Rule(NamedTuple):
    """A signature. `regex` is over words joined by single spaces."""

    label: str
    keywords: str
    regex: str
    priority: int
    weight: float


def _versions(label: str, name: str, keywords: str, versions: tuple[str, ...]) -> list[Family]:
    """Each version of a licence, then the licence without one."""

    def digits(v: str) -> str:
        major, _, minor = v.partition(".")
        tail = f"(?: {minor})?" if minor == "0" else f" {minor}" if minor else ""
        return rf"(?:version |v|ver |v )?{major}{tail}(?! \d)"

    own = [Family(f"{label}-{v}", rf"{name}(?: license)? {digits(v)}", keywords) for v in versions]
    return [*own, Family(label, name, keywords)]


FAMILIES: list[Family] = [
    *_versions("gpl", r"(?:gnu )?(?:gpl|general public license)", " gpl| general public license ", ("1.0", "2.0", "3.0")),
    *_versions("lgpl", r"(?:gnu )?(?:lgpl|lesser general public license|library general public license)", " lgpl| lesser general public | library general public ", ("2.0", "2.1", "3.0")),
    *_versions("agpl", r"(?:gnu )?(?:agpl|affero general public license)", " agpl| affero ", ("1.0", "3.0")),
    *_versions("gfdl", r"(?:gnu )?(?:gfdl|free documentation license)", " gfdl| free documentation license ", ("1.1", "1.2", "1.3")),
    *_versions("apache", r"apache(?: software)?(?: license)?", " apache ", ("1.0", "1.1", "2.0")),
    *_versions("mpl", r"(?:mpl|mozilla public license)", " mpl | mozilla public ", ("1.0", "1.1", "2.0")),
    *_versions("epl", r"(?:epl|eclipse public license)", " epl | eclipse public ", ("1.0", "2.0")),
    *_versions("eupl", r"(?:eupl|european union public licen[cs]e)", " eupl | european union public ", ("1.1", "1.2")),
    *_versions("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w+)", " cc by nc| creative commons attribution ", ("3.0", "4.0")),
    *_versions("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", " cc by nc| creative commons attribution ", ("3.0", "4.0")),
    *_versions("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", " cc by nc| creative commons attribution ", ("3.0", "4.0")),
    *_versions("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv\w+)", " cc by nd| creative commons attribution ", ("3.0", "4.0")),
    *_versions("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", " cc by sa| creative commons attribution ", ("3.0", "4.0")),
    *_versions("cc-by", r"(?:cc by|creative commons attribution)", " cc by | creative commons attribution ", ("3.0", "4.0")),
    Family("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?", " cc0 | cc zero | creative commons zero "),
    Family("mit", r"mit(?: x11)?(?= licen[cs]e)", " mit licen| mit x11 licen"),
    Family("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)", " bsd "),
    Family("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)", " bsd "),
    Family("bsd", r"bsd", " bsd "),
    Family("isc", r"isc(?= licen[cs]e)", " isc licen"),
    Family("zlib", r"zlib(?: libpng)?(?= licen[cs]e)", " zlib licen| zlib libpng licen"),
    Family("boost-1.0", r"boost software license(?: version)?(?: 1 0)?", " boost software license "),
    Family("artistic-2.0", r"artistic license(?: version)? 2(?: 0)?", " artistic license "),
    Family("unlicense", r"unlicense", " unlicense "),
    Family("wtfpl", r"wtfpl", " wtfpl "),
]

#: How a notice names a licence; {name} is the family's pattern.
PHRASINGS: list[tuple[str, int, float]] = [
    (r"this (?:work|program|software|file|document|text|article|page|project|code|library) is (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |an? )?{name}(?: licen[cs]e)?", 90, 0.95),
    (r"(?:licensed|released|distributed|available|published|provided|relicensed|covered) (?:to you )?under (?:the terms (?:and conditions )?of )?(?:the |an? )?{name}(?: licen[cs]e)?", 80, 0.9),
    (r"spdx license identifier {name}", 95, 0.99),
    (r"under the (?:terms|conditions) of (?:the )?{name}(?: licen[cs]e)?", 70, 0.8),
    (r"(?:subject|according|pursuant) to (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", 65, 0.7),
    (r"(?:see|read|copy of) (?:the )?{name}(?: licen[cs]e)?", 40, 0.4),
    (r"(?:license|licence|lizenz|licencia) {name}", 50, 0.6),
    (r"{name} licen[cs]e", 45, 0.5),
]

#: Opening and telling sentences of licences, their addresses, and notices that name no family.
NOTICES: list[Rule] = [
    Rule("apache-2.0", " apache license version 2 0 january ", r"apache license version 2 0 january 2004", 97, 0.99),
    Rule("apache-2.0", " the license you may not use ", r"licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license", 96, 0.99),
    Rule("apache-2.0", " agreed to in writing software ", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 92, 0.9),
    Rule("apache-2.0", " apache org licenses ", r"(?:www )?apache org licenses license 2 0(?: txt| html)?", 88, 0.9),
    Rule("apache-1.1", " apache software foundation ", r"this product includes software developed by the apache software foundation", 75, 0.7),
    Rule("mit", " permission is hereby granted ", r"permission is hereby granted free of charge to any person obtaining a copy", 85, 0.95),
    Rule("mit", " substantial portions ", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 86, 0.95),
    Rule("mit", " opensource org licenses mit ", r"opensource org licenses mit(?: license)?", 84, 0.9),
    Rule("json", " good not evil ", r"the software shall be used for good not evil", 93, 0.95),
    Rule("bsd", " redistribution and use in source ", r"redistribution and use in source and binary forms with or without modification are permitted", 85, 0.95),
    Rule("bsd-2-clause", " redistributions of source code ", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 82, 0.85),
    Rule("bsd-2-clause", " redistributions in binary form ", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 82, 0.85),
    Rule("bsd-3-clause", " endorse or promote ", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|the|their) contributors may be used to endorse or promote products", 90, 0.95),
    Rule("bsd-4-clause", " advertising materials mentioning ", r"all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment", 91, 0.95),
    Rule("gpl-2.0", " version 2 june 1991 ", r"gnu general public license version 2 june 1991", 97, 0.99),
    Rule("gpl-3.0", " version 3 29 june 2007 ", r"gnu general public license version 3 29 june 2007", 97, 0.99),
    Rule("lgpl-2.0", " version 2 june 1991 ", r"gnu library general public license version 2 june 1991", 98, 0.99),
    Rule("lgpl-2.1", " version 2 1 february 1999 ", r"gnu lesser general public license version 2 1 february 1999", 97, 0.99),
    Rule("lgpl-3.0", " version 3 29 june 2007 ", r"gnu lesser general public license version 3 29 june 2007", 98, 0.99),
    Rule("agpl-3.0", " version 3 19 november 2007 ", r"gnu affero general public license version 3 19 november 2007", 97, 0.99),
    Rule("gfdl", " free documentation license ", r"copy distribute and or modify this document under the terms of the gnu free documentation license", 90, 0.95),
    Rule("gpl", " redistribute it and or modify ", r"redistribute it and or modify it under the terms of the gnu general public license", 85, 0.95),
    Rule("lgpl", " redistribute it and or modify ", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 86, 0.95),
    Rule("agpl", " redistribute it and or modify ", r"redistribute it and or modify it under the terms of the gnu affero general public license", 86, 0.95),
    Rule("gpl", " received a copy of the gnu ", r"you should have received a copy of the gnu general public license along with", 84, 0.9),
    Rule("lgpl", " received a copy of the gnu ", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 84, 0.9),
    Rule("agpl", " received a copy of the gnu ", r"you should have received a copy of the gnu affero general public license along with", 84, 0.9),
    Rule("gpl-2.0", " either version 2 of the license ", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 94, 0.97),
    Rule("gpl-3.0", " either version 3 of the license ", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 94, 0.97),
    Rule("gpl", " gnu org licenses ", r"(?:www )?gnu org (?:licenses|copyleft) gpl(?: \d 0)?(?: html| txt)?", 80, 0.85),
    Rule("lgpl", " gnu org licenses ", r"(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: \d \d)?(?: html| txt)?", 80, 0.85),
    Rule("agpl", " gnu org licenses ", r"(?:www )?gnu org licenses agpl(?: \d 0)?(?: html| txt)?", 80, 0.85),
    Rule("gfdl", " gnu org licenses ", r"(?:www )?gnu org (?:licenses|copyleft) fdl(?: \d \d)?(?: html| txt)?", 80, 0.85),
    Rule("mpl-2.0", " this source code form is subject ", r"this source code form is subject to the terms of the mozilla public license v 2 0", 95, 0.98),
    Rule("mpl-1.1", " contents of this file are subject ", r"the contents of this file are subject to the mozilla public license version 1 1", 95, 0.98),
    Rule("mpl", " mozilla org ", r"(?:www )?mozilla org mpl(?: mpl)?(?: \d \d)?(?: html| txt)?", 80, 0.85),
    Rule("epl", " accompanying materials are made available ", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 92, 0.95),
    Rule("epl", " eclipse org legal ", r"(?:www )?eclipse org legal epl(?: v ?\d ?0| \d 0)?(?: html| txt)?", 80, 0.85),
    Rule("cddl", " common development and distribution license ", r"common development and distribution license(?: version 1 [01])?", 82, 0.9),
    Rule("isc", " permission to use copy modify ", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 86, 0.95),
    Rule("postgresql", " permission to use copy modify ", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", 86, 0.95),
    Rule("hpnd", " permission to use copy modify ", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose is hereby granted", 85, 0.9),
    Rule("zlib", " altered source versions ", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 92, 0.97),
    Rule("zlib", " held liable for any damages ", r"in no event will the authors be held liable for any damages arising from the use of this software", 85, 0.85),
    Rule("boost-1.0", " boost software license ", r"boost software license version 1 0 august 17th 2003", 97, 0.99),
    Rule("boost-1.0", " boost org ", r"(?:www )?boost org license 1 0 txt", 88, 0.95),
    Rule("unlicense", " free and unencumbered software ", r"this is free and unencumbered software released into the public domain", 95, 0.98),
    Rule("unlicense", " unlicense org ", r"(?:www )?unlicense org", 80, 0.85),
    Rule("wtfpl", " what the fuck you want to ", r"do what the fuck you want to(?: public license)?", 92, 0.95),
    Rule("cc0-1.0", " creativecommons org publicdomain zero ", r"creativecommons org publicdomain zero 1 0", 92, 0.97),
    Rule("cc-by-nc-nd", " creativecommons org licenses by nc nd ", r"creativecommons org licenses by nc nd(?: \d \d)?", 88, 0.95),
    Rule("cc-by-nc-sa", " creativecommons org licenses by nc sa ", r"creativecommons org licenses by nc sa(?: \d \d)?", 88, 0.95),
    Rule("cc-by-nc", " creativecommons org licenses by nc ", r"creativecommons org licenses by nc(?: \d \d)?", 87, 0.95),
    Rule("cc-by-nd", " creativecommons org licenses by nd ", r"creativecommons org licenses by nd(?: \d \d)?", 88, 0.95),
    Rule("cc-by-sa", " creativecommons org licenses by sa ", r"creativecommons org licenses by sa(?: \d \d)?", 88, 0.95),
    Rule("cc-by", " creativecommons org licenses by ", r"creativecommons org licenses by(?: \d \d)?", 86, 0.95),
    Rule("ofl-1.1", " sil open font license ", r"sil open font license(?: version)?(?: 1 1)?", 85, 0.95),
    Rule("ofl-1.1", " scripts sil org ofl ", r"scripts sil org ofl", 80, 0.85),
    Rule("artistic-2.0", " artistic license 2 0 ", r"the artistic license 2 0 copyright c", 95, 0.97),
    Rule("psf-2.0", " python software foundation license ", r"python software foundation license(?: version 2)?", 85, 0.95),
    Rule("php-3.01", " php license ", r"php license(?: version)? 3 01", 85, 0.95),
    Rule("openssl", " openssl toolkit ", r"software developed by the openssl project for use in the openssl toolkit", 88, 0.95),
    Rule("ms-pl", " microsoft public license ", r"microsoft public license(?: ms pl)?", 85, 0.95),
    Rule("odbl-1.0", " open database license ", r"(?:open data commons )?open database license(?: odbl)?(?: v?1 0)?", 85, 0.95),
    Rule("ncsa", " illinois ", r"university of illinois ncsa open source license", 90, 0.97),
    Rule("beerware", " beer ware license ", r"the beer ware license(?: revision 42)?", 90, 0.97),
    Rule("afl-3.0", " academic free license ", r"academic free license(?: version)?(?: 3 0)?", 85, 0.95),
    Rule("osl-3.0", " open software license ", r"open software license(?: version)?(?: 3 0)?", 85, 0.95),
    Rule("public-domain", " public domain ", r"(?:is|are|in|into|released to|dedicated to) (?:the )?public domain", 60, 0.7),
    Rule("copyright", " copyright ", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", 30, 0.4),
    Rule("copyright", " copyright ", r"copyright (?:c|by) [^ ]+", 25, 0.3),
    Rule("reserved", " rights reserved ", r"(?:all|some|no) rights reserved", 30, 0.3),
    Rule("no-warranty", " warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?", 20, 0.2),
    Rule("no-warranty", " provided as is ", r"provided as is", 20, 0.2),
]


def rules() -> list[Rule]:
    """All rules in order: each family in each phrasing, versions by their bare names, then sentences and notices."""
    versions = [Rule(f.label, f.keywords, f.name, 48, 0.55) for f in FAMILIES if f.label[-1].isdigit()]
    named = [
        Rule(f.label, f.keywords, p.format(name=f.name), priority, weight)
        for p, priority, weight in PHRASINGS
        for f in FAMILIES
    ]
    return named + versions + NOTICES


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def reduced(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), each between single spaces."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


_BEGIN, _END = "\x01", "\x02"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_blocks(values: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of each block of an array that is at hand, about as many blocks as each has values."""

    def cut(n: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n, wide), lambda i: _let(F.slice(values, i, wide), body))

    return F.when(F.size(values) > 0, cut(F.size(values)))


def _running(steps: Column, of: Callable[[Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """`out(step, sum of the steps before)` of each step, by blocks: an array is never copied whole for each of its values."""

    def inside(base: Column, block: Column) -> Column:
        zero = F.struct(base.alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
        return F.aggregate(
            block, zero, lambda acc, x: F.struct((acc["at"] + of(x)).alias("at"), F.concat(acc["found"], F.array(out(x, acc["at"]))).alias("found")),
            lambda acc: acc["found"],
        )

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + of(x)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        bases = F.aggregate(
            sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")), lambda acc: acc["found"]
        )
        return F.flatten(F.zip_with(bases, blocks, inside))

    return _let(steps, lambda v: _let(_in_blocks(v, lambda b: b), whole))


def intervals(form: Column, regex: Column) -> Column:
    """First word and length of each match of `regex` between words of the reduced form: one pass marks them all."""
    bounded = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    pieces = F.split(F.regexp_replace(form, bounded, F.lit(f"{_BEGIN}$0{_END}")), _BEGIN, -1)

    def step(piece: Column) -> Column:
        # a match and the gap behind it; the first piece is a gap alone
        words = F.when(F.contains(piece, F.lit(_END)), _spaces(F.substring_index(piece, _END, 1)) + 1).otherwise(0)
        return F.struct(words.alias("size"), _spaces(piece).alias("spaces"))

    kind = "struct<start:int,size:int>"
    # spaces before a match, less the one before the first word
    found = _running(F.transform(pieces, step), lambda x: x["spaces"], lambda x, at: F.struct((at - 1).alias("start"), x["size"].alias("size")), kind)
    return F.when(F.contains(form, F.lit(" ")), F.filter(found, lambda x: x["size"] > 0)).otherwise(F.array().cast(f"array<{kind}>"))


def _gates(table: list[Rule]) -> list[str]:
    """The keywords of all rules and the base phrases: a text without any holds nothing to find."""
    every = {k for r in table for k in r.keywords.split("|")} | {f" {p} " for p in BASE}
    # one that holds another adds nothing
    return sorted(k for k in every if not any(o != k and o in k for o in every))


def _anchored(form: Column, table: list[Rule]) -> Column:
    return reduce(or_, [F.contains(form, F.lit(k)) for k in _gates(table)])


_RULES = "array<struct<rule:int,label:string,keywords:array<string>,regex:string,priority:int,weight:double>>"


def detections(form: Column, table: list[Rule] | None = None) -> Column:
    """Intervals that the rules find, before suppression, in order of their first words."""
    table = rules() if table is None else table
    rows = [{"rule": i, **r._asdict(), "keywords": r.keywords.split("|")} for i, r in enumerate(table)]
    literal = F.from_json(F.lit(json.dumps(rows)), _RULES)  # one constant of the plan
    gated = F.filter(literal, lambda r: F.exists(r["keywords"], lambda k: F.contains(form, k)))
    return F.array_sort(F.flatten(F.transform(
        gated,
        lambda r: F.transform(
            intervals(form, r["regex"]),
            lambda x: F.struct(
                x["start"].alias("start"), (x["start"] + x["size"]).alias("stop"), r["rule"].alias("rule"),
                r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"),
            ),
        ),
    )))


def suppressed(found: Column) -> Column:
    """The detections, ordered by their first words, that no other one overrides.

    One that overrides another begins at most the longest detection before it,
    so each block of detections is held against its own stretch of words only.
    """

    def overrides(o: Column, d: Column) -> Column:
        contains = (o["start"] <= d["start"]) & (o["stop"] >= d["stop"])
        longer = (o["stop"] - o["start"]) > (d["stop"] - d["start"])
        first = (o["priority"] > d["priority"]) | (
            (o["priority"] == d["priority"]) & (longer | (~longer & (o["rule"] < d["rule"])))
        )
        return contains & first

    def within(reach: Column) -> Column:
        def block(some: Column) -> Column:
            begin, end = F.element_at(some, 1)["start"], F.element_at(some, -1)["start"]
            near = F.filter(found, lambda o: (o["start"] >= begin - reach) & (o["start"] <= end))
            return _let(near, lambda others: F.filter(some, lambda d: ~F.exists(others, lambda o: overrides(o, d))))

        return F.coalesce(F.flatten(_in_blocks(found, block)), found)

    longest = F.aggregate(found, F.lit(0), lambda n, x: F.greatest(n, x["stop"] - x["start"]))
    return _let(longest, within)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places, labels and score of every document, and the detections that remain."""
    form = docs.select(F.col(id_col), reduced(F.col(text_col)).alias("form"))
    size = F.octet_length(F.trim("form"))
    words = F.when(size == 0, 0).otherwise(_spaces(F.col("form")) - 1).cast("long")
    none = "array<struct<start:int,stop:int,rule:int,label:string,priority:int,weight:double>>"
    spot = "array<struct<start:int,label:string>>"
    table = rules()
    counted = form.select(id_col, words.alias("n_words"), F.when(_anchored(F.col("form"), table), F.col("form")).alias("form"))
    base = F.concat(*[
        F.transform(intervals(F.col("form"), F.lit(phrase)), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))
        for phrase, label in BASE.items()
    ])
    hit = F.col("form").isNotNull()
    found = counted.select(
        id_col, "n_words",
        F.when(hit, base.cast(spot)).otherwise(F.array().cast(spot)).alias("base"),
        F.when(hit, detections(F.col("form"), table).cast(none)).otherwise(F.array().cast(none)).alias("raw"),
    )
    kept = found.select(id_col, "n_words", "base", suppressed(F.col("raw")).alias("detections"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    own = F.transform("detections", lambda d: d["label"])
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), own)))
    starts = F.transform("base", lambda b: b["start"])
    miss = F.aggregate("detections", F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    miss = F.aggregate("base", miss, lambda acc, _: acc * 0.7)
    return kept.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        (1 - miss).alias("score"), "detections",
    )
