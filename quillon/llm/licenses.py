"""License scans by ordered signature rules, in DataFrame operations alone.

Rules are regular expressions over a text's words, each gated by a keyword:
only rules whose keyword the text holds are matched. Where detections overlap,
one that lies within another of at least its own priority is suppressed.
Three phrases form the base; their labels always stay.

A null text is empty; an empty text has no words, labels or hits and score 0.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.order_minhash import bind

#: Phrases of the base and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label; words of its identifier; its name; then further signatures: addresses and phrases of its text.
FAMILIES: list[tuple] = [
    ("mit", "mit", "(?:mit|expat) licen[sc]e", "opensource org licenses mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", "mit 0", "mit no attribution(?: licen[sc]e)?", "opensource org licenses mit 0"),
    ("x11", "x11", "x11 licen[sc]e", "x consortium"),
    ("apache-2", "apache 2 0", "apache(?: software)? licen[sc]e(?: version| v)? ?2(?: 0)?", "apache org licenses license 2 0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache 1 1", "apache(?: software)? licen[sc]e(?: version| v)? ?1 1", "apache org licenses license 1 1"),
    ("bsd-2", "bsd 2 clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[sc]e)?", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd 3 clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?", "opensource org licenses bsd 3 clause", "neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse"),
    ("bsd-4", "bsd 4 clause", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-0", "0bsd", "(?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[sc]e)?", "opensource org licenses 0bsd"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "isc", "isc licen[sc]e", "permission to use copy modify and or distribute this software for any purpose", "opensource org licenses isc"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?", "gnu org licenses (?:old licenses )?gpl 2 0", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?", "gnu org licenses gpl 3 0", "either version 3 of the license or at your option any later version"),
    ("gpl", "gpl", "gnu (?:general public licen[sc]e|gpl)", "gnu org licenses gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?2 1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?3(?: 0)?", "gnu org licenses lgpl 3 0"),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", "(?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version| v)? ?2(?: 0)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl", "lgpl", "gnu (?:lesser general public licen[sc]e|lgpl)", "gnu org licenses lgpl"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)? ?3?(?: 0)?", "gnu org licenses agpl 3 0"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?", "(?:gnu )?(?:free documentation licen[sc]e|gfdl)", "gnu org (?:licenses|copyleft) fdl"),
    ("mpl-2", "mpl 2 0", "(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?", "mozilla org mpl 2 0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "mpl 1 1", "(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?1 1", "mozilla org mpl mpl 1 1"),
    ("epl-1", "epl 1 0", "(?:eclipse public licen[sc]e|epl)(?: version| v)? ?1(?: 0)?", "eclipse org legal epl v10"),
    ("epl-2", "epl 2 0", "(?:eclipse public licen[sc]e|epl)(?: version| v)? ?2(?: 0)?", "eclipse org legal epl (?:v20|2 0)"),
    ("cddl-1", "cddl 1 [01]", "(?:common development and distribution licen[sc]e|cddl)(?: version| v)? ?(?:1 [01])?", "opensource org licenses cddl"),
    ("cpl-1", "cpl 1 0", "common public licen[sc]e(?: version| v)?(?: 1 0)?", "opensource org licenses cpl1 0"),
    ("ms-pl", "ms pl", "microsoft public licen[sc]e", "opensource org licenses ms pl"),
    ("ms-rl", "ms rl", "microsoft reciprocal licen[sc]e", "opensource org licenses ms rl"),
    ("artistic-2", "artistic 2 0", "artistic licen[sc]e(?: version| v)? ?2(?: 0)?", "opensource org licenses artistic 2 0"),
    ("artistic-1", "artistic 1 0", "artistic licen[sc]e(?: version| v)? ?1(?: 0)?", "opensource org licenses artistic 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "opensource org licenses zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng org pub png src libpng license"),
    ("boost-1", "bsl 1 0", "boost software licen[sc]e(?: version| v)?(?: 1 0)?", "boost org license 1 0"),
    ("bsl-1.1", "busl 1 1", "business source licen[sc]e(?: version| v)?(?: 1 1)?", "mariadb com bsl11"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense org", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "(?:wtfpl|do what the fuck you want to public licen[sc]e)", "wtfpl net"),
    ("public-domain", "publicdomain", "(?:dedicated to|released into|placed in|in) the public domain", "creativecommons org publicdomain mark"),
    ("cc0", "cc0 1 0", "(?:cc0|cc zero)(?: 1 0)?(?: universal)?", "creativecommons org publicdomain zero"),
    ("cc-by", "cc by [1-4] [05]", "(?:cc by|creative commons attribution)(?! (?:nc|nd|sa|non|no |share))(?: [1-4] [05])?(?: international| unported)?", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "cc by sa [1-4] [05]", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "creativecommons org licenses by sa"),
    ("cc-by-nd", "cc by nd [1-4] [05]", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works))(?: [1-4] [05])?", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works))(?: [1-4] [05])?", "creativecommons org licenses by nc nd"),
    ("cc-by-nc", "cc by nc [1-4] [05]", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "creativecommons org licenses by nc"),
    ("odbl-1", "odbl 1 0", "(?:open database licen[sc]e|odbl)(?: 1 0)?", "opendatacommons org licenses odbl"),
    ("odc-by-1", "odc by 1 0", "(?:open data commons attribution licen[sc]e|odc by)(?: 1 0)?", "opendatacommons org licenses by"),
    ("pddl-1", "pddl 1 0", "(?:public domain dedication and licen[sc]e|pddl)(?: 1 0)?", "opendatacommons org licenses pddl"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font licen[sc]e(?: version| v)?(?: 1 1)?", "scripts sil org ofl"),
    ("python-2", "python 2 0", "(?:python software foundation|psf) licen[sc]e(?: version| v)?(?: 2)?", "docs python org license"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby lang org .{0,20}license"),
    ("php-3", "php 3 01?", "php licen[sc]e(?: version| v)?(?: 3(?: 01)?)?", "php net license"),
    ("perl", "artistic 1 0 perl", "same terms as perl itself", "perl org licensing"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql org about licen[sc]e"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl org source license"),
    ("curl", "curl", "curl licen[sc]e", "curl se docs copyright"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "opensource org licenses ncsa"),
    ("eupl-1.2", "eupl 1 2", "(?:european union public licen[sc]e|eupl)(?: version| v)?(?: 1 2)?", "joinup ec europa eu .{0,30}eupl"),
    ("cecill-2.1", "cecill 2 1", "cecill(?: free software)? licen[sc]e(?: agreement)?", "cecill info licences"),
    ("osl-3", "osl 3 0", "open software licen[sc]e(?: version| v)?(?: 3 0)?", "opensource org licenses osl 3 0"),
    ("afl-3", "afl 3 0", "academic free licen[sc]e(?: version| v)?(?: 3 0)?", "opensource org licenses afl 3 0"),
    ("qpl-1", "qpl 1 0", "(?:q|qt) public licen[sc]e(?: version| v)?(?: 1 0)?", "opensource org licenses qtpl"),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", "opensource org licenses sleepycat"),
    ("vim", "vim", "vim licen[sc]e", "vim org .{0,20}license"),
    ("beerware", "beerware", "beer ?ware licen[sc]e", "you can buy me a beer in return .{0,40}license"),
    ("sspl-1", "sspl 1 0", "server side public licen[sc]e(?: version| v)?(?: 1)?", "mongodb com licensing server side public license"),
    ("elastic-2", "elastic 2 0", "elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?", "elastic co licensing elastic license"),
    ("upl-1", "upl 1 0", "universal permissive licen[sc]e(?: version| v)?(?: 1 0)?", "opensource org licenses upl"),
    ("mulan-2", "mulanpsl 2 0", "mulan (?:psl|permissive software licen[sc]e)(?: version| v)? ?(?:2)?", "license coscl org cn mulanpsl2"),
    ("ecl-2", "ecl 2 0", "educational community licen[sc]e(?: version| v)?(?: 2 0)?", "opensource org licenses ecl 2 0"),
    ("blueoak-1", "blueoak 1 0 0", "blue oak model licen[sc]e(?: 1 0 0)?", "blueoakcouncil org license"),
    ("openrail", "openrail", "(?:creativeml )?open ?rail(?: m)?(?: licen[sc]e)?", "responsible ai licen[sc]e"),
    ("proprietary", "licenseref proprietary", "proprietary(?: software)? licen[sc]e", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", "all rights reserved"),
]
_NOTICE = "(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered|governed|shared)(?: you)?(?: under| by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? {}"
_TERMS = "(?:see|subject to|according to|accordance with|conditions of|copy of|terms of)(?: the| an?)? {}"
#: kind: priority, weight.
KINDS = {"identifier": (4, 1.0), "notice": (3, 0.95), "address": (3, 0.9), "phrase": (3, 0.9), "terms": (2, 0.85), "name": (1, 0.7)}
#: A text that holds none of these is not looked at further; every rule implies one of them.
GATES = ("licen", " cc", "copyright", "public domain", "creativecommons", "creative commons", "gnu", "gpl", "cddl", "gfdl", "wtfpl", "odbl", "odc by", "pddl", "eupl", "mpl", "epl", "open", "bsd", "permission is hereby", "permission to use", "redistribution and use", "all advertising", "neither the name", "all rights reserved", "without any express", "unauthori", "same terms as perl", "perl org", "mozilla org", "mariadb com bsl11", "scripts sil org", "x consortium", "eclipse org", "either version", "free and unencumbered", "free software you can", "mit no attribution", "mulan", "cecill", "freebsd", "spdx", "curl se docs")


def rules() -> list[dict]:
    """Every signature as {label, kind's priority and weight, keyword, pattern}."""
    out = []

    def add(label: str, kind: str, pattern: str, of: str | None = None) -> None:
        priority, weight = KINDS[kind]
        out.append({"label": label, "priority": priority, "weight": weight, "keywords": keywords(of or pattern), "pattern": rf"(?<= ){pattern}(?= )"})

    for label, spdx, name, *more in FAMILIES:
        add(label, "identifier", f"spdx license identifier {spdx}")
        add(label, "notice", _NOTICE.format(name), name)
        add(label, "terms", _TERMS.format(name), name)
        add(label, "name", name)
        for x in more:
            add(label, "address" if " org" in x or " com" in x or " net" in x else "phrase", x)
    return out


def keywords(pattern: str) -> list[str]:
    """Literals of which every match of a pattern holds at least one, as long as can be had."""
    parts: list[str] = []  # top-level groups, literals, and "" for whatever may be absent or vary
    k, run = 0, ""
    while k < len(pattern):
        c = pattern[k]
        if c == "(":
            depth, end = 1, k + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
            parts += [run, pattern[k:end]]
            run = ""
        elif c == "[":
            end = pattern.index("]", k) + 1
            parts, run = [*parts, run, ""], ""
        elif c == ".":
            end = re.compile(r"\.(\{[\d,]*\})?").match(pattern, k).end()
            parts, run = [*parts, run, ""], ""
        elif c == "?":
            if run:
                parts, run = [*parts, run[:-1], ""], ""
            else:
                parts[-1] = ""
            end = k + 1
        else:
            run, end = run + c, k + 1
        k = end
    found = []
    for p in [*parts, run]:
        if p.startswith("(?:"):
            depth, options = 0, [""]
            for c in p[3:-1]:
                depth += {"(": 1, ")": -1}.get(c, 0)
                if c == "|" and not depth:
                    options.append("")
                else:
                    options[-1] += c
            inner = [keywords(o) for o in options]
            if all(inner):
                found.append([x for one in inner for x in one])
        elif p and not p.startswith("(?"):
            found.append([p])
    return max(found, key=lambda xs: min(map(len, xs)), default=[])


_RULES_TYPE = "array<struct<label:string,priority:int,weight:double,keywords:array<string>,pattern:string>>"


def normalised(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one space before, between and after them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), SEPARATORS, " "))


#: Marks before and after a hit; no normalised text holds them.
_OPEN, _SHUT = "\x01", "\x02"
#: A rule's hits as word positions, in time that grows as the text: they are marked in the text, and the marked words' places are listed.
_SPANS = """
transform(array(transform(split(trim(regexp_replace(norm, r.pattern, '{open}$0{shut}')), ' '), (w, i) -> named_struct('w', w, 'i', i))), marked ->
  zip_with(filter(marked, x -> startswith(x.w, '{open}')), filter(marked, x -> endswith(x.w, '{shut}')),
    (a, b) -> named_struct('s', a.i, 'e', -(b.i + 1), 'p', -r.priority, 'label', r.label, 'w', r.weight)))[0]
""".format(open=_OPEN, shut=_SHUT)
_TOP = max(p for p, _ in KINDS.values())
#: Sorted by start, then longest, then priority: a hit is within an earlier one iff some earlier end reaches its own.
_KEPT = """
aggregate(hits,
  named_struct('ends', array_repeat(-1, {n}), 'labels', cast(array() AS array<string>), 'score', 0D),
  (acc, h) -> named_struct(
    'ends', transform(acc.ends, (x, p) -> if(p < -h.p, greatest(x, -h.e), x)),
    'labels', if(acc.ends[-h.p - 1] >= -h.e, acc.labels, array_union(acc.labels, array(h.label))),
    'score', if(acc.ends[-h.p - 1] >= -h.e, acc.score, greatest(acc.score, h.w))))
"""


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with norm, n_words, base (struct per phrase), hits, found (labels and score of the kept hits)."""
    table_sql = f"from_json('{json.dumps(rules()).replace(chr(92), chr(92) * 2)}', '{_RULES_TYPE}')"
    out = docs.withColumn("norm", normalised(F.col(text)))
    out = out.withColumn("n_words", F.when(F.col("norm") == "", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1).cast("long"))
    out = out.withColumn("norm", F.concat(F.lit(" "), F.col("norm"), F.lit(" ")))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("norm", F.lit(g))
    out = out.withColumn("norm", F.when(gate, F.col("norm")))
    none = "cast(array() AS array<struct<s:int,e:int,p:int,label:string,w:double>>)"
    hits = f"if(norm IS NULL, {none}, array_sort(flatten(transform(filter({table_sql}, r -> exists(r.keywords, k -> contains(norm, k)) AND norm RLIKE r.pattern), r -> {_SPANS}))))"
    out = out.withColumn("hits", F.expr(hits))
    return out.withColumn("found", F.expr(_KEPT.format(n=_TOP)))


def base_places(norm: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase's places in a normalised text, as word positions."""
    wide = "  ".join(phrase.split()).join("  ")
    n_words = len(phrase.split())

    def of(doubled: Column) -> Column:
        count = ((F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).cast("long")
        # Every word stands between two spaces of its own, so words before a place are counted by double spaces.
        before = lambda x: F.when(F.length(x) == 0, F.lit(0)).otherwise((F.length(x) - F.length(F.replace(x, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")
        total = before(doubled)
        first = before(F.substring(doubled, F.lit(1), F.locate(wide, doubled) - 1))
        after = before(F.substring(F.reverse(doubled), F.lit(1), F.instr(F.reverse(doubled), wide[::-1]) - 1))
        return F.struct(count.alias("n"), F.when(count > 0, first).alias("first"), F.when(count > 0, total - after - n_words).alias("last"))

    return F.when(F.contains(norm, F.lit(" " + phrase + " ")), bind(F.concat(F.lit(" "), F.replace(F.trim(norm), F.lit(" "), F.lit("  ")), F.lit(" ")), of))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    docs = docs.withColumns({f"_b{i}": base_places(F.col("norm"), phrase) for i, (phrase, _) in enumerate(BASE)})
    base = [F.col(f"_b{i}") for i in range(len(BASE))]
    base_labels = F.array_compact(F.array(*[F.when(b["n"] > 0, F.lit(label)) for b, (_, label) in zip(base, BASE, strict=True)]))
    n_base = sum((F.coalesce(b["n"], F.lit(0)) for b in base), F.lit(0)).cast("long")
    return docs.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*[b["first"] for b in base]).alias("first_word"),
        F.greatest(*[b["last"] for b in base]).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("found.labels"))), ",").alias("labels"),
        F.greatest(F.col("found.score"), F.when(n_base > 0, F.lit(0.95)).otherwise(F.lit(0.0))).alias("score"),
        F.size("hits").alias("n_hits"),
    )
