"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words.  Each rule is a regular expression over the word stream, gated by a
keyword that must occur; a rule has a priority, a label and a weight.  Detections that overlap are resolved in the order of
priority, then length: a detection that lies inside the interval of an accepted one is suppressed, so that "gnu lesser general
public license" is not also a GPL.  Phrases of the query's base are rules that are never suppressed.
The score is 1 - product(1 - weight) over the labels found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table


class Rule(NamedTuple):
    label: str
    pattern: str  # over words with single spaces between
    keyword: str
    priority: int
    weight: float


# Fixed values of the query's contract.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: A-Z to a-z; every byte that is not of a word (digits, letters, above 7F) to a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def signature_rules() -> list[Rule]:
    """The signature rules, family by family; priority: 9 tags, 7 name with version, 5 name, 3 reference, 1 notice."""
    rules: list[Rule] = []

    def family(label: str, keyword: str, name: str, versions: tuple[str, ...], short: str, plain: str | None = None) -> None:
        """A family with versions: tag, full name and short name of each; then the name alone."""
        for v in versions:
            words = " ".join(v.split("."))
            number = words if not words.endswith(" 0") else f"{words[:-2]}(?: 0)?"
            rules.append(Rule(f"{label}-{v}", f"spdx license identifier {short} {words}(?: (?:only|or later))?", "spdx", 9, 0.99))
            rules.append(Rule(f"{label}-{v}-or-later", f"{name}(?: as published by the free software foundation)?(?: either)? (?:version|v) ?{number}(?: of the license)? or (?:at your option )?any later version", keyword, 8, 0.98))
            rules.append(Rule(f"{label}-{v}", f"{name} (?:version |v ?)?{number}", keyword, 7, 0.97))
            rules.append(Rule(f"{label}-{v}", f"(?:licensed under|under|license) (?:the )?{short} ?(?:version |v ?)?{number}", short.split()[0], 6, 0.9))
        rules.append(Rule(plain or label, name, keyword, 5, 0.9))
        rules.append(Rule(plain or label, f"(?:licensed under|released under|under|subject to) the(?: terms of the)? {short}(?: license)?", short.split()[0], 4, 0.85))

    family("agpl", "affero", "gnu affero general public license", ("1.0", "3.0"), "agpl")
    family("lgpl", "lesser", "gnu lesser general public license", ("2.1", "3.0"), "lgpl")
    family("lgpl-library", "library", "gnu library general public license", ("2.0",), "lgpl")
    family("gfdl", "documentation", "gnu free documentation license", ("1.1", "1.2", "1.3"), "gfdl")
    family("gpl", "general public", "(?:gnu )?general public license", ("1.0", "2.0", "3.0"), "gpl", "gpl-any")
    family("apache", "apache", "apache (?:software )?license", ("1.0", "1.1", "2.0"), "apache")
    family("mpl", "mozilla", "mozilla public license", ("1.0", "1.1", "2.0"), "mpl")
    family("epl", "eclipse", "eclipse public license", ("1.0", "2.0"), "epl")
    family("edl", "eclipse", "eclipse distribution license", ("1.0",), "edl")
    family("cddl", "development and distribution", "common development and distribution license", ("1.0", "1.1"), "cddl")
    family("cpl", "common public", "common public license", ("1.0",), "cpl")
    family("cpal", "attribution license", "common public attribution license", ("1.0",), "cpal")
    family("eupl", "european union", "european union public licen[cs]e", ("1.0", "1.1", "1.2"), "eupl")
    family("afl", "academic free", "academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0"), "afl")
    family("osl", "open software", "open software license", ("1.0", "1.1", "2.0", "2.1", "3.0"), "osl")
    family("artistic", "artistic", "artistic license", ("1.0", "2.0"), "artistic")
    family("ofl", "open font", "(?:sil )?open font license", ("1.0", "1.1"), "ofl")
    family("boost", "boost", "boost software license", ("1.0",), "bsl")
    family("zpl", "zope", "zope public license", ("1.1", "2.0", "2.1"), "zpl")
    family("php", "php", "php license", ("3.0", "3.01"), "php")
    family("python", "python", "python (?:software foundation )?license", ("2.0",), "psf")
    family("lppl", "latex", "latex project public license", ("1.0", "1.1", "1.2", "1.3"), "lppl")
    family("odbl", "open database", "open (?:data commons )?open database license", ("1.0",), "odbl")
    family("odc-by", "data commons", "open data commons attribution license", ("1.0",), "odc by")
    family("cecill", "cecill", "cecill(?: free software license)?(?: agreement)?", ("1.0", "1.1", "2.0", "2.1"), "cecill")
    family("sspl", "server side", "server side public license", ("1.0",), "sspl")
    family("busl", "business source", "business source license", ("1.0", "1.1"), "busl")
    family("elastic", "elastic", "elastic license", ("1.0", "2.0"), "elastic")
    family("apsl", "apple public", "apple public source license", ("1.0", "1.1", "1.2", "2.0"), "apsl")
    family("npl", "netscape", "netscape public license", ("1.0", "1.1"), "npl")
    family("ms-pl", "microsoft public", "microsoft public license", ("1.0",), "ms pl")
    family("ms-rl", "microsoft reciprocal", "microsoft reciprocal license", ("1.0",), "ms rl")
    family("openssl", "openssl", "openssl license", ("1.0",), "openssl")
    family("open-government", "open government", "open government licen[cs]e", ("1.0", "2.0", "3.0"), "ogl")

    # Creative Commons: each combination by its short and its full name, with and without versions.
    names = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        parts = kind.split("-")
        short, full = "cc " + " ".join(parts), "creative commons " + " ".join(names[p] for p in parts)
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            a, b = v.split(".")
            rules.append(Rule(f"cc-{kind}-{v}", f"{short} {a} {b}", "cc", 7 + len(parts), 0.97))
            rules.append(Rule(f"cc-{kind}-{v}", f"{full} {a} {b}", "creative", 7 + len(parts), 0.97))
        if kind != "by":
            rules.append(Rule(f"cc-{kind}", short, "cc", 4 + len(parts), 0.9))
        rules.append(Rule(f"cc-{kind}", full, "creative", 4 + len(parts), 0.9))
        rules.append(Rule(f"cc-{kind}", f"creativecommons org licenses {' '.join(parts)}", "creativecommons", 6 + len(parts), 0.97))
    # Names without versions.
    for label, pattern, keyword, priority, weight in [
        ("cc0", "cc0(?: 1 0)?", "cc0", 7, 0.95),
        ("cc0", "creative commons (?:cc )?zero", "zero", 7, 0.95),
        ("mit", "spdx license identifier mit", "spdx", 9, 0.99),
        ("mit", "mit license", "mit license", 5, 0.95),
        ("mit", "(?:licensed|released|distributed) under (?:the )?mit(?: license)?", "under", 6, 0.95),
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted", 8, 0.98),
        ("mit-0", "mit no attribution(?: license)?", "no attribution", 7, 0.95),
        ("bsd-0-clause", "(?:0|zero) clause bsd(?: license)?", "clause", 7, 0.95),
        ("bsd-1-clause", "(?:1|one) clause bsd(?: license)?", "clause", 7, 0.95),
        ("bsd-2-clause", "(?:2|two) clause bsd(?: license)?", "clause", 7, 0.95),
        ("bsd-2-clause", "bsd (?:2|two) clause(?: license)?", "clause", 7, 0.95),
        ("bsd-2-clause", "(?:simplified|freebsd) (?:bsd )?license", "license", 6, 0.9),
        ("bsd-3-clause", "(?:3|three) clause bsd(?: license)?", "clause", 7, 0.95),
        ("bsd-3-clause", "bsd (?:3|three) clause(?: license)?", "clause", 7, 0.95),
        ("bsd-3-clause", "(?:new|revised|modified) bsd license", "bsd", 7, 0.95),
        ("bsd-4-clause", "(?:4|four) clause bsd(?: license)?", "clause", 7, 0.95),
        ("bsd", "bsd (?:style )?license", "bsd", 5, 0.85),
        ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 8, 0.95),
        ("isc", "isc license", "isc", 6, 0.95),
        ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted", 8, 0.97),
        ("zlib", "zlib(?: libpng)? license", "zlib", 6, 0.95),
        ("libpng", "libpng license", "libpng", 5, 0.95),
        ("unlicense", "(?:the )?unlicense", "unlicense", 6, 0.95),
        ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 8, 0.98),
        ("wtfpl", "do what the f\\w+ you want to public license", "you want to", 8, 0.97),
        ("wtfpl", "wtfpl", "wtfpl", 6, 0.95),
        ("beerware", "beer ?ware license", "ware license", 6, 0.9),
        ("postgresql", "postgresql licen[cs]e", "postgresql", 6, 0.95),
        ("ncsa", "(?:university of illinois )?ncsa open source license", "ncsa", 6, 0.95),
        ("sleepycat", "sleepycat license", "sleepycat", 6, 0.95),
        ("vim", "vim license", "vim license", 6, 0.95),
        ("ruby", "ruby license", "ruby license", 6, 0.95),
        ("x11", "x11 license", "x11", 6, 0.95),
        ("w3c", "w3c software (?:notice and )?license", "w3c", 6, 0.95),
        ("curl", "curl license", "curl license", 6, 0.9),
        ("json", "the software shall be used for good not evil", "not evil", 8, 0.97),
        ("icu", "icu license", "icu license", 6, 0.9),
        ("unicode", "unicode (?:data files and software )?license(?: agreement)?", "unicode", 6, 0.9),
        ("tcl", "tcl tk license", "tcl tk", 6, 0.9),
        ("openrail", "(?:creativeml )?open ?rail(?: [ms])?(?: license)?", "rail", 6, 0.9),
        ("public-domain", "(?:in|into|to) the public domain", "public domain", 5, 0.85),
        ("public-domain", "public domain dedication", "public domain", 5, 0.85),
        ("proprietary", "proprietary and confidential", "proprietary", 4, 0.8),
        ("proprietary", "end user license agreement", "end user", 4, 0.8),
        ("proprietary", "no part of this (?:publication|work|book|document) may be reproduced", "reproduced", 5, 0.85),
        ("proprietary", "(?:unauthori[sz]ed|any) (?:copying|reproduction|use|distribution)(?: or distribution)? is (?:strictly )?prohibited", "prohibited", 4, 0.8),
        ("warranty-disclaimer", "provided as is without warranty of any kind", "warranty", 3, 0.5),
        ("warranty-disclaimer", "without any warranty without even the implied warranty", "warranty", 3, 0.5),
        ("copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*", "copyright", 1, 0.6),
        ("copyright", "copyright notice", "copyright", 1, 0.4),
        ("permission", "(?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission", "permission", 2, 0.5),
        ("licensed-work", "this (?:work|article|dataset|document|content|file|software) is (?:licensed|released|distributed|made available) under", "under", 2, 0.6),
        # Sentences of headers and of the licenses' own texts.
        ("apache-2.0", "licensed under the apache license version 2 0 the license", "apache", 8, 0.99),
        ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance", 6, 0.9),
        ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable law", 8, 0.97),
        ("apache-2.0", "apache org licenses license 2 0", "apache", 9, 0.98),
        ("gpl-any", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 6, 0.97),
        ("gpl-any", "you should have received a copy of the gnu general public license along with this program", "received a copy", 6, 0.95),
        ("gpl-any", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim", 6, 0.8),
        ("gpl-any", "gnu org licenses(?: gpl)?", "gnu org", 5, 0.85),
        ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute", 8, 0.97),
        ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)", "received a copy", 8, 0.95),
        ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "received a copy", 8, 0.95),
        ("agpl", "offer all users interacting with it remotely through a computer network", "remotely", 7, 0.9),
        ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions", 8, 0.97),
        ("mit", "opensource org licenses mit(?: license php)?", "opensource", 8, 0.97),
        ("mit", "(?:the )?mit x11 license", "x11", 7, 0.95),
        ("bsd-3-clause", "neither the name of (?:the )?(?:\\w+ ){1,6}nor the names of (?:its|any|the) contributors", "neither the name", 8, 0.95),
        ("bsd-3-clause", "opensource org licenses bsd 3 clause", "opensource", 8, 0.97),
        ("bsd-2-clause", "opensource org licenses bsd (?:2 clause|license)", "opensource", 8, 0.95),
        ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 8, 0.97),
        ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 7, 0.9),
        ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", 7, 0.9),
        ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form", 8, 0.98),
        ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not", 8, 0.97),
        ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "subject to the mozilla", 8, 0.98),
        ("epl-1.0", "made available under the terms of the eclipse public license v1 0", "eclipse", 8, 0.97),
        ("epl-2.0", "made available under the terms of the eclipse public license (?:v )?2 0", "eclipse", 8, 0.97),
        ("cddl", "the contents of this file are subject to the terms of (?:either )?the common development and distribution license", "common development", 8, 0.96),
        ("boost-1.0", "distributed under the boost software license version 1 0", "boost", 8, 0.98),
        ("boost-1.0", "boost org license 1 0 txt", "boost", 9, 0.98),
        ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "held liable", 7, 0.9),
        ("zlib", "altered source versions must be plainly marked as such", "plainly marked", 8, 0.95),
        ("ofl", "the fonts? (?:and derivatives )?(?:however )?cannot be (?:released|sold) (?:under any other type of license|by itself)", "font", 7, 0.9),
        ("ofl-1.1", "scripts sil org ofl", "sil org", 8, 0.95),
        ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "a package may be", 8, 0.95),
        ("python-2.0", "psf is making python available to licensee on an as is basis", "psf is making", 8, 0.97),
        ("openssl", "this product includes software developed by the openssl project", "openssl", 8, 0.97),
        ("cc-by-sa", "text is available under the creative commons attribution share ?alike license", "available under", 8, 0.97),
        ("cc-by", "permits unrestricted use distribution and reproduction in any medium provided the original (?:work|author|authors) (?:is|are|and source are) (?:properly )?cite?d(?:ited)?", "unrestricted use", 8, 0.9),
        ("cc-by", "open access article distributed under the(?: terms of the)? creative commons attribution license", "open access", 8, 0.97),
        ("cc-by-nc", "permits (?:unrestricted )?non ?commercial use distribution and reproduction", "commercial use", 8, 0.9),
        ("cc0", "creativecommons org publicdomain zero 1 0", "publicdomain", 9, 0.98),
        ("cc0", "dedicated to the public domain by waiving all (?:of )?(?:his|her|their) rights", "waiving", 8, 0.95),
        ("public-domain", "creativecommons org publicdomain mark 1 0", "publicdomain", 9, 0.95),
        ("public-domain", "no (?:known )?copyright restrictions", "copyright restrictions", 5, 0.8),
        ("public-domain", "work of the (?:united states|u s|us) (?:federal )?government", "work of the", 5, 0.8),
        ("public-domain", "(?:its|the) copyright (?:term )?has expired", "expired", 5, 0.8),
        ("open-government", "contains public sector information licensed under the open government licen[cs]e", "public sector", 8, 0.97),
        ("llama", "llama (?:2|3|3 1|3 2|3 3) community license(?: agreement)?", "community license", 8, 0.97),
        ("gemma", "gemma terms of use", "gemma", 8, 0.95),
        ("openrail", "bigscience (?:open )?rail(?: [ms])? (?:1 0|license)", "bigscience", 8, 0.97),
        ("commons-clause", "commons clause license condition", "commons clause", 8, 0.97),
        ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) license", "polyform", 8, 0.97),
        ("parity", "parity public license", "parity public", 8, 0.95),
        ("blue-oak", "blue oak model license", "blue oak", 8, 0.97),
        ("mulan-2.0", "mulan (?:psl|permissive software license) (?:v ?2|version 2)", "mulan", 8, 0.97),
        ("nasa-1.3", "nasa open source agreement(?: version 1 3)?", "nasa", 8, 0.95),
        ("cdla-permissive", "community data license agreement permissive", "data license agreement", 8, 0.97),
        ("cdla-sharing", "community data license agreement sharing", "data license agreement", 8, 0.97),
        ("crown-copyright", "crown copyright", "crown copyright", 4, 0.7),
        ("proprietary", "this (?:document|software|material) (?:contains|is) (?:the )?confidential", "confidential", 4, 0.8),
        ("proprietary", "this (?:document|software|material) (?:contains|is) (?:the )?proprietary", "proprietary", 4, 0.8),
        ("proprietary", "may not be (?:copied|reproduced|distributed|republished)(?: \\w+){0,8} without (?:the )?(?:prior|express|written)", "may not be", 5, 0.85),
        ("proprietary", "for (?:internal|personal)(?: and non ?commercial)? use only", "use only", 4, 0.7),
        ("proprietary", "subject to (?:our|the) terms (?:of (?:use|service)|and conditions)", "subject to", 3, 0.5),
        ("warranty-disclaimer", "in no event shall the (?:authors?|copyright (?:holders?|owner)|regents) (?:or (?:copyright holders|contributors) )?be liable", "in no event", 3, 0.6),
        ("warranty-disclaimer", "merchantability fitness for a particular purpose and non ?infringement", "merchantability", 3, 0.6),
        ("trademark", "(?:registered )?trademarks? of (?:their|its) respective owners?", "trademark", 1, 0.3),
        ("license-reference", "(?:licensed|released|distributed|available) under (?:the terms of )?(?:the|a|an)(?: \\w+){1,6}? licen[cs]e", "under", 2, 0.7),
    ]:
        rules.append(Rule(label, pattern, keyword, priority, weight))
    return rules


BASE_WEIGHT = 0.7


class Scanner:
    """Compiled rules; detections of one text."""

    def __init__(self, rules: list[Rule], base: list[tuple[str, str]]):
        gates: dict[bytes, list] = {}
        for r in rules:
            gates.setdefault(r.keyword.encode(), []).append((re.compile(b"(?<= )" + r.pattern.encode() + b"(?= )"), r))
        self.gates = list(gates.items())
        self.base = [(b" " + p.encode() + b" ", p.count(" ") + 1, label) for p, label in base]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, base places (first word, label), accepted detections (first word, end word, label, weight)."""
        words = text.translate(WORDS).split()
        if not words:
            return 0, [], []
        stream = b" " + b" ".join(words) + b" "
        places, found = [], []
        for phrase, _, label in self.base:
            at = stream.find(phrase)
            while at >= 0:
                places.append((at, label))
                at = stream.find(phrase, at + 1)
        for keyword, gated in self.gates:
            if keyword in stream:
                for pattern, rule in gated:
                    found += [(m.start() - 1, m.end(), rule) for m in pattern.finditer(stream)]
        if not (places or found):
            return len(words), [], []
        blank = np.flatnonzero(np.frombuffer(stream, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(blank, at))  # noqa: E731  of the blank before a word: the word's number
        return len(words), sorted((word(at), label) for at, label in places), [(word(s), word(e), r.label, r.weight) for s, e, r in accepted(found)]


def accepted(found: list) -> list:
    """Detections not inside an accepted one, by priority, then length; order of start."""
    out: list = []
    starts, reach = [], []  # accepted ones of higher priorities: starts, and how far any of the first i of them reaches
    for priority in sorted({r.priority for *_, r in found}, reverse=True):
        longest, kept = -1, []
        for s, e, r in sorted((x for x in found if x[2].priority == priority), key=lambda x: (x[0], -x[1], x[2].label)):
            i = bisect_right(starts, s)
            if e > longest and not (i and reach[i - 1] >= e):
                kept.append((s, e, r))
                longest = e
        out = sorted(out + kept, key=lambda x: (x[0], -x[1], x[2].label))
        starts, reach = [x[0] for x in out], []
        for x in out:
            reach.append(max(x[1], reach[-1]) if reach else x[1])
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first_word: long, end_word: long, label: string, weight: double>>"


def _scan(rules: list[Rule], base: list[tuple[str, str]], detail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, base)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for text in batch.column(1):
                n, places, found = scanner.scan(text.as_py() or b"")
                base_labels = {label for _, label in places}
                weights = dict.fromkeys(base_labels, BASE_WEIGHT)
                for *_, label, weight in found:
                    weights[label] = max(weight, weights.get(label, 0.0))
                doubt = 1.0
                for label in sorted(weights):
                    doubt *= 1 - weights[label]
                for k, v in zip(rows, (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base_labels)), ",".join(sorted(weights)), 1 - doubt, [dict(zip(("first_word", "end_word", "label", "weight"), f)) for f in found] if detail else None)):
                    rows[k].append(v)
            ints = [pa.array(rows[k], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
            found_type = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *ints, pa.array(rows["base_labels"], pa.string()), pa.array(rows["labels"], pa.string()), pa.array(rows["score"], pa.float64()), pa.array(rows["detections"], found_type)], names=["doc_id", *rows])

    return run


def license_scan(docs: DataFrame, rules: list[Rule] | None = None, base: list[tuple[str, str]] = BASE, doc_id: str = "doc_id", text: str = "text", detail: bool = True) -> DataFrame:
    """One row per document: n_words, base places and labels, all labels, score, and the accepted ``detections``.

    A null or empty text has no words, empty labels, score 0 and null places.  Whole texts; repeated rows give repeated rows.
    """
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(_scan(signature_rules() if rules is None else rules, base, detail), SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), detail=False).drop("detections")
