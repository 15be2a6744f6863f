"""Operator 9: license scans by ordered signature rules.

Method: hundreds of regular expressions over the normalised words of a text (lower case,
one blank between words).  A rule names the words of which each of its matches holds at
least one; a set intersection of the text's words with all of these tells which rules are
tried at all.  Overlapping detections are resolved in order: an interval inside another of
at least its priority is suppressed.  Base phrases are reported besides and never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp

#: fixed values of the contract: phrases and their labels
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# One line per license: SPDX id; keywords, one of which is a whole word of every match; name as a regex over normalised words; a URL or ''.
_L = r"licen[cs]e"
_FAMILIES = [
    ("mit", "mit", r"mit(?: x11)?", "opensource org licenses mit"),
    ("mit-0", "mit", r"mit (?:0|no attribution)", "opensource org license mit 0"),
    ("apache-2.0", "apache apache2", rf"apache(?: software)?(?: {_L})?(?: version| v)? ?2(?: 0)?", "apache org licenses license 2 0"),
    ("apache-1.1", "apache apache1", rf"apache(?: software)?(?: {_L})?(?: version| v)? ?1 1", "apache org licenses license 1 1"),
    ("gpl-2.0-only", "gpl gpl2 gplv2", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0-only", "gpl gpl3 gplv3", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only)?", "gnu org licenses gpl 3 0"),
    ("gpl-2.0-or-later", "gpl gpl2 gplv2", r"(?:gnu )?gpl ?v?2(?: 0)? (?:or|and) (?:any )?later", ""),
    ("gpl-3.0-or-later", "gpl gpl3 gplv3", r"(?:gnu )?gpl ?v?3(?: 0)? (?:or|and) (?:any )?later", ""),
    ("lgpl-2.1-only", "lgpl lgpl2 lgplv2", r"(?:gnu )?lgpl ?v?2 1(?: only)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0-only", "lgpl lgpl3 lgplv3", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0-only", "agpl agpl3 agplv3", r"(?:gnu )?agpl ?v?3(?: 0)?(?: only)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gfdl gfdl1 gfdlv1 fdl fdl1 fdlv1", r"(?:gnu )?(?:gfdl|fdl) ?v?1 3", "gnu org licenses fdl 1 3"),
    ("bsd-2-clause", "bsd bsd2 bsdclause", r"(?:simplified |freebsd )?bsd(?: 2| two)? ?(?:2 )?clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new |modified |revised )?bsd (?:3|three) clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original )?bsd (?:4|four) clause", ""),
    ("0bsd", "0bsd bsd", r"(?:zero clause bsd|0bsd)", "opensource org licenses 0bsd"),
    ("isc", "isc", r"isc", "opensource org licenses isc"),
    ("mpl-1.1", "mozilla", rf"mozilla public {_L}(?: version| v)? ?1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public {_L}(?: version| v)? ?2(?: 0)?", "mozilla org mpl 2 0"),
    ("mpl-2.0", "mpl mpl2 mplv2", r"mpl ?v?2(?: 0)?", ""),
    ("epl-1.0", "eclipse", rf"eclipse public {_L}(?: version| v)? ?1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", rf"eclipse public {_L}(?: version| v)? ?2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "cddl cddl1 cddlv1", r"cddl ?v?1 0", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", "cddl cddl1 cddlv1", r"cddl ?v?1 1", ""),
    ("cddl-1.0", "distribution", rf"common development and distribution {_L}", ""),
    ("cpl-1.0", "common", rf"common public {_L}", "opensource org licenses cpl1 0"),
    ("bsl-1.0", "boost", rf"boost software {_L}(?: version)? ?1 0", "boost org license 1 0"),
    ("busl-1.1", "business", rf"business source {_L}(?: version)? ?1 1", "mariadb com bsl11"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib net zlib license"),
    ("libpng", "libpng", r"libpng(?: 2 0)?", ""),
    ("unlicense", "unlicense", r"unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl net"),
    ("artistic-1.0", "artistic", rf"artistic {_L} 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2.0", "artistic", rf"artistic {_L} 2 0", "opensource org licenses artistic 2 0"),
    ("python-2.0", "python", rf"python software foundation {_L}", "python org psf license"),
    ("psf-2.0", "psf", r"psf(?: 2 0)?", ""),
    ("ruby", "ruby", r"ruby", "ruby lang org en about license"),
    ("php-3.01", "php", rf"php {_L}(?: version)? 3 01", "php net license 3 01"),
    ("postgresql", "postgresql", r"postgresql", "opensource org licenses postgresql"),
    ("openssl", "openssl", r"openssl", "openssl org source license"),
    ("curl", "curl", r"curl", "curl se docs copyright"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa", "opensource org licenses ncsa"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?", "w3 org consortium legal 2015 copyright software"),
    ("ofl-1.1", "sil", rf"sil open font {_L}", "scripts sil org ofl"),
    ("eupl-1.1", "eupl eupl1 euplv1", r"eupl ?v?1 1", ""),
    ("eupl-1.2", "eupl eupl1 euplv1", r"eupl ?v?1 2", "joinup ec europa eu collection eupl"),
    ("eupl-1.2", "european", rf"european union public {_L}", ""),
    ("cecill-2.1", "cecill", r"cecill(?: 2 1)?", "cecill info licences"),
    ("osl-3.0", "osl osl3 oslv3", r"osl ?v?3 0", "opensource org licenses osl 3 0"),
    ("afl-3.0", "academic", rf"academic free {_L}(?: version| v)? ?3 0", "opensource org licenses afl 3 0"),
    ("ms-pl", "microsoft", rf"microsoft public {_L}", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {_L}", "opensource org licenses ms rl"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?", "opendatacommons org licenses odbl"),
    ("odbl-1.0", "database", rf"open database {_L}", ""),
    ("odc-by-1.0", "odc", r"odc by(?: 1 0)?", "opendatacommons org licenses by"),
    ("pddl-1.0", "pddl", r"pddl(?: 1 0)?", "opendatacommons org licenses pddl"),
    ("sspl-1.0", "sspl", r"sspl(?: v?1)?", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", rf"elastic {_L}(?: 2 0)?", "elastic co licensing elastic license"),
    ("upl-1.0", "upl upl1 uplv1", r"upl ?v?1 0", "opensource org licenses upl"),
    ("vim", "vim", r"vim", ""),
    ("x11", "x11", r"x11", ""),
    ("beerware", "beerware beer", r"beer ?ware", ""),
    ("json", "json", r"json", "json org license"),
    ("blueoak-1.0.0", "blue", r"blue oak model", "blueoakcouncil org license 1 0 0"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software)(?: v2)?", "license coscl org cn mulanpsl2"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "cc", r"cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4 0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4 0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4 0", "creativecommons org licenses by nc nd 4 0"),
]

# Texts and notices with a signature of their own: label; priority; keywords; regex.
_NOTICES = [
    ("mit", 80, "granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", 70, "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", 80, "granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", 85, "apache", rf"licensed under the apache {_L} version 2 0"),
    ("apache-2.0", 80, "compliance", rf"you may not use this file except in compliance with the {_L}"),
    ("bsd-2-clause", 60, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 75, "endorse", r"neither the name of (?:(?!neither the name of |this software is provided )[^ ]+ )+?may be used to endorse or promote products"),
    ("bsd-4-clause", 75, "advertising", r"all advertising materials mentioning features or use of this software"),
    ("gpl", 70, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:affero |lesser |library )?general public"),
    ("gpl-2.0-or-later", 85, "version", rf"general public {_L} as published by the free software foundation (?:either )?version 2 (?:of the {_L} )?or (?:at your option )?any later"),
    ("gpl-3.0-or-later", 85, "version", rf"general public {_L} as published by the free software foundation (?:either )?version 3 (?:of the {_L} )?or (?:at your option )?any later"),
    ("gpl-2.0-only", 80, "general", rf"gnu general public {_L} (?:version |v)2"),
    ("gpl-3.0-only", 80, "general", rf"gnu general public {_L} (?:version |v)3"),
    ("lgpl-2.1-only", 80, "lesser", rf"gnu lesser general public {_L}(?: version| v)? ?2 1"),
    ("lgpl-3.0-only", 80, "lesser", rf"gnu lesser general public {_L}(?: version| v)? ?3"),
    ("lgpl", 65, "lesser", rf"(?:gnu )?lesser general public {_L}"),
    ("lgpl", 65, "library", rf"gnu library general public {_L}"),
    ("agpl-3.0-only", 80, "affero", rf"gnu affero general public {_L}(?: version| v)? ?3"),
    ("agpl", 65, "affero", rf"(?:gnu )?affero general public {_L}"),
    ("gfdl", 65, "documentation", rf"gnu free documentation {_L}"),
    ("gpl", 60, "general", rf"(?:gnu )?general public {_L}"),
    ("mpl-2.0", 80, "mozilla", rf"this source code form is subject to the terms of the mozilla public {_L} v 2 0"),
    ("unlicense", 80, "encumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 80, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 60, "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 40, "domain", r"public domain"),
    ("zlib", 75, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("wtfpl", 80, "want", r"do what the fuck you want to public license"),
    ("beerware", 70, "beer", r"you can buy me a beer in return"),
    ("cc-by", 60, "creative", r"creative commons attribution"),
    ("cc-by-sa", 70, "creative", r"creative commons attribution share ?alike"),
    ("cc-by-nc", 70, "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", 70, "creative", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", 75, "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", 75, "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc0-1.0", 70, "creative", r"creative commons (?:zero|cc0)"),
    ("cc", 30, "creative", rf"creative commons(?: {_L})?"),
    ("cc-by-sa", 55, "cc", r"cc by sa"),
    ("cc-by-nc", 55, "cc", r"cc by nc"),
    ("cc-by-nd", 55, "cc", r"cc by nd"),
    ("cc-by-nc-sa", 58, "cc", r"cc by nc sa"),
    ("cc-by-nc-nd", 58, "cc", r"cc by nc nd"),
    ("apache", 30, "apache", rf"apache {_L}"),
    ("bsd", 30, "bsd", rf"bsd(?: style)? {_L}"),
    ("proprietary", 50, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 50, "unauthorized", r"unauthorized copying of this file"),
    ("copyright", 20, "copyright", r"copyright(?: c)? (?:19|20)\d\d"),
    ("no-warranty", 20, "warranty", r"without (?:any )?warranty(?: of any kind)?"),
    ("no-warranty", 20, "warranties", r"without warranties or conditions of any kind"),
]
#: confidence by kind of rule
_TAG, _URL, _GRANT, _NAME = 95, 90, 85, 50


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: frozenset[bytes]
    pattern: re.Pattern


def _rule(label: str, priority: int, keywords: str, pattern: str) -> Rule:
    return Rule(label, priority, frozenset(keywords.encode().split()), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )", re.S))


def rules() -> list[Rule]:
    """All signatures in order: highest priority first, then as listed."""
    out = []
    for label, keywords, name, url in _FAMILIES:
        spdx = re.sub(r"[^0-9a-z]+", " ", label)
        out.append(_rule(label, _TAG, "identifier", rf"spdx {_L} identifier {spdx}(?: only)?"))
        out.append(_rule(label, _GRANT, keywords, rf"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{name}(?: {_L})?"))
        out.append(_rule(label, _NAME, keywords, rf"(?:the )?{name} {_L}"))
        if url:
            out.append(_rule(label, _URL, url.split()[0], url))
    out += [_rule(*x) for x in _NOTICES]
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    def __init__(self) -> None:
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for r in rules():
            for k in r.keywords:
                self.by_keyword.setdefault(k, []).append(r)
        self.base = [(re.compile(rb"(?<= )" + p.encode() + rb"(?= )"), p.split()[0].encode(), label) for p, label in BASE]
        self.keywords = frozenset([*self.by_keyword, *(k for _, k, _ in self.base)])

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """(n_words, n_base, first_word, last_word, base labels, labels, score)."""
        ws = text.translate(textnp.ALNUM_TRANSLATE).split()
        met = self.keywords.intersection(ws)
        if not met:
            return len(ws), 0, None, None, [], [], 0.0
        norm = b" " + b" ".join(ws) + b" "
        places, base = [], set()
        for pattern, key, label in self.base:
            if key in met:
                found = [m.start() for m in pattern.finditer(norm)]
                places += found
                if found:
                    base.add(label)
        tried = {id(r): r for k in met for r in self.by_keyword.get(k, ())}
        hits = [(m.start(), m.end(), r.priority, r.label) for r in tried.values() for m in r.pattern.finditer(norm)]
        kept = suppress(hits)
        first = norm.count(b" ", 0, min(places)) - 1 if places else None
        last = norm.count(b" ", 0, max(places)) - 1 if places else None
        best = dict.fromkeys(base, 60)
        for _, _, priority, label in kept:
            best[label] = max(priority, best.get(label, 0))
        doubt = 1.0
        for label in sorted(best):
            doubt *= 1 - best[label] / 100
        return len(ws), len(places), first, last, sorted(base), sorted(best), 1 - doubt


def suppress(hits: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Drops every interval that lies inside another of at least its priority.

    Equal intervals of equal priority keep the first label in order.
    """
    levels = sorted({h[2] for h in hits}, reverse=True)
    furthest: dict[int, int] = {}
    kept = []
    for h in sorted(hits, key=lambda h: (h[0], -h[1], -h[2], h[3])):
        if any(furthest.get(p, -1) >= h[1] for p in levels if p >= h[2]):
            continue
        furthest[h[2]] = max(h[1], furthest.get(h[2], -1))
        kept.append(h)
    return kept


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    A null text is empty: no words, no labels, score 0.  A text of any length is scanned
    whole.  Of the method's detections those inside another of at least their priority go;
    of equal intervals and priorities the first label in order stays; base phrases always
    stay.  Repeated rows and null and repeated ids are kept, each judged by its own text;
    other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            got = [scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("t").cast(pa.binary())]
            n, places, first, last, base, labels, score = zip(*got, strict=True) if got else ((),) * 7
            whole = [pa.array(x, pa.int64()) for x in (n, places, first, last)] + [pa.array([",".join(x) for x in v], pa.string()) for v in (base, labels)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *whole, pa.array(score, pa.float64())], ["doc_id", *(f.name for f in RESULT)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *RESULT]))
