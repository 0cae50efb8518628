"""License scans with ordered signature rules.

Texts are lower-cased (A-Z) and cut into words; rules are regular expressions
over the words joined by single spaces.  A rule is tried only if one of the
literals occurs of which its expression, by its own structure, contains one in
every text that it fits.  A finding that lies inside one of a rule of higher priority (or of a longer one of the
same priority) is suppressed, so "the Apache License" in "the Apache License,
Version 2.0" does not count twice.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM, LOWERED, ship, slices, text_buffers, unused, words_of

#: Phrases of the base scan and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Bytes of words stay, all others are spaces.
_SPACED = bytes(i if ALNUM[i] else 0x20 for i in range(256))

_L = r"licen[sc]e"
_V = r"(?:v|version |v )?"

#: (label, name as a regular expression over words, SPDX id in words).
#: Versions stand before the families they belong to: earlier is of higher priority.
NAMES = (
    ("apache-2.0", rf"apache(?: software)?(?: {_L})? {_V}2(?: 0)?(?: {_L})?", "apache 2 0"),
    ("apache-1.1", rf"apache(?: software)?(?: {_L})? {_V}1 1", "apache 1 1"),
    ("apache-1.0", rf"apache(?: software)?(?: {_L})? {_V}1 0", "apache 1 0"),
    ("apache", rf"apache(?: software)? {_L}", "apache"),
    ("agpl-3.0", rf"(?:gnu )?affero general public {_L} {_V}3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-1.0", rf"affero general public {_L} {_V}1(?: 0)?", "agpl 1 0"),
    ("agpl", rf"(?:gnu )?affero general public {_L}", "agpl"),
    ("lgpl-3.0", rf"(?:gnu )?lesser general public {_L} {_V}3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", rf"(?:gnu )?lesser general public {_L} {_V}2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.0", rf"(?:gnu )?library general public {_L} {_V}2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", rf"(?:gnu )?(?:lesser|library) general public {_L}", "lgpl"),
    ("gfdl-1.3", rf"(?:gnu )?free documentation {_L} {_V}1 3", "gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.2", rf"(?:gnu )?free documentation {_L} {_V}1 2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.1", rf"(?:gnu )?free documentation {_L} {_V}1 1", "gfdl 1 1(?: only| or later)?"),
    ("gfdl", rf"(?:gnu )?free documentation {_L}", "gfdl"),
    ("gpl-3.0", rf"(?:gnu )?general public {_L} {_V}3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", rf"(?:gnu )?general public {_L} {_V}2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-1.0", rf"(?:gnu )?general public {_L} {_V}1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl", rf"(?:gnu )?general public {_L}", "gpl"),
    ("mpl-2.0", rf"mozilla public {_L} {_V}2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", rf"mozilla public {_L} {_V}1 1", "mpl 1 1"),
    ("mpl-1.0", rf"mozilla public {_L} {_V}1 0", "mpl 1 0"),
    ("mpl", rf"mozilla public {_L}", "mpl"),
    ("epl-2.0", rf"eclipse public {_L} {_V}2(?: 0)?", "epl 2 0"),
    ("epl-1.0", rf"eclipse public {_L} {_V}1(?: 0)?", "epl 1 0"),
    ("epl", rf"eclipse public {_L}", "epl"),
    ("cddl-1.1", rf"common development and distribution {_L} {_V}1 1", "cddl 1 1"),
    ("cddl-1.0", rf"common development and distribution {_L}(?: {_V}1(?: 0)?)?", "cddl 1 0"),
    ("cpl-1.0", rf"common public {_L}(?: {_V}1(?: 0)?)?", "cpl 1 0"),
    ("ipl-1.0", rf"ibm public {_L}(?: {_V}1(?: 0)?)?", "ipl 1 0"),
    ("eupl-1.2", rf"european union public {_L} {_V}1 2", "eupl 1 2"),
    ("eupl-1.1", rf"european union public {_L} {_V}1 1", "eupl 1 1"),
    ("eupl", rf"european union public {_L}", "eupl"),
    ("osl-3.0", rf"open software {_L} {_V}3(?: 0)?", "osl 3 0"),
    ("osl", rf"open software {_L}", "osl"),
    ("afl-3.0", rf"academic free {_L} {_V}3(?: 0)?", "afl 3 0"),
    ("afl", rf"academic free {_L}", "afl"),
    ("artistic-2.0", rf"artistic {_L} {_V}2(?: 0)?", "artistic 2 0"),
    ("artistic-1.0", rf"artistic {_L}(?: {_V}1(?: 0)?)?", "artistic 1 0"),
    ("bsd-4-clause", rf"(?:original|four clause|4 clause) bsd(?: {_L})?|bsd (?:four|4) clause(?: {_L})?", "bsd 4 clause"),
    ("bsd-3-clause", rf"(?:new|revised|modified|three clause|3 clause) bsd(?: {_L})?|bsd (?:three|3) clause(?: {_L})?", "bsd 3 clause"),
    ("bsd-2-clause", rf"(?:simplified|two clause|2 clause|freebsd) bsd(?: {_L})?|bsd (?:two|2) clause(?: {_L})?", "bsd 2 clause"),
    ("0bsd", rf"zero clause bsd(?: {_L})?|bsd zero clause(?: {_L})?", "0bsd"),
    ("bsd", rf"bsd(?: style)? {_L}", "bsd"),
    ("mit-0", rf"mit no attribution(?: {_L})?|mit 0 {_L}", "mit 0"),
    ("mit", rf"mit(?: expat| x11)? {_L}", "mit"),
    ("mit", rf"expat {_L}", "expat"),
    ("x11", rf"x11 {_L}|x consortium {_L}", "x11"),
    ("isc", rf"isc {_L}", "isc"),
    ("zlib", rf"zlib(?: libpng)? {_L}", "zlib"),
    ("libpng", rf"libpng {_L}", "libpng 2 0"),
    ("bsl-1.0", rf"boost software {_L}(?: {_V}1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", rf"business source {_L}(?: {_V}1 1)?", "busl 1 1"),
    ("sspl-1.0", rf"server side public {_L}(?: {_V}1(?: 0)?)?", "sspl 1 0"),
    ("elastic-2.0", rf"elastic {_L}(?: {_V}2(?: 0)?)?", "elastic 2 0"),
    ("unlicense", r"the unlicense|unlicense", "unlicense"),
    ("wtfpl", rf"do what the f[a-z]* you want to public {_L}", "wtfpl"),
    ("postgresql", rf"postgresql {_L}", "postgresql"),
    ("python-2.0", rf"python software foundation {_L}(?: {_V}2(?: 0)?)?|psf {_L}", "(?:python|psf) 2 0"),
    ("php-3.01", rf"php {_L}(?: {_V}3 01)?", "php 3 01"),
    ("ruby", rf"ruby {_L}", "ruby"),
    ("perl", rf"same terms as perl(?: itself)?|perl {_L}", "perl"),
    ("ofl-1.1", rf"(?:sil )?open font {_L}(?: {_V}1 1)?", "ofl 1 1"),
    ("odbl-1.0", rf"open (?:data commons open )?database {_L}(?: {_V}1(?: 0)?)?", "odbl 1 0"),
    ("odc-by-1.0", rf"open data commons attribution {_L}(?: {_V}1(?: 0)?)?", "odc by 1 0"),
    ("pddl-1.0", rf"public domain dedication and {_L}", "pddl 1 0"),
    ("ogl-uk-3.0", rf"open government {_L}(?: {_V}3(?: 0)?)?", "ogl uk 3 0"),
    ("etalab-2.0", rf"etalab(?: open)? {_L}(?: {_V}2(?: 0)?)?", "etalab 2 0"),
    ("cecill-2.1", rf"cecill(?: free software)? {_L}(?: agreement)?(?: {_V}2 1)?", "cecill 2 1"),
    ("ms-pl", rf"microsoft public {_L}", "ms pl"),
    ("ms-rl", rf"microsoft reciprocal {_L}", "ms rl"),
    ("upl-1.0", rf"universal permissive {_L}(?: {_V}1(?: 0)?)?", "upl 1 0"),
    ("ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa"),
    ("zpl-2.1", rf"zope public {_L}(?: {_V}2 1)?", "zpl 2 1"),
    ("qpl-1.0", rf"q public {_L}(?: {_V}1(?: 0)?)?", "qpl 1 0"),
    ("apsl-2.0", rf"apple public source {_L}(?: {_V}2(?: 0)?)?", "apsl 2 0"),
    ("mulan-psl-2.0", rf"mulan permissive software {_L}(?: {_V}2)?", "mulanpsl 2 0"),
    ("beerware", rf"beer ?ware {_L}", "beerware"),
    ("json", rf"json {_L}", "json"),
    ("openssl", rf"openssl {_L}", "openssl"),
    ("curl", rf"curl {_L}", "curl"),
    ("vim", rf"vim {_L}", "vim"),
    ("tcl", rf"tcl(?: tk)? {_L}", "tcl"),
    ("openrail", rf"(?:creativeml |bigscience )?open rail(?: m)?(?: {_L})?", "openrail"),
    ("llama", rf"llama(?: [23](?: [0-9])?)? community {_L}", "llama"),
)

#: Creative Commons: words of the licence after "by", and its label.
_CC = (("nc sa", "nc sa"), ("nc nd", "nc nd"), ("nc", "nc"), ("sa", "sa"), ("nd", "nd"), ("", ""))
_SPELT = {"by": "(?:by|attribution)", "nc": "(?:nc|non ?commercial)", "sa": "(?:sa|share ?alike)", "nd": "(?:nd|no ?deriv(?:ative|atives|s))"}

#: (label, expression, score): notices by their wording.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 0.9),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("apache-2.0", rf"you may not use this file except in compliance with the {_L}", 0.85),
    ("apache-2.0", rf"apache org {_L}s? {_L} 2 0", 0.95),
    ("gpl", rf"you can redistribute it and or modify it under the terms of the gnu general public {_L}", 0.95),
    ("lgpl", rf"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {_L}", 0.95),
    ("agpl", rf"you can redistribute it and or modify it under the terms of the gnu affero general public {_L}", 0.95),
    ("gpl", rf"gnu org {_L}s? gpl", 0.85),
    ("mpl-2.0", r"subject to the terms of the mozilla public", 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 0.95),
    ("cc0-1.0", r"(?:has|have) waived all copyright and related or neighboring rights", 0.9),
    ("cc0-1.0", rf"cc0(?: 1 0)?(?: universal)?(?: {_L})?", 0.85),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", 0.95),
    ("public-domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", 0.85),
    ("public-domain", r"(?:is|are) in the public domain", 0.75),
    ("all-rights-reserved", r"all rights reserved", 0.6),
    ("copyright-notice", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.4),
    ("proprietary", rf"(?:proprietary and confidential|proprietary {_L})", 0.7),
    ("proprietary", r"may not be (?:copied|reproduced|distributed) (?:[^ ]+ ){0,6}without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 0.6),
    ("cc", rf"creative commons {_L}", 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    literals: tuple[str, ...]
    pattern: re.Pattern
    score: float
    priority: int


def _compiled(expression: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{expression})(?![^ ])")


def literals(expression: str) -> tuple[str, ...]:
    """Strings of which one stands in every text that the expression fits; none if there is no such set.

    Of a sequence the part counts whose shortest literal is longest, of
    alternatives the literals of all; parts that may be absent do not count.
    """

    def of(items) -> tuple[str, ...]:
        sets, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(value)
                continue
            if run:
                sets.append((run,))
                run = ""
            if op is _parser.SUBPATTERN:
                sets.append(of(value[3]))
            elif op is _parser.BRANCH:
                parts = [of(v) for v in value[1]]
                sets.append(tuple(sorted({x for p in parts for x in p})) if all(parts) else ())
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
                sets.append(of(value[2]))
        return max(sets, key=lambda x: min(map(len, x), default=0), default=())

    return of(_parser.parse(expression))


def rules() -> list[Rule]:
    """All rules, in order of priority."""
    found: list[tuple[str, str, float]] = []
    for label, _, spdx in NAMES:
        found.append((label, rf"spdx {_L} identifier {spdx}", 1.0))
    for label, name, _ in NAMES:
        grant = r"(?:licen[sc]ed|released|distributed|available|published|covered|provided|governed|made available|shared)"
        found.append((label, rf"{grant} (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})", 0.95))
    for kinds, suffix in _CC:
        words = " ".join(_SPELT[k] for k in ("by " + kinds).split())
        for version in ("4 0", "3 0", "2 5", "2 0", "1 0", ""):
            label = "-".join(["cc", "by", *suffix.split(), *([version.replace(" ", ".")] if version else [])])
            tail = rf"(?: (?:{_L}|international|unported|generic))*(?: {version})(?: (?:{_L}|international|unported|generic))*" if version else rf"(?: {_L})?"
            found.append((label, rf"(?:cc|creative commons) {words}{tail}", 0.9 if version else 0.75))
            if version:
                found.append((label, rf"creativecommons org {_L}s {' '.join(['by', *kinds.split()])} {version}", 0.95))
    for notice in NOTICES:
        found.append(notice)
    for label, name, _ in NAMES:
        found.append((label, name, 0.8))
    return [Rule(a, literals(e), _compiled(e), s, i) for i, (a, e, s) in enumerate(found)]


RULES = rules()


def detect(words: str, table: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Findings (start, end in characters, rule) that no better one contains."""
    usable = {x for x in {x for r in table for x in r.literals} if x in words}
    found = [(m.start(), m.end(), r) for r in table if not r.literals or not usable.isdisjoint(r.literals) for m in r.pattern.finditer(words)]
    kept: list[tuple[int, int, Rule]] = []
    # Kept ranges of which none contains another, in order: starts and ends both rise.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda f: (f[2].priority, f[0] - f[1], f[0])):
        at = bisect.bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        # Ranges inside the new one contain nothing that it does not.
        last = at
        while last < len(starts) and ends[last] <= end:
            last += 1
        first = at - 1 if at and starts[at - 1] == start else at
        starts[first:last], ends[first:last] = [start], [end]
    return sorted(kept, key=lambda f: (f[0], f[1], f[2].priority))


_BASE_PATTERNS = [(_compiled(p), label) for p, label in BASE]

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "findings",
            T.ArrayType(
                T.StructType(
                    [T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
                )
            ),
        ),
    ]
)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``RESULT`` to every document.

    Findings are word ranges [start, end).  The score is that of the surest
    finding, at least 0.5 with a base phrase, and 0 without any.  Null and
    empty texts have no words, no labels and null first and last words;
    repeated rows are scanned each; an empty table gives an empty result.
    Columns of ``docs`` pass through; those named like results are replaced.
    No row meets another, so nothing is shuffled.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in RESULT.names]
    body_name = unused(docs.columns, "body")
    carried = [docs[c] for c in kept] + [docs[text].alias(body_name)]

    def scan(batches):
        for s in slices(batches, body_name, 4 << 20):
            raw, offsets = text_buffers(s.column(body_name))
            raw = LOWERED[raw]
            _, _, owner = words_of(raw, offsets, ALNUM)
            n_words = np.bincount(owner, minlength=s.num_rows)
            body = raw.tobytes()
            rows = [(int(n), 0, None, None, [], [], 0.0, []) for n in n_words]
            for i in np.flatnonzero(n_words).tolist():
                words = b" ".join(body[offsets[i] : offsets[i + 1]].translate(_SPACED).split()).decode("utf-8", "replace")
                spaces: list[int] = []

                def place(at):
                    """The word at a character; spaces are listed once for a text with findings."""
                    if not spaces:
                        spaces.extend(m.start() for m in re.finditer(" ", words))  # noqa: B023
                    return bisect.bisect_left(spaces, at)  # noqa: B023

                base = [(m.start(), label) for p, label in _BASE_PATTERNS for m in p.finditer(words)]
                found = [(r.label, place(a), place(b) + 1, r.score) for a, b, r in detect(words, RULES)]
                spots = [place(a) for a, _ in base]
                labels = sorted({label for _, label in base})
                score = max([0.5 * bool(base), *(f[3] for f in found)])
                rows[i] = (
                    int(n_words[i]), len(base), min(spots, default=None), max(spots, default=None), labels,
                    sorted({*labels, *(f[0] for f in found)}), score,
                    [dict(zip(("label", "start", "end", "score"), f, strict=True)) for f in found],
                )
            out = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([s.column(c) for c in kept] + [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [*kept, *RESULT.names])

    return docs.select(*carried).mapInArrow(scan, T.StructType([docs.schema[c] for c in kept] + RESULT.fields))
