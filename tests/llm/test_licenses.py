"""License rules: every text that a rule fits gets its finding."""

from re import _parser

import pytest

from foliant.llm.licenses import RULES, detect, scan_licenses

ALONE = {
    "Released under Apache 2.0": "apache-2.0",
    "Distributed under the 3-clause BSD": "bsd-3-clause",
    "the same terms as Perl itself": "perl",
    "Proprietary and confidential": "proprietary",
    "It may not be reproduced in any form without prior written permission": "proprietary",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Neither the name of the X Project nor the names of its contributors may be used to endorse": "bsd-3-clause",
    "All advertising materials mentioning features or use of this software must display": "bsd-4-clause",
    "All rights\nreserved": "all-rights-reserved",
    "is in the public\n domain": "public-domain",
}


def labels(spark, texts):
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return [r.labels for r in sorted(found, key=lambda r: r.doc_id)]


def test_notices_standing_alone(spark):
    got = labels(spark, ALONE)
    assert all(want in have for want, have in zip(ALONE.values(), got, strict=True)), dict(zip(ALONE, got, strict=True))


def spellings(items):
    """Texts that a parsed expression fits, every alternative among them."""
    out = [""]
    for op, value in items:
        if op is _parser.LITERAL:
            more = [chr(value)]
        elif op is _parser.SUBPATTERN:
            more = spellings(value[3])
        elif op is _parser.BRANCH:
            more = [x for v in value[1] for x in spellings(v)]
        elif op is _parser.IN:
            more = [chr(value[0][1] if value[0][0] is _parser.LITERAL else value[0][1][0])]
        elif op is _parser.NOT_LITERAL:
            more = ["x"]
        elif op is _parser.MAX_REPEAT:
            once = spellings(value[2])
            more = [x * max(1, value[0]) for x in once] + ([""] if value[0] == 0 else [])
        else:
            continue
        n = max(len(out), len(more))
        few = [out[i % len(out)] + more[i % len(more)] for i in range(n)]
        out = few if len(out) * len(more) > 400 else [a + b for a in out for b in more]
    return out


@pytest.fixture(scope="module")
def samples():
    return [(rule, text) for rule in RULES for text in spellings(_parser.parse(rule.pattern.pattern))]


def test_every_alternative_passes_its_gate(samples):
    assert {r.priority for r, _ in samples} == {r.priority for r in RULES}
    for rule, text in samples:
        assert rule.pattern.fullmatch(text), (rule.label, text)
        assert any(x in text for x in rule.literals), (rule.label, text, rule.literals)


def test_every_alternative_is_found(samples):
    for rule, text in samples:
        found = detect(text, RULES)
        assert any(a == 0 and b == len(text) and r.priority <= rule.priority for a, b, r in found), (rule.label, text)


def test_one_sample_of_every_rule_is_found_by_the_scan(spark, samples):
    first = {}
    for rule, text in samples:
        first.setdefault(rule.priority, (rule, text))
    got = labels(spark, [text for _, text in first.values()])
    assert all(got), [x for x, y in zip(first.values(), got, strict=True) if not y]


def test_spellings_that_keywords_missed(spark):
    texts = ("Creative Commons Attribution-ShareAlike", "Creative Commons Attribution 4.0", "the X Consortium License", "PSF License", "Beerware License")
    wanted = ("cc-by-sa", "cc-by-4.0", "x11", "python-2.0", "beerware")
    got = labels(spark, texts)
    assert all(w in g for w, g in zip(wanted, got, strict=True)), got
