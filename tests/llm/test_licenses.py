import re
import time

import hypothesis

from driftlens.llm import licenses as L


def brute(text):
    raw = (text or "").encode().lower()
    words = [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", raw) if w]
    places = [(k, label) for phrase, label in L.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    found = [(m.start(), m.end(), r) for r in L.rules() for m in L.compiled(r).finditer(raw)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label, d[2].pattern))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    first = [k for k, _ in places]
    base = sorted({x for _, x in places})
    return len(words), len(places), min(first, default=None), max(first, default=None), ",".join(base), ",".join(sorted({*base, *(d[2].label for d in kept)}))


TEXTS = [
    None, "", "cc by", "CC  by-nc 4.0 and cc/by", "Licensed under the Apache License, Version 2.0.", "GNU Lesser General Public License, version 2.1 or General-Public LICENSE",
    "All rights\nreserved. © 2020 all rights reserved", "SPDX-License-Identifier: MIT", "mit der Arbeit", "éccby cc byé", "Released under the MIT License. Copyright (c) 2001-2004",
    "This is free and unencumbered software released into the public domain", "word " * 500 + "general public license", "creativecommons.org/licenses/by/4.0",
]


TEXTS += ["\u00e9mit license", "mit licens\u00e9", "licen\u00e7a mit", "gpl " * 300, "license: mit, license: bsd-3-clause. " * 60, "under the apache license 2.0 " * 40 + "released under the terms of the mit license"]


def test_no_text_takes_long():
    scanner = L.Scanner(L.rules())
    for unit in ("released under the terms of the the terms of the ", "license " + "the terms of the " * 5, "mit gpl license ", "copyright   \t   ", "gpl cc by "):
        begun = time.process_time()
        L.scan(scanner, unit * (1_000_000 // len(unit)))
        assert time.process_time() - begun < 15, unit
    a, b = L.Rule("a", "", (), (), 1, 2), L.Rule("b", "", (), (), 1, 1)
    begun = time.process_time()
    left = L.suppressed([(k, k + 10, a) for k in range(50_000)] + [(k, k + 9, b) for k in range(50_000)])
    assert len(left) == 50_000 and time.process_time() - begun < 5


def test_every_match_holds_a_keyword():
    @hypothesis.settings(max_examples=3, derandomize=True, deadline=None, database=None, suppress_health_check=list(hypothesis.HealthCheck))
    @hypothesis.given(hypothesis.strategies.data())
    def check(data):
        for r in L.rules():
            plain = re.compile(r.pattern.replace(r"\b", "").encode())
            match = data.draw(hypothesis.strategies.from_regex(plain, fullmatch=True)).lower()
            assert len(match) < L.REACH
            assert any(w.encode() in match for w in r.keywords), (r.pattern, match)
            assert not r.forms or any(w.encode() in match for w in r.forms), (r.pattern, match)

    check()


def test_rules_are_gated_by_keywords_they_cannot_match_without():
    scanner = L.Scanner(L.rules())
    assert len(scanner.rules) >= 500 and len({r.pattern for r in scanner.rules}) == len(scanner.rules)
    for text in TEXTS:
        assert L.scan(scanner, text or "")[:6] == brute(text), text


def test_query_over_odd_rows(spark, odd, none):
    rows = L.license_scan(odd).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(r.n_words for r in rows if r.doc_id == 3) == [6, 6]
    assert L.license_scan(none).count() == 0


def test_suppression_by_priority_and_containment():
    a, b = L.Rule("a", "", (), (), 1, 2), L.Rule("b", "", (), (), 1, 1)
    assert L.suppressed([(0, 10, a), (2, 5, b), (8, 12, b), (0, 20, b)]) == [(0, 10, a), (0, 20, b)]
