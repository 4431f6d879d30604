"""License scans by ordered signature rules.

A rule is a hand-written pattern with a label, a confidence, a priority and the
keywords without one of which it cannot match (license_rules). One automaton
finds all keywords of a text; only the rules that they gate are tried, and only
around them. Time grows in proportion to the text, whatever it says (with the
logarithm of the detections). Detections are places in the text. Taken from the
highest priority down (then longest, then leftmost), a detection is suppressed
if it lies within one already taken; so "gnu lesser general public license" is
not also a detection of the plain one by a rule.

Beside the rules stand three base phrases, found as consecutive words; their
labels always stay, whatever the rules suppress.

Defined cases: a null text is empty; an empty text has no words and no labels,
its score is 0; null ids are kept; a repeated row gives a repeated result;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.common import map_rows, table, texts
from driftlens.llm.license_rules import FORMS, NAMES, NOTICES, REACH, STATEMENTS

#: Phrases and labels of the base.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

#: A word: anything but ASCII that is no letter or digit ends it. Texts are lower-cased in A-Z before.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.array([x >= 128 or chr(x).isdigit() or 97 <= x <= 122 for x in range(256)])


@dataclass(frozen=True)
class Rule:
    """pattern matches lower-cased UTF-8 around one of keywords, in texts that hold one of forms, if any; priority: higher suppresses lower."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    forms: tuple[str, ...]
    confidence: float
    priority: int


def _statement(label: str, keywords: str, pattern: str) -> Rule:
    """Addresses go before clauses, clauses before names, names of more words before shorter ones, notices last."""
    gates = tuple(keywords.split(","))
    if label in NOTICES:
        return Rule(label, pattern, gates, (), 0.6, 12)
    if "\\." in pattern and "/" in pattern:
        return Rule(label, pattern, gates, (), 0.95, 48)
    if not pattern.startswith(r"\b"):
        return Rule(label, pattern, gates, (), 0.95, 45)
    return Rule(label, pattern, gates, (), 0.8, 10 + 2 * min(10, pattern.count(" ")))


def rules() -> list[Rule]:
    """All rules: every name in every form, and the statements; several hundred."""
    out = [_statement(*(x.strip() for x in line.split(" | "))) for line in STATEMENTS]
    for line in NAMES:
        label, keywords, names = (x.strip() for x in line.split(" | "))
        out += [Rule(label, form.replace("{}", names), tuple(keywords.split(",")), gates, c, p) for form, gates, c, p in FORMS]
    return out


_LETTER = r"[0-9a-z_\x80-\xff]"
_BORDER = rf"(?:(?<!{_LETTER})(?={_LETTER})|(?<={_LETTER})(?!{_LETTER}))"


def compiled(rule: Rule) -> re.Pattern[bytes]:
    return re.compile(rule.pattern.replace(r"\b", _BORDER).encode())


class Scanner:
    """The rules, compiled, behind one automaton of their keywords."""

    def __init__(self, ordered: list[Rule]):
        self.rules, self.patterns = ordered, [compiled(r) for r in ordered]
        self.automaton = ahocorasick.Automaton()
        self.near: dict[str, list[int]] = {}
        for k, rule in enumerate(ordered):
            for word in rule.keywords:
                self.near.setdefault(word, []).append(k)
        for word in {w for r in ordered for w in (*r.keywords, *r.forms)}:
            self.automaton.add_word(word.encode().decode("latin-1"), word)
        self.automaton.make_automaton()

    def windows(self, raw: bytes) -> dict[int, list[tuple[int, int]]]:
        """Where each rule can match: around its keywords, if one of its form's is in the text too."""
        hits: dict[str, list[int]] = {}
        for end, word in self.automaton.iter(raw.decode("latin-1")):
            hits.setdefault(word, []).append(end)
        out: dict[int, list[tuple[int, int]]] = {}
        for k in {k for word in hits for k in self.near.get(word, ())}:
            rule = self.rules[k]
            if rule.forms and hits.keys().isdisjoint(rule.forms):
                continue
            parts: list[tuple[int, int]] = []
            for end in sorted(e for w in rule.keywords for e in hits.get(w, ())):
                low, high = max(0, end - REACH), end + REACH
                if parts and low <= parts[-1][1]:
                    low = parts.pop()[0]
                parts.append((low, high))
            out[k] = parts
        return out

    def detections(self, raw: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) by bytes of lower-cased text, after suppression, in order of start."""
        found = [(m.start(), m.end(), self.rules[k]) for k, parts in self.windows(raw).items() for low, high in parts for m in self.patterns[k].finditer(raw, low, high)]
        return sorted(suppressed(found), key=lambda d: (d[0], d[1], d[2].label))


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is left when no detection lies within another that goes before it.

    Those that went before are kept in a tree of starts with the furthest end up
    to each, so n detections take n log n steps.
    """
    order = sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label, d[2].pattern))
    place = {start: k for k, start in enumerate(sorted({d[0] for d in found}), 1)}
    furthest, taken = [0] * (len(place) + 1), []
    for d in order:
        k, reach = place[d[0]], 0
        while k:
            reach, k = max(reach, furthest[k]), k & (k - 1)
        if reach >= d[1]:
            continue
        taken.append(d)
        k = place[d[0]]
        while k < len(furthest):
            furthest[k] = max(furthest[k], d[1])
            k += k & -k
    return taken


_BASE_WORDS = {phrase: phrase.split() for phrase in BASE}


def base_places(raw: bytes) -> list[tuple[int, str]]:
    """(first word's number, label) of every place of a base phrase in lower-cased text, in order."""
    rarest = (b"cc", b"license", b"reserved")
    if not any(w in raw for w in rarest):
        return []
    words = WORD.findall(raw)
    out = []
    for phrase, label in BASE.items():
        want = _BASE_WORDS[phrase]
        k = -1
        while True:
            try:
                k = words.index(want[0], k + 1)
            except ValueError:
                break
            if words[k : k + len(want)] == want:
                out.append((k, label))
    return sorted(out)


def count_words(raw: bytes) -> int:
    """Words of lower-cased text: starts of runs of word bytes."""
    inside = _IS_WORD[np.frombuffer(raw, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].any())


def lower(text: str) -> bytes:
    """UTF-8 with A-Z, and no other letters, lower-cased."""
    return text.encode().lower()


def scan(scanner: Scanner, text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the detections of one text."""
    raw = lower(text)
    base = base_places(raw)
    found = scanner.detections(raw)
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(r.label for _, _, r in found)})
    doubt = 1.0
    for confidence in [0.8] * bool(base) + [r.confidence for _, _, r in found]:
        doubt *= 1 - confidence
    places = [k for k, _ in base]
    spans = ";".join(f"{s}-{e}:{r.label}" for s, e, r in found)
    return count_words(raw), len(base), min(places, default=None), max(places, default=None), ",".join(base_labels), ",".join(labels), round(1 - doubt, 6), spans


def _maker() -> Callable[[dict[str, list]], dict[str, list]]:
    scanner = Scanner(rules())
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

    def one(columns: dict[str, list]) -> dict[str, list]:
        rows = [scan(scanner, t) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], **{n: [r[k] for r in rows] for k, n in enumerate(names)}}

    return one


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each document; detections lists byte ranges and labels that rules found and nothing suppressed."""
    return map_rows(texts(docs), _maker, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
