"""Dictionary matching in a kernel: one automaton over all terms, then each rule's chain of conditions.

A text is read once whatever the number of rules.  The compiled rules are sent
to the workers once; ``dictionary.MOST_RULES`` bounds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np

from ..rules import CASES, INTERNATIONAL_ONLY, SEVERITY, Rule
from .doc import Doc, Issue
from .segmenter import MAPPED, Segmenter

MOST_CLUES, CLUE_CHARS, PLACE_CHARS = 32, 40, 20


def absorbers(rules: Iterable[Rule]) -> list[str]:
    """Exception phrases and suggestions around a term that match in its place, unless they hide another rule (M3)."""
    rules = [r for r in rules if not r.disabled]
    terms = {r.from_ for r in rules}
    heads = {t[:k] for t in terms for k in range(1, len(t) + 1)}
    around = {(p, r.from_) for r in rules for p in (*r.exceptions, *r.to) if r.from_ in p and p not in terms}
    sizes = {len(t) for t in terms}

    def hides(p: str, own: str) -> bool:
        inside = {p[k : k + n] for n in sizes if n <= len(p) for k in range(len(p) - n + 1)} & terms
        return bool(inside - {own}) or any(p[k:] in heads and not own.startswith(p[k:]) for k in range(1, len(p)))

    return sorted({p for p, own in around} - {p for p, own in around if hides(p, own)})


def effective(rule: Rule) -> tuple[str, ...]:
    """Non-empty suggestions; an empty one alone deletes; without any the English gloss (F16)."""
    some = tuple(x for x in rule.to if x)
    return rule.to if rule.to == ("",) else some or ((rule.english,) if rule.english else ())


class Spelling:
    """Rules that a profile's gates let through, compiled (M2-M4)."""

    def __init__(
        self, rules: Iterable[Rule], segmenter: Segmenter | None = None, variants: bool = False, fillers: bool = True, translationese: bool = True, stance: str = "roc_centric",
        cases: Iterable[str] = CASES,
    ) -> None:
        last = {r.from_: r for r in rules}  # the last layer with a term wins
        shut = {k for k, on in (("variant", variants), ("ai_filler", fillers), ("translationese", translationese)) if not on}
        if stance == "neutral":
            shut.add("political_coloring")
        self.rules = {
            t: r for t, r in last.items() if not r.disabled and r.type not in shut and not (stance == "international" and r.type == "political_coloring" and t in INTERNATIONAL_ONLY)
        }
        self.segmenter = segmenter
        self._mapped: tuple[Doc | None, np.ndarray] = (None, np.empty(0))
        self.automaton = ahocorasick.Automaton()
        for t in [*self.rules, *absorbers(self.rules.values())]:
            self.automaton.add_word(t, len(t))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        forms = [c.split("|") for c in cases]
        self.case_terms = {f[0].lower(): f[0] for f in forms}
        self.case_forms = {x for f in forms for x in (f[0], *f[1].split(",")) if x}
        longest = sorted(map(re.escape, self.case_terms), key=lambda t: (-len(t), t))
        self.case = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(longest)})(?![A-Za-z])", re.I | re.ASCII) if forms else None

    def checked(self) -> int:
        """How many rules a scan tries."""
        return len(self.rules)

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost-longest matches, one after the other (M1)."""
        if self.empty:
            return
        at = 0
        for s, n in sorted(((last + 1 - n, n) for last, n in self.automaton.iter(text)), key=lambda m: (m[0], -m[1])):
            if s >= at:
                at = s + n
                yield s, at

    def issues(self, doc: Doc, script: str = "unknown") -> Iterator[Issue]:
        """Hits that pass their rule's conditions; a deletion takes one following ``，`` or ``：`` along."""
        for s, e in self.matches(doc.text):
            rule = self.rules.get(doc.text[s:e])
            if rule is None or (rule.type == "variant" and script == "simplified") or doc.hidden(s, e) or not self._passes(doc, rule, s, e):
                continue
            if rule.to == ("",) and doc.text[e : e + 1] in ("，", "：") and not doc.hidden(e, e + 1):
                e += 1
            kind = "ai_style" if rule.type == "ai_filler" else rule.type
            yield Issue("dictionary", kind, SEVERITY[rule.type], s, e, effective(rule), rule.rule_id, rule.english, rule.clues)

    def _passes(self, doc: Doc, rule: Rule, s: int, e: int) -> bool:
        return not (
            _surrounded(doc.text, rule.from_, rule.to, s)
            or not _clued(doc, rule, s, e)
            or self._cuts(doc, s, e)
            or _surrounded(doc.text, rule.from_, rule.exceptions, s)
            or not all(_placed(doc, p, s, e) for p in rule.positional)
        )

    def _cuts(self, doc: Doc, s: int, e: int) -> bool:
        """Whether a general word runs over an edge of the hit (M4f)."""
        if self.segmenter is None:
            return False
        if len(doc.text) <= MAPPED:
            return self.segmenter.straddles(doc.text, s, e)
        if self._mapped[0] is not doc:
            self._mapped = (doc, self.segmenter.boundaries(doc.text))
        first = self._mapped[1]
        return first[s] < s or first[e] <= s

    def case_issues(self, doc: Doc) -> Iterator[Issue]:
        """Product names in another case, not inside a longer Latin word (M6)."""
        for m in self.case.finditer(doc.text) if self.case else ():
            if m[0] not in self.case_forms and not doc.hidden(*m.span()):
                yield Issue("case", "case", "info", *m.span(), (self.case_terms[m[0].lower()],))


def _surrounded(text: str, term: str, phrases: tuple[str, ...], start: int) -> bool:
    """Whether one of the phrases lies over the hit as it stands in the text (M4e, M4g)."""
    for p in phrases:
        k = p.find(term)
        while k >= 0:
            if p != term and k <= start and text.startswith(p, start - k):
                return True
            k = p.find(term, k + 1)
    return False


def _clued(doc: Doc, rule: Rule, s: int, e: int) -> bool:
    """A positive clue, if any is listed, and no negative one begin in the window (M4h)."""
    if not rule.clues and not rule.negative:
        return True
    low, high = doc.window(s, e, CLUE_CHARS)

    def begins(c: str) -> bool:
        return doc.text.find(c, low, high - 1 + len(c)) >= 0

    return not any(map(begins, rule.negative)) and (not rule.clues or any(map(begins, rule.clues[:MOST_CLUES])))


def _placed(doc: Doc, clue: str, s: int, e: int) -> bool:
    """A positional clue's condition (M4i); ``before:X`` means that the hit comes before X."""
    kind, _, word = clue.partition(":")
    if kind == "adjacent":
        before, after = (s - len(word), s), (e, e + len(word))
        return before[0] >= 0 and any(doc.text[a:b] == word and not doc.hidden(a, b) for a, b in (before,)) or doc.text[e : after[1]] == word and not doc.hidden(*after)
    low, high = doc.window(s, e, PLACE_CHARS)
    found = word in (doc.text[e:high] if kind.endswith("before") else doc.text[low:s])
    return not found if kind.startswith("not_") else found
