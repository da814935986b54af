"""Rewriting a text from its issues, and what a rewrite does to ranges and to the next scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from .doc import Doc, Issue, Span
from .segmenter import Segmenter

MODES = ("none", "orthographic", "lexical_safe", "lexical_contextual")
ORTHOGRAPHIC = ("punctuation", "case", "variant", "grammar")
CLUE_CHARS = 40


class Edit(NamedTuple):
    """One replacement, in the units of its issue (bytes or code points)."""

    offset: int
    length: int
    text: str


def _zero_width(doc: Doc, i: Issue) -> bool:
    found = doc.text[i.start : i.end]
    return i.issue_type == "ai_style" and i.suggestions == ("",) and found != "" and all(c == "​" or (c == "﻿" and i.start > 0) for c in found)


def replacement(doc: Doc, i: Issue, mode: str, segmenter: Segmenter | None, anchor: bool | None = None, outcome: str | None = None) -> str | None:
    """What a tier puts in an issue's place, or null.

    Orthographic issues take their first suggestion in every tier.  All others
    are lexical: they need exactly one suggestion, and one with clues needs the
    contextual tier and enough of its clues among the words around it.
    """
    if mode == "none":
        return None
    if i.issue_type in ORTHOGRAPHIC or _zero_width(doc, i):
        return i.suggestions[0] if i.suggestions else None
    if mode == "orthographic" or outcome == "suppressed" or (anchor is False and not i.clues) or len(i.suggestions) != 1:
        return None
    if i.clues:
        if mode != "lexical_contextual" or segmenter is None:
            return None
        low, high = max(0, i.start - CLUE_CHARS), min(len(doc.text), i.end + CLUE_CHARS)
        low, high = doc.clamp(low, high, i.start, i.end)
        if segmenter.clues(doc.text[low:high], i.clues) < (2 if i.issue_type == "confusable" else 1):
            return None
    return i.suggestions[0]


def applied(doc: Doc, issues: Iterable[Issue], mode: str, segmenter: Segmenter | None, notes: Iterable[tuple[bool | None, str | None]] = ()) -> tuple[str, list[Edit]]:
    """The text after one pass over issues in their order, and the edits made.

    What starts before the last edit's end or touches an excluded range is left
    alone; ``notes`` are the (anchor, tier 2 outcome) of the issues.
    """
    out, edits, cursor = [], [], 0
    known: Iterator[tuple[bool | None, str | None]] = iter(notes)
    for i in issues:
        anchor, outcome = next(known, (None, None))
        touched = any(i.start < e and i.end > s for s, e in doc.excluded) if i.start == i.end else doc.hidden(i.start, i.end)
        if i.start < cursor or touched or (new := replacement(doc, i, mode, segmenter, anchor, outcome)) is None:
            continue
        out += [doc.text[cursor : i.start], new]
        edits.append(Edit(i.start, i.end - i.start, new))
        cursor = i.end
    return "".join([*out, doc.text[cursor:]]), edits


def remapped(offset: int, edits: Iterable[Edit]) -> int:
    """Where a place stands after the edits before it."""
    return offset + sum(len(e.text) - e.length for e in edits if e.offset < offset)


def remapped_ranges(ranges: list[Span], edits: list[Edit]) -> list[Span]:
    """Sorted ranges after edits that lie outside them."""
    out, shift, k = [], 0, 0
    for s, e in ranges:
        while k < len(edits) and edits[k].offset + edits[k].length <= s:
            shift += len(edits[k].text) - edits[k].length
            k += 1
        out.append((s + shift, e + shift))
    return out


def written_spans(edits: list[Edit]) -> list[Span]:
    """The spans that the edits wrote, in the new text."""
    out, shift = [], 0
    for e in edits:
        out.append((e.offset + shift, e.offset + shift + len(e.text)))
        shift += len(e.text) - e.length
    return out


def unwritten(issues: list[Issue], edits: list[Edit]) -> list[Issue]:
    """Issues of a rescan that touch nothing the edits wrote."""
    spans = written_spans(edits)
    return [i for i in issues if not any(i.start <= s < i.end if s == e else i.start < e and i.end > s for s, e in spans)]


def restored(before: list[Issue], after: list[Issue], edits: list[Edit], text: str, new: str) -> list[int | None]:
    """For each issue of a rescan, which issue before the fix it is: same term, place and gloss."""
    known = {(text[i.start : i.end], remapped(i.start, edits), i.end - i.start, i.english): k for k, i in enumerate(before)}
    return [known.get((new[i.start : i.end], i.start, i.end - i.start, i.english)) for i in after]
