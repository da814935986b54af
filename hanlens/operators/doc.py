"""One text as the kernels see it: code points inside, UTF-8 bytes on the way out.

Units (sentences, paragraphs, lines) are found once, by pattern, and excluded
ranges are looked up by bisection, so a detector's work follows its own hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np

Span = tuple[int, int]

# Unicode ranges of ideographs, and of the characters that count as their context.
IDEOGRAPH = "㄀-ㄯ㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002ebe0\U0002ebf0-\U0002ee5f\U00030000-\U000323af"
CONTEXT = IDEOGRAPH + "、-〿！-･︰-﹏"
CJK = re.compile(f"[{IDEOGRAPH}]")
NEAR = re.compile(f"[{CONTEXT}]")
#: White space as Unicode has it (``\s`` of Python adds the separators 1C to 1F).
BLANK = "\t-\r \x85\xa0  -     　"
#: What starts a sentence: not the same ranges as ``IDEOGRAPH``.
_OPENS = "㐀-䶿一-鿿⺀-⻿　-〿豈-﫿"
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Jr", "Sr", "vs", "etc", "i.e", "e.g", "P.S", "p.s", "cf", "al", "Vol", "No", "Fig", "Eq", "Rev")
_END = re.compile(rf"[。！？；]|[.?!](?=[{BLANK}]+([^{BLANK}]))|\r\n\r\n|\n(?=\n)")
_SHORTENED = re.compile(rf"(?:^|[^\w]|_|[{_OPENS}])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})$")
_OPENING = re.compile(f"[{_OPENS}]")
_PARAGRAPH = re.compile(r"\r\n\r\n|\n\n")


class Issue(NamedTuple):
    """A finding, in code points; ``suggestions`` empty advises only, ``("",)`` deletes."""

    code: str
    issue_type: str
    severity: str
    start: int
    end: int
    suggestions: tuple[str, ...] = ()
    rule_id: int | None = None
    english: str | None = None
    clues: tuple[str, ...] = ()


def byte_offsets(text: str) -> np.ndarray:
    """The byte at which each code point starts, and the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])


def merged(spans: list[Span]) -> list[Span]:
    """Sorted ranges with overlapping and adjacent ones joined."""
    out: list[Span] = []
    for s, e in sorted(x for x in spans if x[0] < x[1]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def overlaps(start: int, end: int, spans: list[Span]) -> bool:
    return start < end and any(start < e and end > s for s, e in spans)


class Doc:
    """A text with its merged excluded ranges."""

    def __init__(self, text: str, excluded: list[Span] = ()) -> None:
        self.text = text
        self.excluded = list(excluded)
        self._starts, self._ends = [s for s, _ in excluded], [e for _, e in excluded]

    @cached_property
    def at(self) -> np.ndarray:
        return byte_offsets(self.text)

    @cached_property
    def chinese(self) -> bool:
        return bool(CJK.search(self.text))

    def hidden(self, start: int, end: int) -> bool:
        """Whether a span touches an excluded range; an empty one never does."""
        k = bisect_right(self._ends, start)
        return start < end and k < len(self._starts) and self._starts[k] < end

    def inside(self, start: int, end: int) -> bool:
        """Whether one excluded range covers the span."""
        k = bisect_right(self._starts, start) - 1
        return k >= 0 and end <= self._ends[k]

    def clamp(self, low: int, high: int, start: int, end: int) -> Span:
        """A window around [start, end) cut back to the excluded ranges beside it."""
        k = bisect_right(self._ends, start)
        if k and self._ends[k - 1] > low:
            low = self._ends[k - 1]
        k = bisect_left(self._starts, end)
        if k < len(self._starts) and self._starts[k] < high:
            high = self._starts[k]
        return (low, high) if low <= high else (low, low)

    def window(self, start: int, end: int, chars: int) -> Span:
        """``chars`` characters on both sides, not past a blank line or an excluded range."""
        before, after = self.text[max(0, start - chars) : start], self.text[end : end + chars]
        low, high = start - len(before), end + len(after)
        low += max((before.rfind(b) + len(b) for b in ("\n\n", "\n\r\n") if b in before), default=0)
        breaks = [k for k in (after.find("\n\n"), after.find("\n\r\n")) if k >= 0]
        if breaks:
            high = end + min(breaks)
        return self.clamp(low, high, start, end)

    def places(self, needle: str, start: int = 0, end: int | None = None) -> Iterator[int]:
        """Where ``needle`` stands, one after the other, outside excluded ranges."""
        end = len(self.text) if end is None else end
        k = self.text.find(needle, start, end)
        while k >= 0:
            if not self.hidden(k, k + len(needle)):
                yield k
            k = self.text.find(needle, k + len(needle), end)

    def first(self, needles: tuple[str, ...], start: int, end: int) -> Span | None:
        """The first visible place of any of ``needles``."""
        found = [(k, k + len(n)) for n in needles if (k := next(self.places(n, start, end), -1)) >= 0]
        return min(found, key=lambda s: s[0], default=None)

    def _trimmed(self, start: int, end: int) -> Span | None:
        piece = self.text[start:end]
        left = len(piece) - len(piece.lstrip())
        right = len(piece.rstrip())
        return (start + left, start + right) if left < right else None

    @cached_property
    def sentences(self) -> list[Span]:
        """。！？； and blank lines end one; Latin marks only before white space and a capital, and not after an abbreviation (G1)."""
        out: list[Span] = []
        edges = [0, *(x for r in self.excluded for x in r), len(self.text)]
        for low, high in zip(edges[::2], edges[1::2], strict=True):  # between the excluded ranges
            start = low
            for m in _END.finditer(self.text, low, high):
                mark, end = m[0], m.end()
                if mark in ".?!":
                    if not (m[1].isupper() or _OPENING.match(m[1])) or _SHORTENED.search(self.text[max(0, end - 8) : end - 1]):
                        continue
                elif mark not in "。！？；":
                    end = m.start()
                if span := self._trimmed(start, end):
                    out.append(span)
                start = end
            if span := self._trimmed(start, high):
                out.append(span)
        return out

    @cached_property
    def paragraphs(self) -> list[Span]:
        """What blank lines part, without the blank ones."""
        return list(self.parts(_PARAGRAPH))

    @cached_property
    def blocks(self) -> list[Span]:
        """What an empty line (``\\n\\n`` only) parts, blank and wholly excluded ones left out."""
        return [p for p in self.parts(re.compile("\n\n")) if not self.inside(*p)]

    def parts(self, separator: re.Pattern, start: int = 0, end: int | None = None, blank: bool = False) -> Iterator[Span]:
        """The pieces between separators; blank ones only if asked."""
        end = len(self.text) if end is None else end
        at = start
        for s, e in [*(m.span() for m in separator.finditer(self.text, start, end)), (end, end)]:
            if blank or not self.text[at:s].isspace() and at < s:
                yield at, s
            at = e

    @cached_property
    def lines(self) -> list[Span]:
        return list(self.parts(re.compile("\n"), blank=True))

    def sentence_at(self, k: int) -> Span | None:
        """The sentence over a place."""
        return _over(self.sentences, k)

    def paragraph_at(self, k: int) -> Span | None:
        return _over(self.paragraphs, k)

    def sentences_in(self, paragraph: Span) -> list[Span]:
        """The sentences that lie in a paragraph."""
        k = bisect_left(self.sentences, (paragraph[0], 0))
        out = []
        while k < len(self.sentences) and self.sentences[k][1] <= paragraph[1]:
            out.append(self.sentences[k])
            k += 1
        return out


_ITEM = re.compile(r"(?<=\n)(?=#{1,6} |[-*+] |[0-9]+\. )")


def chunk(text: str, start: int, end: int, most: int = 500) -> Span:
    """The paragraph, heading or list item around a span; of a longer one about ``most`` characters, to the ends of sentences."""
    low = max([text.rfind("\n\n", 0, start) + 2 if "\n\n" in text[:start] else 0, *(m.start() for m in _ITEM.finditer(text, max(0, start - 2000), start + 1) if m.start() <= start)])
    ends = [k for k in (text.find("\n\n", end), next((m.start() - 1 for m in _ITEM.finditer(text, end)), -1)) if k >= end]
    high = min(ends, default=len(text))
    if high - low <= most:
        return low, high
    half = (most - 40) // 2
    left, right = start, end
    while left > low and start - left < half + 20 and not (start - left >= half and text[left - 1] in "。！？；\n"):
        left -= 1
    while right < high and right - end < half + 20:
        right += 1
        if right - end >= half and text[right - 1] in "。！？；\n":
            break
    return left, max(end, min(right, left + most))


def _over(spans: list[Span], k: int) -> Span | None:
    i = bisect_right(spans, (k, 1 << 60)) - 1
    return spans[i] if i >= 0 and k < spans[i][1] else None
