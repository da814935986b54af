"""Words of running Chinese: maximum matching over a frequency dictionary, and the boundary test."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np

from ..rules import STOP_WORDS, VOCABULARY, Rule
from .doc import CJK

LONGEST = 32
#: Characters of a text from which the boundaries are read off a map.
MAPPED = 4096


class Segmenter:
    """Three-word-chunk maximum matching (G4, G5); rules weigh 1, the vocabulary 5, stop words 10."""

    def __init__(self, rules: Iterable[Rule], vocabulary: Iterable[str] = VOCABULARY, stop_words: Iterable[str] = STOP_WORDS) -> None:
        live = [r for r in rules if not r.disabled]
        self.words = {w: 1 for r in live for w in (r.from_, *r.to, *r.clues, *r.negative) if w}
        for w in vocabulary:
            self.words.setdefault(w, 5)
        self.words.update(dict.fromkeys(stop_words, 10))
        self.terms = {r.from_ for r in live}
        self.longest = min(LONGEST, max(map(len, self.words), default=1))
        by_head: dict[str, set[int]] = {}
        for w in self.words:
            by_head.setdefault(w[0], set()).add(len(w))
        self._words: ahocorasick.Automaton | None = None
        #: Lengths of the words that begin with a character; a text is only cut where one can be.
        self.lengths = {c: tuple(sorted(n for n in ns if 1 < n <= LONGEST)) for c, ns in by_head.items()}

    def _here(self, text: str, k: int) -> list[str]:
        return [text[k : k + 1], *(w for n in self.lengths.get(text[k : k + 1], ()) if len(w := text[k : k + n]) == n and w in self.words)]

    def segment(self, text: str) -> list[tuple[int, str, bool]]:
        """(code point offset, word, in dictionary); runs of other scripts are one word."""
        out, k = [], 0
        while k < len(text):
            if not CJK.match(text[k]):
                m = CJK.search(text, k)
                e = m.start() if m else len(text)
                out.append((k, text[k:e], text[k:e] in self.words))
                k = e
                continue
            best, word = None, text[k]
            for a in self._here(text, k):
                for b in self._here(text, k + len(a)) if k + len(a) < len(text) else [""]:
                    rest = k + len(a) + len(b)
                    for c in self._here(text, rest) if b and rest < len(text) else [""]:
                        chunk = [w for w in (a, b, c) if w]
                        n = sum(map(len, chunk))
                        mean = n / len(chunk)
                        key = (n, -len(chunk), -sum((len(w) - mean) ** 2 for w in chunk), sum(self.words.get(w, 0) for w in chunk if len(w) == 1), len(a))
                        if best is None or key > best:
                            best, word = key, a
            out.append((k, word, word in self.words))
            k += len(word)
        return out

    def clues(self, window: str, clues: Iterable[str]) -> int:
        """Distinct clues that are, or are properly inside, a dictionary word of the window."""
        words = {w for _, w, known in self.segment(window) if known}
        return sum(any(c in w for w in words) for c in set(clues))

    def boundaries(self, text: str) -> np.ndarray:
        """For each place of a long text where the earliest word begins that runs over it, or its length (G8b); the same answers as ``straddles``, read off."""
        first = np.full(len(text) + 1, len(text) + 1)
        if self._words is None:
            self._words = ahocorasick.Automaton()
            for w in self.words:
                lead = next((k for k, c in enumerate(w) if not CJK.match(c)), len(w))
                if 1 < len(w) <= LONGEST and w not in self.terms and lead > 1:
                    self._words.add_word(w, (len(w), min(lead, len(w))))
            if len(self._words):
                self._words.make_automaton()
        for last, (n, lead) in self._words.iter(text) if len(self._words) else ():
            s = last + 1 - n
            np.minimum(first[s + 1 : s + lead], s, out=first[s + 1 : s + lead])
        return first

    def straddles(self, text: str, start: int, end: int) -> bool:
        """Whether a dictionary word that is no rule's term crosses an edge of [start, end).

        At the end only words count that begin at the start or before it.
        """
        return self._crosses(text, start, start) or self._crosses(text, end, start)

    def _crosses(self, text: str, edge: int, last: int) -> bool:
        if not 0 < edge < len(text) or not CJK.match(text[edge]):
            return False
        for k in range(edge - 1, max(-1, edge - self.longest), -1):
            if not CJK.match(text[k]):
                return False
            if k <= last:
                for n in self.lengths.get(text[k], ()):
                    w = text[k : k + n]
                    if k + n > edge and len(w) == n and w in self.words and w not in self.terms:
                        return True
        return False
