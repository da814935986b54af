"""Toxicity (operator 2): a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps letter by letter, so positions survive: case, accents (the base
letter of the compatibility decomposition), look-alike letters of other
scripts, and digits or signs that stand for letters.  Zero-width characters are
taken out first.  A match must start where a word starts in the unfolded text
and hold a letter there, so bare numbers never match; entries for whole words
must end where the word ends.  A match inside an exception phrase does not
count.  The score is the logistic of ``a + b * sum(weights) / words ** gamma``.

Lexicon, exceptions learnt beside the given ones, ``a``, ``b`` and ``gamma`` come
from at most ``PER_CLASS`` labelled rows of each class (the documented bound).
Every word, and every beginning of words, that enough toxic texts hold and whose
document log-odds are high is an entry.  Copies of one text count once towards
enough, so words that merely travel with it are left out; a beginning is folded
into its entries when too few toxic texts hold it without one of them.

Bounds: the sample alone bounds the lexicon, the exceptions (a match with the
word next to it that three clean texts and no toxic one hold) and so the
automaton that is sent to the workers; beginnings are 4 to 8 letters long.

Cases: null and empty texts have no match and score like any text without one; a
very long text is matched whole in one pass; of entries that start together
(ties) the heaviest counts, once; no labelled rows of both classes leave an empty
lexicon and a score of 0.25 everywhere; repeated rows score alike; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, held_out, label_sample, texts, written

PER_CLASS = 4096
#: Lengths of word beginnings that may become entries.
STEM = range(4, 9)
MIN_ROWS, MIN_LOG_ODDS = 5, 2.5
#: Powers of the length that a score may be divided by; none of them leaves the length out.
GAMMAS = (0.25, 0.5, 0.75, 1.0)
#: Texts are copies when all hashes of a band agree: smallest hashes of their runs of three words.
BANDS, BAND_HASHES = 4, 4
EXCEPTIONS = ("clown fish", "trash can", "pathetic fallacy")

#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOK_ALIKE = "аеорсухкмтвніѕјԁԛԝɡɩαεικνορτυχ"
LOOKS_LIKE = "aeopcyxkmtbhisjdqwgiaeikvoptux"
SIGNS, LETTERS = "013457@$!|", "oieastasil"
_M64 = (1 << 64) - 1
_ZERO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def _table() -> dict[int, str]:
    """Folding of the Latin, full-width and mathematical letters by their decomposition."""
    fold = {}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D6A6)):
        for code in block:
            if (base := unicodedata.normalize("NFKD", chr(code))[0].lower()) != chr(code) and base.isascii():
                fold[code] = base
    for a, b in zip(LOOK_ALIKE, LOOKS_LIKE, strict=True):
        fold[ord(a)] = fold[ord(a.upper())] = b
    fold |= {ord(a): b for a, b in zip(SIGNS, LETTERS, strict=True)}
    return fold


_FOLD = _table()
_ASCII_FOLD = str.maketrans(SIGNS, LETTERS)


def plain(text: str) -> str:
    """Lower case without zero-width characters; every letter keeps one place."""
    if text.isascii():
        return text.lower()
    return _ZERO_WIDTH.sub("", text).lower()


def fold(low: str) -> str:
    """Letter for letter what ``plain`` text stands for."""
    return low.translate(_ASCII_FOLD if low.isascii() else _FOLD)


def _words(text: str) -> set[str]:
    """Folded words that hold a letter."""
    low = plain(text)
    folded = fold(low)
    return {folded[m.start() : m.end()] for m in re.finditer(r"\w+", low) if not m[0].isdigit()}


class Toxicity(NamedTuple):
    """Entries (folded, whole word or beginning) with weights, exceptions, and the calibration."""

    entries: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    a: float
    b: float
    gamma: float


class Matcher:
    """The automaton of one model."""

    def __init__(self, model: Toxicity) -> None:
        self.model, self.automaton = model, ahocorasick.Automaton()
        found: dict[str, list] = {}
        for term, whole, weight in model.entries:
            found.setdefault(term, []).append((whole, weight))
        for phrase in model.exceptions:
            found.setdefault(fold(plain(phrase)), []).append(None)
        for term, values in found.items():
            self.automaton.add_word(term, (len(term), values))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each counted match; of entries that start together the heaviest."""
        if self.empty:
            return []
        low = plain(text)
        best: dict[int, tuple[int, float]] = {}
        safe: list[tuple[int, int]] = []
        for last, (n, values) in self.automaton.iter(fold(low)):
            start, end = last + 1 - n, last + 1
            if start and low[start - 1].isalnum():
                continue
            for v in values:
                if v is None:
                    safe.append((start, end))
                elif not (v[0] and end < len(low) and low[end].isalnum()) and any(c.isalpha() for c in low[start:end]) and v[1] > best.get(start, (0, 0.0))[1]:
                    best[start] = (end, v[1])
        out, k, reach = [], 0, 0
        safe.sort()
        for s, (e, w) in sorted(best.items()):
            while k < len(safe) and safe[k][0] <= s:  # how far the phrases that start by now reach
                reach, k = max(reach, safe[k][1]), k + 1
            if e > reach:
                out.append((s, e, w))
        return out

    def value(self, text: str, gamma: float) -> float:
        total = sum(w for *_, w in self.hits(text))
        return total / max(1, len(text.split())) ** gamma if total else 0.0

    def score(self, text: str) -> float:
        m = self.model
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, m.a + m.b * self.value(text, m.gamma)))))


def _log_odds(n1: int, n0: int, all1: int, all0: int) -> float:
    return math.log((n1 + 0.5) / (all1 + 1)) - math.log((n0 + 0.5) / (all0 + 1))


def _terms(words: set[str]) -> set[str]:
    """Words as ``=word`` and beginnings as ``^stem``."""
    return {"=" + w for w in words if len(w) >= 3} | {"^" + w[:k] for w in words for k in STEM if len(w) >= k}


def _logistic_1d(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(a, b, loss) of an even-prior logistic fit with a light ridge on b, by Newton's method."""
    wt = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    a = b = 0.0
    scale = max(float(x.std()), 1e-9)
    u = x / scale
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * u, -35, 35)))
        g = np.array([(wt * (p - y)).sum() + 1e-3 * a, (wt * (p - y) * u).sum() + 0.5 * b])
        d = wt * p * (1 - p)
        h = np.array([[d.sum() + 1e-3, (d * u).sum()], [(d * u).sum(), (d * u * u).sum() + 0.5]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-(a + b * u))), 1e-12, 1 - 1e-12)
    return a, b / scale, float(-(wt * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Lexicon and calibration from a bounded sample; nothing but texts and the label is read."""
    sample = written(label_sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col).select("doc_id", "text", "y"), "toxicity-sample")
    totals = dict(sample.groupBy("y").count().collect())
    all1, all0 = totals.get(1, 0), totals.get(0, 0)
    if not all1 or not all0:
        return Toxicity((), exceptions, math.log(1 / 3), 0.0, 0.0)

    counted = arrow_schema("term string, n1 long, n0 long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                n[y].update(_terms(_words(t.decode())))
            terms = list(n[0] | n[1])
            yield batch(counted, [terms, [n[1][t] for t in terms], [n[0][t] for t in terms]])

    odds = F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n0") + 0.5) / (all0 + 1))
    rows = sample.select("text", "y").mapInArrow(count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    rows = rows.where((F.col("n1") >= MIN_ROWS) & (odds >= MIN_LOG_ODDS)).collect()
    weight = {r.term: _log_odds(r.n1, r.n0, all1, all0) for r in rows}
    sent = sample.sparkSession.sparkContext.broadcast(weight)
    holding = arrow_schema("doc_id long, terms array<string>, copied array<long>")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [x.decode() for x in texts(b.column(1))]
            yield batch(holding, [b.column(0), [sorted(t for t in _terms(_words(x)) if t in sent.value) for x in given], [_bands(x) for x in given]])

    toxic = sample.where("y = 1").select("doc_id", "text").mapInArrow(hold, "doc_id long, terms array<string>, copied array<long>").orderBy("doc_id").collect()
    chosen = _admitted([set(r.terms) for r in toxic], _same([r.copied for r in toxic]), weight)
    entries = tuple((t[1:], t[0] == "=", w) for t, w in chosen)
    return _calibrated(sample, Toxicity(entries, exceptions, 0.0, 0.0, 0.0))


def _bands(text: str) -> list[int]:
    """A key for each band of the text's smallest hashes; copies of a text agree in one of them."""
    w = fold(plain(text)).split()
    runs = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    h = np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64)
    least = [int(((h ^ np.uint64(k * 0x9E3779B97F4A7C15 & _M64)) * np.uint64(0xBF58476D1CE4E5B9)).min()) for k in range(1, BANDS * BAND_HASHES + 1)]
    return [xxhash.xxh64_intdigest(repr((k, least[k : k + BAND_HASHES]))) >> 1 for k in range(0, len(least), BAND_HASHES)]


def _same(keys: list[list[int]]) -> list[int]:
    """The text of each row: rows that share a key have the same one."""
    up = list(range(len(keys)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    first: dict[int, int] = {}
    for k, row in enumerate(keys):
        for x in row:
            a, b = root(k), root(first.setdefault(x, k))
            up[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(keys))]


def _admitted(rows: list[set[str]], text: list[int], weight: dict[str, float]) -> list[tuple[str, float]]:
    """Every term of enough distinct texts; a beginning counts those that hold no entry it begins."""
    where: dict[str, set[int]] = {}
    for k, terms in zip(text, rows, strict=True):
        for t in terms:
            where.setdefault(t, set()).add(k)
    chosen: list[tuple[str, float]] = []
    under: dict[str, set[int]] = {}
    for t in sorted(where, key=lambda t: (t[0] != "=", -len(t), t)):
        if len(where[t] - under.get(t[1:], set()) if t[0] == "^" else where[t]) >= MIN_ROWS:
            chosen.append((t, weight[t]))
            for k in STEM:
                if len(t) > k:
                    under.setdefault(t[1 : k + 1], set()).update(where[t])
    return chosen


def _calibrated(sample: DataFrame, model: Toxicity) -> Toxicity:
    """Add the exceptions that clean rows show, then choose ``gamma`` and fit ``a`` and ``b``."""
    seen = arrow_schema("y int, n long, total double, around array<string>")
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sent.value)
        for b in batches:
            out: list[list] = [[], [], []]
            for t in texts(b.column(0)):
                text = t.decode()
                hits, low = m.hits(text), plain(text)
                out[0].append(len(text.split()))
                out[1].append(float(sum(w for *_, w in hits)))
                out[2].append(sorted({p for s, e, _ in hits for p in _around(low, s, e)}))
            yield batch(seen, [b.column(1), *out])

    def measure() -> list:
        return sample.select("text", "y").mapInArrow(look, "y int, n long, total double, around array<string>").collect()

    rows = measure()
    near: tuple[Counter, Counter] = (Counter(), Counter())
    for r in rows:
        near[r.y].update(r.around)
    learnt = sorted(p for p, n in near[0].items() if n >= 3 and not near[1][p])
    if learnt:
        model = model._replace(exceptions=(*model.exceptions, *learnt))
        sent = sample.sparkSession.sparkContext.broadcast(model)
        rows = measure()
    y, n, total = (np.array([r[k] for r in rows], float) for k in range(3))
    fits = [(_logistic_1d(total / np.maximum(n, 1) ** g, y), g) for g in GAMMAS]
    (a, b, _), gamma = min(fits, key=lambda f: f[0][2])
    return model._replace(a=a, b=b, gamma=gamma)


def _around(low: str, start: int, end: int) -> list[str]:
    """The match with the word before it, and with the word after it, where one space parts them."""
    def word(k: int) -> bool:
        return 0 <= k < len(low) and (low[k].isalnum() or low[k] == "_")

    out, a, b = [], start - 1, end
    if a > 0 and low[a] == " ":
        while word(a - 1):
            a -= 1
        if a < start - 1:
            out.append(low[a:end])
    while word(b):
        b += 1
    if low[b : b + 1] == " " and word(b + 1):
        b += 1
        while word(b):
            b += 1
        out.append(low[start:b])
    return out


def toxicity_scores(docs: DataFrame, model: Toxicity, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches) for every row."""
    ddl = "doc_id long, held_out boolean, score double, predicted int, n_matches int"
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sent.value)
        for b in batches:
            out: list[list] = [[], []]
            for t in texts(b.column(1)):
                text = t.decode()
                hits = m.hits(text)
                x = sum(w for *_, w in hits) / max(1, len(text.split())) ** m.model.gamma if hits else 0.0
                out[0].append(1 / (1 + math.exp(-max(-35.0, min(35.0, m.model.a + m.model.b * x)))))
                out[1].append(len(hits))
            yield batch(schema, [b.column(0), held_out(b.column(0).to_pylist(), 5, 0), out[0], [int(s >= threshold) for s in out[0]], out[1]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, ddl)


def toxic_spans(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every counted match: (doc_id, start, length, weight), in code points of ``plain`` text."""
    ddl = "doc_id long, start int, length int, weight double"
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(model)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sent.value)
        for b in batches:
            rows = [(i, s, e - s, w) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True) for s, e, w in m.hits(t.decode())]
            yield batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(spans, ddl)
