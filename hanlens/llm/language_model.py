"""LM scoring with a hidden Markov language model (operator 3).

*Counts.*  Every training text's words (A-Z lowered) and one end each are counted
over the whole corpus; ``c``, ``N`` and ``V`` give the base score.

*Model.*  ``STATES`` latent states emit symbols.  The ``OWN`` most frequent words
and the end are symbols of their own; every other word shows the state only its
class, a hash of its first two and last three bytes, and within its class a word
has the share ``(1 - u) * (c + 1) / mass``, where ``u`` is the class's
Good-Turing mass of unseen words (all unseen words of a class are one event).
So ``P(word | state) = B[state, symbol] * share(word)``, which sums to one over
the known words and the unseen events, and the score is the exact likelihood of
the symbols, by the scaled forward recursion, plus the logarithms of the shares.

*Training.*  Baum-Welch: each task folds its texts into expected transition and
emission counts, which are summed over the cluster.  Every iteration reads the
counts of all training texts, never of some of them.  The first ones, which break
the symmetry of the start, read them as a table of neighbours: how often a symbol
follows another (or begins a text), at most ``SYMBOLS ** 2`` pairs whatever the
corpus, whose likelihood they raise.  Then come passes over the texts themselves,
until a token gains less than ``LEAST_GAIN``.  Nothing depends on how the rows are
dealt; a text over ``PIECE`` tokens is passed over, not scored, in pieces of that
length.

*Size.*  The words with a count above a threshold, at most ``HEAD`` of at most
``LONGEST`` bytes each, are broadcast (longer words are known by their SHA-256).
All other words meet their counts by a shuffle, pre-aggregated by text; none of
them can be frequent, so no key is hot.

Cases: null and empty texts are the end alone; a very long text is scored whole,
``PIECE`` tokens at a time with the state carried over; null ids count as ``''``
for the split; repeated rows are texts of their own; words of one count (ties)
are ordered by their bytes; without training rows N = V = 0, every word is
unseen, and the model is the uniform start; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, held_out, held_out_col, texts, written

STATES, OWN, CLASSES = 8, 4096, 2048
HEAD, LONGEST = 1 << 17, 64
START_ITERATIONS, PASSES, LEAST_GAIN = 24, 8, 0.002
STICKY = 0.9
END = OWN + CLASSES
SYMBOLS = END + 1
#: Distinct words a task holds before it hands its counts on; tokens of one recursion.
COUNTED, TOKENS = 400_000, 500_000
PIECE = 200_000
#: Rows in which the sums of an iteration, and the table of neighbours, are dealt.
SLICE, PARTS = 64, 256
#: Tokens whose neighbours are counted at once; pairs in one step of their recursion.
COUNTED_PAIRS, PAIRS = 4_000_000, 1 << 14


def word_keys(text: bytes) -> list[bytes]:
    """Words with A-Z lowered; one longer than ``LONGEST`` bytes as its marked digest."""
    words = text.lower().split()
    if len(text) > LONGEST and words and max(map(len, words)) > LONGEST:
        return [w if len(w) <= LONGEST else b"\x00" + hashlib.sha256(w).digest() for w in words]
    return words


def word_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[:2] + b"|" + word[-3:]) % CLASSES


def word_class_col(word: str) -> Column:
    part = F.concat(F.substring(word, 1, 2), F.lit(bytearray(b"|")), F.expr(f"if(length({word}) <= 3, {word}, substring({word}, length({word}) - 2, 3))"))
    return (OWN + F.crc32(part) % CLASSES).cast("int")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts."""
    schema = arrow_schema("word binary, c long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in texts(b.column(0)):
                n.update(word_keys(t))
                if len(n) > COUNTED:
                    yield batch(schema, [list(n), list(n.values())])
                    n.clear()
        yield batch(schema, [list(n), list(n.values())])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary(NamedTuple):
    """What scoring needs of the counts: all of bounded size."""

    head: dict[bytes, int]
    #: symbol, log10(c + 1) and log10(share) of the head's words
    symbol: np.ndarray
    log_count: np.ndarray
    log_share: np.ndarray
    #: log10(mass / (1 - u)) and log10(u) of the classes
    log_mass: np.ndarray
    log_unseen: np.ndarray
    least: int
    n: int
    v: int
    ends: int
    #: probability of each symbol by the counts
    prior: np.ndarray


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """``counts`` is a written table; the head is every word counted ``least`` times or more."""
    histogram = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    words = sum(n for _, n in histogram)
    total = sum(c * n for c, n in histogram)
    taken, least = 0, (histogram[0][0] + 1 if histogram else 1)
    for c, n in histogram:
        if taken + n > HEAD:
            break
        taken, least = taken + n, c
    rows = sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda r: (-r[1], r[0]))
    own = [w for w, _ in rows[:OWN]]
    sent = counts.sparkSession.createDataFrame([(bytearray(w),) for w in own], "word binary")
    classed = counts.join(F.broadcast(sent), "word", "left_anti").groupBy(word_class_col("word").alias("q")).agg(F.sum("c").alias("c"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("once"))
    c, types, once = (np.zeros(CLASSES) for _ in range(3))
    for r in classed.collect():
        c[r.q - OWN], types[r.q - OWN], once[r.q - OWN] = r.c, r.types, r.once
    unseen = (once + 1) / (c + 2)
    log_mass = np.log10(np.maximum(c + types, 1)) - np.log10(1 - np.minimum(unseen, 1 - 1e-9))
    prior = np.ones(SYMBOLS)
    prior[OWN:END] += c
    prior[END] += ends
    symbol = np.array([k if k < OWN else word_class(w) for k, (w, _) in enumerate(rows)], np.uint16)
    log_count = np.log10(np.array([n + 1 for _, n in rows], float))
    share = np.array([0.0 if k < OWN else log_count[k] - log_mass[symbol[k] - OWN] for k in range(len(rows))])
    for k, (_, n) in enumerate(rows[:OWN]):
        prior[k] += n
    return Vocabulary({w: k for k, (w, _) in enumerate(rows)}, symbol, log_count, share, log_mass, np.log10(unseen), least, total + ends, words + (ends > 0), ends, prior / prior.sum())


class _Classes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= COUNTED:
            self.clear()
        self[word] = q = word_class(word)
        return q


_ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, log_count double, log_share double, symbols binary, tail array<binary>, times array<int>"


def encode(docs: DataFrame, vocab: Vocabulary, mod: int, rest: int, id_col: str, text_col: str) -> DataFrame:
    """Every text as its symbols, the head's sums, and its other words with their numbers."""
    schema, sent = arrow_schema(_ENCODED), docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, classes = sent.value, _Classes()
        rid = TaskContext.get().partitionId() << 33
        symbol = np.append(v.symbol, 0).astype(np.uint16)
        log_count, log_share = np.append(v.log_count, 0.0), np.append(v.log_share, 0.0)
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for t in texts(b.column(1)):
                words = word_keys(t)
                code = np.fromiter(map(v.head.get, words, repeat(-1)), np.int32, len(words))
                s = np.empty(len(words) + 1, np.uint16)
                s[:-1], s[-1] = symbol[code], END
                rare = [words[k] for k in np.flatnonzero(code < 0).tolist()]
                if rare:
                    s[:-1][code < 0] = list(map(classes.__getitem__, rare))
                tail = Counter(rare)
                row = (len(words) + 1, len(words) - len(rare), float(log_count[code].sum()), float(log_share[code].sum()), s.tobytes(), list(tail), list(tail.values()))
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            yield batch(schema, [list(range(rid, rid + len(ids))), ids, held_out(ids, mod, rest), *out])
            rid += len(ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _ENCODED)


class Hmm(NamedTuple):
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


class _Laid:
    """Sequences laid out by time: at each time those that still run, longest first."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
        self.at = np.concatenate([[0], np.cumsum(self.alive)])
        self.symbols, self.slot = np.empty(self.at[-1], np.int64), np.empty(self.at[-1], np.int64)
        for k, d in enumerate(self.order):
            where = self.at[: lengths[k]] + k
            self.symbols[where], self.slot[where] = sequences[d], k


def forward(hmm: Hmm, laid: _Laid, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """log10 likelihood by sequence (laid order), emissions and scales by time, scaled alphas if kept, the last alpha of the longest."""
    emitted = np.ascontiguousarray(hmm.emit.T)[laid.symbols]
    at = laid.at.tolist()
    scale = np.empty(len(laid.symbols))
    alphas = np.empty_like(emitted) if keep else None
    a = np.broadcast_to(hmm.start, (laid.alive[0], len(hmm.start)))
    for t, n in enumerate(laid.alive.tolist()):
        s, e = at[t], at[t + 1]
        a = (a[:n] @ hmm.step if t else a) * emitted[s:e]
        c = a.sum(axis=1)
        a = a / c[:, None]
        scale[s:e] = c
        if alphas is not None:
            alphas[s:e] = a
    total = np.bincount(laid.slot, weights=np.log10(scale), minlength=laid.alive[0])
    return total, emitted, alphas, scale, a[0]


def expected(hmm: Hmm, laid: _Laid) -> tuple[Hmm, float]:
    """Expected start, step and emission counts (forward-backward), and the log10 likelihood of all."""
    total, emitted, alphas, scale, _ = forward(hmm, laid, keep=True)
    k, at = len(hmm.start), laid.at.tolist()
    back = hmm.step.T
    steps, alive = np.zeros((k, k)), laid.alive.tolist()
    gamma = alphas
    beta = np.ones((alive[-1], k))
    for t in range(len(alive) - 1, -1, -1):
        s, e = at[t], at[t + 1]
        own = alphas[s:e].copy()
        gamma[s:e] = own * beta
        if t:
            ahead = emitted[s:e] * beta / scale[s:e, None]
            before = alphas[at[t - 1] : at[t - 1] + alive[t]]
            steps += before.T @ ahead
            beta = np.ones((alive[t - 1], k))
            beta[: alive[t]] = ahead @ back
    emits = np.stack([np.bincount(laid.symbols, weights=gamma[:, j], minlength=SYMBOLS) for j in range(k)])
    return Hmm(gamma[: alive[0]].sum(axis=0), steps * hmm.step, emits), float(total.sum())


def maximised(counts: Hmm, prior: np.ndarray) -> Hmm:
    """The model of expected counts, smoothed so that nothing is impossible."""
    start = counts.start + 1
    step = counts.step + 0.5
    emit = counts.emit + prior * 50
    return Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def uniform_start(prior: np.ndarray, seed: int = 3) -> Hmm:
    """Sticky states whose emissions are the prior, each perturbed by ``seed``."""
    rng = np.random.default_rng(seed)
    emit = prior * rng.gamma(1.0, 1.0, (STATES, SYMBOLS))
    step = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(step, STICKY)
    return Hmm(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=1, keepdims=True))


def _packs(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of sequences of like length, about ``TOKENS`` tokens at a time."""
    pack, held = [], 0
    for k in sorted(range(len(sequences)), key=lambda k: -len(sequences[k])):
        pack.append(k)
        held += len(sequences[k])
        if held >= TOKENS:
            yield pack
            pack, held = [], 0
    if pack:
        yield pack


def _summed(rows: DataFrame, hmm: Hmm, counted: Callable[[Hmm, list[pa.Array]], Iterator[tuple[Hmm, float]]]) -> tuple[Hmm, float]:
    """Expected counts of all rows and their log10 likelihood; tasks send slices of their sums, the cluster adds them."""
    ddl, sent = "slice int, n binary", rows.sparkSession.sparkContext.broadcast(hmm)
    schema, cells = arrow_schema(ddl), 1 + STATES + STATES * STATES + STATES * SYMBOLS
    slices = -(-cells // SLICE)

    def sent_on(sums: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return batch(schema, [pa.array(at, pa.int32()), [sums[k].tobytes() for k in at]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(slices * SLICE), False
        for b in batches:
            for c, fit in counted(sent.value, b.columns):
                total[:cells] += np.concatenate([[fit], c.start, c.step.ravel(), c.emit.ravel()])
                met = True
        if met:
            yield sent_on(total.reshape(slices, SLICE), np.arange(slices))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((slices, SLICE)), np.zeros(slices, bool)
        for b in batches:
            at = b.column(0).to_numpy()
            np.add.at(total, at, np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(-1, SLICE))
            met[at] = True
        yield sent_on(total, np.flatnonzero(met))

    sums, flat = rows.mapInArrow(fold, ddl).repartition("slice").mapInArrow(add, ddl).toArrow(), np.zeros((slices, SLICE))
    for k, n in zip(sums["slice"].to_pylist(), sums["n"].to_pylist(), strict=True):
        flat[k] = np.frombuffer(n)
    fit, *_ = flat = flat.ravel()[:cells]
    a, b = 1 + STATES, 1 + STATES + STATES * STATES
    return Hmm(flat[1:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, SYMBOLS)), float(fit)


def baum_welch(encoded: DataFrame, hmm: Hmm, prior: np.ndarray) -> tuple[Hmm, float]:
    """One iteration over all sequences, and their log10 likelihood before it."""

    def counted(hmm: Hmm, columns: list[pa.Array]) -> Iterator[tuple[Hmm, float]]:
        seqs = [s[k : k + PIECE] for s in (np.frombuffer(s, np.uint16) for s in columns[0].to_pylist()) for k in range(0, len(s), PIECE)]
        for pack in _packs(seqs):
            yield expected(hmm, _Laid([seqs[k] for k in pack]))

    counts, fit = _summed(encoded.select("symbols"), hmm, counted)
    return maximised(counts, prior), fit


def neighbours(encoded: DataFrame) -> DataFrame:
    """(part, pair, n), a row for the symbols ``part, part + PARTS, ...``: how often (``n``, 64 bits each) symbol
    ``pair % SYMBOLS`` follows ``pair // SYMBOLS`` (32 bits each) in all texts; a text's first follows an end."""
    ddl = "part int, pair binary, n binary"
    schema = arrow_schema(ddl)
    # Symbols by part, so that sorted pairs of a part stand together, and a part holds frequent and rare ones.
    order = np.argsort(np.arange(SYMBOLS) % PARTS, kind="stable")
    place = np.argsort(order).astype(np.int32)
    ends = np.searchsorted(order % PARTS, np.arange(PARTS + 1)) * SYMBOLS

    def counts(laid: list[np.ndarray]) -> pa.RecordBatch:
        # Texts end with an end, so one after another each first symbol follows an end.
        x = np.concatenate([[END], *laid]).astype(np.int32)
        pairs, n = np.unique(place[x[:-1]] * np.int32(SYMBOLS) + x[1:], return_counts=True)
        at = np.searchsorted(pairs, ends)
        kept = np.flatnonzero(np.diff(at)).tolist()
        return batch(schema, [kept, *([v[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in kept] for v in (pairs, n))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laid, held = [], 0
        for b in batches:
            for s in b.column(0).to_pylist():
                laid.append(np.frombuffer(s, np.uint16))
                held += len(laid[-1])
                if held > COUNTED_PAIRS:
                    yield counts(laid)
                    laid, held = [], 0
        if laid:
            yield counts(laid)

    def total(part: int, sums: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(sums)
        pair = order[(cells + ends[part]) // SYMBOLS] * SYMBOLS + cells % SYMBOLS
        return batch(schema, [[part], [pair.astype(np.int32).tobytes()], [sums[cells].tobytes()]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = -1, np.zeros(0, np.int64)
        for b in batches:
            for p, pair, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if part >= 0:
                        yield total(part, sums)
                    part, sums = p, np.zeros(ends[p + 1] - ends[p], np.int64)
                sums[np.frombuffer(pair, np.int32) - ends[p]] += np.frombuffer(n, np.int32)
        if part >= 0:
            yield total(part, sums)

    return encoded.select("symbols").mapInArrow(count, ddl).repartition("part").sortWithinPartitions("part").mapInArrow(add, ddl)


def expected_pairs(hmm: Hmm, left: np.ndarray, blobs: Iterable[tuple[bytes, bytes]]) -> tuple[Hmm, float]:
    """Expected counts of neighbours, each pair taken alone, and the log10 likelihood of all; ``left``: shares of the states before a symbol."""
    # A ninth state stands before a text; it alone shows an end on the left.
    before = np.vstack([hmm.emit, np.zeros(SYMBOLS)])
    before[:, END] = np.arange(STATES + 1) == STATES
    joint = np.vstack([left[:, None] * hmm.step, hmm.start])
    ahead, emit, fit = joint.T @ before, hmm.emit, 0.0
    by_left, by_right = np.zeros((STATES, SYMBOLS)), np.zeros((STATES, SYMBOLS))
    pieces = ((np.frombuffer(p, np.int32)[k : k + PAIRS], np.frombuffer(n, np.int64)[k : k + PAIRS]) for p, n in blobs for k in range(0, len(p) // 4, PAIRS))
    for pair, n in pieces:
        a, b = np.divmod(pair, SYMBOLS)
        x, y = [row[a] for row in ahead], [row[b] for row in emit]
        p = sum(map(np.multiply, x, y))
        fit += float(n @ np.log10(p))
        share = n / p
        for j in range(STATES):
            by_left[j] += np.bincount(a, share * y[j], SYMBOLS)
            by_right[j] += np.bincount(b, share * x[j], SYMBOLS)
    moved = joint * (before @ by_left.T)
    emits = emit * by_right + (before * (joint @ by_left))[:STATES]
    # An end is in one pair, every other symbol in two.
    emits[:, END] *= 2
    return Hmm(moved[STATES], moved[:STATES], emits), fit


def start(encoded: DataFrame, prior: np.ndarray) -> Hmm:
    """The model of all texts' neighbours, from ``uniform_start``."""
    hmm, left = uniform_start(prior), np.full(STATES, 1 / STATES)
    pairs = written(neighbours(encoded).select("pair", "n"), "lm-pairs")
    for _ in range(START_ITERATIONS):

        def counted(hmm: Hmm, columns: list[pa.Array], left: np.ndarray = left) -> Iterator[tuple[Hmm, float]]:
            yield expected_pairs(hmm, left, zip(*(c.to_pylist() for c in columns), strict=True))

        counts, _ = _summed(pairs, hmm, counted)
        hmm, left = maximised(counts, prior), counts.step.sum(axis=1) + 1
        left /= left.sum()
    return hmm


def train(encoded: DataFrame, prior: np.ndarray) -> Hmm:
    """``encoded``: the training texts' symbols."""
    count, size = encoded.agg(F.count("*"), F.sum(F.length("symbols"))).first()
    if not count:
        return uniform_start(prior)
    hmm, before = start(encoded, prior), -np.inf
    for _ in range(PASSES):
        hmm, fit = baum_welch(encoded, hmm, prior)
        if fit - before < LEAST_GAIN * size / 2:
            break
        before = fit
    return hmm


def path(hmm: Hmm, symbols: np.ndarray) -> float:
    """log10 likelihood of one sequence of any length, a piece at a time."""
    total, start = 0.0, hmm.start
    for k in range(0, len(symbols), PIECE):
        got, _, _, _, last = forward(hmm._replace(start=start), _Laid([symbols[k : k + PIECE]]))
        total, start = total + float(got[0]), last @ hmm.step
    return total


def likelihoods(encoded: DataFrame, hmm: Hmm) -> DataFrame:
    """(rid, doc_id, held_out, n_tokens, n_head, log_count, log_share, path): path is log10 P(symbols)."""
    kept = ["rid", "doc_id", "held_out", "n_tokens", "n_head", "log_count", "log_share"]
    ddl = _ENCODED[: _ENCODED.index(", symbols")] + ", path double"
    schema, sent = arrow_schema(ddl), encoded.sparkSession.sparkContext.broadcast(hmm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(s, np.uint16) for s in b.column(len(kept)).to_pylist()]
            paths = np.empty(len(seqs))
            for pack in _packs(seqs):
                if len(seqs[pack[0]]) > PIECE:
                    paths[pack] = [path(sent.value, seqs[k]) for k in pack]
                    continue
                laid = _Laid([seqs[k] for k in pack])
                paths[np.array(pack)[laid.order]] = forward(sent.value, laid)[0]
            yield batch(schema, [*(b.column(k) for k in range(len(kept))), pa.array(paths)])

    return encoded.select(*kept, "symbols").mapInArrow(run, ddl)


def lm_scores(docs: DataFrame, mod: int = 7, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    learning = docs.where(~held_out_col(F.col(id_col).cast("long"), mod, rest))
    counts = written(word_counts(learning, text_col), "lm-counts")
    vocab = vocabulary(counts, learning.count())
    encoded = written(encode(docs, vocab, mod, rest, id_col, text_col), "lm-encoded")
    hmm = train(encoded.where("not held_out"), vocab.prior)
    classes = spark.createDataFrame([(OWN + k, float(m), float(u)) for k, (m, u) in enumerate(zip(vocab.log_mass, vocab.log_unseen, strict=True))], "q int, log_mass double, log_unseen double")
    tail = encoded.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    met = tail.join(counts.where(F.col("c") < vocab.least), "word", "left").withColumn("q", word_class_col("word")).join(F.broadcast(classes), "q")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    share = F.when(F.isnull("c"), F.col("log_unseen")).otherwise(log_count - F.col("log_mass"))
    sums = met.groupBy("rid").agg(F.sum(F.when(F.isnotnull("c"), F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * log_count).alias("tail_count"), F.sum(F.col("times") * share).alias("tail_share"))
    out = likelihoods(encoded, hmm).join(sums, "rid", "left")
    none = F.lit(0.0)
    base = F.col("log_count") + F.coalesce("tail_count", none) + float(np.log10(vocab.ends + 1)) - F.col("n_tokens") * float(np.log10(vocab.n + vocab.v + 1))
    score = F.col("path") + F.col("log_share") + F.coalesce("tail_share", none)
    known = F.col("n_head") + F.coalesce("known", F.lit(0)) + int(vocab.ends > 0)
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
