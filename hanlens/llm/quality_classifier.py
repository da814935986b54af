"""Quality classifier (operator 8): hashed word n-grams, FTRL-proximal logistic regression.

A text becomes the hashed counts of its words, punctuation runs and adjacent
pairs; a word that repeats its predecessor counts as the token ``<rep>``.  Counts
enter as ``log(1 + n)``, scaled to unit length, and a score is one sparse dot
product through the logistic function.

The weights are fitted on at most ``PER_CLASS`` labelled rows of each class (the
documented bound; see ``label_sample``), collected as at most ``2**BITS``
hashed counts a row.  Classes weigh the same, so the score is P(label 1) under
even priors.  Every row of the table is scored over its whole text.

Cases: a null or empty text has no feature and scores the bias alone; a very long
text is at most ``2**BITS`` counts; a score that equals the threshold (a tie)
passes; without labelled rows of both classes every score is 0.5; repeated rows
score alike; null ids count as ``''`` for the held-out split; an empty table
gives an empty result; other columns are ignored by the report and kept by the
filter, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, held_out, label_sample, texts

BITS = 18
PER_CLASS = 4096
EPOCHS = 4
#: Tokens whose hashes a worker remembers.
REMEMBERED = 1 << 20
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REP = zlib.crc32(b"<rep>")


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = h = zlib.crc32(token.encode())
        return h


_hashes = _Hashes()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices below ``2**BITS`` and their values, of unit length together."""
    tokens = _TOKEN.findall(text.lower())
    if not tokens:
        return np.empty(0, np.int32), np.empty(0)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    h[1:][h[1:] == h[:-1]] = _REP
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), pairs]) >> np.uint64(64 - BITS)
    index, counts = np.unique(both.astype(np.int32), return_counts=True)
    value = np.log1p(counts)
    return index, value / np.sqrt(value @ value)


class Ftrl(NamedTuple):
    """Weights and bias of a fitted model."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        index, value = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[index] @ value + self.bias, -35, 35))))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2, seed: int = 8) -> Ftrl:
    """Per-coordinate follow-the-regularised-leader (McMahan et al., 2013).

    The last slot is the bias, which is not regularised.  Each class has the same
    total weight.  The order is drawn from ``seed`` and so the same in every run.
    """
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    ones = sum(y for *_, y in rows)
    if not 0 < ones < len(rows):
        return Ftrl(w[:-1], 0.0)
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value, y = rows[k]
            index, value = np.append(index, size), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            shrink = np.where(index < size, l1, 0.0)
            wi = np.where(np.abs(zi) <= shrink, 0.0, -(zi - np.sign(zi) * shrink) / ((beta + np.sqrt(ni)) / alpha + np.where(index < size, l2, 0.0)))
            g = (1 / (1 + np.exp(-np.clip(wi @ value, -35, 35))) - y) * weight[y] * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index] += g - sigma * wi
            n[index] += g * g
    used = np.abs(z[:-1]) > l1
    w[:-1][used] = (-(z[:-1] - np.sign(z[:-1]) * l1) / ((beta + np.sqrt(n[:-1])) / alpha + l2))[used]
    return Ftrl(w[:-1], float(-z[-1] * alpha / (beta + np.sqrt(n[-1]))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Ftrl:
    """Fit on a bounded sample of the rows whose crc32(doc_id) mod 5 is not 0."""
    ddl = "doc_id long, y int, feature binary, value binary"  # packed: a list of Python numbers would be ten times as large
    schema = arrow_schema(ddl)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.decode()) for t in texts(b.column(1))]
            yield batch(schema, [b.column(0), b.column(2), [i.tobytes() for i, _ in made], [v.astype(np.float32).tobytes() for _, v in made]])

    sample = label_sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col)
    rows = sample.select("doc_id", "text", "y").mapInArrow(featurise, ddl).toArrow()
    made = sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "y", "feature", "value")), strict=True))
    return fit_ftrl([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for _, y, i, v in made])


def quality_scores(docs: DataFrame, model: Ftrl, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    ddl = "doc_id long, held_out boolean, score double, predicted int"
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [sent.value.score(t.decode()) for t in texts(b.column(1))]
            yield batch(schema, [b.column(0), held_out(b.column(0).to_pylist(), 5, 0), s, [int(x >= threshold) for x in s]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, ddl)


def quality_filter(docs: DataFrame, model: Ftrl, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([sent.value.score(t.decode()) >= threshold for t in texts(b.column(b.schema.get_field_index(text_col)))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
