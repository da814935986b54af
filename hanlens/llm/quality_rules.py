"""Quality rules (operator 10): clean line by line, then judge what is left.

A line with a word fails when one of these holds (``w`` its words):

* *navigation*: two or more ``|`` and at least one for every four words;
* *symbols*: ``#*$%&|<>`` make at least half as many characters as words;
* *repetition*: eight words or more of which half or more repeat the word before;
* *punctuation*: twelve words or more without any of ``.,;:!?`` or their CJK forms;
* *boilerplate*: it holds one of ``BOILERPLATE`` (legal and sharing lines in four languages) in any ASCII case.

Failing lines are removed.  A document is rejected when they hold more than
``MOST_LOST`` of its words.  The base counts are taken on the whole input text:
see ``COUNTS``.

Cases: a null text is empty, so it has no word, fails the base rule and is not
kept; blank lines are neither counted nor lost; a very long text, or line, is
judged whole; a document that loses exactly ``MOST_LOST`` (a tie) is kept;
repeated rows get equal rows; an empty table gives an empty result; the report
ignores other columns, the filter keeps all of them, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, texts

MIN_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 0.3
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "click here to", "lorem ipsum", "share this article",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "tous droits réservés", "politique de confidentialité", "mentions légales", "partager cet article",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "compartir este artículo",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_PUNCTUATION = re.compile("|".join(["[.,;:!?]", *"。，；：！？、…"]).encode())
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    base = len(seen)
    keys = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:  # three ids would not fit 63 bits: number the pairs first
        keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    keys = keys[:-1] * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n, bars = len(words), line.count(b"|")
    if bars >= 2 and 4 * bars >= n:
        return True
    symbols = len(line.translate(None, _NOT_SYMBOL))
    if 2 * symbols >= n and symbols:
        return True
    if n >= 8 and 2 * sum(map(eq, words, words[1:])) >= n:
        return True
    return (n >= 12 and not _PUNCTUATION.search(line)) or bool(_BOILERPLATE.search(line.lower()))


def judge(text: bytes) -> tuple[int, int, int, int, int, bool, bool, int, int, bytes]:
    """Base counts, base_failed, kept, words lost, lines lost, and the cleaned text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUED))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    repeated = repeat_words(words)
    seen: set[bytes] = set()
    duplicates = lost = removed = 0
    left = []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        if line_fails(line, own):
            lost += len(own)
            removed += 1
        else:
            left.append(line)
    failed = n < MIN_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, chars, symbols, duplicates, repeated, failed, not failed and lost <= MOST_LOST * n, lost, removed, b"\n".join(left)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """One row a document: base counts, verdict, what was lost; with ``cleaned`` the lines that stay."""
    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long" + ", clean_text binary" * cleaned
    schema = arrow_schema(ddl)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t)[: len(schema) - 1] for t in texts(b.column(1))]
            yield batch(schema, [b.column(0), *([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * (len(schema) - 1))])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(report, ddl)
    return out.withColumn("clean_text", F.decode("clean_text", "UTF-8")) if cleaned else out


def quality_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, their texts without the failing lines; all columns stay."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            found = [judge(t) for t in texts(b.column(k))]
            text = pa.array([f[9].decode() for f in found], b.schema.field(k).type)
            yield b.set_column(k, b.schema.field(k), text).filter(pa.array([f[6] for f in found], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


_LIKE = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS t FROM documents),
x AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
n AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM x
),
tri AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM x)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY 1),
l AS (SELECT doc_id, k, ls[k] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
lw AS (SELECT doc_id, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l),
lf AS (
  SELECT doc_id, line, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup,
         (bars >= 2 AND 4 * bars >= len(w)) OR (sym > 0 AND 2 * sym >= len(w)) OR (len(w) >= 8 AND 2 * rep >= len(w))
         OR (len(w) >= 12 AND NOT regexp_matches(line, '[.,;:!?。，；：！？、…]')) OR ({_LIKE}) AS bad
  FROM (SELECT *, length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
               (SELECT count(*) FROM (SELECT unnest(range(1, len(w))) AS j) WHERE w[j] = w[j + 1]) AS rep FROM lw WHERE len(w) > 0)
),
la AS (SELECT doc_id, count_if(dup) AS dups, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost, count_if(bad) AS bad_lines FROM lf GROUP BY 1),
j AS (
  SELECT n.doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words, CAST(coalesce(bad_lines, 0) AS BIGINT) AS n_lost_lines
  FROM n LEFT JOIN covered USING (doc_id) LEFT JOIN la USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_lost_words <= {MOST_LOST} * n_words AS kept
FROM j
"""
