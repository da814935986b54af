"""Exact dedup by skew-safe combining (operator 9).

Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``.  Three
stages merge equal texts, each comparing the full content and not only a digest:

1. *local*: every task folds the rows it reads, so a group of copies leaves a
   task as one row however large it is;
2. *salted*: local winners meet by (digest, salt, content), the salt taken from
   the winner's row, so one group is spread over ``SALTS`` reducers;
3. *global*: at most ``SALTS`` salt winners of a group meet by (digest, content).

The content travels zstd-compressed; the coding is injective and deterministic,
so equal codes are equal contents.  A group's members find their survivor by two
joins of small rows along member -> local winner -> salt winner.  In the first a
key has the copies of one local winner, at most what one task reads in
``LOCAL_BYTES`` of contents; in the second at most a salt's local winners.

Cases: a null text is empty; the empty text is a text like any other, so all
blank rows form one group; a very long text is coded and compared whole, and is
a batch of its own where need be; repeated rows (even with one doc_id) are rows
of their own, of which one stays; ties go to the longest original (code points),
the smallest doc_id (null last), the earliest row read.  An empty table gives
an empty result.  Other columns are not read by the report, and all stay in
``exact_dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, free_name, texts, written

SALTS = 32
#: Bytes of content a task holds before it hands its local winners on.
LOCAL_BYTES = 48 << 20
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Member rows have a null content.
_ROWS = "rid long, doc_id long, rep long, sha binary, content binary, n_chars long, n long"
ROW_ID = "_hanlens_rid"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, text) to member rows and local winners."""
    schema, code = arrow_schema(_ROWS), zstandard.ZstdCompressor(level=1).compress
    groups: dict[bytes, list] = {}  # coded content -> [rep, best rank, n, digest, coded content]
    held = 0

    for b in batches:
        out: list[list] = [[], [], [], []]
        for rid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
            content = text.translate(None, _SPACE)
            digest = hashlib.sha256(content).digest()
            chars = len(text.decode())
            rank = (-chars, doc_id is None, doc_id or 0, rid)
            coded = code(content)
            if (g := groups.get(coded)) is None:
                groups[coded] = g = [rid, rank, 0, digest, coded]
                held += len(coded) + 300
            elif rank < g[1]:
                g[1] = rank
            g[2] += 1
            for c, v in zip(out, (rid, doc_id, g[0], digest), strict=True):
                c.append(v)
        none = [None] * b.num_rows
        yield batch(schema, [*out, none, none, none])
        if held > LOCAL_BYTES:
            yield _winners(schema, groups)
            held = 0
    yield _winners(schema, groups)


def _winners(schema: pa.Schema, groups: dict[bytes, list]) -> pa.RecordBatch:
    """Local winners: rid and doc_id are the winner's, rep the members' key."""
    rows = [(rank[3], None if rank[1] else rank[2], rep, digest, coded, -rank[0], n) for rep, rank, n, digest, coded in groups.values()]
    groups.clear()
    return batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(schema))


def with_row_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, text) with an id for every row, given out by task and position."""
    schema = arrow_schema("rid long, doc_id long, text string")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            yield batch(schema, [list(range(at, at + b.num_rows)), b.column(0), b.column(1)])
            at += b.num_rows

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(number, "rid long, doc_id long, text string")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, text) to (rid, doc_id, keep_rid, keep_id, group_size, sha)."""
    t = written(rows.mapInArrow(_fold, _ROWS), "dedup-local")
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.isnull("doc_id").alias("none"), "doc_id", "rid"))

    def merge(part: DataFrame, keys: list[str], member: str) -> DataFrame:
        """One row for each digest and content: the survivor, the size, what it stands for."""
        g = part.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("n"), F.collect_list(member).alias("of"))
        return g.select(*keys, (-F.col("best.short")).alias("n_chars"), "best.doc_id", "best.rid", "n", "of")

    local = t.where("content is not null").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    salted = written(merge(local, ["sha", "salt", "content"], "rep").withColumn("salt_rep", F.col("rid")), "dedup-salted")
    whole = merge(salted, ["sha", "content"], "salt_rep").select(F.col("rid").alias("keep_rid"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.explode("of").alias("salt_rep"))
    chain = salted.select(F.explode("of").alias("rep"), "salt_rep").join(whole, "salt_rep").drop("salt_rep")
    members = t.where("content is null").select("rid", "doc_id", "rep", "sha")
    return members.join(chain, "rep").drop("rep")


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``, dropped ones too."""
    return duplicate_groups(with_row_ids(docs, id_col, text_col)).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept, rid = numbered(docs)
    groups = duplicate_groups(kept.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    stay = groups.where("rid = keep_rid").select(F.col("rid").alias(rid))
    return kept.join(stay, rid, "left_semi").drop(rid)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a row id that stays the same whenever it is read, and that column's name."""
    rid = free_name(docs.columns, ROW_ID)
    return written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows"), rid


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce("text", '') AS t, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents
), w AS (
  SELECT doc_id, c,
         first_value(doc_id) OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY c) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM w
"""
