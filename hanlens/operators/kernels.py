"""Kernels over a DataFrame's texts: Arrow in, Arrow out, row by row, so partitioning never matters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doc import Doc, Issue

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def per_text(docs: DataFrame, fn: Callable[[Doc], Iterable[tuple]], ddl: str) -> DataFrame:
    """``doc_id`` and a row for each tuple that ``fn`` makes of the text (null counts as empty)."""
    fields = [f.strip().rsplit(" ", 1) for f in ddl.split(",")]
    schema = pa.schema([("doc_id", pa.int64()), *((n, _KINDS[k]) for n, k in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in fn(Doc(t or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {ddl}")


ISSUE = "code string, issue_type string, severity string, offset int, length int, found string, suggestion string"


def issue_rows(doc: Doc, issues: Iterable[Issue]) -> Iterator[tuple]:
    """Issues as (code, issue_type, severity, offset, length, found, suggestion), in bytes."""
    for i in issues:
        s, e = int(doc.at[i.start]), int(doc.at[i.end])
        yield i.code, i.issue_type, i.severity, s, e - s, doc.text[i.start : i.end], i.suggestions[0] if i.suggestions else None


def detected(docs: DataFrame, rule: Callable[..., Iterable[Issue]], *args: object) -> DataFrame:
    """One rule's issues over whole texts, nothing excluded."""
    return per_text(docs, lambda d: issue_rows(d, rule(d, *args)), ISSUE)
