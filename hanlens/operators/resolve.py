"""Competition of overlapping issues, and their final order and places."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..rules import SEVERITY_ORDER, TYPE_ORDER
from .doc import Issue, Span, byte_offsets


def resolved(issues: Iterable[Issue]) -> list[Issue]:
    """Longer issues first, then graver, then earlier ones; one is taken when it overlaps nothing taken (O1).

    An empty span overlaps a taken one only strictly inside it.  Taken spans
    stay sorted, so each candidate looks at its neighbours alone.
    """
    order = sorted(sorted(issues, key=lambda i: (i.start, i.start - i.end)), key=lambda i: (i.start - i.end, -SEVERITY_ORDER[i.severity], i.start))
    starts: list[int] = []
    end_of: dict[int, int] = {}
    kept = []
    for i in order:
        k = bisect_right(starts, i.start) if i.end > i.start else bisect_left(starts, i.start)
        if k and end_of[starts[k - 1]] > i.start or i.end > i.start and k < len(starts) and starts[k] < i.end:
            continue
        if i.end > i.start:
            insort(starts, i.start)
            end_of[i.start] = i.end
        kept.append(i)
    return sorted(kept, key=lambda i: (i.start, i.start - i.end))


def final_order(issues: Iterable[Issue]) -> list[Issue]:
    """By place, then the graver, then by type (O2)."""
    return sorted(issues, key=lambda i: (i.start, -SEVERITY_ORDER[i.severity], TYPE_ORDER[i.issue_type]))


_UP = {"info": "warning", "warning": "error", "error": "error"}


def boosted(issues: list[Issue], headings: list[Span]) -> list[Issue]:
    """Severity one step up for issues inside a heading."""
    starts = [s for s, _ in headings]

    def inside(i: Issue) -> bool:
        k = bisect_right(starts, i.start) - 1
        return k >= 0 and i.end <= headings[k][1]

    return [i._replace(severity=_UP[i.severity]) if inside(i) else i for i in issues]


def cell_of(cells: list[tuple[int, int, int, int]], start: int, end: int) -> tuple[int, int] | None:
    """Row and column of the first table cell around a span."""
    k = bisect_right(cells, start, key=lambda c: c[2]) - 1
    return cells[k][:2] if k >= 0 and end <= cells[k][3] else None


def line_columns(text: str, places: Iterable[int], encoding: str = "utf16") -> tuple[np.ndarray, np.ndarray]:
    """1-based lines and columns of code point places; columns in UTF-16 or UTF-32 units, one pass over the text."""
    places = np.array(list(places), np.int64)
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
    starts = np.concatenate([[0], breaks + 1])
    line = np.searchsorted(starts, places, "right") - 1
    at = np.arange(len(text) + 1)
    if encoding == "utf16" and not text.isascii():
        at = np.concatenate([[0], np.cumsum(1 + (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF))])
    return line + 1, at[places] - at[starts[line]] + 1


def line_columns_of_bytes(text: str, offsets: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for byte offsets."""
    return line_columns(text, np.searchsorted(byte_offsets(text), np.array(list(offsets), np.int64)))


def severity_order(severity: str | Column = "severity") -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.create_map(*(F.lit(x) for p in SEVERITY_ORDER.items() for x in p))[c]


def type_order(issue_type: str | Column = "issue_type") -> Column:
    c = F.col(issue_type) if isinstance(issue_type, str) else issue_type
    return F.create_map(*(F.lit(x) for p in TYPE_ORDER.items() for x in p))[c]


def ordered(issues: DataFrame) -> DataFrame:
    """Issue rows in their final order (O2)."""
    return issues.orderBy("doc_id", "offset", F.desc(severity_order()), type_order())


def placed(issues: DataFrame) -> DataFrame:
    """Issue rows with their place in their document's final order; a document's issues are bounded by its own text."""
    order = Window.partitionBy("doc_id").orderBy("offset", F.desc(severity_order()), type_order())
    return issues.withColumn("place", F.row_number().over(order))


def matched_rules(issues: DataFrame) -> DataFrame:
    """Distinct dictionary rules behind a document's issues (O3)."""
    return issues.groupBy("doc_id").agg(F.count_distinct("rule_id").alias("rules_matched"))
