"""Spans as arrays of structs, in UTF-8 byte offsets, row-local until someone explodes them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Hits summed one by one before their sums are summed: no array grows by single elements beyond this.
STRETCH = 64


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


NO_SPANS = "cast(array() as array<struct<start:int,length:int,found:string>>)"


def matches_sql(text: str, pattern: str, group: int = 0, needs: Iterable[str] = ()) -> str:
    """SQL of ``array<struct<start, length, found>>``, a pattern's matches in the SQL expression ``text`` (none may be empty).

    With ``group`` the match's text is that of the group, which must start the match.
    Offsets are running sums in two levels, so the work grows with the hits.  A
    text that holds none of ``needs`` is not searched at all.  SQL, because a
    plan of many detectors is then parsed in the JVM and not built call by call.
    """
    p = f"r'{pattern}'"
    if "'" in pattern:
        raise ValueError("a pattern must not hold a quote")
    found = "h" if not group else f"regexp_extract_all({text}, {p}, {group})"
    sized = f"""zip_with(zip_with(slice(split({text}, {p}, -1), 1, size(h)), h, (g, w) -> named_struct('gap', octet_length(g), 'size', octet_length(w))), {found}, (n, f) -> named_struct('gap', n.gap, 'size', n.size, 'found', f))"""
    cut = f"transform(sequence(0, cast(floor((size(r) - 1) / {STRETCH}) as int)), k -> slice(r, k * {STRETCH} + 1, {STRETCH}))"
    begins = "aggregate(transform(c, t -> aggregate(t, 0, (a, x) -> a + x.gap + x.size)), array(0), (a, n) -> array_append(a, element_at(a, -1) + n))"
    step = "named_struct('at', a.at + x.gap + x.size, 'out', array_append(a.out, named_struct('start', a.at + x.gap, 'length', octet_length(x.found), 'found', x.found)))"
    placed = f"aggregate(t, named_struct('at', b, 'out', {NO_SPANS}), (a, x) -> {step}, a -> a.out)"
    summed = f"flatten(zip_with(c, slice({begins}, 1, size(c)), (t, b) -> {placed}))"
    able = " OR ".join(f"contains({text}, '{n}')" for n in needs)
    able = f"({able}) AND regexp({text}, {p})" if needs else f"regexp({text}, {p})"
    return f"CASE WHEN {able} THEN {let(f'regexp_extract_all({text}, {p}, 0)', 'h', let(sized, 'r', let(cut, 'c', summed)))} ELSE {NO_SPANS} END"


def matches(text: str, pattern: str, group: int = 0, needs: Iterable[str] = ()) -> Column:
    """``matches_sql`` as a column."""
    return F.expr(matches_sql(text, pattern, group, needs))


def union(ranges: DataFrame, key: str) -> DataFrame:
    """(key, start, end): each key's ranges with overlapping and adjacent ones merged, as a stream along one sort.

    Both windows read the same sort, so that equal ranges stand in the same order in both.  A null start
    comes last and joins the range before it; ranges without any end so far stay apart.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = ranges.select(key, "start", "end", before.alias("_before"))
    first = F.when(F.isnull("_before") | (F.col("start") > F.col("_before")), 1).otherwise(0)
    k = F.sum(first).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return met.select(key, "start", "end", k.alias("_k")).groupBy(key, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")
