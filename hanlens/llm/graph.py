"""Connected components and skew-safe lookups, both fully distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A key with more than this share of the rows is hot; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 500


def _stamp(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) long pairs to (node, root): the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014) until the edges
    stay as they are; each round is a written table.  Minima are aggregated
    before the shuffle, so a hub costs one row a task.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _stamp(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = written(small.where("a <> b").distinct(), "edges")
        after = _stamp(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def skew_lookup(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` inner-joined with ``values`` (one row a key, ``count`` rows of it in ``rows``).

    Hot keys, fewer than ``1 / HOT_SHARE`` by definition, are looked up by
    broadcast; the others meet by a shuffle that no single key can swell.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in values.where(F.col(count) > max(1, total * HOT_SHARE)).select(key).collect()]
    values = values.drop(count)
    if not hot:
        return rows.join(values, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(values.where(~is_hot), key).unionByName(rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key))
