"""Mixing sources to target weights by entropy balancing (operator 5), native.

*Targets.*  Sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share 150 % of all words; no target exceeds twice its source's size, and what
that frees goes to the others by weight.  That is one water level ``c`` with
``target = min(2 * size, c * weight)``.

*Rates.*  Document rates ``r`` stay as near to one as they can: they minimise
``sum(r * log r - r)`` subject to ``sum(r * size) = target`` for each source and
``r <= 2``.  The dual is convex with one multiplier a source, and its solution
is the tilt ``r = min(2, exp(lambda * size / mean))``.  Newton's iterations run
over the histogram of (source, size), an exact summary far smaller than the
documents; a bracket turns a step that leaves it into a bisection.

*Copies.*  All documents of a cell (source, size) share one rate, so rounding
goes by cell: cumulated rates along the sizes are rounded, then what is still missing,
at most a largest document, is moved from large to small sizes.  A cell's odd
copies go to the documents that come first by hash; ranks are found in ``SLOTS``
hash slots of a cell, so no window holds a large cell.  Sums along an order are
taken in two levels (``running``), so neither the sources nor one source's sizes
are ever gathered in a task.

Cases: a null or empty text has size 0; documents of size 0 have one copy and take
no words; a very long text is one number like any other, and is taken whole or
not; a null source is a source of its own, after the others, and so is the
empty name, before them; repeated rows are documents of their own, and which of
equal rows gets an odd copy makes no difference; ties of the water level go by
source; a source without words has target 0; an empty table gives an empty
result.  Other columns stay in ``mix``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, shuffle_partitions, written
from .exact_dedup import numbered

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
ITERATIONS, TOLERANCE = 80, 1e-9
SLOTS = 1024
NO_SIZE = (1 << 63) - 1
_SOURCE = ["no_source", "source_name"]
_CELL = [*_SOURCE, "size"]


def sizes(docs: DataFrame, keep: list[str], source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The kept columns with the source as a non-null pair and the number of words."""
    return docs.select(
        *keep,
        F.isnull(source_col).alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_name"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def running(rows: DataFrame, groups: list[str], order: list[str], values: list[str], label: str) -> DataFrame:
    """``rows`` with ``before_<v>`` for each of ``values``: its sum over the rows of the group that come before.

    Two levels: the rows are dealt by range, so a task sums its own stretch, and
    stretches meet as one row a group and task.  ``values`` are exact types.
    """
    spark = rows.sparkSession
    dealt = written(rows.repartitionByRange(shuffle_partitions(spark), *groups, *order).withColumn("_part", F.spark_partition_id()), label)
    parts = dealt.groupBy(*groups, "_part").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*groups, "_part", *(F.sum(v).over(earlier).alias(f"_earlier_{v}") for v in values))
    own = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    dealt = dealt.withColumns({f"_own_{v}": F.sum(v).over(own) for v in values}).join(parts, [*groups, "_part"])
    sums = [(F.coalesce(f"_earlier_{v}", zero) + F.coalesce(f"_own_{v}", zero)).alias(f"before_{v}") for v in values]
    return dealt.select(*rows.columns, *sums)


def targets(cells: DataFrame) -> DataFrame:
    """(source, source_size, target, mean, least) from the histogram; the rows are the sources."""
    s = cells.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    s = running(s.withColumn("one", F.lit(1)), [], _SOURCE, ["one"], "mix-order")
    turn = F.pmod(F.col("before_one"), F.lit(len(WEIGHTS)))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("long")).withColumn("most", F.lit(MOST) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("most") / F.col("weight")).drop("one", "before_one")
    s = written(running(s, [], ["full_at", *_SOURCE], ["most", "weight"], "mix-levels"), "mix-levelled")
    words, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(SHARE * (words or 0)) - F.col("before_most")) / (F.lit(weights or 0) - F.col("before_weight"))
    # The first source that does not fill up sets the level.
    first = s.where(level <= F.col("full_at")).agg(F.min_by(level, F.struct("full_at", *_SOURCE))).first()[0]
    target = F.col("most").cast("double") if first is None else F.least(F.col("most").cast("double"), F.lit(first) * F.col("weight"))
    return s.select(*_SOURCE, "source_size", target.alias("target"), (F.col("source_size") / F.col("docs")).alias("mean"), "least")


def _rate() -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(1.0), F.col("lam") * F.col("size") / F.col("mean"))))


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of the rows, so reruns agree."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def multipliers(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the dual solution ``lam`` (null where every rate is the most allowed, or nothing is asked)."""
    full = (F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)) | (F.col("source_size") == 0)
    rest = sources.where(~full)
    top = F.lit(math.log(MOST)) * F.col("mean") / F.col("least")
    state = written(rest.select(*_SOURCE, "target", "mean", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), top.alias("high"), F.lit(1.0).alias("off")), "mix-dual")
    for _ in range(ITERATIONS):
        x = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * F.col("rate")
        at = cells.join(state, _SOURCE).withColumn("rate", _rate())
        g = at.groupBy(*_SOURCE, "target", "mean", "lam", "low", "high").agg(_exact(words).alias("words"), _exact(F.when(F.col("rate") < MOST, words * x).otherwise(0.0)).alias("slope"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        g = g.select(*_SOURCE, "target", "mean", "lam", low.alias("low"), high.alias("high"), (F.abs(gap) / F.col("target")).alias("off"), (F.col("lam") - gap / F.nullif("slope", F.lit(0.0))).alias("step"))
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        step = F.when(F.col("off") <= TOLERANCE, F.col("lam")).when(inside, F.col("step")).otherwise((F.greatest("low", F.col("lam") - 16) + F.least("high", F.col("lam") + 16)) / 2)
        state = written(g.select(*_SOURCE, "target", "mean", step.alias("lam"), "low", "high", "off"), "mix-dual")
        if (state.agg(F.max("off")).first()[0] or 0) <= TOLERANCE:
            break
    return sources.join(state.select(*_SOURCE, "lam"), _SOURCE, "left")


def cell_copies(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Histogram cells with ``copies``, the copies that their ``n`` documents get together."""
    c = cells.join(sources, _SOURCE).withColumn("rate", F.when(F.col("source_size") == 0, 1.0).when(F.col("size") == 0, 1.0).when(F.isnull("lam"), float(MOST)).otherwise(_rate()))
    c = running(c.withColumn("share", (F.col("n") * F.col("rate")).cast("decimal(38,12)")), _SOURCE, ["size"], ["share"], "mix-shares")
    whole = lambda x: F.round(x).cast("long")
    c = c.withColumn("copies", whole(F.col("before_share") + F.col("share")) - whole(F.col("before_share")))
    c = written(c.select(*_CELL, "n", "rate", "copies", "source_size", "target"), "mix-cells")
    gaps = c.groupBy(*_SOURCE, "target").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
    moves = _moves(c, gaps.select(*_SOURCE, (F.round("target").cast("long") - F.col("words")).alias("gap"), F.lit(NO_SIZE).alias("below")))
    return c.join(moves, _CELL, "left").select(*_CELL, "n", "rate", "source_size", "target", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))


def _moves(cells: DataFrame, gaps: DataFrame) -> DataFrame:
    """(source, size, by): copies that close each source's ``gap``, from large to small sizes.

    Rounded along the sizes, a source misses its target by no more than its
    largest document, so every source is done after a few picks of the largest
    size that fits; a round makes one pick for each source that still has one.
    """
    made, gaps = None, written(gaps, "mix-gaps")
    while True:
        up, down = F.col("n") * MOST - F.col("copies"), F.col("copies")
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (F.col("size") < F.col("below")) & (F.when(F.col("gap") > 0, up).otherwise(down) > 0)
        pick = cells.join(gaps, _SOURCE).where(fits).groupBy(*_SOURCE, "gap").agg(F.max(F.struct("size", up.alias("up"), down.alias("down"))).alias("at"))
        by = F.expr("if(gap > 0, least(at.up, gap div at.size), -least(at.down, -gap div at.size))")
        picked = written(pick.select(*_SOURCE, F.col("at.size").alias("size"), by.alias("by"), "gap"), "mix-moves")
        made = picked.drop("gap") if made is None else made.unionByName(picked.drop("gap"))
        if picked.isEmpty():
            return made
        gaps = picked.select(*_SOURCE, (F.col("gap") - F.col("size") * F.col("by")).alias("gap"), F.col("size").alias("below"))


def mix_plan(docs: DataFrame, keep: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The kept columns (the id among them) with size, source_size, target, rate, copies and taken."""
    slot = F.pmod(F.xxhash64(id_col), F.lit(SLOTS)).cast("int")
    d = written(sizes(docs, keep, source_col, text_col).withColumn("slot", slot), "mix-sizes")
    slots = written(d.groupBy(*_CELL, "slot").agg(F.count("*").alias("here")), "mix-slots")
    cells = written(slots.groupBy(*_CELL).agg(F.sum("here").alias("n")), "mix-histogram")
    sources = written(multipliers(cells, written(targets(cells), "mix-targets")), "mix-sources")
    copies = cell_copies(cells, sources)
    before = Window.partitionBy(*_CELL).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.join(copies, _CELL).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*_CELL, "slot").orderBy(*keep)) - 1
    d = d.withColumn("rank", rank).join(slots, [*_CELL, "slot"])
    d = d.withColumn("copies", F.expr("copies div n") + ((F.col("before") + F.col("rank")) < F.expr("copies % n")).cast("long"))
    return d.select(*keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row."""
    plan = mix_plan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows: each of ``docs`` none, one or two times, with all its columns."""
    rows, rid = numbered(docs)
    narrow = rows.select(F.col(id_col).cast("long").alias("_mix_id"), F.col(rid).alias("_mix_row"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    plan = mix_plan(narrow, ["_mix_id", "_mix_row"], "_mix_id")
    times = plan.where("copies > 0").select(F.col("_mix_row").alias(rid), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_mix_one")).drop("_mix_one")
    return rows.join(times, rid).select(*(rows[c] for c in docs.columns))
