"""Reports over issues: groups, summaries, gates and renderings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chars import compact_suggestion, escape_tsv
from ..operators.detectors import Detector, hits
from ..operators.resolve import line_columns_of_bytes, severity_order

SHORT_SEVERITY = {"error": "E", "warning": "W", "info": "I"}


def summary(issues: DataFrame) -> DataFrame:
    """One row for the whole: issues by severity, documents with any, distinct terms (the summary sink)."""
    by = (F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SHORT_SEVERITY)
    return issues.agg(F.count("*").alias("n"), *by, F.count_distinct("doc_id").alias("docs"), F.count_distinct("found").alias("terms"))


def top_per_axis(issues: DataFrame, most: int = 5) -> DataFrame:
    """Of each document and axis of style the gravest issues, then the first ones (part of O12)."""
    axis = F.when(F.col("issue_type") == "ai_style", "ai").when(F.col("issue_type") == "translationese", "translationese").when(F.col("issue_type").isin("cross_strait", "confusable"), "consistency")
    best = Window.partitionBy("doc_id", "axis").orderBy(F.desc(severity_order()), "line", "offset", "code")
    return issues.withColumn("axis", axis).where("axis IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def located(docs: DataFrame, found: tuple[Detector, ...]) -> DataFrame:
    """Issues with their lines and UTF-16 columns, found and placed in a document's own row: one pass over its text."""
    per_doc = docs.select("doc_id", "text").withColumn("hits", F.expr(hits("text", found)))
    schema, codes = "doc_id long, code string, offset int, line int, col int", [d.code for d in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text, mine in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places = zip(*(x.tolist() for x in line_columns_of_bytes(text or "", [h["offset"] for h in mine])), strict=True) if mine else ()
                rows += [(doc_id, codes[h["code"]], h["offset"], line, col) for h, (line, col) in zip(mine, places, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "code", "offset", "line", "col"])

    return per_doc.where(F.size("hits") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "hits").mapInArrow(run, schema)


def residual(issues: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rescan issues that touch nothing the fixer wrote; ``fixed`` has its ``edits``."""
    start = F.struct(F.lit(0).alias("shift"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(a: Column, e: Column) -> Column:
        size = F.octet_length(e["text"])
        span = F.struct((e["offset"] + a["shift"]).alias("start"), (e["offset"] + a["shift"] + size).alias("end"))
        return F.struct((a["shift"] + size - e["length"]).alias("shift"), F.array_append(a["out"], span).alias("out"))

    spans = fixed.select("doc_id", F.aggregate("edits", start, step, lambda a: a["out"]).alias("written"))
    inside = lambda w: F.when(w["start"] == w["end"], (F.col("offset") <= w["start"]) & (F.col("offset") + F.col("length") > w["start"])).otherwise((F.col("offset") < w["end"]) & (F.col("offset") + F.col("length") > w["start"]))
    return issues.join(spans, "doc_id").where(~F.exists("written", inside)).drop("written")


def grouped(issues: DataFrame) -> DataFrame:
    """Equal findings of a document: count and sorted offsets (K1)."""
    return issues.groupBy("doc_id", "found", "issue_type", "suggestion", "severity").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("offset")), lambda x: x.cast("string")), ",").alias("offsets"))


def severity_counts(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Errors, warnings and infos of every document, also of clean ones (K2)."""
    g = issues.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SHORT_SEVERITY))
    return docs.select("doc_id").join(g, "doc_id", "left").na.fill(0)


def totals(issues: DataFrame) -> DataFrame:
    """Counts by type and severity with their subtotals and the total (a two-level roll-up)."""
    return issues.rollup("issue_type", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def gate(counts: DataFrame, max_errors: int | None = 0, max_warnings: int | None = None) -> DataFrame:
    """Whether each document keeps the limits that are given (K4)."""
    ok = F.lit(True)
    for most, column in ((max_errors, "n_error"), (max_warnings, "n_warning")):
        ok = ok if most is None else ok & (F.col(column) <= most)
    return counts.withColumn("accepted", ok)


def tier_metrics(issues: DataFrame) -> DataFrame:
    """Issues by resolution tier, and how many needed no judgement (K3, K9)."""
    n = F.count("*")
    return issues.agg(n.alias("n"), *(F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("deterministic", "heuristic", "llm", "unresolved")), F.try_divide(F.count_if(F.col("tier").isin("deterministic", "heuristic")) * 100.0, n).alias("avoided_percent"))


def telemetry(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Issues per thousand characters and per document, null where nothing can be divided (K5)."""
    i = issues.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") != "info").alias("graver"))
    d = docs.agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return i.join(d).select("issues", "docs", F.try_divide(F.col("issues") * 1000.0, "chars").alias("per_1k"), F.try_divide(F.col("graver") * 1.0, "issues").alias("graver_share"))


def corpus_metrics(found: DataFrame, gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Precision and recall of (doc_id, found) pairs, and the share of clean documents with a finding (K8)."""
    f, g = found.select("doc_id", "found").distinct(), gold.select("doc_id", "found").distinct()
    hit = f.join(g, ["doc_id", "found"], "left_semi").agg(F.count("*").alias("hit"))
    clean = docs.select("doc_id").join(g.select("doc_id").distinct(), "doc_id", "left_anti")
    loud = clean.join(f.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("loud"))
    n = f.agg(F.count("*").alias("n_found")).join(g.agg(F.count("*").alias("n_gold"))).join(hit).join(loud).join(clean.agg(F.count("*").alias("n_clean")))
    return n.select(F.try_divide("hit", "n_found").alias("precision"), F.try_divide("hit", "n_gold").alias("recall"), F.try_divide("loud", "n_clean").alias("false_positive_rate"))


def badge(issues: DataFrame) -> DataFrame:
    """A document's badge: what is not info, at most ``99+``."""
    n = F.count_if(F.col("severity") != "info")
    return issues.groupBy("doc_id").agg(F.when(n > 99, "99+").otherwise(n.cast("string")).alias("badge"))


def as_json(issues: DataFrame) -> DataFrame:
    """One JSON line an issue."""
    return issues.select("doc_id", F.to_json(F.struct("offset", "length", "found", "issue_type", "severity", "suggestion")).alias("line"))


def as_tabular(issues: DataFrame) -> DataFrame:
    """One tab-separated line an issue."""
    short = F.create_map(*(F.lit(x) for p in SHORT_SEVERITY.items() for x in p))[F.col("severity")]
    return issues.select("doc_id", F.concat_ws("\t", F.col("offset").cast("string"), short, "issue_type", escape_tsv(F.col("found")), escape_tsv(F.coalesce("suggestion", F.lit("")))).alias("line"))


def as_human(issues: DataFrame) -> DataFrame:
    arrow = F.when(F.isnull("suggestion"), "").when(F.col("suggestion") == "", " -> (delete)").otherwise(F.concat(F.lit(" -> "), "suggestion"))
    return issues.select("doc_id", F.concat(F.col("offset").cast("string"), F.lit(": "), "severity", F.lit(" ["), "issue_type", F.lit("] "), "found", arrow).alias("line"))


def as_compact(issues: DataFrame) -> DataFrame:
    """Groups with their number and the shortened suggestion."""
    g = issues.groupBy("doc_id", "found", "issue_type", "severity", "suggestion").agg(F.count("*").alias("n"))
    return g.select("doc_id", "found", "issue_type", "severity", compact_suggestion(F.when(F.isnull("suggestion"), F.array().cast("array<string>")).otherwise(F.array("suggestion"))).alias("suggestion"), "n")


def as_sarif(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """SARIF 2.1.0 results, one JSON object an issue; ``docs`` gives the path."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("offset").alias("byteOffset"), F.col("length").alias("byteLength")).alias("region")).alias("physicalLocation")))
    return issues.join(docs.select("doc_id", "path"), "doc_id").select("doc_id", F.to_json(F.struct(F.col("issue_type").alias("ruleId"), level.alias("level"), F.struct(F.col("found").alias("text")).alias("message"), place.alias("locations"))).alias("line"))


def search_replace(issues: DataFrame) -> DataFrame:
    """Edit blocks for issues with a suggestion."""
    block: Column = F.concat(F.lit("<<<<<<< SEARCH\n"), "found", F.lit("\n=======\n"), "suggestion", F.lit("\n>>>>>>> REPLACE"))
    return issues.where("suggestion IS NOT NULL").select("doc_id", "offset", block.alias("block"))


def ambiguous_dictionary(rules: DataFrame) -> DataFrame:
    """Active rules with an English gloss, as JSON (K7)."""
    return rules.where("english IS NOT NULL AND NOT disabled").select("from", F.to_json(F.struct("from", "to", "english")).alias("entry"))
