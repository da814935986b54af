"""Rule tables as DataFrames, and the dictionary over a corpus.

Layering and gates are relational; matching is the kernel of ``spelling``: one
automaton, sent to the workers once, whose size ``MOST_RULES`` bounds.  A text is
read once, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..rules import CASES, INTERNATIONAL_ONLY, SEVERITY, Rule, parse
from .detectors import hits_sql
from .doc import CJK, Doc
from .kernels import ISSUE, issue_rows, per_text
from .segmenter import Segmenter
from .spelling import CLUE_CHARS, MOST_CLUES, PLACE_CHARS, Spelling, absorbers, effective

MOST_RULES = 50_000
_SCHEMA = "rule_id int, `from` string, `to` array<string>, type string, english string, exceptions array<string>, clues array<string>, negative array<string>, positional array<string>, disabled boolean, context string, layer int"


def checked(rules: Iterable[Rule]) -> list[Rule]:
    """The rules, no more than may be sent out."""
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rules


def rule_table(spark: SparkSession, rules: Iterable[Rule] | None = None, layer: int = 0) -> DataFrame:
    rows = [(*[list(v) if isinstance(v, tuple) else v for v in r], layer) for r in checked(parse() if rules is None else rules)]
    return spark.createDataFrame(rows, _SCHEMA)


def rules_of(table: DataFrame) -> list[Rule]:
    """A rule table's rows, as many as may be sent out, for the kernel."""
    names = [f.replace("`", "").split(" ")[0] for f in _SCHEMA.split(", ")[:-1]]
    rows = table.select(*(F.col(f"`{n}`") for n in names)).orderBy("rule_id").limit(MOST_RULES + 1).collect()
    return checked(Rule(*(tuple(v or ()) if n in ("to", "exceptions", "clues", "negative", "positional") else v for n, v in zip(names, r, strict=True))) for r in rows)


def layered(*layers: DataFrame) -> DataFrame:
    """Base, overrides, packs: the last one with a term wins; then disabled ones go."""
    every = layers[0]
    for x in layers[1:]:
        every = every.unionByName(x)
    last = Window.partitionBy("from").orderBy(F.desc("layer"), F.desc("rule_id"))
    return every.withColumn("rank", F.row_number().over(last)).where("rank = 1 AND NOT disabled").drop("rank")


def compiled(rules: DataFrame, variants: bool = False, fillers: bool = True, translationese: bool = True, stance: str = "roc_centric") -> DataFrame:
    """Rules that a profile's gates let through, clues distinct and at most ``MOST_CLUES``, with their severity."""
    gates = ~F.col("disabled")
    for on, kind in ((variants, "variant"), (fillers, "ai_filler"), (translationese, "translationese")):
        gates = gates if on else gates & (F.col("type") != kind)
    if stance != "roc_centric":
        gates = gates & ((F.col("type") != "political_coloring") | (F.lit(stance == "international") & ~F.col("from").isin(*INTERNATIONAL_ONLY)))
    severity = F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p))[F.col("type")]
    return rules.where(gates).select("rule_id", "from", "to", "type", severity.alias("severity"), "english", "exceptions", F.slice(F.array_distinct("clues"), 1, MOST_CLUES).alias("clues"), F.array_distinct("negative").alias("negative"), "positional")


_FOUND = "doc_id long, rule_id int, rule_type string, severity string, offset int, length int, found string, suggestions array<string>, english string, clues array<string>, window string"


def _context(doc: Doc, start: int, end: int) -> str:
    """40 characters on both sides, up to a blank line."""
    before, after = doc.text[max(0, start - CLUE_CHARS) : start], doc.text[end : end + CLUE_CHARS]
    return before[before.rfind("\n\n") + 2 if "\n\n" in before else 0 :] + doc.text[start:end] + after.split("\n\n")[0]


def spelling_issues(docs: DataFrame, rules: Iterable[Rule] | None = None, **gates: object) -> DataFrame:
    """Issues of the dictionary alone, nothing excluded, each with the window that disambiguation looks at."""
    sent = docs.sparkSession.sparkContext.broadcast(checked(parse() if rules is None else rules))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("rule_id", pa.int32()), ("rule_type", pa.string()), ("severity", pa.string()), ("offset", pa.int32()), ("length", pa.int32()), ("found", pa.string()),
        ("suggestions", pa.list_(pa.string())), ("english", pa.string()), ("clues", pa.list_(pa.string())), ("window", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(sent.value, Segmenter(sent.value), **gates)
        kinds = {r.rule_id: r.type for r in spelling.rules.values()}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = Doc(text or "")
                for i in spelling.issues(doc):
                    s, e = int(doc.at[i.start]), int(doc.at[i.end])
                    rows.append((doc_id, i.rule_id, kinds[i.rule_id], i.severity, s, e - s, doc.text[i.start : i.end], list(i.suggestions), i.english, list(i.clues), _context(doc, i.start, i.end)))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def case_issues(docs: DataFrame, cases: Iterable[str] = CASES) -> DataFrame:
    """Product names in another case (M6)."""
    forms = tuple(cases)
    made: dict[str, Spelling] = {}  # filled in the worker: patterns are not sent

    def issues(doc: Doc) -> Iterator[tuple]:
        if "it" not in made:
            made["it"] = Spelling((), cases=forms)
        return issue_rows(doc, made["it"].case_issues(doc))

    return per_text(docs, issues, ISSUE).select("doc_id", "offset", "length", "found", "suggestion")


# The same in SQL, written from the rules


def alternation(terms: Iterable[str]) -> str:
    return "|".join(re.escape(t).replace("\\，", "，") for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def values_sql(rules: Iterable[Rule]) -> str:
    """The rules as SQL rows for an oracle."""
    def text(x: object) -> str:
        if isinstance(x, tuple):
            return "CAST([" + ", ".join(map(text, x)) + "] AS VARCHAR[])"
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rules) + ") AS r(rule_id, src, dst, type, english, exceptions, clues, negative, places, disabled, context)"


def found_sql(corpus: str, rules: Iterable[Rule]) -> str:
    """CTEs down to ``m``: dictionary hits with their rule and sides, the sides up to a blank line; ``t`` is the text."""
    live = [r for r in rules if not r.disabled]
    terms = {r.from_ for r in live}
    return rf"""
{hits_sql(corpus, alternation([*terms, *absorbers(live)]))},
y AS (SELECT x.doc_id, f, p, b, c.t, right(pre, {CLUE_CHARS}) AS l0, left(post, {CLUE_CHARS}) AS r0 FROM x JOIN c USING (doc_id)),
s AS (SELECT *, regexp_extract(l0, '^(?s:.*(?:\n\n|\n\r\n))?((?s:.*))$', 1) AS l, regexp_extract(r0, '^((?s:.*?))(?:\n\n|\n\r\n|$)', 1) AS r1 FROM y),
m AS (SELECT s.doc_id, s.f, s.p, s.b, s.t, s.l, s.r1, s.l0, s.r0, s.p - length(s.l) AS low, s.p + length(s.f) + length(s.r1) AS high, r.* FROM s JOIN {values_sql(live)} ON f = src)"""


def _words_sql(rules: Iterable[Rule]) -> str:
    s = Segmenter(rules)
    words = sorted(w for w in s.words if 1 < len(w) <= 32 and w not in s.terms and all(map(CJK.match, w)))
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_OVER = "len(list_filter(range(1, length(ph) - length(f) + 2), lambda k: substr(ph, k, length(f)) = f AND ph <> f AND p >= k - 1 AND substr(t, p - k + 2, length(ph)) = ph)) > 0"
_BEGINS = "contains(substr(t, low + 1, high - low - 1 + length(cl)), cl)"
_PLACED = (
    "CASE split_part(pl, ':', 1) WHEN 'before' THEN contains(left(r1, {n}), split_part(pl, ':', 2)) WHEN 'after' THEN contains(right(l, {n}), split_part(pl, ':', 2)) "
    "WHEN 'not_before' THEN NOT contains(left(r1, {n}), split_part(pl, ':', 2)) WHEN 'not_after' THEN NOT contains(right(l, {n}), split_part(pl, ':', 2)) "
    "WHEN 'adjacent' THEN starts_with(substr(t, p + length(f) + 1), split_part(pl, ':', 2)) OR ends_with(left(t, p), split_part(pl, ':', 2)) ELSE TRUE END"
).format(n=PLACE_CHARS)


def kept_sql(rules: Iterable[Rule]) -> str:
    """The conditions of a hit (M4), over ``m``."""
    crossing = "substr(t, {at} - k + 1, length(w)) = w AND {at} >= k"
    start, end = crossing.format(at="p"), crossing.format(at="(p + length(f))")
    return rf"""
len(list_filter(dst, lambda ph: {_OVER})) = 0 AND len(list_filter(exceptions, lambda ph: {_OVER})) = 0
AND (len(clues) = 0 OR len(list_filter(clues, lambda cl: {_BEGINS})) > 0) AND len(list_filter(negative, lambda cl: {_BEGINS})) = 0
AND len(list_filter(places, lambda pl: NOT ({_PLACED}))) = 0
AND len(list_filter({_words_sql(rules)}, lambda w: len(list_filter(range(1, length(w)), lambda k: ({start}) OR (k >= length(f) AND {end}))) > 0)) = 0"""


def effective_sql(rules: Iterable[Rule]) -> str:
    """What a rule suggests, by its term ``f``."""
    return "CASE f " + " ".join(f"WHEN '{r.from_}' THEN CAST([{', '.join(repr(x) for x in effective(r))}] AS VARCHAR[])" for r in rules) + " END"


def spelling_oracle(corpus: str, rules: Iterable[Rule] | None = None, words: Iterable[Rule] | None = None, variants: bool = False) -> str:
    """SQL of the dictionary over ``rules``; ``words`` are the rules whose words may not be cut."""
    rules = [r for r in (rules or parse()) if variants or r.type != "variant"]
    severity = "CASE type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in SEVERITY.items()) + " END"
    return rf"""
WITH {found_sql(corpus, rules)},
k AS (SELECT *, CASE WHEN len(dst) = 1 AND dst[1] = '' AND substr(t, p + length(f) + 1, 1) IN ('，', '：') THEN f || substr(t, p + length(f) + 1, 1) ELSE f END AS found FROM m WHERE {kept_sql(words or rules)})
SELECT doc_id, type AS rule_type, {severity} AS severity, CAST(b AS INTEGER) AS "offset", CAST(strlen(found) AS INTEGER) AS length, found, array_to_string({effective_sql(rules)}, ',') AS suggestions, english
FROM k
"""


def case_oracle(corpus: str, cases: Iterable[str] = CASES) -> str:
    terms = [c.split("|")[0] for c in cases]
    right = [x for c in cases for x in (c.split("|")[0], *[a for a in c.split("|")[1].split(",") if a])]
    return rf"""
WITH {hits_sql(corpus, f"(?i)(?:{alternation(terms)})")}
SELECT doc_id, CAST(b AS INTEGER) AS "offset", CAST(strlen(f) AS INTEGER) AS length, f AS found, CASE lower(f) {' '.join(f"WHEN '{t.lower()}' THEN '{t}'" for t in terms)} END AS suggestion
FROM x WHERE NOT regexp_matches(pre, '[A-Za-z]$') AND NOT regexp_matches(post, '^[A-Za-z]') AND f NOT IN ({', '.join(f"'{x}'" for x in right)})
"""
