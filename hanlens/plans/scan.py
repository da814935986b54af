"""The whole scan of a corpus, in one row-local plan: no shuffle, whatever a document holds.

Composed characters first; then the pattern detectors run as columns, and one
Arrow kernel does what needs a document's state: exclusions, the dictionary,
quotes and lists, the competition for spans, style rules, order and places.  A
fix happens in the same kernel, so rounds of scan and fix are a chain of
projections.  Only the compiled rules, of a checked size, are sent out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detectors, exclusions, fixes, orthography, resolve, scores, style
from ..operators.conversion import SEED, Tables, nfc, script, to_traditional
from ..operators.dictionary import checked
from ..operators.doc import Doc, Issue, merged
from ..operators.kernels import per_text
from ..operators.segmenter import Segmenter
from ..operators.spelling import Spelling
from ..rules import CASES, Rule, parse


class Profile(NamedTuple):
    """What a scan looks for."""

    variants: bool = False
    fillers: bool = True
    translationese: bool = True
    grammar: bool = True
    colon: bool = True
    dunhao: bool = True
    en_dash: bool = False
    ai_words: bool = False
    ai_density: bool = False
    ai_structure: bool = False
    multiplier: float = 1.0
    boost: bool = True
    stance: str = "roc_centric"
    domain: str = "general"
    exempt_quotes: bool = False


BASE = Profile()


def ai_profile(level: str = "medium", base: Profile = BASE) -> Profile:
    """``base`` that also looks for machine-written text, more or less strictly."""
    return base._replace(ai_words=True, ai_density=True, ai_structure=True, multiplier=scores.MULTIPLIERS[level])


#: ``strict`` adds variant forms; ``relaxed`` drops colon, 、 and grammar rules and writes ranges with an en dash.
PROFILES = {"base": BASE, "strict": BASE._replace(variants=True), "relaxed": BASE._replace(grammar=False, colon=False, dunhao=False, en_dash=True), "ai": ai_profile()}

_AI_WORDS = ("a3_passive", "a4_didactic", "a5_exaggeration")


def wanted(p: Profile) -> tuple[detectors.Detector, ...]:
    """The pattern detectors of a profile, those that compete for spans first."""
    def on(d: detectors.Detector) -> bool:
        if d.issue_type == "ai_style":
            return p.ai_words if d.code in _AI_WORDS else p.ai_structure
        return {"grammar": p.grammar, "translationese": p.translationese}.get(d.issue_type, True) and (p.colon or d.code != "p5_colon")

    return tuple(d for d in detectors.DETECTORS if on(d))


def _profile(profile: str | Profile) -> Profile:
    return PROFILES[profile] if isinstance(profile, str) else profile


class Scanner:
    """A profile's rules, compiled in the worker that uses them."""

    def __init__(self, rules: list[Rule], profile: Profile, cases: Iterable[str] = CASES, tag: str = exclusions.TAG) -> None:
        self.profile, self.tag, self.patterns = profile, tag, wanted(profile)
        self.segmenter = Segmenter(rules)
        self.spelling = Spelling(rules, self.segmenter, profile.variants, profile.fillers, profile.translationese, profile.stance, cases)
        self.asr = {r.rule_id for r in rules if r.type == "confusable" and "ASR" in (r.english or "")}

    def _pattern_issues(self, doc: Doc, hits: list[dict]) -> list[Issue]:
        if not hits:
            return []
        bounds = np.searchsorted(doc.at, [(h["offset"], h["offset"] + h["length"]) for h in hits]).tolist()
        out = []
        for h, (s, e) in zip(hits, bounds, strict=True):
            d = self.patterns[h["code"]]
            if not doc.hidden(s, e):
                new = "–" if self.profile.en_dash and d.code.startswith("p9_") else h["suggestion"]
                out.append(Issue(d.code, d.issue_type, d.severity, s, e, () if new is None else (new,)))
        return out

    def document(self, text: str, content_type: str = "plain") -> Doc:
        return Doc(text, exclusions.exclusions(text, content_type, self.tag, self.profile.exempt_quotes))

    def issues(self, doc: Doc, hits: list[dict]) -> list[Issue]:
        """All issues of a document, in the survey's order of passes."""
        p = self.profile
        patterns = self._pattern_issues(doc, hits)
        early = [*self.spelling.issues(doc, script(doc.text)), *self.spelling.case_issues(doc)]
        early += [i for i in patterns if i.issue_type in ("punctuation", "repetition")]
        rules = orthography.RULES if doc.chinese else orthography.ANY_SCRIPT
        early += [i for rule in rules if p.dunhao or rule is not orthography.dunhao for i in rule(doc)]
        kept = resolve.resolved(early)
        late = [i for i in patterns if i.issue_type == "grammar"]
        late += [i for rule in style.AI_WORDS if p.ai_words for i in rule(doc)]
        late += [i for i in patterns if i.issue_type == "ai_style"]
        late += [i for rule in style.AI_DENSITY if (p.ai_density if rule is style.densities else p.ai_structure) for i in rule(doc, p.multiplier)]
        late += [i for rule in style.AI_STRUCTURE if p.ai_structure for i in rule(doc)]
        if p.ai_structure:
            both = style.hedged(doc, [*kept, *late])
            kept, late = both[: len(kept)], both[len(kept) :]
        if p.translationese and doc.chinese:
            late += [i for i in patterns if i.issue_type == "translationese"]
            late += [i for rule in style.TRANSLATED for i in rule(doc)] + [i for rule in style.BY_DOMAIN for i in rule(doc, p.domain)]
        out = orthography.paired(doc, style.without_twins([*kept, *late]))
        return resolve.final_order([*out, *orthography.quote_hierarchy(doc)])


ISSUE = pa.struct([
    ("offset", pa.int32()), ("length", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("found", pa.string()), ("code", pa.string()), ("issue_type", pa.string()), ("severity", pa.string()),
    ("suggestions", pa.list_(pa.string())), ("rule_id", pa.int32()), ("english", pa.string()), ("clues", pa.list_(pa.string())), ("row", pa.int32()), ("cell", pa.int32()),
])
_ISSUE_DDL = "array<struct<offset: int, length: int, line: int, col: int, found: string, code: string, issue_type: string, severity: string, suggestions: array<string>, rule_id: int, english: string, clues: array<string>, row: int, cell: int>>"
#: One row a document.
SCANNED = f"doc_id long, chars int, script string, rules_checked int, rules_matched int, ai double, ai_signals array<string>, translationese double, translationese_signals array<string>, consistency double, oral_density double, quality_flags array<string>, issues {_ISSUE_DDL}"
_LISTS = pa.list_(pa.string())


def composed(docs: DataFrame, content_type: str | Column = "plain", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, content_type, back, kept columns): the text in NFC, and where it differs the original byte of each of its bytes."""
    kind = F.lit(content_type) if isinstance(content_type, str) else content_type
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), kind.cast("string").alias("content_type"), *keep)
    out = T.StructType([*d.schema.fields[:3], T.StructField("back", T.ArrayType(T.IntegerType())), *d.schema.fields[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [nfc(t or "") for t in b.column(1).to_pylist()]
            text, back = pa.array([t for t, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), text, b.column(2), back, *b.columns[3:]], names=out.names)

    return d.mapInArrow(run, out)


#: A text without these has no CJK and no mark that a pattern looks for, but for Latin letters set apart.
_MARKED = r"[^\x{0}-\x{1FFF}]"


def _with_hits(d: DataFrame, profile: Profile) -> DataFrame:
    """``d`` with the pattern detectors' hits; a text of plain Latin letters runs the one pattern it can match."""
    found = wanted(profile)
    number = next(k for k, x in enumerate(found) if x.code == "p19_spaced_acronym")
    latin = f"transform({detectors.hits('text', found[number : number + 1])}, s -> named_struct('code', {number}, 'offset', s.offset, 'length', s.length, 'f', s.f))"
    hits = f"CASE WHEN regexp(text, r'{_MARKED}') THEN {detectors.hits('text', found)} ELSE {latin} END"
    return d.withColumn("hits", F.expr(hits)).withColumn("hits", F.expr(detectors.suggested("hits", found)))


def _rendered(scanner: Scanner, doc: Doc, issues: list[Issue], content_type: str, back: list[int] | None) -> list[dict]:
    """Issues as structs: bytes of the original text, lines and columns, table cells."""
    if not issues:
        return []
    lines, columns = resolve.line_columns(doc.text, [i.start for i in issues])
    cells = exclusions.table_cells(doc.text) if content_type.startswith("markdown") and "|" in doc.text else []
    out = []
    for i, line, column in zip(issues, lines.tolist(), columns.tolist(), strict=True):
        s, e = int(doc.at[i.start]), int(doc.at[i.end])
        if back is not None:
            s, e = int(back[s]), int(back[e])
        cell = resolve.cell_of(cells, i.start, i.end) or (None, None)
        out.append({
            "offset": s, "length": e - s, "line": line, "col": column, "found": doc.text[i.start : i.end], "code": i.code, "issue_type": i.issue_type, "severity": i.severity,
            "suggestions": list(i.suggestions), "rule_id": i.rule_id, "english": i.english, "clues": list(i.clues), "row": cell[0], "cell": cell[1],
        })
    return out


def scanned(docs: DataFrame, profile: str | Profile = "base", rules: list[Rule] | None = None, content_type: str | Column = "plain", tag: str = exclusions.TAG, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document (``SCANNED`` and the kept columns): its issues in order, its scores and flags."""
    p, terms = _profile(profile), checked(rules or parse())
    sent = docs.sparkSession.sparkContext.broadcast((terms, p, tag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*sent.value[:2], tag=sent.value[2])
        for b in batches:
            out: list[list] = [[] for _ in range(12)]
            given = dict(zip(b.schema.names, b.columns, strict=True))
            for text, kind, back, found in zip(*(given[c].to_pylist() for c in ("text", "content_type", "back", "hits")), strict=True):
                doc = scanner.document(text, kind)
                issues = scanner.issues(doc, found)
                if p.boost and kind.startswith("markdown"):
                    issues = resolve.final_order(resolve.boosted(issues, exclusions.headings(text)))
                ai = scores.ai_score(doc, issues, p.multiplier) if p.fillers or p.ai_words or p.ai_density or p.ai_structure else scores.Report(None)
                trans = scores.translationese_score(doc, issues, p.domain) if p.translationese else scores.Report(None)
                row = (
                    len(text), script(text), scanner.spelling.checked(), len({i.rule_id for i in issues if i.rule_id is not None}), ai.score, list(ai.signals), trans.score, list(trans.signals),
                    scores.consistency(issues, len(text)), scores.spoken(text), scores.quality_flags(doc, issues, scanner.asr), _rendered(scanner, doc, issues, kind, back),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), _LISTS, pa.float64(), _LISTS, pa.float64(), pa.float64(), _LISTS, pa.list_(ISSUE))
            yield pa.RecordBatch.from_arrays([given["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), *(given[c] for c in keep)], names=schema.names)

    d = _with_hits(composed(docs, content_type, keep), p)
    schema = T.StructType([*T.StructType.fromDDL(SCANNED).fields, *(d.schema[c] for c in keep)])
    return d.mapInArrow(run, schema)


def scan(docs: DataFrame, profile: str | Profile = "base", rules: list[Rule] | None = None, content_type: str | Column = "plain", tag: str = exclusions.TAG) -> DataFrame:
    """One row an issue, in order within its document."""
    return exploded(scanned(docs, profile, rules, content_type, tag))


def exploded(scanned_docs: DataFrame) -> DataFrame:
    rows = scanned_docs.select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.*")
    return rows.withColumn("suggestion", F.when(F.size("suggestions") == 1, F.element_at("suggestions", 1))).withColumn("rule_type", F.when(F.isnotnull("rule_id"), F.col("issue_type")))


def counted(scanned_docs: DataFrame) -> DataFrame:
    """Errors, warnings and infos of every document, from its own row (K2)."""
    def count(severity: str) -> Column:
        return F.size(F.filter("issues", lambda i: i["severity"] == severity)).cast("long").alias(f"n_{severity}")

    return scanned_docs.select("doc_id", *map(count, ("error", "warning", "info")))


FIXED = "doc_id long, fixed_text string, n_edits int, n_issues int, edits array<struct<offset: int, length: int, text: string>>, open boolean"


def fixed(docs: DataFrame, mode: str = "lexical_safe", profile: str | Profile = "base", rules: list[Rule] | None = None, content_type: str | Column = "plain", tag: str = exclusions.TAG) -> DataFrame:
    """Scan and fix in one pass (O25): the text, the edits in bytes of the composed text, and whether anything was fixed.

    A document whose ``open`` is false already is passed through.
    """
    p, terms = _profile(profile), checked(rules or parse())
    sent = docs.sparkSession.sparkContext.broadcast((terms, p, tag))
    edit = pa.list_(pa.struct([("offset", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))
    asked = docs.withColumn("open", F.lit(True)) if "open" not in docs.columns else docs
    closed = F.when(F.col("open"), F.lit(content_type) if isinstance(content_type, str) else content_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*sent.value[:2], tag=sent.value[2])
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            given = dict(zip(b.schema.names, b.columns, strict=True))
            for text, kind, found in zip(*(given[c].to_pylist() for c in ("text", "content_type", "hits")), strict=True):
                new, edits, n, at = text, [], 0, None
                if kind is not None:
                    doc = scanner.document(text, kind)
                    issues = scanner.issues(doc, found)
                    n, at = len(issues), doc.at
                    new, edits = fixes.applied(doc, issues, mode, scanner.segmenter)
                rows = [{"offset": int(at[e.offset]), "length": int(at[e.offset + e.length] - at[e.offset]), "text": e.text} for e in edits]
                for column, value in zip(out, (new, len(edits), n, rows, bool(edits)), strict=True):
                    column.append(value)
            kinds_ = (pa.string(), pa.int32(), pa.int32(), edit, pa.bool_())
            yield pa.RecordBatch.from_arrays([given["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds_, strict=True))], names=["doc_id", "fixed_text", "n_edits", "n_issues", "edits", "open"])

    return _with_hits(composed(asked, closed), p).mapInArrow(run, FIXED)


def converge(docs: DataFrame, rounds: int = 3, mode: str = "lexical_contextual", tables: Tables = SEED) -> DataFrame:
    """Convert to traditional characters, then scan and fix until nothing is fixed any more, or the rounds are used up.

    A chain of row-local steps: a round reads only the round before it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_traditional(t or "", sent.value) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")
    for _ in range(rounds):
        more = (d.open,) if "open" in d.columns else ()
        d = fixed(d.select("doc_id", "text", *more), mode).select("doc_id", F.col("fixed_text").alias("text"), "open")
    return d.select("doc_id", "text")


def excluded_ranges(docs: DataFrame, content_type: str = "plain", tag: str = exclusions.TAG) -> DataFrame:
    """(doc_id, start, stop) of every merged excluded range, in bytes (X11)."""
    return per_text(docs, lambda d: [(int(d.at[s]), int(d.at[e])) for s, e in merged(exclusions.exclusions(d.text, content_type, tag))], "start int, stop int")
