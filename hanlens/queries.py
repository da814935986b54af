"""Queries over the driver's tables by name, and the SQL that must give the same rows.

Every query reads its whole tables and whole texts.  Texts are ``corpus.text_sql``
of ``documents`` (or ``long_sql`` for rules about paragraphs and density): a
sample in Chinese, which the driver's texts lack, and then the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus, oracles
from .functions import chars, spans
from .operators import annotate, conversion, detectors, dictionary, exclusions, fixes, kernels, orthography, resolve, scores, style
from .operators.doc import Doc, Issue, chunk
from .operators.segmenter import Segmenter
from .operators.spelling import Spelling
from .plans import quality, report, scan
from .rules import COLLOCATIONS, INTERNATIONAL_ONLY, OTHER_SENSES, PRIORS, Rule, parse
from .sources import rpc

Query = Callable[[SparkSession, str], DataFrame]
SHORT = f"SELECT doc_id, {corpus.text_sql('text')} AS t FROM documents"
LONG = f"SELECT doc_id, {corpus.long_sql('text')} AS t FROM documents"
ALL = parse()
RULES = [r for r in ALL if r.type != "variant"]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(corpus.text_sql("text")).alias("text"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(corpus.long_sql("text")).alias("text"))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


for _d in detectors.DETECTORS:
    query(detectors.oracle(_d, SHORT), f"detect_{_d.code}")(lambda spark, sf_dir, d=_d: detectors.issues(short(spark, sf_dir), (d,)))

_STYLE = {
    "a1_meaning": style.meaning, "a2_copula": style.copulas, "a6_density": style.densities, "a7_binary_contrast": style.binary_contrast, "a8_paragraph_endings": style.paragraph_endings,
    "a9_dashes": style.dashes, "a10_formulaic_headings": style.formulaic_headings, "a11_list_density": style.list_density, "a13_tricolon": style.tricolons, "a16_bullets": style.bullets,
    "a17_bold": style.bold, "a18_em_dash": style.em_dashes, "a22_line_metaphor": style.line_metaphor, "a23_slogans": style.slogans, "t1_passive": style.passives,
    "t2_abstract_subject": style.abstract_subjects, "t3_late_condition": style.late_conditions, "t4_pronoun_runs": style.pronoun_runs, "t7_de_chain": style.de_chains, "t9_tense": style.tenses,
    "t10_one_of_density": style.one_of_density, "t11_connective_pair": style.connectives_by_sentence, "t12_nominal_chain": style.nominal_chains, "t13_premodifier": style.premodifiers,
    "t15_connectives": style.connectives, "t16_nominal_pair": style.nominal_pairs, "t17_false_friend": style.false_friends,
}
_STYLE_SQL = oracles.style_oracles(LONG)
for _code, _rule in _STYLE.items():
    query(_STYLE_SQL[_rule.__name__], f"structure_{_code}")(lambda spark, sf_dir, r=_rule: kernels.detected(long(spark, sf_dir), r))


def _spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.spelling_issues(short(spark, sf_dir), RULES)


@query(dictionary.spelling_oracle(SHORT))
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling(spark, sf_dir).select("doc_id", "rule_type", "severity", "offset", "length", "found", F.array_join("suggestions", ",").alias("suggestions"), "english")


@query(dictionary.case_oracle(SHORT))
def case_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.case_issues(short(spark, sf_dir))


_SEVERITY = "CASE type WHEN 'political_coloring' THEN 'error' WHEN 'typo' THEN 'error' WHEN 'ai_filler' THEN 'info' WHEN 'translationese' THEN 'info' ELSE 'warning' END"
_NEXT = "substr(t, p + length(f) + 1, 1)"
_FOUND = f"""WITH {dictionary.found_sql(SHORT, RULES)}, i AS (SELECT doc_id, type AS rule_type, {_SEVERITY} AS severity, CASE WHEN dst = [''] AND {_NEXT} IN ('，', '：') THEN f || {_NEXT} ELSE f END AS found,
{dictionary.effective_sql(RULES)} AS dst, english, clues, CAST(b AS INTEGER) AS "offset", regexp_replace(l0, '^(?s:.*)\n\n', '') || f || regexp_extract(r0, '^((?s:.*?))(?:\n\n|$)', 1) AS w FROM m WHERE {dictionary.kept_sql(RULES)})"""
@query(f"""{_FOUND}, g AS (SELECT doc_id, count_if(severity = 'error') AS n_error, count_if(severity = 'warning') AS n_warning, count_if(severity = 'info') AS n_info FROM i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_error, 0) AS BIGINT) AS n_error, CAST(coalesce(n_warning, 0) AS BIGINT) AS n_warning, CAST(coalesce(n_info, 0) AS BIGINT) AS n_info, coalesce(n_error, 0) <= 0 AND coalesce(n_warning, 0) <= 1 AS accepted
FROM documents d LEFT JOIN g USING (doc_id)""")
def gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: regional terms of every document and whether it passes."""
    return report.gate(report.severity_counts(_spelling(spark, sf_dir), short(spark, sf_dir)), 0, 1)


@query(f"""{_FOUND} SELECT rule_type, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM i GROUP BY ROLLUP (rule_type, severity)""")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_spelling(spark, sf_dir).withColumnRenamed("rule_type", "issue_type")).withColumnRenamed("issue_type", "rule_type")


@query(f"{_FOUND} SELECT found, count(*) AS n, count(DISTINCT doc_id) AS docs, min(array_to_string(dst, ',')) AS suggestions FROM i GROUP BY 1 ORDER BY n DESC, found LIMIT 10")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _spelling(spark, sf_dir)
    return i.groupBy("found").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min(F.array_join("suggestions", ",")).alias("suggestions")).orderBy(F.desc("n"), "found").limit(10)


@query(f"""{_FOUND}, g AS (SELECT doc_id, english, array_to_string(list_sort(list(DISTINCT found)), ',') AS terms, min(dst[1]) AS preferred, count(*) AS n FROM i WHERE severity <> 'info' AND rule_type IN ('cross_strait', 'confusable') AND english IS NOT NULL GROUP BY 1, 2)
SELECT g.*, contains(t, preferred) AS mixed FROM g JOIN ({SHORT}) d USING (doc_id)""")
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.consistency(_spelling(spark, sf_dir), short(spark, sf_dir))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling(spark, sf_dir).withColumn("issue_type", F.col("rule_type"))



def _tier2_sql(profile: str = "base") -> str:
    """Score and outcome of the eligible terms of ``i``, as columns score and outcome."""
    settled = "CASE " + " ".join(f"WHEN found = '{t}' AND contains(w, '{n}') THEN '{to}'" for t, n, to in COLLOCATIONS) + " END"
    prior = "CASE found " + " ".join(f"WHEN '{t}' THEN {w}" for t, _, w in PRIORS[profile]) + " ELSE 0 END"
    preferred = "CASE found " + " ".join(f"WHEN '{t}' THEN '{p}'" for t, p, _ in PRIORS[profile]) + " END"
    other = " OR ".join(f"(found = '{t}' AND ({' OR '.join(f'contains(w, {chr(39)}{x}{chr(39)})' for x in words)}))" for t, words in OTHER_SENSES.items())
    return f"""el AS (SELECT *, {settled} AS c, len(list_filter(clues, lambda c: contains(w, c))) AS k, {prior} AS prior, {preferred} AS preferred, {other} AS other FROM i
WHERE rule_type IN ('cross_strait', 'confusable') AND (len(dst) > 1 OR len(clues) > 0 OR found IN ({', '.join(map(repr, OTHER_SENSES))}))),
cl AS (SELECT *, CASE WHEN k > 0 THEN least(0.7, 0.3 + 0.4 * k / len(clues)) ELSE 0.0 END AS clue, coalesce(list_contains(dst, c), FALSE) AS fits FROM el),
sc AS (SELECT *, round(CASE WHEN fits THEN 1.0 WHEN other THEN 0.0 ELSE least(1.0, clue + prior) END, 6) AS score FROM cl),
t2 AS (SELECT *, CASE WHEN score >= 0.6 THEN 'resolved' WHEN score < 0.3 THEN 'suppressed' ELSE 'gray' END AS outcome FROM sc),
t3 AS (SELECT *, CASE WHEN outcome = 'resolved' THEN CASE WHEN fits THEN c WHEN prior > clue AND list_contains(dst, preferred) THEN preferred ELSE dst[1] END END AS term FROM t2)"""


@query(f"{_FOUND}, {_tier2_sql()} SELECT doc_id, found, CAST(score AS DOUBLE) AS score, outcome, term FROM t3")
def tier2_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = annotate.tier2(_spelling(spark, sf_dir).where(annotate.eligible()))
    return m.select("doc_id", "found", F.round("tier2_score", 6).alias("score"), F.col("tier2_outcome").alias("outcome"), F.col("tier2_term").alias("term"))


@query(f"""{_FOUND}, {_tier2_sql('strict')}, oc AS (SELECT doc_id, "offset", outcome, term FROM t3)
SELECT i.doc_id, found, CASE WHEN outcome = 'suppressed' THEN 'info' ELSE severity END AS severity,
array_to_string(CASE WHEN term IS NULL OR NOT list_contains(dst, term) THEN dst ELSE list_transform(range(1, len(dst) + 1), lambda k: CASE WHEN k = 1 THEN term WHEN dst[k] = term THEN dst[1] ELSE dst[k] END) END, ',') AS suggestions
FROM i LEFT JOIN oc ON i.doc_id = oc.doc_id AND i."offset" = oc."offset" """)
def tier2_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled suggestions to the front, suppressed terms info (O15), with the strict profile's priors."""
    return annotate.tier2_apply(_spelling(spark, sf_dir), "strict").select("doc_id", "found", "severity", F.array_join("suggestions", ",").alias("suggestions"))


@query(f"""{_FOUND} SELECT doc_id, found, CASE WHEN doc_id % 2 = 0 AND found = '軟件' THEN 'info' ELSE severity END AS severity FROM i""")
def bulk_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a bulk question about issues by their place."""
    i = _spelling(spark, sf_dir)
    answers = i.where("found = '軟件'").select("doc_id", "offset", (F.col("doc_id") % 2 != 0).alias("keep"))
    return annotate.confirmed(i, answers).select("doc_id", "found", "severity")


@query(f"""{_FOUND}, b AS (SELECT doc_id, CAST(b AS INTEGER) AS "offset", f FROM ({'WITH ' + detectors.hits_sql(SHORT, '網路|系統') + ' SELECT * FROM x'}) z),
k AS (SELECT i.*, EXISTS (SELECT 1 FROM b WHERE b.doc_id = i.doc_id AND i."offset" <= b."offset" AND i."offset" + strlen(i.found) >= b."offset" + strlen(b.f)) AS banned FROM i)
SELECT doc_id, "offset", found, CASE WHEN banned THEN 'error' ELSE severity END AS severity, banned AS glossary_banned FROM k
UNION ALL SELECT doc_id, "offset", f, 'error', TRUE FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE b.doc_id = i.doc_id AND i."offset" <= b."offset" AND i."offset" + strlen(i.found) >= b."offset" + strlen(b.f))""")
def glossary_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banned terms become errors, where an issue covers them and where none does."""
    d = short(spark, sf_dir)
    return annotate.glossary(_typed(spark, sf_dir), [], ["網路", "系統"], d).select("doc_id", "offset", "found", "severity", "glossary_banned")


@query(f"""{_FOUND} SELECT doc_id, found, CASE WHEN found IN ('軟件', '用戶') THEN 'info' WHEN found = '內存' AND severity <> 'info' THEN 'info' ELSE severity END AS severity FROM i WHERE found <> '優化'""")
def side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary proper nouns, a suppression list and the last word of the translation memory."""
    i = annotate.glossary(_spelling(spark, sf_dir).withColumn("issue_type", F.col("rule_type")), ["優化"], [])
    i = annotate.suppressed(i, spark.createDataFrame([("軟件",), ("用戶",)], "term string"))
    memory = spark.createDataFrame([("內存", "記憶體", 1), ("內存", "內存", 2), ("線程", "線程", 1), ("線程", "執行緒", 3)], "found string, user_chose string, seq int")
    return annotate.remembered(i, memory).select("doc_id", "found", "severity")


@query(f"""{_FOUND} SELECT doc_id, found, rule_type FROM i WHERE NOT (rule_type = 'cross_strait' AND found IN ('內存', '線程') AND doc_id % 2 = 0)""")
def baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _spelling(spark, sf_dir).withColumn("issue_type", F.col("rule_type")).withColumn("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    old = i.where((F.col("doc_id") % 2 == 0) & F.col("found").isin("內存", "線程")).select(annotate.fingerprint().alias("fingerprint")).distinct()
    return annotate.baseline_filter(i, old).select("doc_id", "found", "rule_type")


_LAYERS = (
    [Rule(1, "軟件", ("軟體",), "cross_strait", "software"), Rule(2, "土豆", ("馬鈴薯",), "cross_strait", "potato"), Rule(3, "支持", ("支援",), "cross_strait")],
    [Rule(1, "土豆", ("洋芋",), "cross_strait", "potato"), Rule(2, "支持", (), "cross_strait", disabled=True)],
    [Rule(1, "軟件", ("軟體", "程式"), "cross_strait", "software"), Rule(2, "硬件", ("硬體",), "cross_strait", "hardware")],
)


def _layers_sql() -> str:
    return " UNION ALL ".join(f"SELECT *, {k} AS layer FROM {dictionary.values_sql(layer)}" for k, layer in enumerate(_LAYERS))


@query(f"SELECT src AS term, array_to_string(dst, ',') AS suggestions, CAST(layer AS INTEGER) AS layer FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY layer DESC, rule_id DESC) AS k FROM ({_layers_sql()})) WHERE k = 1 AND NOT disabled")
def rule_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.layered(*(dictionary.rule_table(spark, x, k) for k, x in enumerate(_LAYERS))).select(F.col("from").alias("term"), F.array_join("to", ",").alias("suggestions"), "layer")


@query(f"SELECT src AS term, count(DISTINCT array_to_string(dst, ',')) AS variants, array_to_string(list_sort(list(DISTINCT layer)), ',') AS layers FROM ({_layers_sql()}) GROUP BY 1 HAVING count(DISTINCT array_to_string(dst, ',')) > 1")
def pack_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = dictionary.rule_table(spark, _LAYERS[0])
    for k in (1, 2):
        every = every.unionByName(dictionary.rule_table(spark, _LAYERS[k], k))
    c = annotate.conflicts(every)
    return c.select(F.col("from").alias("term"), "variants", F.array_join(F.transform("layers", lambda x: x.cast("string")), ",").alias("layers"))


_ALL_RULES = dictionary.values_sql(ALL)
for _name, (_check, _sql) in quality.checks(ALL).items():
    query(_sql, f"rules_{_name}")(lambda spark, sf_dir, c=_check: c(quality.annotated(spark)))


_SIMP, _TRAD = conversion.SIMPLIFIED, conversion.TRADITIONAL
_S = f"(length(t) - length(translate(t, '{_SIMP}', '')))"
_T = f"(length(t) - length(translate(t, '{_TRAD}', '')))"


@query(f"SELECT doc_id, CASE WHEN {_S} > {_T} THEN 'simplified' WHEN {_T} > {_S} THEN 'traditional' ELSE 'unknown' END AS script FROM ({SHORT})")
def script_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(spark, sf_dir).select("doc_id", chars.script(F.col("text"), _SIMP, _TRAD).alias("script"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(t, '[{chars.IDEOGRAPH}]')) AS INTEGER) AS ideographs, CAST(len(regexp_extract_all(t, '[{chars.CONTEXT}]')) AS INTEGER) AS context, CAST(len(regexp_extract_all(t, '[{chars.NARROW}]')) AS INTEGER) AS narrow, CAST(len(regexp_extract_all(t, '[{chars.FULL_PUNCTUATION}]')) AS INTEGER) AS punctuation, translate(t, '０１２３４５６７８９', '0123456789') AS folded FROM ({SHORT})")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return short(spark, sf_dir).select("doc_id", chars.count_of(t, chars.IDEOGRAPH).alias("ideographs"), chars.count_of(t, chars.CONTEXT).alias("context"), chars.count_of(t, chars.NARROW).alias("narrow"), chars.count_of(t, chars.FULL_PUNCTUATION).alias("punctuation"), chars.fold_digits(t).alias("folded"))


_COMMA = detectors.oracle(detectors.BY_CODE["p1_comma"], LONG)


@query(rf"""WITH i AS ({_COMMA}), d AS ({LONG}), h AS (SELECT i.doc_id, "offset", decode(encode(t)[1:"offset"]) AS head FROM i JOIN d USING (doc_id))
SELECT doc_id, "offset", CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(string_split(head, chr(10))[-1]) + len(regexp_extract_all(string_split(head, chr(10))[-1], '[\x{{10000}}-\x{{10FFFF}}]')) + 1 AS INTEGER) AS col FROM h""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and columns of a document's issues, merged once with its line starts."""
    return report.located(long(spark, sf_dir), (detectors.BY_CODE["p1_comma"],)).select("doc_id", "offset", "line", "col")


_LINKS = r"[a-zA-Z0-9+.\-]*://[^\s「」『』《》]+|@[a-zA-Z0-9_]+"


@query(rf"""WITH c AS (SELECT doc_id, t, regexp_extract_all(t, '{_LINKS}') AS h, string_split_regex(t, '{_LINKS}') AS g FROM ({SHORT})),
e AS (SELECT doc_id, h[i] AS found, strlen(array_to_string(list_transform(range(1, i), lambda j: g[j] || h[j]), '') || g[i]) AS s FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM c))
SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(s + strlen(found) AS INTEGER) AS "end", found FROM e""")
def exclusion_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans.matches("text", _LINKS)
    return short(spark, sf_dir).select("doc_id", F.explode(s).alias("s")).select("doc_id", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.length")).alias("end"), F.col("s.found").alias("found"))


@query("""WITH e AS (SELECT user_id, CAST(floor(value) AS INTEGER) AS s, CAST(floor(value) AS INTEGER) + 1 + CAST(event_id % 5 AS INTEGER) AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS "start", max(e) AS "end" FROM g GROUP BY user_id, k""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of overlapping and adjacent ranges, as exclusions are merged, on the event table.

    A null start comes last and joins the range before it; where no end is known, each row is a range.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.floor("value").cast("int").alias("start"), (F.floor("value") + 1 + F.col("event_id") % 5).cast("int").alias("end"))
    return spans.union(e, "user_id")


@query(f"SELECT doc_id, k, para FROM (SELECT doc_id, unnest(range(len(ps))) AS k, unnest(ps) AS para FROM (SELECT doc_id, list_filter(string_split_regex(t, '\\r\\n\\r\\n|\\n\\n'), lambda p: regexp_matches(p, '[^\\s]')) AS ps FROM ({LONG})))".replace("\\\\", "\\"))
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.filter(F.split("text", r"\r\n\r\n|\n\n", -1), lambda x: x.rlike(r"[^\s]"))
    return long(spark, sf_dir).select("doc_id", F.posexplode(p).alias("k", "para")).select("doc_id", F.col("k").cast("long").alias("k"), "para")


_ORAL = "|".join(sorted(scores.ORAL, key=len, reverse=True))
_CJK = f"len(regexp_extract_all(t, '[{chars.NARROW}]'))"


@query(f"SELECT doc_id, CASE WHEN {_CJK} >= 20 THEN round(({_CJK} - len(regexp_extract_all(regexp_replace(t, '{_ORAL}', '', 'g'), '[{chars.NARROW}]'))) * 1.0 / {_CJK}, 6) END AS oral_density FROM ({SHORT})")
def oral_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(spark, sf_dir).select("doc_id", F.round(scores.oral_density(), 6).alias("oral_density"))


def _phrase_sql() -> str:
    n = [f"(len(regexp_extract_all(t, '{p}')) * 1000.0 / length(t))" for p, *_ in scores.AI_SIGNALS]
    top = " + ".join(f"CASE WHEN {d} > {t} THEN least(2.0, ({d} - {t}) / {t}) ELSE 0 END * {w}" for d, (_, t, w) in zip(n, scores.AI_SIGNALS, strict=True))
    weights = " + ".join(f"CASE WHEN {d} > 0 THEN {w} ELSE 0 END" for d, (_, _, w) in zip(n, scores.AI_SIGNALS, strict=True))
    return f"0.7 * least(1.0, coalesce(({top}) / nullif({weights}, 0), 0))"


_MARKS = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS mark, unnest(list_transform(p[2:len(p) - 1], lambda x: length(x) + 1)) AS g, len(p) - 1 AS marks FROM (SELECT doc_id, string_split(t, '{m}') AS p FROM d)" for m in "，。；、")
#: Two signs in a row are a dash; of three, two dashes begin.
_DASHES = "SELECT doc_id, '—' AS mark, b - a AS g, m AS marks FROM (SELECT doc_id, k AS b, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS a, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, unnest(list_filter(range(1, length(t)), lambda k: substr(t, k, 2) = '——')) AS k FROM d WHERE contains(t, '——'))) WHERE a IS NOT NULL"


@query(f"""WITH d AS ({LONG}), s AS (SELECT doc_id, count(*) AS n, stddev_pop(length(x)) AS sigma FROM (SELECT doc_id, unnest(v[1:len(v) - 1]) AS x FROM (SELECT doc_id, string_split_regex(t, '[。！？!?]') AS v FROM d)) WHERE length(x) >= 4 GROUP BY 1),
g AS ({_MARKS} UNION ALL {_DASHES}), v AS (SELECT doc_id, mark, any_value(marks) AS marks, stddev_pop(g) / avg(g) AS cv FROM g GROUP BY 1, 2 HAVING count(*) >= 9 AND avg(g) >= 1),
c AS (SELECT doc_id, sum(cv * marks) / sum(marks) AS cv FROM v GROUP BY 1)
SELECT d.doc_id, CASE WHEN length(t) >= 500 THEN CAST(round(least(1.0, {_phrase_sql()} + CASE WHEN s.n >= 10 AND sigma < 5 THEN 0.15 * (1 - sigma / 5) ELSE 0 END + least(0.2, 0.2 * len(regexp_extract_all(t, '[{chars.ZERO_WIDTH}]')) / 3) + coalesce(greatest(0, 0.5 - c.cv) / 0.5 * 0.1, 0)), 6) AS DOUBLE) END AS score
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)""")
def ai_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's own part of the score; what issues add is part of ``document_scores``."""
    return kernels.per_text(long(spark, sf_dir), lambda d: [(None if (s := scores.ai_score(d).score) is None else round(s, 6),)], "score double")


def _translationese_sql(domain: str) -> str:
    v = [f"(len(regexp_extract_all(t, '{p}')) * 1000.0 / length(t))" for p in ("被", "他們|她們|他|她|它")]
    objects = "|".join(scores.WEAK_OBJECTS)
    weak = " + ".join(f"(SELECT len(list_filter(range(2, len(v) + 1), lambda k: regexp_matches(left(array_to_string(v[k:k + 3], '{x}'), 4), '{objects}'))) FROM (SELECT string_split(t, '{x}') AS v))" for x in scores.WEAK_VERBS)
    passive, weak_most, pronoun, chain, _ = scores.DOMAINS[domain]
    parts = ((v[0], passive, ">", 1.0), ("most", float(chain), ">=", 0.7), ("weak * 1000.0 / length(t)", weak_most, ">", 0.8), (v[1], pronoun, ">", 0.6))
    total = " + ".join(f"CASE WHEN {x} {op} {t} THEN least(2.0, greatest(0.1, ({x} - {t}) / {t})) ELSE 0 END * {w}" for x, t, op, w in parts)
    weak = f"CASE WHEN regexp_matches(t, '{'|'.join(scores.WEAK_VERBS)}') THEN {weak} ELSE 0 END"
    return f"""WITH d AS (SELECT doc_id, t, {weak} AS weak FROM ({LONG})), m AS (SELECT doc_id, max(len(regexp_extract_all(x, '的'))) AS most FROM (SELECT doc_id, unnest(string_split_regex(t, '[，,。！？；\n]')) AS x FROM d) GROUP BY 1)
SELECT doc_id, CASE WHEN length(t) >= 200 THEN CAST(round(least(1.0, ({total}) / {sum(scores.SIGNAL_WEIGHTS)}), 6) AS DOUBLE) END AS score FROM d JOIN m USING (doc_id)"""


def _translationese(doc: Doc, domain: str) -> list[tuple]:
    score = scores.translationese_score(doc, (), domain).score
    return [(None if score is None else round(score, 6),)]


for _domain in scores.DOMAINS:
    query(_translationese_sql(_domain), f"translationese_score_{_domain}")(lambda spark, sf_dir, domain=_domain: kernels.per_text(long(spark, sf_dir), lambda d: _translationese(d, domain), "score double"))


@query(rf"""WITH w AS (SELECT doc_id, i, ws[i] AS w, ws[i + 1] AS nxt FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS ws FROM documents)))
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, nxt, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS nn FROM w) WHERE regexp_matches(w, '^[A-Za-z]{{3,}}$') AND nxt = ' ' AND lower(nn) = lower(w) GROUP BY 1""")
def adjacent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin words that repeat their predecessor, on the driver's own texts, by arrays alone."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("w"))
    n = F.size(F.filter(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 3, F.lit(0))).alias("a"), F.slice(F.col("w"), 2, F.size("w")).alias("b"), F.slice(F.col("w"), 3, F.size("w")).alias("c")), lambda x: x["a"].rlike("^[A-Za-z]{3,}$") & (x["b"] == " ") & (F.lower(x["a"]) == F.lower(x["c"]))))
    return d.select("doc_id", n.cast("long").alias("n")).where("n > 0")


@query(f"WITH i AS ({detectors.oracle(detectors.BY_CODE['p1_comma'], SHORT)}) SELECT doc_id, found, issue_type, suggestion, severity, count(*) AS n, array_to_string(list_sort(list(\"offset\")), ',') AS offsets FROM i GROUP BY ALL")
def grouped_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.grouped(detectors.issues(short(spark, sf_dir), (detectors.BY_CODE["p1_comma"],)))


@query(f"""WITH i AS (SELECT * FROM ({detectors.oracle(detectors.BY_CODE['p12_space_after'], LONG)}) UNION ALL SELECT * FROM ({detectors.oracle(detectors.BY_CODE['p14_full_digit'], LONG)})) SELECT doc_id, found, issue_type, severity, CASE WHEN suggestion = '' THEN '(delete)' ELSE coalesce(suggestion, '') END AS suggestion, count(*) AS n FROM i GROUP BY ALL""")
def compact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal issues with their shortened suggestion (K6)."""
    return report.as_compact(detectors.issues(long(spark, sf_dir), (detectors.BY_CODE["p12_space_after"], detectors.BY_CODE["p14_full_digit"])))


@query(f"WITH i AS ({detectors.oracle(detectors.BY_CODE['r5_light_verb'], SHORT)}) SELECT doc_id, CAST(\"offset\" AS VARCHAR) || chr(9) || 'I' || chr(9) || issue_type || chr(9) || found || chr(9) || suggestion AS line FROM i")
def tabular_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_tabular(detectors.issues(short(spark, sf_dir), (detectors.BY_CODE["r5_light_verb"],)))


@query(f"WITH i AS ({detectors.oracle(detectors.BY_CODE['r5_light_verb'], SHORT)}) SELECT doc_id, CAST(\"offset\" AS VARCHAR) || ': info [grammar] ' || found || ' -> ' || suggestion AS line FROM i")
def human_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_human(detectors.issues(short(spark, sf_dir), (detectors.BY_CODE["r5_light_verb"],)))


_ROWS = """SELECT doc_id, '{code}' AS code, '{kind}' AS issue_type, '{severity}' AS severity, CAST({b} AS INTEGER) AS "offset", CAST(strlen({f}) AS INTEGER) AS length, {f} AS found, {suggestion} AS suggestion"""
#: A mark that is said twice, for an engine without back-references; dashes and ellipses have two free.
_REPEATABLE = "、。〃〈〉《》「」『』【】〔〕〖〗〘〙〚〛！（），．：；？"


def _repeats_sql() -> str:
    q = "|".join([*(f"{c}{{2,}}" for c in _REPEATABLE.replace("．", "．")), "—{3,}", "…{3,}"])
    row = _ROWS.format(code="p13_repeated_mark", kind="punctuation", severity="warning", b="b + 3 * (k - 1)", f="left(f, 1)", suggestion="''")
    return f"WITH {detectors.hits_sql(SHORT, q)} {row} FROM (SELECT *, unnest(range(CASE WHEN left(f, 1) IN ('—', '…') THEN 3 ELSE 2 END, length(f) + 1)) AS k FROM x)"


_DUNHAO = f"""WITH {detectors.hits_sql(SHORT, '，')}, g AS (SELECT *, lead(p) OVER q AS after, lag(p) OVER q AS before FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
w AS (SELECT g.*, length(regexp_replace(regexp_replace(substr(t, before + 2, g.p - before - 1), '^[{oracles.BLANK}]+', ''), '[{oracles.BLANK}]+$', '')) BETWEEN 1 AND 4 AS short FROM g JOIN c USING (doc_id)),
r AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT * REPLACE (coalesce(short, FALSE) AS short) FROM w))
{_ROWS.format(code='p7_dunhao', kind='punctuation', severity='info', b='b', f='f', suggestion="'、'")} FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r) WHERE n >= 3"""
_LATIN = rf"""WITH {detectors.hits_sql(SHORT, '[A-Za-z0-9]+')}, n AS (SELECT *, lead(f) OVER q AS f2, lead(p) OVER q AS p2, lead(b) OVER q AS b2, lead(post) OVER q AS post2, row_number() OVER q AS j FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
l AS (SELECT n.*, lower(f) = lower(f2) AND length(f) >= 3 AND regexp_matches(substr(t, p + length(f) + 1, p2 - p - length(f)), '^(?:[ \t]+|[ \t]*\r?\n[ \t]*)$') AND NOT regexp_matches(post2, '^[\pL\pN]') AS link, substr(t, p + 1, p2 + length(f2) - p) AS pair FROM (SELECT * FROM n WHERE lower(f) = lower(f2)) n JOIN c USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY j) AS turn FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM l WHERE link))
{_ROWS.format(code='p18_latin_repetition', kind='repetition', severity='info', b='b', f='pair', suggestion='f')} FROM k WHERE turn % 2 = 1"""
_KERNELS: dict[str, tuple[Callable[[Doc], Iterable[Issue]], str | None]] = {
    "detect_p6_ascii_quotes": (orthography.ascii_quotes, None), "detect_p7_dunhao": (orthography.dunhao, _DUNHAO), "detect_p13_repeated_marks": (orthography.repeated_marks, _repeats_sql()),
    "detect_p16_quote_hierarchy": (orthography.quote_hierarchy, None), "detect_p17_cjk_repetition": (orthography.cjk_repetitions, None), "detect_p18_latin_repetition": (orthography.latin_repetitions, _LATIN),
}
for _name, (_rule, _sql) in _KERNELS.items():
    query(_sql, _name)(lambda spark, sf_dir, r=_rule: kernels.detected(short(spark, sf_dir), r))


def _curly(doc: Doc) -> list[Issue]:
    return orthography.paired(doc, [Issue("p8_double_curly", "punctuation", "warning", k, k + 1) for k, c in enumerate(doc.text) if c in "“”"])


@query()
def detect_p15_quote_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.detected(short(spark, sf_dir), _curly)


@query(f"""WITH c AS (SELECT doc_id, t, unnest(list_filter(range(1, length(t)), lambda i: regexp_matches(substr(t, i, 2), '[{chars.IDEOGRAPH}][A-Za-z0-9]|[A-Za-z0-9][{chars.IDEOGRAPH}]'))) AS i FROM ({SHORT}) WHERE regexp_matches(t, '[{chars.IDEOGRAPH}]'))
{_ROWS.format(code='p11_spacing', kind='punctuation', severity='info', b='strlen(left(t, i))', f="''", suggestion="' '")} FROM c""")
def detect_p11_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.detected(short(spark, sf_dir), orthography.spacing)


def _bytes(doc: Doc, found: Iterable[tuple[int, int]]) -> list[tuple]:
    return [(int(doc.at[s]), int(doc.at[e])) for s, e in found]


@query(f"""WITH {oracles.texts(LONG)}, {oracles.sentences()} SELECT doc_id, CAST(strlen(left(t, s)) AS INTEGER) AS "start", CAST(strlen(left(t, s + length(u))) AS INTEGER) AS "stop", u AS sentence FROM sent JOIN d USING (doc_id)""")
def sentence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_text(long(spark, sf_dir), lambda d: [(int(d.at[s]), int(d.at[e]), d.text[s:e]) for s, e in d.sentences], "start int, stop int, sentence string")


@query(f"""WITH {oracles.texts(LONG)}, {oracles.sentences()},
{oracles.paragraphs()}, p AS (SELECT doc_id, k, s, unnest(range(0, length(u), 97)) + s AS place FROM para)
SELECT p.doc_id, CAST(place AS INTEGER) AS place, CAST(coalesce(sent.s, -1) AS INTEGER) AS sentence, CAST(p.s AS INTEGER) AS paragraph FROM p LEFT JOIN sent ON p.doc_id = sent.doc_id AND place >= sent.s AND place < sent.s + length(sent.u)""")
def unit_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence and the paragraph over every 97th place of a paragraph."""
    def look(d: Doc) -> Iterable[tuple]:
        for s, e in d.paragraphs:
            for k in range(s, e, 97):
                yield k, (d.sentence_at(k) or (-1,))[0], d.paragraph_at(k)[0]

    return kernels.per_text(long(spark, sf_dir), look, "place int, sentence int, paragraph int")


@query(f"""WITH {oracles.texts(SHORT)}, {oracles.pieces('line', 'd', 't', chr(10), blank=True)}
SELECT doc_id, CAST(strlen(left(t, s)) AS INTEGER) AS "start", CAST(strlen(left(t, s + length(key))) AS INTEGER) AS "stop" FROM (
SELECT *, regexp_extract(u, '^((?:[^"'':]|:+[^ \\t\\r:"'']|:+"[^"]*"|:+''[^'']*''|"[^"]*"|''[^'']*'')*?:+)(?:[ \\t\\r]|$)', 1) AS key FROM line) JOIN d USING (doc_id) WHERE key <> ''""")
def exclusions_yaml_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_text(short(spark, sf_dir), lambda d: _bytes(d, exclusions.yaml_keys(d.text)), "start int, stop int")


_SUPPRESSED = rf"""WITH {oracles.texts(SHORT)}, {oracles.pieces('line', 'd', 't', chr(10), blank=True)},
m AS (SELECT line.*, length(t) AS size, regexp_matches(u, '<!-- {exclusions.TAG}:(?:ignore|disable)-block -->') AS o, regexp_matches(u, '<!-- {exclusions.TAG}:end-(?:ignore|disable) -->') AS e, regexp_matches(u, '<!-- {exclusions.TAG}:(?:ignore|disable)-next-line -->') AS nx, regexp_matches(u, '// {exclusions.TAG}:(?:ignore|disable)') AS h FROM line JOIN d USING (doc_id) WHERE contains(t, '{exclusions.TAG}:')),
q AS (SELECT *, max(CASE WHEN o THEN k END) OVER w AS last_o, max(CASE WHEN e THEN k END) OVER w AS last_e FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(last_o > coalesce(last_e, 0), FALSE) AS inside FROM q), n AS (SELECT *, lag(nx AND NOT inside AND NOT o) OVER (PARTITION BY doc_id ORDER BY k) AS told FROM b)
SELECT doc_id, k FROM n WHERE inside OR o OR told OR h"""


@query(_SUPPRESSED)
def suppressed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a suppression comment switches off."""
    def lines(d: Doc) -> Iterable[tuple]:
        off = Doc(d.text, scan.merged(exclusions.suppressions(d.text)))
        return [(k,) for k, (s, e) in enumerate(d.lines, 1) if off.inside(s, max(e, s + 1)) or (s == e and off.hidden(max(0, s - 1), s + 1) and off.inside(s, s))]

    return kernels.per_text(short(spark, sf_dir), lines, "k long")


for _kind, _source in (("plain", short), ("markdown", long), ("yaml", short)):
    query(None, f"exclusions_{_kind}")(lambda spark, sf_dir, kind=_kind, source=_source: scan.excluded_ranges(source(spark, sf_dir), kind))
query(None, "heading_spans")(lambda spark, sf_dir: kernels.per_text(long(spark, sf_dir), lambda d: _bytes(d, exclusions.headings(d.text)), "start int, stop int"))
query(None, "table_cells")(lambda spark, sf_dir: kernels.per_text(short(spark, sf_dir), lambda d: [(r, c, int(d.at[s]), int(d.at[e])) for r, c, s, e in exclusions.table_cells(d.text)], "row int, cell int, start int, stop int"))
query(None, "semantic_chunks")(lambda spark, sf_dir: kernels.per_text(long(spark, sf_dir), lambda d: [(k, d.text[slice(*chunk(d.text, k, k + 2))]) for k in d.places("系統")], "place int, chunk string"))


def _converted_sql() -> str:
    q = conversion.SEED.found.pattern
    pairs = ", ".join(f"'{s}': '{t}'" for s, t in conversion.SEED.phrases.items())
    first = [(chr(a), b) for a, b in conversion.SEED.characters.items()]
    usual = [(chr(a), b) for a, b in conversion.SEED.variants.items()]
    gap = f"translate(translate(g[i], '{''.join(a for a, _ in first)}', '{''.join(b for _, b in first)}'), '{''.join(a for a, _ in usual)}', '{''.join(b for _, b in usual)}')"
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: {gap} || coalesce(map_extract(MAP {{{pairs}}}, h[i])[1], '')), '') AS converted
FROM (SELECT doc_id, regexp_extract_all(t, '{q}') AS h, string_split_regex(t, '{q}') AS g FROM ({SHORT}))"""


query(_converted_sql(), "simplified_to_traditional")(lambda spark, sf_dir: kernels.per_text(short(spark, sf_dir), lambda d: [(conversion.to_traditional(d.text),)], "converted string"))
query(f"SELECT doc_id, nfc_normalize(t) AS normal FROM ({SHORT})", "nfc_text")(lambda spark, sf_dir: kernels.per_text(short(spark, sf_dir), lambda d: [(conversion.nfc(d.text)[0],)], "normal string"))


@query()
def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Segmenter(ALL)
    return kernels.per_text(short(spark, sf_dir), lambda d: words.segment(d.text), "offset int, word string, known boolean")


def _scan(docs: DataFrame, profile: str, content_type: str | Column = "plain") -> DataFrame:
    return scan.scan(docs, profile, content_type=content_type).select("doc_id", "offset", "length", "line", "col", "code", "issue_type", "severity", "found", F.array_join("suggestions", "|").alias("suggestions"), "rule_id", "row", "cell")


for _profile in scan.PROFILES:
    query(None, f"scan_{_profile}")(lambda spark, sf_dir, p=_profile: _scan(short(spark, sf_dir), p))
query(None, "scan_markdown")(lambda spark, sf_dir: _scan(long(spark, sf_dir), "ai", "markdown"))


@query()
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, flags and coverage of every document, from one pass."""
    s = scan.scanned(long(spark, sf_dir), "ai")
    return s.select("doc_id", "chars", "script", "rules_checked", "rules_matched", *(F.round(c, 6).alias(c) for c in ("ai", "translationese", "consistency", "oral_density")), *(F.array_join(c, ",").alias(c) for c in ("ai_signals", "translationese_signals", "quality_flags")))


@query()
def gate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the whole scan: counts come from a document's own row, without a join (K2, K4)."""
    return report.gate(scan.counted(scan.scanned(short(spark, sf_dir))), 0, 1)


for _mode in fixes.MODES[1:]:
    query(None, f"fix_{_mode}")(lambda spark, sf_dir, m=_mode: scan.fixed(short(spark, sf_dir), m).select("doc_id", "fixed_text", "n_edits", "n_issues"))


@query()
def convert_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.converge(short(spark, sf_dir))


@query()
def residual_after_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues left after a fix, by document, without those that only touch what the fix wrote."""
    f = scan.fixed(short(spark, sf_dir))
    again = scan.exploded(scan.scanned(f.select("doc_id", F.col("fixed_text").alias("text"))))
    return report.severity_counts(report.residual(again, f), f)


@query(f"""WITH i AS ({detectors.oracle(detectors.BY_CODE['p1_comma'], SHORT)})
SELECT doc_id, to_json({{'ruleId': issue_type, 'level': CASE severity WHEN 'info' THEN 'note' ELSE severity END, 'message': {{'text': found}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': 'doc-' || doc_id}}, 'region': {{'byteOffset': "offset", 'byteLength': length}}}}}}]}}) AS line FROM i""")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = short(spark, sf_dir).withColumn("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return report.as_sarif(detectors.issues(d, (detectors.BY_CODE["p1_comma"],)), d)


@query(f"""WITH i AS ({detectors.oracle(detectors.BY_CODE['p1_comma'], SHORT)})
SELECT doc_id, to_json({{'offset': "offset", 'length': length, 'found': found, 'issue_type': issue_type, 'severity': severity, 'suggestion': suggestion}}) AS line FROM i""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(detectors.issues(short(spark, sf_dir), (detectors.BY_CODE["p1_comma"],)))





_ONE = "len(dst) = 1 AND dst[1] <> ''"


@query(f"""{_FOUND} SELECT doc_id, found, CASE WHEN severity = 'error' THEN 'high' WHEN {_ONE} AND len(clues) = 0 THEN 'high' WHEN len(dst) > 1 THEN 'low' ELSE 'medium' END AS confidence,
{_ONE} AND len(clues) = 0 AS auto_fix_safe, len(dst) <> 1 OR len(clues) > 0 AS needs_review FROM i""")
def explain_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.explained(_spelling(spark, sf_dir)).select("doc_id", "found", "confidence", F.coalesce("auto_fix_safe", F.lit(False)).alias("auto_fix_safe"), "needs_review")


@query(f"""{_FOUND}, w AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['computer', 'memory'] WHEN 1 THEN ['thread', 'software'] END AS words FROM documents)
SELECT doc_id, found, CASE WHEN english IS NULL OR words IS NULL THEN 'unknown' WHEN len(list_intersect(string_split(lower(english), ' '), words)) > 0 THEN 'yes' ELSE 'no' END AS anchor_match FROM i LEFT JOIN w USING (doc_id)""")
def anchor_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings against the words of a translation that is handed in (null where there is none)."""
    words = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("computer"), F.lit("memory"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("thread"), F.lit("software")))
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("words"))
    return annotate.anchored(_spelling(spark, sf_dir), given).select("doc_id", "found", F.when(F.isnull("anchor_match"), "unknown").when(F.col("anchor_match"), "yes").otherwise("no").alias("anchor_match"))


@query(f"""{_FOUND}, j AS (SELECT doc_id, found, dst, severity, doc_id % 4 AS k FROM i)
SELECT doc_id, found, CASE WHEN k = 0 THEN 'llm' WHEN k = 1 THEN 'deterministic' WHEN k = 2 THEN 'unresolved' ELSE 'heuristic' END AS tier,
CASE WHEN k = 0 AND found <> '進程' AND found <> '內存' THEN 'info' ELSE severity END AS severity, CASE WHEN k = 0 AND found = '進程' THEN '處理程序,行程,進度' ELSE array_to_string(dst, ',') END AS suggestions FROM j""")
def judgement_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray terms meet a table of judgements; the tier says what settled each."""
    i = _typed(spark, sf_dir).withColumn("context_key", (F.col("doc_id") % 4).cast("string"))
    made = spark.createDataFrame([("內存", "0", "記憶體", 0.9), ("進程", "0", "處理程序", 0.9), *((t, "0", None, 0.9) for t in sorted({r.from_ for r in RULES} - {"內存", "進程"}))], "found string, context_key string, chosen string, confidence double")
    i = annotate.judged(i, made).withColumn("tier2_outcome", F.when(F.col("context_key") == "2", "gray").when(F.col("context_key") == "3", "resolved"))
    return i.select("doc_id", "found", annotate.resolution_tier().alias("tier"), "severity", F.array_join("suggestions", ",").alias("suggestions"))


@query(f"{_FOUND} SELECT (SELECT count(*) FROM i) AS issues, (SELECT count(*) FROM documents) AS docs, round((SELECT count(*) FROM i) * 1000.0 / (SELECT sum(length(t)) FROM ({SHORT})), 6) AS per_1k, round((SELECT count(*) FILTER (WHERE severity <> 'info') * 1.0 / nullif(count(*), 0) FROM i), 6) AS graver_share")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = report.telemetry(_spelling(spark, sf_dir), short(spark, sf_dir))
    return t.select("issues", "docs", F.round("per_1k", 6).alias("per_1k"), F.round("graver_share", 6).alias("graver_share"))


@query(f"""{_FOUND}, f AS (SELECT DISTINCT doc_id, found FROM i), g AS (SELECT doc_id, found FROM f WHERE doc_id % 3 <> 0), cl AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g))
SELECT round((SELECT count(*) FROM g) / (SELECT count(*) FROM f), 6) AS "precision", round((SELECT count(*) FROM g) / nullif((SELECT count(*) FROM g), 0), 6) AS recall, round((SELECT count(*) FROM cl WHERE doc_id IN (SELECT doc_id FROM f)) / (SELECT count(*) FROM cl), 6) AS false_positive_rate""")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _spelling(spark, sf_dir)
    m = report.corpus_metrics(i, i.where("doc_id % 3 <> 0"), short(spark, sf_dir))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"{_FOUND} SELECT doc_id, CASE WHEN count_if(severity <> 'info') > 99 THEN '99+' ELSE CAST(count_if(severity <> 'info') AS VARCHAR) END AS badge FROM i GROUP BY 1")
def badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.badge(_spelling(spark, sf_dir))


@query(f"SELECT src AS term, CASE WHEN len(dst) = 0 THEN '' WHEN dst[1] = '' THEN '(delete)' WHEN len(dst) = 1 THEN dst[1] ELSE dst[1] || '+' || CAST(len(dst) - 1 AS VARCHAR) END AS compact, array_to_string(CASE WHEN len(dst) = 1 AND dst[1] = '' THEN dst WHEN len(list_filter(dst, lambda x: x <> '')) > 0 THEN list_filter(dst, lambda x: x <> '') WHEN english IS NOT NULL THEN [english] ELSE CAST([] AS VARCHAR[]) END, '|') AS effective FROM {_ALL_RULES}")
def suggestion_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dictionary.rule_table(spark)
    return r.select(F.col("from").alias("term"), chars.compact_suggestion(F.col("to")).alias("compact"), F.array_join(chars.effective_suggestions(F.col("to"), F.col("english")), "|").alias("effective"))


@query(rf"SELECT doc_id, 'v1:' || substr(b, CAST(greatest(floor((length(b) - 80) / 2), 0) AS INTEGER) + 1, 80) AS cache_key, replace(replace(replace(replace(t, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS tsv FROM (SELECT doc_id, t, regexp_replace(t, '\s+', '', 'g') AS b FROM ({SHORT}))")
def context_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(spark, sf_dir).select("doc_id", chars.cache_context(F.col("text")).alias("cache_key"), chars.escape_tsv(F.col("text")).alias("tsv"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of results does not hold: an anti join on the content key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("content_key", chars.identity(F.col("o_orderkey")))
    return annotate.to_scan(o, o.where("o_orderkey % 3 = 0")).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 10 = 0")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove and upsert rows of a store by key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    left = annotate.remove(c, c.where("c_custkey % 7 = 0"), "c_custkey")
    return annotate.upsert(left, c.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("changed")), "c_custkey")


@query("SELECT user_id, CASE WHEN count(*) >= 9 AND avg(value) >= 1 THEN round(stddev_pop(value) / avg(value), 6) END AS cv FROM events GROUP BY 1")
def coefficient_of_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation over mean of a list, as distances between marks are judged."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.round(scores.variation_of("value"), 6).alias("cv"))


@query()
def heading_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of markdown, those in headings a step graver."""
    return scan.scan(long(spark, sf_dir), content_type="markdown").select("doc_id", "offset", "severity", "found", "code")


@query()
def style_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest issues of each axis of style."""
    return report.top_per_axis(scan.scan(long(spark, sf_dir), "ai")).select("doc_id", "axis", "rank", "severity", "line", "code", "found")


@query(f"{_FOUND} SELECT count(*) AS n, CAST(count_if(severity = 'error') AS BIGINT) AS n_error, CAST(count_if(severity = 'warning') AS BIGINT) AS n_warning, CAST(count_if(severity = 'info') AS BIGINT) AS n_info, count(DISTINCT doc_id) AS docs, count(DISTINCT found) AS terms FROM i")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_spelling(spark, sf_dir))


@query(f"{_FOUND} SELECT doc_id, CAST(count(DISTINCT found) AS BIGINT) AS rules_matched FROM (SELECT doc_id, CASE WHEN found LIKE '%，，' OR found LIKE '%，：' THEN left(found, length(found) - 1) ELSE found END AS found FROM i) GROUP BY 1")
def rules_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rules behind a document's issues (O3)."""
    return resolve.matched_rules(_spelling(spark, sf_dir))


@query(f"SELECT src AS \"from\", to_json({{'from': src, 'to': dst, 'english': english}}) AS entry FROM {_ALL_RULES} WHERE english IS NOT NULL AND NOT disabled")
def ambiguous_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ambiguous_dictionary(dictionary.rule_table(spark))


@query(f"{_FOUND}, {_tier2_sql()}, k AS (SELECT CASE WHEN o.outcome IS NULL THEN 'deterministic' WHEN outcome = 'gray' THEN 'unresolved' ELSE 'heuristic' END AS tier FROM i LEFT JOIN (SELECT doc_id, \"offset\", outcome FROM t3) o ON i.doc_id = o.doc_id AND i.\"offset\" = o.\"offset\") SELECT count(*) AS n, CAST(count_if(tier = 'deterministic') AS BIGINT) AS n_deterministic, CAST(count_if(tier = 'heuristic') AS BIGINT) AS n_heuristic, CAST(count_if(tier = 'llm') AS BIGINT) AS n_llm, CAST(count_if(tier = 'unresolved') AS BIGINT) AS n_unresolved, round(count_if(tier IN ('deterministic', 'heuristic')) * 100.0 / count(*), 6) AS avoided_percent FROM k")
def tier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by what settled them, and how many needed no judgement (K3, K9)."""
    i = annotate.tier2_apply(_spelling(spark, sf_dir)).withColumn("llm_judged", F.lit(False))
    t = report.tier_metrics(i.withColumn("tier", annotate.resolution_tier()))
    return t.withColumn("avoided_percent", F.round("avoided_percent", 6))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of a cache within its time to live (O32); a top-k, which is the feature."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", F.unix_date(F.col("o_orderdate").cast("date")).alias("created_at"))
    return annotate.fresh(o, 20_000, 20_000, 500, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'pong' AS answer FROM documents")
def rpc_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-RPC lines in, answers out."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("doc_id").cast("string").alias("id"), F.lit("ping").alias("method"))).alias("line"))
    got = rpc.answers(lines)
    return got.select(F.get_json_object("line", "$.id").alias("id"), F.when(F.get_json_object("line", "$.result") == "{}", "pong").alias("answer"))


@query()
def rpc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call for every document: its scan as the answer."""
    d = short(spark, sf_dir)
    call = F.struct(F.lit("lint").alias("name"), F.struct(F.col("text")).alias("arguments"))
    return rpc.answers(d.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("doc_id").cast("string").alias("id"), F.lit("tools/call").alias("method"), call.alias("params"))).alias("line")))


for _gate, _keep in (("strict", lambda r: True), ("international", lambda r: r.type != "variant" and not (r.type == "political_coloring" and r.from_ in INTERNATIONAL_ONLY)), ("neutral", lambda r: r.type not in ("variant", "political_coloring")), ("plain", lambda r: r.type not in ("variant", "ai_filler", "translationese"))):
    _gates = {"strict": {"variants": True}, "plain": {"fillers": False, "translationese": False}}.get(_gate, {"stance": _gate})
    _kept_rules = [r for r in ALL if _keep(r)]

    @query(dictionary.spelling_oracle(SHORT, _kept_rules, ALL, _gate == "strict"), f"dictionary_{_gate}")
    def _gated(spark: SparkSession, sf_dir: str, gates: dict = _gates) -> DataFrame:
        """The dictionary behind a profile's gates (M4a-M4c): variants on, a stance, or without fillers and translated style."""
        i = dictionary.spelling_issues(short(spark, sf_dir), ALL, **gates)
        return i.select("doc_id", "rule_type", "severity", "offset", "length", "found", F.array_join("suggestions", ",").alias("suggestions"), "english")


_GATES = {"base": "type <> 'variant'", "strict": "TRUE", "plain": "type NOT IN ('variant', 'ai_filler', 'translationese')"}


@query(" UNION ALL ".join(f"SELECT '{g}' AS profile, count(*) AS rules_checked FROM {_ALL_RULES} WHERE {w}" for g, w in _GATES.items()))
def rules_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules a profile tries."""
    table = dictionary.layered(dictionary.rule_table(spark, ALL))
    gates = {"base": {}, "strict": {"variants": True}, "plain": {"fillers": False, "translationese": False}}
    parts = [dictionary.compiled(table, **g).agg(F.count("*").alias("rules_checked")).select(F.lit(n).alias("profile"), "rules_checked") for n, g in gates.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT src AS term, CASE WHEN type = 'translationese' THEN list_filter(dst, lambda x: x <> '')[1] END AS rewrite, coalesce(regexp_extract(context, '@domain\\s+([^。\\s]+)', 1), '') AS domain FROM {dictionary.values_sql([*ALL, *quality.FAULTY])}")
def rule_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite a rule suggests (F18) and its domain tag."""
    r = quality.annotated(spark)
    domain = F.coalesce(F.regexp_extract("context", r"@domain\s+([^。\s]+)", 1), F.lit(""))
    return r.select(F.col("from").alias("term"), chars.suggested_rewrite(F.col("type"), F.col("to")).alias("rewrite"), domain.alias("domain"))


@query(f"""{_FOUND}, b AS (SELECT DISTINCT rule_type, found FROM i WHERE doc_id % 2 = 0) SELECT rule_type, found FROM b UNION SELECT rule_type, found FROM i WHERE rule_type = 'typo'""")
def baseline_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline and the issues that are added to it, each once."""
    i = _typed(spark, sf_dir).withColumn("path", F.lit("all"))
    old = i.where("doc_id % 2 = 0").select(annotate.fingerprint().alias("fingerprint")).distinct()
    new = annotate.baseline_update(i.where("rule_type = 'typo'"), old)
    return i.withColumn("fingerprint", annotate.fingerprint()).join(new, "fingerprint", "left_semi").select("rule_type", "found").distinct()


@query(f"""{_FOUND}, w AS (SELECT DISTINCT doc_id, w FROM i WHERE english IS NOT NULL)
SELECT doc_id, w AS "window", CAST(floor(coalesce(sum(strlen(w)) OVER (PARTITION BY doc_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 64) AS BIGINT) AS payload FROM w""")
def translation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a translator would be asked, in payloads of 64 bytes."""
    return annotate.translation_requests(_spelling(spark, sf_dir), 64)


@query(f"""{_FOUND}, {_tier2_sql()}, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE outcome WHEN 'gray' THEN 0 ELSE 1 END, "offset") AS turn FROM t3 WHERE outcome <> 'suppressed')
SELECT doc_id, found, "offset", turn FROM q WHERE turn <= 2""")
def judgement_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge would be asked, two terms a document."""
    i = annotate.tier2(_spelling(spark, sf_dir).where(annotate.eligible()))
    return annotate.judgement_requests(i, 2).select("doc_id", "found", "offset", F.col("turn").cast("long").alias("turn"))


_THREE = ("p1_comma", "p14_full_digit", "r5_light_verb", "t6_de")
_UNION = " UNION ALL ".join(f"SELECT * FROM ({detectors.oracle(detectors.BY_CODE[c], SHORT)})" for c in _THREE)
_RANK = "CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
_TYPE = "CASE issue_type WHEN 'punctuation' THEN 6 WHEN 'grammar' THEN 7 ELSE 10 END"


@query(f'SELECT doc_id, code, "offset", row_number() OVER (PARTITION BY doc_id ORDER BY "offset", {_RANK} DESC, {_TYPE}) AS place FROM ({_UNION})')
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by place, then the graver, then by type (O2)."""
    i = detectors.issues(short(spark, sf_dir), tuple(detectors.BY_CODE[c] for c in _THREE))
    return resolve.placed(i).select("doc_id", "code", "offset", F.col("place").cast("long").alias("place"))


@query(rf"""WITH i AS ({_COMMA}), d AS ({LONG}), h AS (SELECT i.doc_id, "offset", decode(encode(t)[1:"offset"]) AS head FROM i JOIN d USING (doc_id)),
l AS (SELECT doc_id, "offset", length(head) - length(replace(head, chr(10), '')) + 1 AS line, length(string_split(head, chr(10))[-1]) + 1 AS col FROM h)
SELECT doc_id, CASE WHEN count(*) > 1 AND count(DISTINCT col) = 1 THEN string_agg(CAST(line AS VARCHAR), ',' ORDER BY "offset") || ':' || min(col) ELSE string_agg(line || ':' || col, ',' ORDER BY "offset") END AS locations FROM l GROUP BY 1""")
def compact_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's places in short form."""
    i = report.located(long(spark, sf_dir), (detectors.BY_CODE["p1_comma"],))
    g = i.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "line", "col"))).alias("l"))
    return g.select("doc_id", chars.compressed_locations(F.col("l")).alias("locations"))


@query(f"""WITH {dictionary.found_sql(SHORT, RULES)}, i AS (SELECT doc_id, CAST(b AS INTEGER) AS s, CAST(strlen(f) AS INTEGER) AS n FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM i), ed AS (SELECT * FROM w WHERE k % 2 = 1), od AS (SELECT * FROM w WHERE k % 2 = 0)
SELECT od.doc_id, CAST(od.s + coalesce(sum(2 - ed.n), 0) AS INTEGER) AS "start" FROM od LEFT JOIN ed ON od.doc_id = ed.doc_id AND ed.s + ed.n <= od.s GROUP BY od.doc_id, od.s""")
def remapped_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges after edits beside them (X14): every other term is replaced by two bytes, the rest move."""
    made: dict[str, Spelling] = {}  # compiled in the worker

    def moved(d: Doc) -> list[tuple]:
        it = made.setdefault("it", Spelling(RULES)) if "it" not in made else made["it"]
        spots = [(int(d.at[s]), int(d.at[e])) for s, e in it.matches(d.text) if d.text[s:e] in it.rules]
        edits = [fixes.Edit(s, e - s, "xx") for s, e in spots[::2]]
        return [(s,) for s, _ in fixes.remapped_ranges(spots[1::2], edits)]

    return kernels.per_text(short(spark, sf_dir), moved, "start int")
