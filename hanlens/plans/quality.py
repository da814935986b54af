"""Checks of a rule table, as queries over it (terms that fail, and the value that is wrong).

A check is one SQL text for Spark and for the oracle; only the spelling of array
functions differs.  ``FAULTY`` holds a rule for each fault, so that every check
finds something in the registered queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.conversion import SIMPLIFIED, TRADITIONAL
from ..operators.dictionary import rule_table, values_sql
from ..rules import Rule

TYPES = ("cross_strait", "political_coloring", "typo", "confusable", "variant", "ai_filler", "translationese")
OPERATORS = ("before", "after", "adjacent", "not_before", "not_after")
GEO, PERSON = ("country", "city", "landmark", "university"), ("politician", "celebrity", "scientist")
DOMAINS, TECHNICAL = ("IT", "生活", "交通", "金融", "醫學"), ("IT",)
STOCK_CLUES = ("程式", "系統", "軟體")
COUNTRY_NAMES, PROPER = ("台灣", "中國", "大陸"), ("中國時報", "台灣海峽")

FAULTY = tuple(Rule(1000 + k, *x) for k, x in enumerate((
    ("甲詞", ("乙詞",), "cross_strait", "alpha", (), (), (), (), False, "@domain IT。用法"),
    ("乙詞", ("丙詞",), "cross_strait", "beta", (), (), (), (), False, "@domain IT。(@seealso 甲詞, 沒有的詞)"),
    ("丙詞", ("甲詞",), "cross_strait", "gamma", (), (), (), (), False, "@domain 未知"),
    ("空詞", (), "cross_strait", None, (), (), (), (), False, None),
    ("填充", (), "ai_filler", "filler"), ("雙體", ("双体", "雙體字"), "variant"), ("一", ("壹",), "variant"), ("二", ("貳",), "variant"), ("一二", (), "cross_strait", "one two"),
    ("自指", ("自指", "別詞"), "confusable", "self"), ("錯型", ("對型",), "unknown_type", "type"), ("錯位", ("對位",), "typo", "place", (), (), (), ("beside:詞", "before:"), False, "x"),
    ("基礎詞", ("根基",), "cross_strait", "base", (), (), (), (), False, "@domain IT"), ("基礎詞組", ("根基",), "cross_strait", "base group", (), (), (), (), False, "@domain IT"),
    ("線索", ("提示",), "confusable", "clue", (), ("很長的線索詞語啊", "共有", ""), ("線索", "共有"), (), False, "x"),
    ("英城", ("英市",), "cross_strait", "city", (), (), (), (), False, "@geo city (E)。"), ("大英之城", ("英市",), "cross_strait", "city", (), (), (), (), False, "@geo city (E)。"),
    ("地名", ("地市",), "cross_strait", "place", (), (), (), (), False, "@geo planet (P)。"), ("人名", ("某君",), "cross_strait", "person", (), (), (), (), False, "@person hero (X)。"),
    ("限詞", ("限字",), "cross_strait", "limit", (), (), (), (), False, "@domain IT。限IT語境"), ("例外", ("意外",), "typo", "exception", ("不相干",), (), (), (), False, "x"),
    ("矛盾", ("衝突",), "typo", "clash", (), (), (), ("before:詞", "not_before:詞"), False, "x"), ("空 格", ("空白",), "cross_strait", "space"), ("空格", ("空白",), "cross_strait", "space"),
    ("鸚鵡", ("八哥",), "cross_strait", "parrot", (), (), (), (), False, "@domain 生活。cn用「鸚鵡」；tw用「八哥」"), ("问题", ("問題",), "cross_strait", "question", (), (), (), (), False, "@domain 生活"),
    ("公车", ("巴士",), "cross_strait", "bus", (), ("程式", "系統", "軟體"), (), (), False, "@domain 交通。大陸說法"), ("贅語", ("",), "ai_filler"), ("贅語，", ("",), "ai_filler"),
    ("可疑", ("什麼?",), "typo", "odd"), ("可疑二", ("這是一個非常長而且一定超過二十個字的建議值啊啊",), "typo", "long"),
)))


class _Spark:
    name = "spark"

    def any(self, array: str, var: str, test: str) -> str:
        return f"exists({array}, {var} -> {test})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def has(self, array: str, value: str) -> str:
        return f"array_contains({array}, {value})"

    def rx(self, text: str, pattern: str) -> str:
        return f"regexp({text}, r'{pattern}')"

    def extract(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    def filter(self, array: str, var: str, test: str) -> str:
        return f"filter({array}, {var} -> {test})"

    def join(self, array: str) -> str:
        return f"array_join({array}, '')"

    def rows(self, array: str) -> str:
        return f"explode({array})"

    def first(self, array: str) -> str:
        return f"get({array}, 0)"

    def chars(self, text: str) -> str:
        return f"split({text}, '')"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def strings(self, values: Iterable[str]) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    def each(self, array: str, var: str, value: str) -> str:
        return f"transform({array}, {var} -> {value})"

    def part(self, text: str, sep: str, k: int) -> str:
        return f"split_part({text}, '{sep}', {k})"


class _Duck(_Spark):
    name = "duck"

    def any(self, array: str, var: str, test: str) -> str:
        return f"len(list_filter({array}, lambda {var}: {test})) > 0"

    def size(self, array: str) -> str:
        return f"len({array})"

    def has(self, array: str, value: str) -> str:
        return f"list_contains({array}, {value})"

    def rx(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def extract(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    def filter(self, array: str, var: str, test: str) -> str:
        return f"list_filter({array}, lambda {var}: {test})"

    def join(self, array: str) -> str:
        return f"array_to_string({array}, '')"

    def rows(self, array: str) -> str:
        return f"unnest({array})"

    def first(self, array: str) -> str:
        return f"{array}[1]"

    def chars(self, text: str) -> str:
        return f"string_split({text}, '')"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def strings(self, values: Iterable[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def each(self, array: str, var: str, value: str) -> str:
        return f"list_transform({array}, lambda {var}: {value})"


def _sql(d: _Spark) -> dict[str, str]:
    """Every check over ``r(rule_id, src, dst, type, english, exceptions, clues, negative, places, disabled, context)``, live rules only."""
    some = d.filter("dst", "x", "x <> ''")
    listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
    one = lambda where, detail="''", src="src": f"SELECT {src} AS term, {detail} AS detail FROM r WHERE {where}"
    live = f"s AS (SELECT *, {some} AS made, coalesce(context, '') AS ctx FROM r)"
    tagged = d.extract("ctx", r"^@domain\s+([^。\s]+)\s*(?:。|$)", 1)
    masked = "ctx"
    for x in PROPER:
        masked = f"replace({masked}, '{x}', '_')"
    named = " OR ".join(f"(contains({masked}, '{x}') AND NOT contains(src || {d.join('dst')}, '{x}'))" for x in COUNTRY_NAMES)
    changed = f"translate(src, '{SIMPLIFIED}', '{TRADITIONAL}')"
    clues = f"concat({d.strings(())} , clues, negative)" if d.name == "spark" else "list_concat(clues, negative)"
    clues = "concat(clues, negative)" if d.name == "spark" else clues
    parrot = r"cn\s*用「([^」]*)」[；;]\s*tw\s*用「([^」]*)」"
    near = f"length(translate(a.src, b.src, '')) <= 2 AND length(a.src) = length(b.src)"
    return {
        "q01_cycles": """WITH RECURSIVE e AS (SELECT a.src AS a, b.src AS b FROM r a, r b WHERE a.src <> b.src AND {has}),
w(origin, here, steps) AS (SELECT a, b, 1 FROM e UNION ALL SELECT w.origin, e.b, w.steps + 1 FROM w JOIN e ON w.here = e.a WHERE w.steps < 8 AND w.here <> w.origin)
SELECT DISTINCT origin AS term, '' AS detail FROM w WHERE origin = here""".format(has=d.has("a.dst", "b.src")),
        "q02_empty": one(f"({d.size('dst')} = 0 AND type <> 'ai_filler' AND english IS NULL) OR (type = 'ai_filler' AND {d.size('dst')} = 0 AND english IS NOT NULL)"),
        "q03_variant_targets": f"WITH {live} SELECT src AS term, CAST({d.size('made')} AS VARCHAR(9)) AS detail FROM s WHERE type = 'variant' AND {d.size('made')} <> 1",
        "q04_orphans": f"""WITH {live}, x AS (SELECT src, {d.rows("split(" + d.extract("ctx", r"\(@seealso\s+([^)]+)\)", 1) + ", ',')" if d.name == 'spark' else "string_split(" + d.extract("ctx", r"\(@seealso\s+([^)]+)\)", 1) + ", ',')")} AS ref FROM s WHERE contains(ctx, '(@seealso '))
SELECT src AS term, trim(ref) AS detail FROM x WHERE trim(ref) NOT IN (SELECT src FROM r)""",
        "q05_decomposed": f"""WITH {live}, c AS (SELECT src, {d.first('made')} AS best FROM s WHERE length(src) = 1 AND {d.size('made')} > 0), x AS (SELECT src, length(src) AS n, {d.rows(d.chars('src'))} AS ch FROM s WHERE length(src) >= 2 AND {d.size('made')} = 0)
SELECT x.src AS term, '' AS detail FROM x JOIN c ON x.ch = c.src GROUP BY x.src, x.n HAVING count(*) = x.n""",
        "q06_chained": f"WITH {live} SELECT a.src AS term, b.src AS detail FROM s a JOIN s b ON a.src <> b.src AND {d.has('a.made', 'b.src')} WHERE {d.size('b.clues')} = 0 AND {d.size('b.negative')} = 0 AND {d.size('b.made')} > 0",
        "q07_schema": one(f"type NOT IN {listed(TYPES)} OR {d.any('places', 'x', 'NOT ' + d.rx('x', '^(' + '|'.join(OPERATORS) + '):.+'))}", "type"),
        "q08_suffix": f"""WITH {live}, f AS (SELECT *, {d.first('made')} AS best FROM s WHERE {d.size('made')} > 0) SELECT a.src AS term, b.src AS detail FROM f a JOIN f b ON length(b.src) < length(a.src) AND left(a.src, length(b.src)) = b.src
WHERE length(a.src) >= 3 AND a.best = b.best AND right(b.best, length(a.src) - length(b.src)) <> substr(a.src, length(b.src) + 1) AND NOT {d.has('b.exceptions', 'a.src')}""",
        "q09_clues": one(f"{d.any(clues, 'x', chr(39) + chr(39) + ' = trim(x)')} OR {d.size(d.intersect('clues', 'negative'))} > 0 OR {d.has('negative', 'src')}"),
        "q10_self": one(d.has("dst", "src")),
        "q11_annotation": f"""WITH {live} SELECT src AS term, left(ctx, 12) AS detail FROM s WHERE type = 'cross_strait' AND NOT (
{d.rx('ctx', r'^@geo\s+(' + '|'.join(GEO) + r')\s*(\([^)]*\))?\s*(。|$)')} OR {d.rx('ctx', r'^@person\s+(' + '|'.join(PERSON) + r')\s*(\([^)]*\))?\s*(。|$)')} OR {d.rx('ctx', r'^@domain\s+(' + '|'.join(DOMAINS) + r')\s*(。|$)')}
OR (NOT {d.rx('ctx', '^@(geo|person|domain)')} AND (contains(ctx, '(@seealso ') OR {d.rx('ctx', '^compound:')})))""",
        "q11_duplicate_geo": f"WITH {live}, g AS (SELECT src, {d.first('made')} AS best FROM s WHERE left(ctx, 4) = '@geo' AND {d.size('made')} > 0) SELECT a.src AS term, b.src AS detail FROM g a JOIN g b ON a.best = b.best AND a.src < b.src WHERE NOT ({near})",
        "q12_redundant": f"WITH {live} SELECT src AS term, {tagged} AS detail FROM s WHERE {tagged} <> '' AND contains(ctx, '限' || {tagged} || '語境')",
        "q13_ungated": f"WITH {live} SELECT src AS term, '' AS detail FROM s WHERE {d.rx('ctx', '限[^。]+語境')} AND {d.size('clues')} = 0 AND {d.size('negative')} = 0 AND {d.size('exceptions')} = 0",
        "q14_long_clues": one(d.any(clues, "x", "length(x) > 6")),
        "q15_no_english": one("type NOT IN ('variant', 'ai_filler', 'political_coloring', 'translationese') AND english IS NULL"),
        "q16_no_context": one("type NOT IN ('variant', 'ai_filler', 'political_coloring', 'translationese') AND context IS NULL"),
        "q17_filler_mark": f"SELECT a.src AS term, b.src AS detail FROM r a JOIN r b ON a.src = b.src || '，' OR a.src = b.src || '：' WHERE a.type = 'ai_filler' AND b.type = 'ai_filler' AND {d.size('b.dst')} = 1 AND {d.first('b.dst')} = ''",
        "q18_clue_overlap": one(d.any("negative", "n", "n <> '' AND " + d.any("clues", "p", "contains(p, n)"))),
        "q19_exceptions": one(d.any("exceptions", "x", "NOT contains(x, src)")),
        "q20_places": one(" OR ".join(d.any("places", "x", f"{d.part('x', ':', 1)} = '{op}' AND {d.has('places', chr(39) + 'not_' + chr(39) + ' || x')}") for op in ("before", "after"))),
        "q21_spaces": "SELECT min(src) AS term, max(src) AS detail FROM r GROUP BY replace(src, ' ', '') HAVING count(*) > 1",
        "q22_parrots": f"WITH {live} SELECT src AS term, '' AS detail FROM s WHERE {d.size('dst')} > 0 AND {d.extract('ctx', parrot, 1)} = src AND {d.extract('ctx', parrot, 2)} = {d.first('dst')}",
        "q23_simplified": one(f"type NOT IN ('variant', 'ai_filler') AND {changed} <> src", f"CASE WHEN {d.size('dst')} > 0 AND {changed} = {d.first('dst')} THEN 'characters only' ELSE 'in the term' END"),
        "q24_stock_clues": f"WITH {live} SELECT src AS term, {tagged} AS detail FROM s WHERE clues = {d.strings(STOCK_CLUES)} AND {tagged} NOT IN {listed(TECHNICAL)}",
        "q25_country_names": f"WITH {live} SELECT src AS term, '' AS detail FROM s WHERE left(ctx, 4) <> '@geo' AND ({named})",
        "q26_suspicious": one(f"{d.any('dst', 'x', '(x = ' + chr(39) * 2 + ' AND type <> ' + chr(39) + 'ai_filler' + chr(39) + ') OR contains(x, ' + chr(39) + '?' + chr(39) + ') OR length(x) > 20')}"),
    }


_NAMES = ("rule_id", "src", "dst", "type", "english", "exceptions", "clues", "negative", "places", "disabled", "context")


def checks(rules: Iterable[Rule]) -> dict[str, tuple[Callable[[DataFrame], DataFrame], str]]:
    """Every check as a function of a rule table, and as SQL over ``rules`` and ``FAULTY``."""
    given = values_sql([*rules, *FAULTY])
    duck = {n: q for n, q in _sql(_Duck()).items()}

    def run(q: str) -> Callable[[DataFrame], DataFrame]:
        def check(table: DataFrame) -> DataFrame:
            r = table.where("NOT disabled").select("rule_id", "from", "to", "type", "english", "exceptions", "clues", "negative", "positional", "disabled", "context").toDF(*_NAMES)
            r.createOrReplaceTempView("r")
            return table.sparkSession.sql(q)

        return check

    def oracle(q: str) -> str:
        view = f"r AS (SELECT * FROM {given} WHERE NOT disabled)"
        return q.replace("WITH RECURSIVE ", f"WITH RECURSIVE {view}, ", 1) if q.startswith("WITH RECURSIVE") else q.replace("WITH ", f"WITH {view}, ", 1) if q.startswith("WITH ") else f"WITH {view} {q}"

    return {n: (run(q), oracle(duck[n])) for n, q in _sql(_Spark()).items()}


def annotated(spark: SparkSession) -> DataFrame:
    """The seed and the faulty rules as one table."""
    from ..rules import parse

    return rule_table(spark, [*parse(), *FAULTY])
