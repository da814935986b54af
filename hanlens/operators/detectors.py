"""Span detectors as data: one Java pattern each, run by ``spans.matches``.

``check`` states the same rule a second way for the SQL oracle, which has no
look-around: a plain core pattern and a condition on what stands before
(``pre``) and after (``post``) a hit ``f``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import CONTEXT as C
from ..functions.chars import FULL_PUNCTUATION as FP
from ..functions.chars import IDEOGRAPH as I
from ..functions.spans import matches_sql

Z = r"[。？！?!\n]"
N = r"[^。？！?!\n]"

# Word lists of the rules.
VERB_SUFFIXES = "了過著來去完好到"
PRONOUNS = ("我", "你", "他", "她", "它", "我們", "你們", "他們", "她們", "這", "那", "這個", "那個")
ADJECTIVES = (
    "漂亮", "高興", "開心", "難過", "傷心", "生氣", "快樂", "緊張", "害怕", "著急", "無聊", "好看",
    "難看", "厲害", "聰明", "笨", "冷", "熱", "忙", "累", "餓", "渴", "胖", "瘦", "大", "小", "多",
    "少", "長", "短", "高", "矮", "好", "壞", "新", "舊", "快", "慢", "早", "晚", "遠", "近", "深",
    "淺", "重", "輕", "難", "容易",
)
#: May follow a bare adjective; any other ideograph makes it modify a noun.
ADJECTIVE_TAILS = "的了啊呀呢吧嗎又且並但而"
A_NOT_A = (
    "是不是", "有沒有", "能不能", "會不會", "要不要", "好不好", "對不對", "行不行", "可不可以", "願不願意",
    "想不想", "知不知道", "喜不喜歡", "認不認識", "做不做", "吃不吃", "去不去", "來不來", "看不看", "走不走",
)
REDUNDANT_PREPOSITIONS = (("強調", "在"), ("討論", "關於"), ("研究", "關於"), ("影響", "到"), ("考慮", "到"), ("處理", "到"), ("分析", "關於"))
NOMINALISED = (
    "討論", "分析", "研究", "調查", "測試", "開發", "設計", "評估", "檢查", "審查", "修改", "更新", "比較",
    "溝通", "合作", "訓練", "處理", "管理", "規劃", "改善", "調整", "整合", "驗證", "觀察", "監控", "維護",
)
ACTION_OBJECTS = ("決定", "回應", "貢獻", "改變", "調整", "承諾", "解釋", "判斷", "選擇", "反應", "讓步", "保證", "回答", "犧牲", "努力")
FRONTED_VERBS = (
    "討論", "分析", "研究", "調查", "測試", "開發", "設計", "評估", "檢查", "審查", "修改", "更新", "比較", "處理", "管理",
    "規劃", "改善", "調整", "整合", "驗證", "觀察", "監控", "維護", "計算", "編輯", "翻譯", "優化", "部署", "配置", "重構",
)
PAIRS_DE = (
    ("仔細的看", "仔細地看"), ("認真的聽", "認真地聽"), ("慢慢的走", "慢慢地走"), ("靜靜的坐", "靜靜地坐"), ("快速的跑", "快速地跑"),
    ("努力的工作", "努力地工作"), ("安靜的離開", "安靜地離開"), ("輕輕的放", "輕輕地放"), ("默默的承受", "默默地承受"), ("悄悄的走", "悄悄地走"),
)
ADVERBS_DE = ("慢慢地", "靜靜地", "認真地", "安靜地", "輕輕地", "默默地", "悄悄地", "漸漸地", "緩緩地", "偷偷地")
ENDINGS = ("展望未來", "拭目以待", "值得期待", "我們有理由相信", "具有重要意義", "具有重要戰略意義")
ENDING_PAIRS = (("奠定", "理論基礎"), ("提供", "重要框架"), ("發揮", "關鍵作用"), ("印證", "重要性"))
PERSON_NOUNS = ("畫家", "學者", "作家", "工程師", "程式設計師", "設計師", "研究員", "運動員", "球員", "演員", "歌手", "作者", "記者", "教授", "醫師", "醫生")
TWO_LETTER_ACRONYMS = ("AI", "IO", "OS", "IP", "UI", "VM", "GC", "PC", "DB", "PR", "RD", "QA", "ML", "FE", "BE")


def alt(words) -> str:
    return "(?:" + "|".join(words) + ")"


def led(words) -> str:
    """A look at the first character, which settles most places of a text."""
    return "(?=[" + "".join(sorted({w[0] for w in words})) + "])"


class Detector(NamedTuple):
    code: str
    issue_type: str
    severity: str
    pattern: str
    #: SQL over ``f`` (the found text), the same in both dialects; '' deletes, NULL advises only.
    suggestion: str = "NULL"
    group: int = 0
    check: tuple[str, str] | None = None
    #: A text without any of these has no hit; looked for before the pattern is.
    needs: tuple[str, ...] = ()


def _case(pairs) -> str:
    return "CASE " + " ".join(f"WHEN f = '{a}' THEN '{b}'" for a, b in pairs) + " END"


#: White space as Unicode has it.
W = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BEFORE, AFTER = rf"(?<=[{C}][{W}]{{0,30}})", rf"(?=[{W}]*[{C}])"
SQL_BEFORE, SQL_AFTER = rf"regexp_matches(pre, '[{C}][{W}]{{0,30}}$')", rf"regexp_matches(post, '^[{W}]*[{C}]')"


def _near(sign: str) -> tuple[str, str]:
    """(Java, SQL) for CJK context on either side, whitespace skipped; the sign itself is looked for first."""
    return rf"(?={sign})(?:{BEFORE}{sign}|{sign}{AFTER})", rf"({SQL_BEFORE} OR {SQL_AFTER})"


def _punctuation() -> list[Detector]:
    made = []
    java, sql = _near(",")
    made.append(Detector("p1_comma", "punctuation", "warning", rf"{java}(?!(?<=[0-9],)[0-9])", "'，'", 0, (",", f"{sql} AND NOT (regexp_matches(pre, '[0-9]$') AND regexp_matches(post, '^[0-9]'))")))
    made.append(Detector("p2_period", "punctuation", "warning", rf"(?=\.)(?<![.]){BEFORE}\.(?![.A-Za-z0-9])", "'。'", 0, (r"\.", rf"NOT regexp_matches(pre, '\.$') AND {SQL_BEFORE} AND NOT regexp_matches(post, '^[.A-Za-z0-9]')")))
    for code, sign, full in (("p3_exclamation", "!", "！"), ("p3_question", r"\?", "？"), ("p3_semicolon", ";", "；")):
        java, sql = _near(sign)
        exempt = r"(?!!\[)" if sign == "!" else ""
        made.append(Detector(code, "punctuation", "warning", exempt + java, f"'{full}'", 0, (sign, sql + (r" AND NOT regexp_matches(post, '^\[')" if exempt else ""))))
    made.append(Detector("p4_parenthesis", "punctuation", "warning", rf"(?=[()])(?<=[{C}])[()](?=[{C}])", "CASE WHEN f = '(' THEN '（' ELSE '）' END", 0, ("[()]", f"regexp_matches(pre, '[{C}]$') AND regexp_matches(post, '^[{C}]')")))
    java, sql = _near(":")
    made.append(Detector("p5_colon", "punctuation", "warning", rf"(?=:)(?!(?<=[0-9]):[0-9])(?!://)(?<!\])(?!(?<![^\n]): ){java}", "'：'", 0, (":", rf"{sql} AND NOT (regexp_matches(pre, '[0-9]$') AND regexp_matches(post, '^[0-9]')) AND NOT regexp_matches(post, '^//') AND NOT regexp_matches(pre, '\]$') AND NOT ((pre = '' OR regexp_matches(pre, '\n$')) AND regexp_matches(post, '^ '))")))
    quotes = rf"(?=[“”])(?:(?<=[{C}]\s{{0,3}})[“”]|[“”](?=\s{{0,3}}[{C}]))"
    made.append(Detector("p8_double_curly", "punctuation", "warning", quotes, "CASE WHEN f = '“' THEN '「' ELSE '」' END", 0, ("[“”]", rf"(regexp_matches(pre, '[{C}]\s{{0,3}}$') OR regexp_matches(post, '^\s{{0,3}}[{C}]'))")))
    single = rf"(?=[‘’])(?<![A-Za-z])(?:(?<=[{C}]\s{{0,3}})[‘’]|[‘’](?=\s{{0,3}}[{C}]))(?![A-Za-z])"
    made.append(Detector("p8_single_curly", "punctuation", "warning", single, "CASE WHEN f = '‘' THEN '『' ELSE '』' END", 0, ("[‘’]", rf"(regexp_matches(pre, '[{C}]\s{{0,3}}$') OR regexp_matches(post, '^\s{{0,3}}[{C}]')) AND NOT regexp_matches(pre, '[A-Za-z]$') AND NOT regexp_matches(post, '^[A-Za-z]')")))
    made.append(Detector("p9_range_tilde", "punctuation", "info", rf"(?=~)(?:{BEFORE}|(?<=[0-9]))~{AFTER}", "'～'", 0, ("~", rf"({SQL_BEFORE} OR regexp_matches(pre, '[0-9]$')) AND {SQL_AFTER}")))
    line_start = r"(?<![\n\r][ \t]{0,30})(?<!^[ \t]{0,30})"
    made.append(Detector("p9_range_hyphen", "punctuation", "info", rf"(?=-)(?<!-){line_start}{BEFORE}-(?!-){AFTER}", "'～'", 0, ("-", rf"NOT regexp_matches(pre, '-$') AND NOT regexp_matches(post, '^-') AND NOT regexp_matches(pre, '(^|[\n\r])[ \t]*$') AND {SQL_BEFORE} AND {SQL_AFTER}")))
    formula, comment = rf"(?<!=[{W}]{{0,30}})", rf"(?<!(?:^|[\n\r])[{W}]{{0,30}}(?://|/\*)[^\n\r]{{0,200}})"
    dots = rf"(?=\.\.\.)(?<!\.){formula}{comment}(?:{BEFORE}\.{{3,}}|\.{{3,}}{AFTER})(?!\.)(?!(?<=\.{{5}}) *[0-9])"
    made.append(Detector("p10_ascii_dots", "punctuation", "warning", dots, "'……'", 0, (r"\.{3,}", rf"({SQL_BEFORE} OR {SQL_AFTER}) AND NOT regexp_matches(pre, '=[{W}]*$') AND NOT regexp_matches(pre, '(^|[\n\r])[{W}]*(//|/\*)[^\n\r]*$') AND NOT (length(f) >= 5 AND regexp_matches(post, '^ *[0-9]'))")))
    made.append(Detector("p10_full_stops", "punctuation", "warning", "。{3,}", "'……'"))
    one = rf"(?=…)(?<!…)(?:{BEFORE}…|…{AFTER})(?!…)"
    made.append(Detector("p10_single_ellipsis", "punctuation", "info", one, "'……'", 0, ("…", rf"({SQL_BEFORE} OR {SQL_AFTER}) AND NOT regexp_matches(pre, '…$') AND NOT regexp_matches(post, '^…')")))
    made.append(Detector("p12_space_before", "punctuation", "info", rf"(?= )(?= +[{FP}])(?<=[{I}A-Za-z0-9]) +", "''", 0, (" +", f"regexp_matches(pre, '[{I}A-Za-z0-9]$') AND regexp_matches(post, '^[{FP}]')")))
    made.append(Detector("p12_space_after", "punctuation", "info", rf"(?= )(?<=[{FP}]) +(?=[{I}A-Za-z0-9])", "''", 0, (" +", f"regexp_matches(pre, '[{FP}]$') AND regexp_matches(post, '^[{I}A-Za-z0-9]')")))
    made.append(Detector("p14_full_digit", "punctuation", "warning", "[０-９]", "translate(f, '０１２３４５６７８９', '0123456789')"))
    return made


def _style() -> list[Detector]:
    p, adj = alt(sorted(PRONOUNS, key=len, reverse=True)), alt(sorted(ADJECTIVES, key=len, reverse=True))
    fronted = rf"(?=對)(?<![針面絕相反比核校應配])對(?!於)[^，。；,\n進對]{{1,6}}進行[^，。；,\n]{{0,2}}?{alt(FRONTED_VERBS)}"
    attribution = r"根據[^，。；,\n\[\]]+?(?:顯示(?!器)|指出|表明|表示(?!式)|說明(?!書))"
    return [
        Detector("r1_a_not_a_ma", "grammar", "warning", rf"{led(A_NOT_A)}({alt(A_NOT_A)}{N}*嗎)\s*(?:{Z}|$)", "CASE " + " ".join(f"WHEN f LIKE '{w}%' THEN '{w}'" for w in A_NOT_A) + " END", 1, (rf"({alt(A_NOT_A)}{N}*嗎)\s*(?:{Z}|$)", "TRUE")),
        Detector("r2_and_clauses", "grammar", "info", rf"(?=和)(?<=[{VERB_SUFFIXES}])和(?={p})(?!.{{0,10}}(?:一樣|一般|相同|類似|相似))", "'，'", 0, ("和", rf"regexp_matches(pre, '[{VERB_SUFFIXES}]$') AND regexp_matches(post, '^{p}') AND NOT regexp_matches(post, '^.{{0,10}}(?:一樣|一般|相同|類似|相似)')")),
        Detector("r3_bare_adjective", "grammar", "info", rf"{led(PRONOUNS)}{p}是{adj}(?:(?=[{ADJECTIVE_TAILS}])|(?![{I}]))", "replace(f, '是', '很')", 0, (rf"{p}是{adj}", f"(NOT regexp_matches(post, '^[{I}]') OR regexp_matches(post, '^[{ADJECTIVE_TAILS}]'))")),
        Detector("r4_redundant_preposition", "grammar", "info", led(v for v, _ in REDUNDANT_PREPOSITIONS) + alt(rf"{v}[^，。；,\n]{{0,2}}?{q}" for v, q in REDUNDANT_PREPOSITIONS), "substr(f, 1, 2)", 0, ("|".join(rf"{v}[^，。；,\n]{{0,2}}?{q}" for v, q in REDUNDANT_PREPOSITIONS), "TRUE")),
        Detector("r5_light_verb", "grammar", "info", rf"(?:進行|加以|予以)[^，。；,\n]{{0,2}}?{alt(NOMINALISED)}", "right(f, 2)"),
        Detector("r6_light_action", "grammar", "info", rf"(?:做出|作出)[^，。；,\n]?{alt(ACTION_OBJECTS)}", "right(f, 2)"),
        Detector("r7_fronted_object", "grammar", "info", fronted, "right(f, 2) || split_part(substr(f, 2), '進行', 1)", 0, (rf"對[^，。；,\n進對]{{1,6}}進行[^，。；,\n]{{0,2}}?{alt(FRONTED_VERBS)}", "NOT regexp_matches(pre, '[針面絕相反比核校應配]$') AND NOT regexp_matches(f, '^對於')")),
        Detector("r8_attribution", "grammar", "info", attribution, "substr(f, 1, length(f) - 2)", 0, (r"根據[^，。；,\n\[\]]+?(?:顯示|指出|表明|表示|說明)", "NOT (f LIKE '%顯示' AND post LIKE '器%') AND NOT (f LIKE '%表示' AND post LIKE '式%') AND NOT (f LIKE '%說明' AND post LIKE '書%')")),
        Detector("a3_passive", "ai_style", "info", "被廣泛(?:使用|採用|應用)", "substr(f, 2)"),
        Detector("a4_didactic", "ai_style", "info", rf"的(?:故事|案例|經驗|教訓|歷史){N}{{0,8}}?(?:告訴|提醒|啟示)(?:我們|後人|世人)"),
        Detector("a5_exaggeration", "ai_style", "info", rf"(?:領先|超前|超越){N}{{0,12}}?(?:時代|業界|同期){N}{{0,6}}?[0-9]+{N}{{0,4}}?年"),
        Detector("a12_zero_width", "ai_style", "info", r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{200E}\x{200F}]", "''"),
        Detector("a14_negative_parallel", "ai_style", "info", rf"(?:不僅僅是|不只是|不僅是){N}{{0,30}}?(?:而是|更是)"),
        Detector("a15_stock_ending", "ai_style", "info", alt(sorted(ENDINGS, key=len, reverse=True)) + "|" + "|".join(rf"{a}{N}{{0,20}}?{b}" for a, b in ENDING_PAIRS) + rf"|隨著{N}{{0,40}}?不斷發展"),
        Detector("a19_challenge", "ai_style", "info", rf"儘管{N}{{0,40}}?挑戰{N}{{0,40}}?(?:仍然|持續|蓬勃發展|繼續){N}*"),
        Detector("a20_from_to", "ai_style", "info", rf"從{N}{{1,20}}?到{N}{{1,20}}?再到{N}{{3,}}"),
        Detector("t5_copula_classifier", "translationese", "info", rf"(是一(?:個|名|位)){N}*?的", "'是'", 1),
        Detector("t6_de", "translationese", "warning", led(a for a, _ in PAIRS_DE) + alt(a for a, _ in PAIRS_DE), _case(PAIRS_DE), 0, (alt(a for a, _ in PAIRS_DE), "TRUE")),
        Detector("t8_redundant_de", "translationese", "info", led(ADVERBS_DE) + alt(ADVERBS_DE), "substr(f, 1, 2)", 0, (alt(ADVERBS_DE), "TRUE")),
        Detector("t14_one_of_most", "translationese", "info", rf"(?:最|極為)[^之。？！?!\n]{{1,20}}?(?<!{alt(PERSON_NOUNS)})之一", "NULL", 0, (r"(?:最|極為)[^之。？！?!\n]{1,20}?之一", f"NOT regexp_matches(f, '{alt(PERSON_NOUNS)}之一$')")),
        Detector("p19_spaced_acronym", "repetition", "info", rf"(?=[A-Z] [A-Z])(?<![A-Za-z])(?:(?:[A-Z] ){{2,}}[A-Z]|{'|'.join(' '.join(a) for a in TWO_LETTER_ACRONYMS)})(?![A-Za-z]| [A-Z](?![A-Za-z]))", "replace(f, ' ', '')", 0, (r"(?:[A-Z] )+[A-Z]", "NOT regexp_matches(pre, '[A-Za-z]$') AND NOT regexp_matches(post, '^[A-Za-z]') AND (length(f) >= 5 OR replace(f, ' ', '') IN (" + ", ".join(f"'{a}'" for a in TWO_LETTER_ACRONYMS) + "))")),
    ]


#: What a pattern cannot match without.
_NEEDS = {
    "p1_comma": (",",), "p2_period": (".",), "p3_exclamation": ("!",), "p3_question": ("?",), "p3_semicolon": (";",), "p4_parenthesis": ("(", ")"), "p5_colon": (":",), "p8_double_curly": ("“", "”"),
    "p8_single_curly": ("‘", "’"), "p9_range_tilde": ("~",), "p9_range_hyphen": ("-",), "p10_ascii_dots": ("...",), "p10_full_stops": ("。。。",), "p10_single_ellipsis": ("…",),
    "r1_a_not_a_ma": ("嗎",), "r2_and_clauses": ("和",), "r3_bare_adjective": ("是",), "r4_redundant_preposition": tuple(v for v, _ in REDUNDANT_PREPOSITIONS), "r5_light_verb": ("進行", "加以", "予以"),
    "r6_light_action": ("做出", "作出"), "r7_fronted_object": ("進行",), "r8_attribution": ("根據",), "a3_passive": ("被廣泛",), "a4_didactic": ("告訴", "提醒", "啟示"), "a5_exaggeration": ("領先", "超前", "超越"),
    "a14_negative_parallel": ("不只是", "不僅是", "不僅僅是"), "a15_stock_ending": (*ENDINGS, *(a for a, _ in ENDING_PAIRS), "隨著"), "a19_challenge": ("儘管",), "a20_from_to": ("再到",),
    "t5_copula_classifier": ("是一",), "t6_de": tuple(a for a, _ in PAIRS_DE), "t8_redundant_de": ADVERBS_DE, "t14_one_of_most": ("之一",),
}
DETECTORS: tuple[Detector, ...] = tuple(d._replace(needs=_NEEDS.get(d.code, ())) for d in (*_punctuation(), *_style()))
BY_CODE = {d.code: d for d in DETECTORS}


def found(text: str, detector: Detector) -> str:
    """SQL of one detector's spans in the SQL expression ``text``."""
    return matches_sql(text, detector.pattern, detector.group, detector.needs)


def hits(text: str, detectors: tuple[Detector, ...]) -> str:
    """SQL of ``array<struct<code, offset, length, f>>`` of several detectors; ``code`` is a detector's number among them."""
    each = (f"transform({found(text, d)}, s -> named_struct('code', {k}, 'offset', s.start, 'length', s.length, 'f', s.found))" for k, d in enumerate(detectors))
    return f"flatten(array({', '.join(each)}))"


def suggested(column: str, detectors: tuple[Detector, ...]) -> str:
    """SQL of ``array<struct<code, offset, length, suggestion>>`` from a column of ``hits``."""
    cases = " ".join(f"WHEN {k} THEN ({d.suggestion})" for k, d in enumerate(detectors))
    suggestion = re.sub(r"\bf\b", "s.f", f"CASE s.code {cases} END")
    return f"transform({column}, s -> named_struct('code', s.code, 'offset', s.offset, 'length', s.length, 'suggestion', cast({suggestion} AS string)))"


def issues(docs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """(doc_id, code, issue_type, severity, offset, length, found, suggestion), one row an issue; no shuffle."""
    rows = docs.select("doc_id", F.explode(F.expr(hits("text", detectors))).alias("i")).select("doc_id", "i.*")

    def by_code(value: str) -> Column:
        return F.expr("CASE code " + " ".join(f"WHEN {k} THEN {value.format(d=d)}" for k, d in enumerate(detectors)) + " END")

    rows = rows.withColumns({"issue_type": by_code("'{d.issue_type}'"), "severity": by_code("'{d.severity}'"), "suggestion": by_code("({d.suggestion})").cast("string"), "code": by_code("'{d.code}'")})
    return rows.select("doc_id", "code", "issue_type", "severity", "offset", "length", F.col("f").alias("found"), "suggestion")


#: Characters that an oracle's conditions see on both sides of a hit.
SQL_CONTEXT = 240


def hits_sql(corpus: str, core: str, group: int = 0) -> str:
    """CTEs ``c``, ``e`` and ``x``: every hit ``f`` of a pattern with its character offset ``p``, byte offset ``b``, and its sides."""
    q = core.replace("'", "''")
    found = f"regexp_extract(w, '{q}', {group})" if group else "w"
    return rf"""
c AS (SELECT doc_id, t, regexp_extract_all(t, '{q}') AS h, string_split_regex(t, '{q}') AS g FROM (SELECT doc_id, coalesce(t, '') AS t FROM ({corpus}) y) WHERE regexp_matches(t, '{q}')),
u AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS w, unnest(g[1:len(h)]) AS gap FROM c),
o AS (SELECT doc_id, i, w, sum(length(gap) + length(w)) OVER q - length(w) AS p, sum(strlen(gap) + strlen(w)) OVER q - strlen(w) AS b FROM u WINDOW q AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
x AS (SELECT o.doc_id, {found} AS f, CAST(p AS BIGINT) AS p, CAST(b AS BIGINT) AS b, substr(t, CAST(greatest(p - {SQL_CONTEXT}, 0) AS BIGINT) + 1, CAST(least(p, {SQL_CONTEXT}) AS BIGINT)) AS pre, substr(t, CAST(p + length(w) AS BIGINT) + 1, {SQL_CONTEXT}) AS post FROM o JOIN c USING (doc_id))"""


def oracle(detector: Detector, corpus: str) -> str:
    """SQL for one detector's issues over ``SELECT doc_id, text``."""
    core, where = detector.check or (detector.pattern, "TRUE")
    return rf"""
WITH {hits_sql(corpus, core, detector.group)}
SELECT doc_id, '{detector.code}' AS code, '{detector.issue_type}' AS issue_type, '{detector.severity}' AS severity, CAST(b AS INTEGER) AS "offset", CAST(strlen(f) AS INTEGER) AS length, f AS found, CAST({detector.suggestion} AS VARCHAR) AS suggestion
FROM x WHERE {where}
"""
