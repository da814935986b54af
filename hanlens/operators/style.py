"""Rules of style over sentences, paragraphs, clauses and lines, each a generator of issues with their spans.

They need the whole document (its length, its paragraphs, what is excluded), so
they run as a kernel, row by row.  ``m`` multiplies the thresholds of the rules
for machine-written text; ``domain`` chooses those for translated text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np

from .doc import CJK, Doc, Issue, Span

# Word lists and thresholds of the rules, in their order where the first one counts.
DENSITY = (
    ("更重要的是", 0.5), ("值得注意的是", 0.3), ("這意味著", 0.5), ("不容忽視", 0.2), ("深刻影響", 0.3),
    ("從某種意義上", 0.2), ("從某種程度上", 0.2), ("需要注意的是", 0.3), ("在某種程度上", 0.2), ("在這個過程中", 0.3),
)
SENSES = (
    ("表示", ("定義", "是指", "就是", "即", "所謂", "稱為", "指的是")),
    ("代表", ("因此", "所以", "結果", "導致", "造成", "如果", "一旦", "將會", "可能")),
    ("也就是說", ("換言之", "換句話說", "簡單來說", "簡言之", "具體來說")),
)
COPULAS = ("作為", "標誌著", "充當", "擁有", "設有")
TECHNICAL = ("系統", "程式", "函式", "API", "介面", "模組", "元件", "架構", "伺服器", "資料庫")
CONTRASTS = ((("雖然", "儘管", "即便", "即使"), ("但", "卻", "然而", "不過")), (("不僅", "不只", "不單"), ("更", "還", "也", "亦")))
ENDINGS = ("的基礎", "的基石", "的起點", "的關鍵", "的核心", "證明了", "揭示了", "展示了", "體現了", "正是這", "正是在", "這也正是")
HEADINGS = ("挑戰與未來展望", "結論與展望", "挑戰與機遇", "問題與挑戰", "優勢與劣勢", "現狀與未來", "回顧與展望", "總結與展望", "影響與意義", "發展與演變")
HEDGES = ("在某種程度上", "從某個角度來看", "可以說是", "相對而言")
ABSTRACT_LINES, GROWTH = ("一條線", "路線", "軸線", "脈絡", "橋"), ("走出來", "長出來", "鋪出來", "延伸", "串起來", "拓寬")
PASSIVES_ALLOWED = ("被定義為", "被廣泛採用", "被置於", "被稱作", "被觀察到", "被記錄為")
ABSTRACT_NOUNS, ABSTRACT_VERBS = ("的減少", "的增加", "的提高", "的下降", "的通過", "的實施"), ("導致", "標誌著", "意味著")
CONDITIONALS = ("如果", "假如", "若")
CONNECTIVES = (("因為", "所以", 40, True), ("雖然", "但是", 40, True), ("當", "的時候", 30, False), ("如果", "那麼", 40, False))
NOT_WHEN = "下時作初今年日前地局事中然面選權代"
FORMAL = ("敬啟者", "謹此", "茲就", "謹啟", "合約", "契約")
CHAIN_HEADS = (
    "實施", "分析", "講解", "理解", "認識", "發現", "提升", "下降", "改善", "評估", "探索", "建構", "推動",
    "落實", "形成", "確立", "發展", "建立", "促進", "強化", "深化", "整合", "統合", "落地", "規劃", "執行",
)
PAIR_HEADS = ("的實施", "的分析", "的講解", "的理解", "的認識", "的發現", "的提升", "的下降", "的改善")
PAIRS = ((("的實施", "的改善", "的提升", "的下降"), ("的提升", "的改善", "的下降")), (("的分析", "的講解", "的理解", "的認識"), ("的發現", "的理解", "的認識")))
FALSE_FRIENDS = ("實際上", "字面上", "基本上", "絕對地", "肯定地", "明顯地", "嚴肅地表示", "誠實地說")
SEEN_VERBS = ("看到", "看見", "遇到", "聽到", "找到", "收到", "發現", "認識", "帶著", "帶到", "帶來", "告訴", "看著", "碰到", "經過")


class Thresholds(NamedTuple):
    one_of: float
    chain: int
    modifier_chars: int
    modifier_de: int


DOMAINS = {"general": Thresholds(2.0, 3, 15, 2), "technical": Thresholds(3.0, 4, 18, 2), "literary": Thresholds(1.0, 3, 12, 2), "news": Thresholds(2.5, 3, 15, 2)}

_CLAUSE = re.compile("[，。；,\n]")
_STOP = re.compile("[。！？]")
_SENTENCE = re.compile("[。？！?!\n]")
_NUMBERED = re.compile(r"[0-9]+[.)](?=[ \t]|$)")
_HEAD = re.compile("|".join(sorted(CHAIN_HEADS, key=len, reverse=True)))


def _ai(code: str, span: Span, severity: str = "info", suggestions: tuple[str, ...] = ()) -> Issue:
    return Issue(code, "ai_style", severity, *span, suggestions)


def _trans(code: str, span: Span, severity: str = "info", suggestions: tuple[str, ...] = ()) -> Issue:
    return Issue(code, "translationese", severity, *span, suggestions)


# Machine-written text: words


def meaning(doc: Doc) -> Iterator[Issue]:
    """A1: 意味著, with the word that its sentence's clues ask for."""
    places = list(doc.places("意味著"))
    cuts = [-1, *(m.start() for m in _SENTENCE.finditer(doc.text)), len(doc.text)] if places else []
    for k in places:
        n = bisect_left(cuts, k)
        sentence = doc.text[cuts[n - 1] + 1 : cuts[n]]
        yield _ai("a1_meaning", (k, k + 3), "info", tuple(word for word, clues in SENSES if any(c in sentence for c in clues))[:1])


def copulas(doc: Doc) -> Iterator[Issue]:
    """A2: an inflated copula with a technical word within 80 bytes, begun characters included, and not inside a compound."""
    text = doc.text
    for word in COPULAS:
        for k in doc.places(word):
            if word == "作為" and text[max(0, k - 1) : k] in ("所", "大") or word == "擁有" and text[k + 2 : k + 3] in ("權", "者", "感", "量"):
                continue
            low = int(np.searchsorted(doc.at, doc.at[k] - 80, "right")) - 1
            high = int(np.searchsorted(doc.at, doc.at[k + len(word)] + 80))
            if any(t in text[max(0, low) : high] for t in TECHNICAL):
                yield _ai("a2_copula", (k, k + len(word)))


# Machine-written text: densities and structure


def densities(doc: Doc, m: float = 1.0) -> Iterator[Issue]:
    """A stock phrase too often in a thousand characters, at its first place."""
    if len(doc.text) < 500:
        return
    for phrase, most in DENSITY:
        places = list(doc.places(phrase))
        if places and len(places) * 1000 / len(doc.text) > most * m:
            yield _ai("a6_density", (places[0], places[0] + len(phrase)), "warning")


def _nothing(code: str, places: list[int]) -> Issue:
    return _ai(code, (places[0], places[0]))


def binary_contrast(doc: Doc, m: float = 1.0) -> Iterator[Issue]:
    """Sentences built on an opposition or on a gradation, over five in a thousand characters and three at least."""
    if len(doc.text) < 500:
        return
    hits = []
    for block in doc.blocks:
        for s, e in doc.parts(_STOP, *block):
            sentence = doc.text[s:e]
            for openers, turns in CONTRASTS:
                if opener := next((o for o in openers if o in sentence), None):
                    k = sentence.index(opener)
                    if any(t in sentence[k + len(opener) :] for t in turns):
                        hits.append(s + k)
    if len(hits) >= 3 and len(hits) * 1000 / len(doc.text) > 5 * m:
        yield _nothing("a7_binary_contrast", hits)


def paragraph_endings(doc: Doc) -> Iterator[Issue]:
    """Three paragraphs of five or more whose last 90 bytes hold a stock phrase."""
    hits = []
    for s, e in doc.blocks:
        tail = doc.text[s:e].strip()
        raw = tail.encode()
        cut = max(0, len(raw) - 90)
        while cut and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        if any(x in raw[cut:].decode() for x in ENDINGS):
            hits.append(s)
    if len(doc.blocks) >= 5 and len(hits) >= 3:
        yield _nothing("a8_paragraph_endings", hits)


def dashes(doc: Doc) -> Iterator[Issue]:
    """Three paragraphs with three dashes each."""
    hits = [s for s, e in doc.blocks if sum(1 for _ in doc.places("—", s, e)) >= 3]
    if len(hits) >= 3:
        yield _nothing("a9_dashes", hits)


def formulaic_headings(doc: Doc) -> Iterator[Issue]:
    """A10: two headings made of a stock phrase."""
    hits = [s for s, e in doc.lines if doc.text[s:e].strip().startswith("#") and not doc.inside(s, e) and any(h in doc.text[s:e] for h in HEADINGS)]
    if len(hits) >= 2:
        yield _nothing("a10_formulaic_headings", hits)


def _listed(line: str) -> bool:
    line = line.strip()
    return line.startswith(("- ", "* ")) or (len(line.encode()) > 2 and line[0] in "0123456789" and 0 <= line.encode().find(b". ") < 4)


def list_density(doc: Doc, m: float = 1.0) -> Iterator[Issue]:
    """Lists in over two fifths of five or more paragraphs, and in three."""
    hits = [s for s, e in doc.blocks if any(map(_listed, doc.text[s:e].split("\n")))]
    if len(doc.blocks) >= 5 and len(hits) >= 3 and len(hits) / len(doc.blocks) > 0.4 * m:
        yield _nothing("a11_list_density", hits)


def tricolons(doc: Doc) -> Iterator[Issue]:
    """Three ``、`` items in a row of one length, 1 to 8; one a sentence."""
    for s, e in doc.sentences:
        if "、" not in doc.text[s:e]:
            continue
        e = s + len(doc.text[s:e].rstrip("。！？；.!?"))
        items = list(doc.parts(re.compile("、"), s, e, blank=True))
        for (a, b), (c, d), (f, g) in zip(items, items[1:], items[2:], strict=False):
            if 0 < b - a == d - c == g - f <= 8:
                if not doc.hidden(a, g):
                    yield _ai("a13_tricolon", (a, g))
                break


def bullets(doc: Doc) -> Iterator[Issue]:
    """A list of three items or more that all open in bold, at its first marker."""
    run: list[tuple[int, bool]] = []
    for s, e in [*doc.lines, (len(doc.text), len(doc.text))]:
        line = doc.text[s:e].removesuffix("\r")
        body = line.lstrip()
        mark = _NUMBERED.match(body)
        if body.startswith(("- ", "* ")) or mark:
            content = body[mark.end() :].lstrip() if mark else body[2:]
            run.append((s + len(line) - len(body), content.startswith("**")))
            continue
        if len(run) >= 3 and all(bold for _, bold in run) and not doc.hidden(run[0][0], run[0][0] + 1):
            yield _ai("a16_bullets", (run[0][0], run[0][0] + 1))
        run = []


def bold(doc: Doc) -> Iterator[Issue]:
    """Two to four bold runs in a sentence; three, and three in 200 characters, in a paragraph."""
    def runs(span: Span) -> int:
        return sum(1 for _ in doc.places("**", *span)) // 2

    for s, e in doc.sentences:
        if 2 <= runs((s, e)) <= 4 and not doc.hidden(s, e):
            yield _ai("a17_bold_sentence", (s, min(s + 2, e)))
    for s, e in doc.paragraphs:
        if e - s >= 30 and runs((s, e)) >= max(3, math.ceil((e - s) * 3 / 200)) and not doc.hidden(s, s + 1):
            yield _ai("a17_bold_paragraph", (s, min(s + 2, e)))


def em_dashes(doc: Doc) -> Iterator[Issue]:
    """A paragraph with two dashes of two signs, at the first."""
    for p in doc.paragraphs:
        places = list(doc.places("——", *p))
        if len(places) >= 2:
            yield _ai("a18_em_dash", (places[0], places[0] + 2))


def hedged(doc: Doc, issues: list[Issue]) -> list[Issue]:
    """In a paragraph full of hedges the hedges that were found as info become warnings."""
    heavy = [(s, e) for s, e in doc.paragraphs if e - s >= 50 and sum(1 for h in HEDGES for _ in doc.places(h, s, e)) >= max(3, math.ceil((e - s) * 3 / 200))]

    def up(i: Issue) -> bool:
        return i.issue_type == "ai_style" and i.severity == "info" and any(h in doc.text[i.start : i.end] for h in HEDGES) and any(s <= i.start < e for s, e in heavy)

    return [i._replace(severity="warning") if up(i) else i for i in issues] if heavy else issues


def line_metaphor(doc: Doc) -> Iterator[Issue]:
    """An abstract line that is pointed back to twice and grows."""
    for s, e in doc.paragraphs:
        term = doc.first(ABSTRACT_LINES, s, e)
        back = sum(1 for x in ("這條線", "這條路") for _ in doc.places(x, s, e))
        if term and back >= 2 and doc.first(GROWTH, s, e):
            yield _ai("a22_line_metaphor", term)


def _parallel(sentence: str) -> bool:
    s = sentence.rstrip("。！？!?").strip()
    if not 8 <= len(s) <= 80:
        return False
    if "不是" in s and "而是" in s or "不只" in s and ("更是" in s or "也是" in s) or s.count("越") >= 2:
        return True
    mark = next((c for c in "；，," if c in s), None)
    left, right = map(len, s.split(mark, 1)) if mark else (0, 0)
    return left >= 3 and right >= 3 and abs(left - right) <= 8


def slogans(doc: Doc) -> Iterator[Issue]:
    """A parallel sentence that another paragraph repeats, once, at its first place."""
    seen: dict[str, tuple[int, int]] = {}
    told: set[str] = set()
    for n, p in enumerate(doc.paragraphs):
        for s, e in doc.sentences_in(p):
            sentence = doc.text[s:e]
            if doc.hidden(s, e) or not _parallel(sentence):
                continue
            k, para = seen.setdefault(sentence, (s, n))
            if para != n and sentence not in told:
                told.add(sentence)
                yield _ai("a23_slogan", (k, min(k + 8, len(doc.text))))


# Translated text


def passives(doc: Doc) -> Iterator[Issue]:
    """More than two 被 in 100 characters of a paragraph, and more than two; set terms do not count."""
    for s, e in doc.paragraphs:
        n = sum(not doc.text.startswith(PASSIVES_ALLOWED, k, e) for k in doc.places("被", s, e))
        if e - s >= 20 and n > max(2, math.ceil((e - s) * 2 / 100)):
            yield _trans("t1_passive", (s, min(s + 2, e)), "warning")


def _bytes_on(doc: Doc, start: int, end: int, most: int) -> int:
    """The end of at most ``most`` bytes of a span, a begun character included."""
    while end > start + 1 and doc.at[end - 1] - doc.at[start] >= most:
        end -= 1
    return end


def abstract_subjects(doc: Doc) -> Iterator[Issue]:
    """A sentence with an abstract noun in its first 20 characters and a verb of consequence."""
    for s, e in doc.sentences:
        if any(n in doc.text[s : min(e, s + 20)] for n in ABSTRACT_NOUNS) and any(v in doc.text[s:e] for v in ABSTRACT_VERBS) and not doc.hidden(s, _bytes_on(doc, s, min(e, s + 12), 12)):
            yield _trans("t2_abstract_subject", (s, e))


def late_conditions(doc: Doc) -> Iterator[Issue]:
    """A condition in the second half of a sentence of six characters or more; one a sentence."""
    for s, e in doc.sentences:
        middle = s + (e - s) // 2
        word = next((c for c in CONDITIONALS if doc.text.find(c, middle, e) >= 0), None)
        if e - s >= 6 and word:
            k = doc.text.find(word, middle, e)
            if not doc.hidden(k, k + len(word)):
                yield _trans("t3_late_condition_said" if "的話" in doc.text[k:e] else "t3_late_condition", (k, k + len(word)))


def pronoun_runs(doc: Doc) -> Iterator[Issue]:
    """T4: three or more sentences in a row of a paragraph that open with a pronoun."""
    for p in doc.paragraphs:
        run: list[int] = []
        for s, _ in [*doc.sentences_in(p), (len(doc.text), 0)]:
            if doc.text.startswith(("他", "她", "它"), s):
                run.append(s)
                continue
            if len(run) >= 3 and not doc.hidden(run[0], run[0] + 1):
                yield _trans("t4_pronoun_run", (run[0], run[0] + 1))
            run = []


def de_chains(doc: Doc) -> Iterator[Issue]:
    """A clause of a sentence with four 的."""
    for s, e in doc.sentences:
        if doc.text.count("的", s, e) >= 4:
            for clause in doc.parts(re.compile("[，,]"), s, e):
                if doc.text.count("的", *clause) >= 4 and not doc.hidden(*clause):
                    yield _trans("t7_de_chain", clause, "warning")


def tenses(doc: Doc) -> Iterator[Issue]:
    """A dated sentence with three marks of tense."""
    for s, e in doc.sentences:
        sentence = doc.text[s:e]
        if sum(map(sentence.count, "曾已過了")) >= 3 and re.search("[年月日0-9]", sentence) and not doc.hidden(s, _bytes_on(doc, s, min(e, s + 6), 6)):
            yield _trans("t9_tense", (s, e))


def one_of_density(doc: Doc, domain: str = "general") -> Iterator[Issue]:
    """之一 twice and too often in 200 characters of a paragraph of 100."""
    for s, e in doc.paragraphs:
        places = list(doc.places("之一", s, e)) if e - s >= 100 else []
        if len(places) >= 2 and len(places) * 200 / (e - s) >= DOMAINS[domain].one_of:
            yield _trans("t10_one_of_density", (places[0], places[0] + 2))


def _connectives(doc: Doc, start: int, end: int) -> Iterator[tuple[int, int, bool, str, str]]:
    for opener, closer, chars, drop_first in CONNECTIVES:
        k = doc.text.find(opener, start, end)
        while k >= 0:
            after = k + len(opener)
            at = -1 if opener == "當" and doc.text[after : min(after + 1, end)] in tuple(NOT_WHEN) else doc.text.find(closer, after, min(end, after + chars))
            stop = at + len(closer) if at >= 0 else after
            if at >= 0 and not doc.hidden(k, stop):
                yield k, stop, drop_first, opener, closer
            k = doc.text.find(opener, stop, end)


def connectives_by_sentence(doc: Doc) -> Iterator[Issue]:
    """Both halves of a connective in one sentence; the suggestion leaves one out."""
    for sentence in doc.sentences:
        for s, e, drop_first, opener, closer in _connectives(doc, *sentence):
            found = doc.text[s:e]
            yield _trans("t11_connective_pair", (s, e), "info", (found.removeprefix(opener) if drop_first else found.removesuffix(closer),))


def connectives(doc: Doc) -> Iterator[Issue]:
    """The same across sentences, unless the text opens like a letter or a contract."""
    if not any(f in doc.text[:100] for f in FORMAL):
        for s, e, *_ in _connectives(doc, 0, len(doc.text)):
            yield _trans("t15_connectives", (s, e))


def nominal_chains(doc: Doc, domain: str = "general") -> Iterator[Issue]:
    """Abstract heads joined by 的, in a sentence."""
    for s, e in doc.sentences:
        k = s
        while m := _HEAD.search(doc.text, k, e):
            n, stop = 1, m.end()
            while stop < e and doc.text[stop] == "的" and (more := _HEAD.match(doc.text, stop + 1, e)):
                n, stop = n + 1, more.end()
            if n >= DOMAINS[domain].chain and not doc.hidden(m.start(), stop):
                yield _trans("t12_nominal_chain", (m.start(), stop))
            k = stop if n >= DOMAINS[domain].chain else m.end()


def premodifiers(doc: Doc, domain: str = "general") -> Iterator[Issue]:
    """A long stretch without a comma that ends in 的 and a noun; the longest of those that start together."""
    limit = DOMAINS[domain]
    for sentence in doc.sentences:
        if doc.text.count("的", *sentence) < limit.modifier_de:
            continue
        for s, e in doc.parts(re.compile("[，、。；：,;:]"), *sentence, blank=True):
            if s == e or doc.text[s] in "我你他她它咱您":
                continue
            best, n = 0, 0
            for k in doc.places("的", s, e):
                n += 1
                stop = k + 1
                while stop < e and CJK.match(doc.text[stop]):
                    stop += 1
                inner = n + sum(1 for _ in doc.places("的", k + 1, stop))
                if stop > k + 1 and stop - s >= limit.modifier_chars and inner >= limit.modifier_de and not any(v in doc.text[s:k] for v in SEEN_VERBS) and not doc.hidden(s, stop):
                    best = max(best, stop)
            if best:
                yield _trans("t13_premodifier", (s, best), "warning")


def nominal_pairs(doc: Doc) -> Iterator[Issue]:
    """Two nominal heads of a clause that touch, or that pair up with nothing coordinating between; one a clause."""
    heads = re.compile("|".join(PAIR_HEADS))
    for clause in doc.parts(_CLAUSE):
        hits = list(heads.finditer(doc.text, *clause))
        for a, b in zip(hits, hits[1:], strict=False):
            gap = doc.text[a.end() : b.start()]
            if not gap or not re.search("[和與及並且或]", gap) and any(a[0] in left and b[0] in right for left, right in PAIRS):
                if not doc.hidden(a.start(), b.end()):
                    yield _trans("t16_nominal_pair", (a.start(), b.end()))
                break


def false_friends(doc: Doc) -> Iterator[Issue]:
    """A listed word whose clause holds another one, or that an English gloss follows."""
    hits = sorted((k, k + len(w)) for w in FALSE_FRIENDS for k in doc.places(w))
    if not hits:
        return
    cuts = [m.start() for m in _CLAUSE.finditer(doc.text)]
    clauses = [bisect_left(cuts, s) for s, _ in hits]
    for (s, e), clause in zip(hits, clauses, strict=True):
        gloss = re.compile(r"[ \t]{0,2}(\([^)]*[A-Za-z][^)]*\))").match(doc.text, e)
        if clauses.count(clause) > 1 or gloss and not doc.hidden(*gloss.span(1)):
            yield _trans("t17_false_friend", (s, e))


#: The rule that sees the sentences wins over its plain twin.
FAMILIES = {"t14_one_of_most": "t10_one_of_density", "t15_connectives": "t11_connective_pair", "t16_nominal_pair": "t12_nominal_chain"}


def without_twins(issues: list[Issue]) -> list[Issue]:
    """Drop an issue that overlaps one of the finer rule of its family."""
    finer: dict[str, list[Span]] = {}
    for i in issues:
        finer.setdefault(i.code, []).append((i.start, i.end))
    return [i for i in issues if not any(s < i.end and i.start < e for s, e in finer.get(FAMILIES.get(i.code, ""), ()))]


Rule = Callable[..., Iterable[Issue]]
AI_WORDS: tuple[Rule, ...] = (meaning, copulas)
AI_DENSITY: tuple[Rule, ...] = (densities, binary_contrast, list_density)
AI_STRUCTURE: tuple[Rule, ...] = (paragraph_endings, dashes, formulaic_headings, tricolons, bullets, bold, em_dashes, line_metaphor, slogans)
TRANSLATED: tuple[Rule, ...] = (passives, abstract_subjects, late_conditions, pronoun_runs, de_chains, tenses, connectives_by_sentence, connectives, nominal_pairs, false_friends)
BY_DOMAIN: tuple[Rule, ...] = (one_of_density, nominal_chains, premodifiers)
