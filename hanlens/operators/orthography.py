"""Orthographic rules that carry a state along the text: quotes, lists, spaces, repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .doc import IDEOGRAPH, NEAR, Doc, Issue

# Reduplications that are words.
REDUPLICATIONS = frozenset((
    "媽媽", "爸爸", "哥哥", "姐姐", "弟弟", "妹妹", "爺爺", "奶奶", "叔叔", "伯伯", "姑姑", "舅舅", "嬸嬸", "婆婆", "公公", "太太", "謝謝", "哈哈", "嘿嘿", "呵呵", "嗯嗯", "喔喔",
    "常常", "慢慢", "漸漸", "快快", "好好", "早早", "偷偷", "悄悄", "剛剛", "僅僅", "淡淡", "默默", "靜靜", "輕輕", "深深", "滿滿", "多多", "少少", "大大", "小小", "明明", "真真",
    "最最", "乖乖", "看看", "想想", "試試", "聽聽", "說說", "走走", "談談", "問問", "查查", "算算", "猜猜", "找找", "玩玩", "等等", "改改", "講講", "聊聊", "碰碰", "摸摸", "拍拍",
    "拉拉", "推推", "搖搖", "動動", "跑跑", "跳跳", "唸唸", "寫寫", "畫畫", "讀讀", "學學", "做做", "用用", "吃吃", "星星", "點點", "毛毛", "某某", "一一", "往往", "處處", "步步",
    "層層", "年年", "天天", "人人", "家家", "個個", "條條", "種種", "件件", "樣樣", "沾沾", "一步一步", "欣欣", "彬彬", "娓娓", "津津", "歷歷", "源源", "嗷嗷", "洋洋", "碌碌",
    "赫赫", "蒸蒸", "岌岌", "喋喋", "耿耿", "落落", "諄諄", "鼎鼎", "惴惴", "孜孜", "矇矇",
))
_NARROW = re.compile("[一-鿿]+")
_TWICE = re.compile(r"(?<![A-Za-z0-9])([A-Za-z0-9]{3,})(?:[ \t]+|[ \t]*\r?\n[ \t]*)(\1)(?![A-Za-z0-9])", re.ASCII | re.IGNORECASE)
_BREAK = re.compile(r"\n\n|\r\n\r\n")
_MARKS = re.compile(r"([、-〃〈-】〔-〛！（），．：；？—…])\1+")
_JOINTS = re.compile(f"(?<=[{IDEOGRAPH}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{IDEOGRAPH}])")


def _mark(code: str, start: int, end: int, suggestion: str, severity: str = "warning") -> Issue:
    return Issue(code, "punctuation", severity, start, end, (suggestion,))


def ascii_quotes(doc: Doc) -> Iterator[Issue]:
    """Straight quotes near CJK, opening and closing in turn; a blank line starts anew."""
    text, odd = doc.text, False
    for m in re.finditer('"|\n\n', text) if '"' in text and NEAR.search(text) else ():
        if m[0] != '"':
            odd = False
        elif not doc.hidden(*m.span()):
            before, after = re.search(r"(\S)\s{0,3}$", text[max(0, m.start() - 4) : m.start()]), re.match(r"\s{0,3}(\S)", text[m.end() : m.end() + 4])
            if odd or (before and NEAR.match(before[1])) or (after and NEAR.match(after[1])):
                yield _mark("p6_ascii_quote", *m.span(), "」" if odd else "「")
                odd = not odd


def dunhao(doc: Doc) -> Iterator[Issue]:
    """Full-width commas that bound two or more short segments in a row."""
    commas = list(doc.places("，"))
    runs: list[list[int]] = [commas[:1]]
    for a, b in zip(commas, commas[1:], strict=False):
        if 1 <= len(doc.text[a + 1 : b].strip()) <= 4:
            runs[-1].append(b)
        else:
            runs.append([b])
    for run in runs:
        if len(run) >= 3:
            yield from (_mark("p7_dunhao", k, k + 1, "、", "info") for k in run)


def repeated_marks(doc: Doc) -> Iterator[Issue]:
    """Each repeat of a full-width mark; dashes and ellipses may stand twice."""
    for m in _MARKS.finditer(doc.text):
        for k in range(m.start() + (2 if m[1] in "—…" else 1), m.end()):
            if not doc.hidden(k, k + 1):
                yield _mark("p13_repeated_mark", k, k + 1, "")


def spacing(doc: Doc) -> Iterator[Issue]:
    """An empty span where a space belongs between CJK and Latin letters or digits."""
    for m in _JOINTS.finditer(doc.text):
        k = m.start()
        if not doc.hidden(k - 1, k + 1):
            yield _mark("p11_spacing", k, k, " ", "info")


def cjk_repetitions(doc: Doc) -> Iterator[Issue]:
    """A unit of 3, 2 or 1 characters said twice; words built so are left out."""
    text = doc.text
    for run in _NARROW.finditer(text):
        k = run.start()
        while k < run.end():
            for n in (3, 2, 1):
                unit = text[k : k + n]
                if k + 2 * n <= run.end() and text.startswith(unit, k + n) and unit * 2 not in REDUPLICATIONS:
                    if n == 1 and run.end() - run.start() > 2 and unit not in "的了是在和":
                        continue
                    if not doc.hidden(k, k + 2 * n):
                        yield Issue("p17_cjk_repetition", "repetition", "info", k, k + 2 * n, (unit,))
                    k += 2 * n - 1
                    break
            k += 1


def latin_repetitions(doc: Doc) -> Iterator[Issue]:
    """A Latin word of three letters or more said twice, in any case."""
    text, k = doc.text, 0
    while m := _TWICE.search(text, k):
        k = m.end()
        if text[k : k + 1].isalnum():  # a letter of another script goes on
            k = m.start(2)
        elif not doc.hidden(*m.span()):
            yield Issue("p18_latin_repetition", "repetition", "info", *m.span(), (m[1],))


def paired(doc: Doc, issues: list[Issue]) -> list[Issue]:
    """The suggestions of curly double quotes by their depth, or in turn where they do not nest; a blank line starts anew."""
    marks = [k for k, i in enumerate(issues) if i.end == i.start + 1 and doc.text[i.start] in "“”"]
    if len(marks) < 2:
        return issues
    marks.sort(key=lambda k: issues[k].start)
    signs = [doc.text[issues[k].start] for k in marks]
    fresh = [True, *(bool(_BREAK.search(doc.text, issues[a].end, issues[b].start)) for a, b in zip(marks, marks[1:], strict=False))]
    depth, nests = 0, len(set(signs)) > 1
    for c, new in zip(signs, fresh, strict=True):
        depth = (0 if new else depth) + (1 if c == "“" else -1)
        nests &= depth >= 0
    out, depth, turn = list(issues), 0, 0
    for k, c, new in zip(marks, signs, fresh, strict=True):
        depth, turn = (0, 0) if new else (depth, turn)
        if c == "“" if nests else turn % 2 == 0:
            sign, depth = "「『"[depth % 2], depth + 1
        else:
            depth = max(0, depth - 1)
            sign = "」』"[depth % 2]
        out[k] = issues[k]._replace(suggestions=(sign,))
        turn += 1
    return out


def quote_hierarchy(doc: Doc) -> Iterator[Issue]:
    """Unmatched, interleaved, top-level inner, and unclosed CJK quotes of each paragraph."""
    close = {"」": "「", "』": "『", "》": "《"}
    for s, e in doc.parts(_BREAK):
        stack: list[int] = []
        bad: list[int] = []
        for m in re.finditer("[「」『』《》]", doc.text[s:e]):
            k, c = s + m.start(), m[0]
            if doc.hidden(k, k + 1):
                continue
            if c in "「『《":
                if c == "『" and not stack:
                    bad.append(k)
                stack.append(k)
            elif stack and doc.text[stack[-1]] == close[c]:
                stack.pop()
            else:
                bad.append(k)
        yield from (_mark("p16_quote_hierarchy", k, k + 1, "") for k in sorted({*bad, *stack}))


#: Competing for spans; the two of quotes come after the competition.
RULES = (ascii_quotes, dunhao, spacing, repeated_marks, cjk_repetitions, latin_repetitions)
#: Those that can find something in a text without ideographs.
ANY_SCRIPT = (ascii_quotes, dunhao, repeated_marks, latin_repetitions)
