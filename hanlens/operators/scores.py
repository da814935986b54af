"""Scores of one document, from its text, its issues and what is excluded."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import NARROW
from .doc import Doc, Issue

# Phrase, threshold per 1000 characters, weight.
AI_SIGNALS = (
    ("更重要的是", 0.5, 1.0), ("值得注意的是", 0.3, 1.0), ("這意味著", 0.5, 0.8), ("不容忽視", 0.2, 0.7), ("深刻影響", 0.3, 0.8),
    ("從某種意義上", 0.2, 0.6), ("從某種程度上", 0.2, 0.6), ("需要注意的是", 0.3, 0.8), ("在某種程度上", 0.2, 0.6), ("在這個過程中", 0.3, 0.7),
)
ORAL = (
    "嗯", "啊", "呢", "吧", "哦", "喔", "欸", "哎", "唉", "嘛", "齁", "蛤", "咧", "啦", "耶", "哇", "呀", "喂",
    "就是", "其實", "然後", "所以說", "基本上", "對不對", "就是說", "怎麼說", "那個", "這個",
)
WEAK_VERBS = ("進行", "加以", "予以", "展開", "作出", "給予", "提供")
WEAK_OBJECTS = (
    "討論", "分析", "研究", "調查", "測試", "開發", "設計", "評估", "檢查", "審查", "修改", "更新", "比較", "溝通", "合作", "訓練",
    "處理", "管理", "規劃", "改善", "調整", "整合", "驗證", "觀察", "監控", "維護", "決定", "回應", "貢獻", "改變", "承諾", "解釋",
    "判斷", "選擇", "反應", "讓步", "保證", "回答", "犧牲", "努力", "支援", "協助", "檢討", "投票", "改革", "發表", "發展",
)
PRONOUNS = ("他們", "她們", "他", "她", "它")
#: domain: passive, weak verb and pronoun per 1000 characters, 的 in a clause, issues per 1000.
DOMAINS = {"general": (3.0, 2.0, 8.0, 4, 5.0), "technical": (6.0, 4.0, 6.0, 5, 7.0), "literary": (1.5, 1.0, 10.0, 3, 3.0), "news": (2.5, 2.0, 7.0, 4, 4.0)}
#: passive, 的 chain, weak verb, pronoun, issues
SIGNAL_WEIGHTS = (1.0, 0.7, 0.8, 0.6, 0.5)
#: How strict a check for machine-written text is.
MULTIPLIERS = {"low": 0.5, "medium": 1.0, "high": 1.5}
_ZERO_WIDTH = re.compile("[​‌‍﻿‎‏]")
_STOPS = re.compile("[。！？!?]")
_NO_CHAIN = re.compile("[，,。！？；\n]")

#: Codes whose issues count as structural signs of machine-written text.
STRUCTURAL = (
    "a7_binary_contrast", "a8_paragraph_endings", "a9_dashes", "a10_formulaic_headings", "a11_list_density", "a13_tricolon", "a14_negative_parallel", "a15_stock_ending",
    "a16_bullets", "a17_bold_sentence", "a17_bold_paragraph", "a18_em_dash", "a19_challenge", "a20_from_to", "a22_line_metaphor", "a23_slogan",
)


class Report(NamedTuple):
    """A score (null where the text is too short) and its strongest signals."""

    score: float | None
    signals: tuple[str, ...] = ()


def visible(doc: Doc) -> int:
    return len(doc.text) - sum(min(e, len(doc.text)) - s for s, e in doc.excluded)


def variation(distances: Iterable[float]) -> float | None:
    """Population deviation over mean of at least nine distances with a mean of one or more."""
    d = np.array(list(distances), float)
    return float(d.std() / d.mean()) if len(d) >= 9 and d.mean() >= 1 else None


def variation_of(value: str) -> Column:
    """``variation`` as an aggregate of a column."""
    return F.when((F.count(value) >= 9) & (F.avg(value) >= 1), F.stddev_pop(value) / F.avg(value))


def _mark_places(doc: Doc, mark: re.Pattern) -> np.ndarray:
    """Where a mark stands, counted in visible characters."""
    places = [m.start() for m in mark.finditer(doc.text) if not doc.hidden(m.start(), m.start() + 1)]
    if not doc.excluded or not places:
        return np.array(places)
    starts, sizes = np.array(doc.excluded).T[0], np.diff(np.array(doc.excluded), axis=1)[:, 0]
    return np.array(places) - np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, places)]


def sentence_lengths(doc: Doc) -> list[int]:
    """Characters between sentence marks or excluded ranges, four at least."""
    cuts = sorted({*(m.span() for m in _STOPS.finditer(doc.text) if not doc.hidden(*m.span())), *doc.excluded, (len(doc.text), len(doc.text))})
    out, at = [], 0
    for s, e in cuts[:-1]:
        if s - at >= 4:
            out.append(s - at)
        at = e
    return out


def ai_score(doc: Doc, issues: Iterable[Issue] = (), m: float = 1.0) -> Report:
    """0 to 1 from phrase densities, structural findings, other findings, sentence variation, hidden marks and rhythm; null below 500 characters."""
    chars = visible(doc)
    if chars < 500:
        return Report(None)
    top, weights, marked = 0.0, 0.0, []
    for phrase, threshold, weight in AI_SIGNALS:
        density = sum(1 for _ in doc.places(phrase)) * 1000 / chars
        if density:
            weights += weight
        if density > threshold * m:
            top += min(2.0, (density - threshold * m) / (threshold * m)) * weight
            marked.append((-density / (threshold * m), phrase))
    mine = [i for i in issues if i.issue_type == "ai_style"]
    structural = sum(i.code in STRUCTURAL for i in mine)
    phrases = {p for p, *_ in AI_SIGNALS}
    others = sum(i.code not in STRUCTURAL and i.code != "a12_zero_width" and doc.text[i.start : i.end] not in phrases for i in mine) * 1000 / chars
    lengths = sentence_lengths(doc)
    sigma = float(np.std(lengths)) if len(lengths) >= 10 else None
    even = max(0.0, (5 * m - sigma) / (5 * m) * 0.15) if sigma is not None else 0.0
    hidden = sum(not doc.hidden(*x.span()) for x in _ZERO_WIDTH.finditer(doc.text))
    rhythm = [(cv, len(p)) for p in (_mark_places(doc, re.compile(x)) for x in ("，", "。", "；", "、", "—(?=—)")) if (cv := variation(np.diff(p))) is not None]
    steady = max(0.0, 0.5 * m - sum(cv * n for cv, n in rhythm) / sum(n for _, n in rhythm)) / (0.5 * m) * 0.1 if rhythm else 0.0
    score = (min(1.0, top / weights) * 0.7 if weights else 0.0) + min(0.4, structural * 0.1) + (min(0.3, (others - 2) / 5) if others > 2 else 0.0) + min(0.15, even) + min(0.2, hidden / (3 * m) * 0.2) + min(0.1, steady)
    signs = [p for _, p in sorted(marked, key=lambda x: x[0])[:3]]
    signs += ["structure"] * (structural > 0) + ["sentence_length"] * (sigma is not None and sigma < 5 * m) + ["zero_width"] * (hidden > 0) + ["rhythm"] * (steady > 0)
    return Report(min(1.0, score), tuple(signs[:3]))


def _longest_chain(doc: Doc) -> int:
    """Most 的 between two marks or excluded ranges."""
    cuts = sorted({*(x.span() for x in _NO_CHAIN.finditer(doc.text)), *doc.excluded, (len(doc.text), len(doc.text))})
    most, at = 0, 0
    for s, e in cuts:
        most, at = max(most, doc.text.count("的", at, max(at, s))), max(at, e)
    return most


def _weak_verbs(doc: Doc) -> int:
    return sum(any(next(doc.places(o, k + len(v), min(len(doc.text), k + len(v) + 4)), -1) >= 0 for o in WEAK_OBJECTS) for v in WEAK_VERBS for k in doc.places(v))


def translationese_score(doc: Doc, issues: Iterable[Issue] = (), domain: str = "general") -> Report:
    """0 to 1 from five densities against a domain's thresholds; null below 200 characters."""
    chars = visible(doc)
    if chars < 200:
        return Report(None)
    passive, weak, pronoun, chain, density = DOMAINS[domain]
    pronouns = sum(not doc.hidden(*x.span()) for x in re.finditer("|".join(PRONOUNS), doc.text))
    per = 1000 / chars
    values = (
        ("passive", sum(1 for _ in doc.places("被")) * per, passive, False),
        ("de_chain", float(_longest_chain(doc)), float(chain), True),
        ("weak_verb", _weak_verbs(doc) * per, weak, False),
        ("pronoun", pronouns * per, pronoun, False),
        ("issues", sum(i.issue_type == "translationese" for i in issues) * per, density, False),
    )
    total, signs = 0.0, []
    for (name, value, threshold, equal), weight in zip(values, SIGNAL_WEIGHTS, strict=True):
        excess = min(2.0, max(0.1, (value - threshold) / threshold))
        if value > threshold or (equal and value == threshold):
            total += excess * weight
        if value >= threshold:
            signs.append((-excess, name))
    return Report(min(1.0, max(0.0, total / sum(SIGNAL_WEIGHTS))), tuple(n for _, n in sorted(signs, key=lambda x: x[0])[:3]))


def quality_flags(doc: Doc, issues: Iterable[Issue], asr_rules: Iterable[int] = ()) -> list[str]:
    """Traits of transcribed text (O9); ``asr_rules`` are the confusable rules about speech recognition."""
    issues, asr = list(issues), set(asr_rules)
    flags = ["asr_artifacts"] if any(i.issue_type == "confusable" and i.rule_id in asr for i in issues) else []
    flags += ["stutter_detected"] if any(i.issue_type == "repetition" and i.code != "p19_spaced_acronym" for i in issues) else []
    flags += ["spaced_acronyms"] if any(i.code == "p19_spaced_acronym" for i in issues) else []
    density = spoken(doc.text)
    return [*flags, "high_oral_density"] if density is not None and density > 0.05 else flags


_SPOKEN = re.compile("|".join(sorted(ORAL, key=len, reverse=True)))
_HAN = re.compile("[一-鿿]")


def spoken(text: str) -> float | None:
    """CJK characters that oral markers cover over all CJK characters; null below 20."""
    n = len(_HAN.findall(text))
    if n < 20:
        return None
    covered, at = 0, 0
    for s, e in sorted((k.start(), k.start() + len(w)) for w in ORAL for k in re.finditer(w, text)):
        covered, at = covered + max(0, e - max(s, at)), max(at, e)
    return covered / n


def consistency(issues: Iterable[Issue], chars: int) -> float:
    """Regional and confusable terms per 1000 characters, one at most (part of O12)."""
    return min(1.0, sum(i.issue_type in ("cross_strait", "confusable") for i in issues) * 1000 / chars) if chars else 0.0


def oral_density(text: str = "text") -> Column:
    """``spoken`` as a column: no marker begins inside another and ends outside it, so the longest ones cover all."""
    n = F.regexp_count(F.col(text), F.lit(f"[{NARROW}]"))
    left = F.regexp_replace(F.col(text), _SPOKEN.pattern, "")
    return F.when(n >= 20, (n - F.regexp_count(left, F.lit(f"[{NARROW}]"))) / n)
