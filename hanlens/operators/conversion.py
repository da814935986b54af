"""Text forms: composed characters with the way back, script, and conversion to traditional characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from typing import NamedTuple

import numpy as np

from .doc import byte_offsets

# A seed of simplified and traditional forms by position, and phrases that a character map
# gets wrong.  Full tables are a parameter (``tables``).
SIMPLIFIED = "万专业东个为么书买产亲们价会传伤体关兴养内写军农决况净减击则刚创务动劳势区医协单卖厂历压双变叶号听员响团园围国图圆场坏块声处备头学宁实审对导将岁师带帮应开张强当录态总战护报担择挂据摆断时显术机杀权条来极构标样检楼欢气没测济热爱独现电画盘码确礼离种积称竞笔签简红约级纪纯线组细终经结给络统继续维综缓编网联艺节药营虑蚀补观规视觉计认让议讯记讲许论设访证评识词译试话详语误说请读课调问题软够这错严"
TRADITIONAL = "萬專業東個為麼書買產親們價會傳傷體關興養內寫軍農決況淨減擊則剛創務動勞勢區醫協單賣廠歷壓雙變葉號聽員響團園圍國圖圓場壞塊聲處備頭學寧實審對導將歲師帶幫應開張強當錄態總戰護報擔擇掛據擺斷時顯術機殺權條來極構標樣檢樓歡氣沒測濟熱愛獨現電畫盤碼確禮離種積稱競筆簽簡紅約級紀純線組細終經結給絡統繼續維綜緩編網聯藝節藥營慮蝕補觀規視覺計認讓議訊記講許論設訪證評識詞譯試話詳語誤說請讀課調問題軟夠這錯嚴"
#: Left alone by the character map; phrases decide them.
AMBIGUOUS = "里后干发复余云斗谷面只台丑系"
PHRASES = {
    "以后": "以後", "之后": "之後", "后来": "後來", "然后": "然後", "最后": "最後", "今后": "今後", "头发": "頭髮", "理发": "理髮", "发现": "發現", "发展": "發展", "开发": "開發", "发生": "發生",
    "发送": "發送", "发布": "發布", "皇后": "皇后", "太后": "太后", "里面": "裡面", "这里": "這裡", "那里": "那裡", "公里": "公里", "里程": "里程", "关系": "關係", "联系": "聯繫", "系统": "系統",
    "系列": "系列", "干净": "乾淨", "干燥": "乾燥", "干部": "幹部", "干预": "干預", "若干": "若干", "只是": "只是", "只有": "只有", "一只": "一隻", "复杂": "複雜", "重复": "重複", "恢复": "恢復",
    "回复": "回覆", "其余": "其餘", "剩余": "剩餘", "云端": "雲端", "云计算": "雲計算", "奋斗": "奮鬥", "北斗": "北斗", "山谷": "山谷", "稻谷": "稻穀", "面条": "麵條", "面包": "麵包", "方面": "方面",
    "台湾": "台灣", "平台": "平台", "台风": "颱風", "丑陋": "醜陋", "小丑": "小丑",
    "问题": "問題", "导致": "導致", "错误": "錯誤", "范围": "範圍", "软件": "軟件", "内存": "內存",
}
#: Forms of a character to the one that is usual in Taiwan.
VARIANTS = dict(zip("爲啓峯羣衆着麽綫裏牀污祕恒鷄濶", "為啟峰群眾著麼線裡床汙秘恆雞闊", strict=True))


class Tables(NamedTuple):
    """Character map, phrases (pre-normalised), the one pattern that finds them, and the variant map."""

    characters: dict[int, str]
    phrases: dict[str, str]
    found: re.Pattern
    variants: dict[int, str]


def tables(pairs: Iterable[tuple[str, str]], phrases: Mapping[str, str], ambiguous: str = AMBIGUOUS, variants: Mapping[str, str] = VARIANTS) -> Tables:
    """Conversion tables of a dictionary (M8): ambiguous characters leave the map, phrases that stay as they are protect them, phrases already carry the usual variants."""
    usual = {ord(a): b for a, b in variants.items()}
    plain = {ord(s): t for s, t in pairs if s not in ambiguous and s != t}
    kept = {s: t.translate(usual) for s, t in phrases.items() if s != t or any(ord(c) in plain or c in ambiguous for c in s)}
    longest = sorted(map(re.escape, kept), key=lambda p: (-len(p), p))
    return Tables(plain, kept, re.compile("|".join(longest) or r"(?!)"), usual)


SEED = tables(zip(SIMPLIFIED, TRADITIONAL, strict=True), PHRASES)


def to_traditional(text: str, t: Tables = SEED) -> str:
    """Phrases first, leftmost and longest; what lies between by character, then by variant (M7)."""
    out, at = [], 0
    for m in t.found.finditer(text):
        out += [text[at : m.start()].translate(t.characters).translate(t.variants), t.phrases[m[0]]]
        at = m.end()
    return "".join([*out, text[at:].translate(t.characters).translate(t.variants)])


_SIMPLE, _TRADITIONAL = (re.compile(f"[{''.join(sorted(set(a) - set(b)))}]") for a, b in ((SIMPLIFIED, TRADITIONAL), (TRADITIONAL, SIMPLIFIED)))


def script(text: str) -> str:
    """Which script's own characters are strictly more."""
    s, t = len(_SIMPLE.findall(text)), len(_TRADITIONAL.findall(text))
    return "simplified" if s > t else "traditional" if t > s else "unknown"


def nfc(text: str) -> tuple[str, np.ndarray | None]:
    """NFC text, and unless it is the text itself, for each of its bytes (and its end) the byte it came from."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, back, k = [], [], 0
    at = byte_offsets(text)
    while k < len(text):
        e = k + 1  # up to the next character that nothing before it can absorb
        while e < len(text) and not _stands(text[e]):
            e += 1
        piece = unicodedata.normalize("NFC", text[k:e])
        out.append(piece)
        back += [at[k]] * len(piece.encode())
        k = e
    return "".join(out), np.array([*back, at[-1]])


def _stands(c: str) -> bool:
    """Whether a character begins a piece: no mark, no Hangul vowel or final, nothing that composes with what stands before."""
    return not unicodedata.combining(c) and not unicodedata.category(c).startswith("M") and not 0x1160 <= ord(c) <= 0x11FF
