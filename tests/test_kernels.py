"""The sequential kernels on small texts, against plain statements of their rules."""

import itertools
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hanlens.operators import conversion, exclusions, fixes, orthography, resolve, scores, style
from hanlens.operators.doc import Doc, Issue, byte_offsets, chunk, merged
from hanlens.operators.segmenter import Segmenter
from hanlens.operators.spelling import Spelling, absorbers
from hanlens.plans import scan
from hanlens.rules import Rule, parse


def found(rule, text, *args, excluded=()):
    return [text[i.start : i.end] for i in rule(Doc(text, list(excluded)), *args)]


def test_exclusions_by_content_type():
    text = "見 https://a.b/c 與 @me\n```\ncode\n```\n`x` 內文"
    assert [text[s:e] for s, e in exclusions.exclusions(text)] == ["https://a.b/c", "@me"]
    assert any(text[s:e].startswith("```\ncode") for s, e in exclusions.exclusions(text, "markdown"))
    assert not any("code" in text[s:e] for s, e in exclusions.exclusions(text, "markdown_scan_code"))
    assert exclusions.exclusions("name: 值\n", "yaml") == [(0, 5)]
    assert [("a: 'x: y' b"[s:e]) for s, e in exclusions.yaml_keys("a: 'x: y' b")] == ["a:"]
    quote = "> 引用\n繼續\n\n內文"
    assert [quote[s:e] for s, e in exclusions.exclusions(quote, "markdown", quotes=True)] == ["> 引用\n繼續"]


def test_paths_and_links():
    assert exclusions.links("a://b/c /d/e ../f") == [(0, 7), (8, 12), (13, 17)]
    assert [("x@y /p@q"[s:e]) for s, e in exclusions.links("x@y /p@q")] == ["/p@q", "@y"]


def test_suppressions():
    text = "a\n<!-- hanlens:ignore-next-line -->\nb\nc // hanlens:ignore\nd"
    assert [text[s:e] for s, e in exclusions.suppressions(text)] == ["b\n", "c // hanlens:ignore\n"]
    block = "x\n<!-- hanlens:disable-block -->\ny\n<!-- hanlens:end-disable -->\nz"
    assert [block[s:e] for s, e in exclusions.suppressions(block)] == ["<!-- hanlens:disable-block -->\ny\n<!-- hanlens:end-disable -->\n"]
    opened = "x\n<!-- other:ignore-block -->\ny"
    assert exclusions.suppressions(opened) == [] and exclusions.suppressions(opened, "other") == [(2, len(opened))]


def test_front_matter():
    text = "---\ntitle: \"標題\"\n---\n內文\n::: note\n"
    hidden = [text[s:e] for s, e in exclusions.exclusions(text, "markdown")]
    assert hidden == ["---\ntitle:", '"', '"', "---\n", "::: note"]


def test_headings_and_tables():
    text = "# 標題 #\n\n| a | b |\n|---|---|\n| c | d |\n"
    assert [text[s:e] for s, e in exclusions.headings(text)] == ["標題"]
    assert [(r, c, text[s:e].strip()) for r, c, s, e in exclusions.table_cells(text)] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]
    assert resolve.cell_of(exclusions.table_cells(text), text.index("d"), text.index("d") + 1) == (1, 1)


def test_sentences():
    text = "Dr. Wang left. He said hi。好！etc. Then\n\n後段；尾"
    assert [text[s:e] for s, e in Doc(text).sentences] == ["Dr. Wang left.", "He said hi。", "好！", "etc. Then", "後段；", "尾"]
    hole = "甲乙 `x。y` 丙丁。"
    assert [hole[s:e] for s, e in Doc(hole, [(3, 8)]).sentences] == ["甲乙", "丙丁。"]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)), max_size=8), st.integers(0, 40), st.integers(0, 6))
def test_hidden_equals_brute_force(ranges, start, size):
    spans = merged([(s, s + n) for s, n in ranges])
    doc = Doc("x" * 60, spans)
    assert doc.hidden(start, start + size) == (size > 0 and any(s < start + size and start < e for s, e in spans))
    assert doc.inside(start, start + size) == any(s <= start and start + size <= e for s, e in spans)


@given(st.text(alphabet="aé漢😀\n", max_size=30))
def test_lines_and_bytes(text):
    assert byte_offsets(text).tolist() == [len(text[:k].encode()) for k in range(len(text) + 1)]
    lines, columns = resolve.line_columns(text, range(len(text) + 1))
    for k in range(len(text) + 1):
        head = text[:k]
        assert lines[k] == head.count("\n") + 1
        assert columns[k] == len(head.rsplit("\n", 1)[-1].encode("utf-16-le")) // 2 + 1


@given(st.text(alphabet="aéé̂ñ漢ガ゙ᄀ\u1161ｶﾞ", max_size=12))
def test_nfc_map(text):
    normal, back = conversion.nfc(text)
    assert normal == unicodedata.normalize("NFC", text)
    if back is None:
        assert normal == text
    else:
        assert len(back) == len(normal.encode()) + 1 and list(back) == sorted(back) and back[-1] == len(text.encode())


def naive_resolution(issues):
    kept = []
    for i in sorted(sorted(issues, key=lambda i: (i.start, i.start - i.end)), key=lambda i: (i.start - i.end, {"info": 2, "warning": 1, "error": 0}[i.severity], i.start)):
        def clash(k, i=i):
            if i.start == i.end or k.start == k.end:
                return i.start == i.end != k.start and k.start < i.start < k.end
            return i.start < k.end and k.start < i.end

        if not any(map(clash, kept)):
            kept.append(i)
    return kept


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 6), st.sampled_from(["info", "warning", "error"])), max_size=12))
def test_resolution_equals_brute_force(rows):
    issues = [Issue("x", "typo", sev, s, s + n) for s, n, sev in rows]
    assert sorted(resolve.resolved(issues)) == sorted(naive_resolution(issues))


def test_repetitions():
    assert found(orthography.latin_repetitions, "the The word, word word") == ["the The", "word word"]
    assert found(orthography.cjk_repetitions, "重複重複了，謝謝你") == ["重複重複"]
    assert found(orthography.cjk_repetitions, "的的") == ["的的"]


def test_dunhao_and_marks():
    assert len(found(orthography.dunhao, "有蘋果，香蕉，橘子，很好吃的東西")) == 3
    assert found(orthography.dunhao, "有，香蕉，很好吃的東西") == []
    assert len(found(orthography.repeated_marks, "好！！！——……")) == 2


def brute_pairs(text):
    """P15 on a text of quotes and blank lines alone."""
    marks = [(k, c) for k, c in enumerate(text) if c in "“”"]
    paragraph = lambda k: text[:k].count("|")
    nests, depth, last = len({c for _, c in marks}) > 1, 0, None
    for k, c in marks:
        depth = 0 if paragraph(k) != last else depth
        last = paragraph(k)
        depth += 1 if c == "“" else -1
        nests = nests and depth >= 0
    out, depth, turn, last = [], 0, 0, None
    for k, c in marks:
        if paragraph(k) != last:
            depth = turn = 0
        last = paragraph(k)
        if (c == "“") if nests else turn % 2 == 0:
            out.append("「『"[depth % 2])
            depth += 1
        else:
            depth = max(0, depth - 1)
            out.append("」』"[depth % 2])
        turn += 1
    return out


def test_quote_pairs_equal_brute_force():
    for n in range(2, 7):
        for marks in itertools.product("“”|", repeat=n):
            if sum(m != "|" for m in marks) >= 2:
                plain = "".join(marks)
                text = plain.replace("|", "\n\n")
                issues = [Issue("p8_double_curly", "punctuation", "warning", k, k + 1) for k, c in enumerate(text) if c in "“”"]
                assert [i.suggestions[0] for i in orthography.paired(Doc(text), issues)] == brute_pairs(plain), plain


def test_quotes():
    assert found(orthography.quote_hierarchy, "「a『b』」") == []
    assert found(orthography.quote_hierarchy, "「a") == ["「"]
    assert found(orthography.quote_hierarchy, "『a』「b》") == ["『", "「", "》"]
    assert [i.suggestions for i in orthography.ascii_quotes(Doc('他說"這"的\n\nabcd "x"'))] == [("「",), ("」",)]


def test_traditional_is_idempotent():
    text = "这个系统的内存以后会导致问题，公里"
    once = conversion.to_traditional(text)
    assert once == conversion.to_traditional(once)
    assert "以後" in once and "公里" in once
    assert conversion.to_traditional("裏面為爲") == "裡面為為"
    made = conversion.tables([("后", "後"), ("国", "國")], {"皇后": "皇后", "以后": "以後", "国内": "國內"}, "后")
    assert conversion.to_traditional("皇后国以后后", made) == "皇后國以後后" and "国内" in made.phrases
    assert conversion.script("问题") == "simplified" and conversion.script("問題") == "traditional" and conversion.script("x") == "unknown"


def brute_segments(words, text):
    """Maximum matching by trying every chunk of up to three words."""
    at, out = 0, []
    while at < len(text):
        best = None
        def here(k):
            return [text[k : k + 1], *(text[k : k + n] for n in range(2, 6) if len(text[k : k + n]) == n and text[k : k + n] in words)]

        chunks = []
        for a in here(at):
            k = at + len(a)
            chunks += [(a, b, c) if (c) else (a, b) for b in (here(k) if k < len(text) else [])for c in (here(k + len(b)) if k + len(b) < len(text) else [""])] if k < len(text) else [(a,)]
        for c in chunks:
            sizes = [len(w) for w in c]
            mean = sum(sizes) / len(c)
            key = (sum(sizes), -len(c), -sum((n - mean) ** 2 for n in sizes), sum(words.get(w, 0) for w in c if len(w) == 1), sizes[0])
            if best is None or key > best[0]:
                best = (key, c[0])
        out.append(best[1])
        at += len(best[1])
    return out


def test_segmenter():
    words = Segmenter([], ["研究", "研究生", "生命", "起源"], [])
    assert [w for _, w, _ in words.segment("研究生命起源")] == ["研究", "生命", "起源"]
    assert Segmenter([], ["生命", "起源"], []).clues("生命起源", ("生命", "命", "沒有")) == 2
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(2, 4))) for _ in range(14)]
    s = Segmenter([], vocabulary, ["甲", "丙"])
    for _ in range(300):
        text = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 9)))
        assert [w for _, w, _ in s.segment(text)] == brute_segments(s.words, text), text


def test_straddling_equals_brute_force():
    rng = random.Random(2)
    rules = [Rule(0, "乙丙", ("丁",), "typo")]
    s = Segmenter(rules, ["甲乙", "乙丙丁", "丙丁", "丁甲乙", "甲x"], [])
    for _ in range(500):
        text = "".join(rng.choice("甲乙丙丁x") for _ in range(rng.randint(2, 9)))
        for m in re.finditer("乙丙", text):
            a, b = m.span()
            words = [w for w in s.words if w not in s.terms and len(w) > 1]
            cjk = lambda t: all("一" <= c <= "鿿" for c in t)
            over = [(k, k + len(w)) for w in words for k in range(len(text)) if text.startswith(w, k)]
            want = any((p < a < q and cjk(text[p : a + 1])) or (p <= a and p < b < q and cjk(text[p : b + 1])) for p, q in over)
            assert s.straddles(text, a, b) == want, text
            first = s.boundaries(text)
            assert (first[a] < a or first[b] <= a) == want, text


def test_dictionary_conditions():
    rules = [
        Rule(0, "內存", ("記憶體",), "cross_strait", "memory", ("國內存款",)), Rule(1, "支持", ("支援",), "cross_strait", None, (), ("系統",), ("公益",)), Rule(2, "程序", ("程式",), "cross_strait"),
        Rule(3, "廢話", ("",), "ai_filler"), Rule(4, "文件", ("檔案",), "cross_strait", None, (), (), (), ("before:目錄", "not_after:公")), Rule(5, "裏", ("裡",), "variant"), Rule(6, "祖國", (), "political_coloring", "homeland"),
    ]
    spelling = Spelling(rules, Segmenter(rules, ["程序員"], []))
    run = lambda text, **k: [(text[i.start : i.end], i.suggestions) for i in spelling.issues(Doc(text, **k))]
    assert run("內存") == [("內存", ("記憶體",))] and run("國內存款") == []
    assert run("支持") == [] and run("支持系統") == [("支持", ("支援",))] and run("支持系統公益") == []
    assert run("支持\n\n系統") == [] and run("支持 x 系統", excluded=[(3, 4)]) == []
    assert run("程序員") == [] and run("程序") == [("程序", ("程式",))]
    assert run("廢話，好") == [("廢話，", ("",))] and run("廢話。") == [("廢話", ("",))]
    assert run("文件在目錄") == [("文件", ("檔案",))] and run("公文件在目錄") == [] and run("文件") == []
    assert run("祖國") == [("祖國", ("homeland",))]
    for stance, n in (("roc_centric", 1), ("international", 0), ("neutral", 0)):
        assert len(list(Spelling(rules, stance=stance).issues(Doc("祖國")))) == n
    strict = Spelling(rules, variants=True)
    assert [i.start for i in strict.issues(Doc("裏"))] == [0] and not list(strict.issues(Doc("裏"), "simplified"))
    assert spelling.checked() == 6


def test_many_rules():
    """Tens of thousands of terms cost a text no more than one pass."""
    signs = [chr(0x4E00 + k) for k in range(40)]
    rules = [Rule(k, a + b + c, (c + b,), "cross_strait", "x") for k, (a, b, c) in enumerate(itertools.product(signs, signs, signs[:15]))]
    spelling = Spelling(rules, Segmenter(rules, [], []))
    rng = random.Random(3)
    text = "".join(rng.choice(signs) for _ in range(20_000))
    terms, at, want = {r.from_ for r in rules}, 0, []
    while at < len(text):
        hit = text[at : at + 3] in terms
        want += [at] * hit
        at += 3 if hit else 1
    assert [s for s, _ in spelling.matches(text)] == want and len(rules) == 24_000
    assert len(list(spelling.issues(Doc(text)))) > 1000


def test_absorbers_do_not_hide_rules():
    made = absorbers(parse())
    assert "國內存款" in made
    assert not set(made) & {r.from_ for r in parse()}
    rules = [Rule(0, "甲", (), "typo", None, ("甲乙", "丙甲丁", "甲戊")), Rule(1, "乙己", (), "typo"), Rule(2, "丁", (), "typo")]
    assert absorbers(rules) == ["甲戊"]


def test_case_rules():
    s = Spelling(())
    text = "javascript Github GitHub xGithub MariaDB mysql LaTeX TeX"
    assert [text[i.start : i.end] for i in s.case_issues(Doc(text))] == ["javascript", "Github", "mysql"]


def test_style_words():
    assert [i.suggestions for i in style.meaning(Doc("所謂快取意味著暫存。因此意味著失敗。換言之，這意味著它。意味著"))] == [("表示",), ("代表",), ("也就是說",), ()]
    assert found(style.copulas, "系統作為核心。有所作為的系統。擁有權限的API") == ["作為"]
    assert found(style.copulas, "作為一個人") == []


def test_style_lists():
    assert found(style.bullets, "- **甲** x\n- **乙** y\n- **丙** z\n\n- **丁**") == ["-"]
    assert found(style.bullets, "1. **甲**\n2. 乙\n3. **丙**") == []
    assert found(style.tricolons, "團結、奮鬥、創新。甲、乙丙、丁。") == ["團結、奮鬥、創新"]
    assert [i.code for i in style.bold(Doc("這**很**好**的**話說到這裡就好了不用再繼續說下去了，**真的**真的很好。"))] == ["a17_bold_sentence", "a17_bold_paragraph"]


def test_style_translated():
    assert found(style.premodifiers, "這是本由許多優秀的作者共同完成的著作。") == ["這是本由許多優秀的作者共同完成的著作"]
    assert found(style.premodifiers, "我在街上看到許多優秀的作者共同完成的著作。") == []
    assert found(style.connectives, "因為天氣不好。所以我們沒去。") == ["因為天氣不好。所以"] and found(style.connectives, "敬啟者：因為甲所以乙") == []
    assert found(style.connectives_by_sentence, "因為天氣不好。所以我們沒去。") == []
    assert [i.suggestions[0] for i in style.connectives_by_sentence(Doc("因為甲所以乙。當時的時候。如果甲那麼乙"))] == ["甲所以", "如果甲"]
    assert found(style.false_friends, "實際上基本上對，基本上錯，絕對地 (absolutely) 好") == ["實際上", "基本上", "絕對地"]
    assert found(style.nominal_pairs, "制度的實施帶來效率的提升，改善的改善和環境的提升") == ["的實施帶來效率的提升"]
    assert found(style.nominal_chains, "提升的改善的實施。提升的改善") == ["提升的改善的實施"] and found(style.nominal_chains, "提升的改善的實施", "technical") == []
    twins = [Issue("t15_connectives", "translationese", "info", 0, 5), Issue("t11_connective_pair", "translationese", "info", 3, 8), Issue("t15_connectives", "translationese", "info", 9, 12)]
    assert style.without_twins(twins) == twins[1:]


def test_hedges_are_promoted():
    text = "可以說是相對而言在某種程度上" + "好" * 40
    issues = [Issue("a6_density", "ai_style", "info", 0, 4), Issue("x", "ai_style", "info", 20, 22)]
    assert [i.severity for i in style.hedged(Doc(text), issues)] == ["warning", "info"]


def test_scores():
    assert scores.ai_score(Doc("短")).score is None and scores.translationese_score(Doc("短")).score is None
    flat = "更重要的是我們學到經驗。" * 50
    assert scores.ai_score(Doc(flat)).score > 0.7 and scores.ai_score(Doc(flat)).signals[0] == "更重要的是"
    assert scores.translationese_score(Doc("他被他們進行討論的的的的。" * 20)).score == 1.0
    assert scores.variation([2] * 9) == 0 and scores.variation([2] * 8) is None
    repeat = Issue("p18_latin_repetition", "repetition", "info", 0, 1)
    assert scores.quality_flags(Doc("x"), [repeat, Issue("p19_spaced_acronym", "repetition", "info", 0, 1)]) == ["stutter_detected", "spaced_acronyms"]


def test_chunk():
    text = "前段。\n\n# 標題\n第一項系統的說明。\n- 第二項"
    assert text[slice(*chunk(text, text.index("系統"), text.index("系統") + 2))] == "# 標題\n第一項系統的說明。"
    long = "字" * 600 + "系統" + "文" * 600
    s, e = chunk(long, 600, 602)
    assert e - s <= 500 and s <= 600 and e >= 602


TIERS = "軟件很好,支持系統。javascript"


@pytest.mark.parametrize(("mode", "want"), [("none", TIERS), ("orthographic", "軟件很好，支持系統。JavaScript"), ("lexical_safe", "軟體很好，支持系統。JavaScript"), ("lexical_contextual", "軟體很好，支援系統。JavaScript")])
def test_fix_tiers(mode, want):
    """Each tier fixes strictly more; clues are only trusted by the last."""
    scanner = scan.Scanner(parse(), scan.BASE)
    doc = Doc(TIERS)
    issues = resolve.final_order([*scanner.spelling.issues(doc), *scanner.spelling.case_issues(doc), Issue("p1_comma", "punctuation", "warning", 4, 5, ("，",))])
    assert fixes.applied(doc, issues, mode, scanner.segmenter)[0] == want


def test_fix_bookkeeping():
    doc = Doc("甲乙丙丁戊")
    issues = [Issue("x", "typo", "error", 0, 1, ("一二",)), Issue("x", "typo", "error", 2, 3, ("",)), Issue("x", "typo", "error", 4, 5, ("尾",))]
    new, edits = fixes.applied(doc, issues, "lexical_safe", None)
    assert new == "一二乙丁尾" and fixes.written_spans(edits) == [(0, 2), (3, 3), (4, 5)]
    assert fixes.remapped(3, edits) == 3 and fixes.remapped_ranges([(1, 2), (3, 4)], edits) == [(2, 3), (3, 4)]
    again = [Issue("y", "typo", "error", 0, 1), Issue("y", "typo", "error", 2, 3), Issue("y", "typo", "error", 3, 4)]
    assert fixes.unwritten(again, edits) == again[1:2]
    assert fixes.restored([Issue("x", "typo", "error", 1, 2)], [Issue("y", "typo", "error", 2, 3)], edits, doc.text, new) == [0]
    assert fixes.applied(Doc("甲", [(0, 1)]), [Issue("x", "typo", "error", 0, 1, ("乙",))], "lexical_safe", None)[0] == "甲"
    noted = fixes.applied(Doc("甲乙"), [Issue("x", "typo", "error", 0, 1, ("一",)), Issue("x", "typo", "error", 1, 2, ("二",))], "lexical_safe", None, [(None, "suppressed"), (False, None)])
    assert noted[0] == "甲乙"
    zero = Doc("a\u200bb")
    assert fixes.applied(zero, [Issue("a12_zero_width", "ai_style", "info", 1, 2, ("",))], "orthographic", None)[0] == "ab"


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="軟件內存,。！“”的了是 aA1\n-*#", max_size=60))
def test_scanner_takes_any_text(text):
    scanner = scan.Scanner(parse(), scan.PROFILES["ai"])
    for kind in ("plain", "markdown", "yaml"):
        doc = scanner.document(text, kind)
        issues = scanner.issues(doc, [])
        assert all(0 <= i.start <= i.end <= len(text) for i in issues)
        assert fixes.applied(doc, issues, "lexical_contextual", scanner.segmenter)[0] is not None
