"""What a scan leaves alone: links, code, markup, keys, and lines that a comment switches off."""

from __future__ import annotations

import re

from .doc import Doc, Span, merged, overlaps

#: The tag before the directive of a suppression comment.
TAG = "hanlens"

# Formats that are skipped.
_URL = re.compile(r"[a-zA-Z0-9+.\-]*://[^\s「」『』《》]+")
_URL_ENDS = re.compile(r"[a-zA-Z0-9+.\-]*://[^\s「」『』《》]+$")
_PATH = re.compile(r"(?:\.\.?/|/)[^\s「」『』《》]+")
_MENTION = re.compile(r"@[a-zA-Z0-9_]+")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_INLINE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_CONTAINER = re.compile(r"(?m)^[ \t]*:::.*$")
_FRONT = re.compile(r"---\r?\n(?:.*\n)*?---\r?(?:\n|$)")
_KEY = re.compile(r"""(?:[^"':\n]|:(?![ \t\r]|$)|"[^"\n]*"|'[^'\n]*')*?:(?=[ \t\r]|$)""", re.M)
_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*")
_HEADING = re.compile(r" {0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*")


def links(text: str) -> list[Span]:
    """URLs, paths that do not go on from one, and mentions that overlap nothing."""
    spans = [m.span() for m in _URL.finditer(text)]
    if "/" in text:
        for m in _PATH.finditer(text):
            s, e = m.span()
            before = text[max(0, s - 50) : s]
            while len(before.encode()) > 50:
                before = before[1:]
            if _URL_ENDS.search(before):
                continue
            k = next((k for k, (a, b) in enumerate(spans) if s < b and e > a), None)
            if k is None:
                spans.append((s, e))
            elif s <= spans[k][0] and e >= spans[k][1]:
                spans[k] = (s, e)
    return spans + [m.span() for m in _MENTION.finditer(text) if not overlaps(*m.span(), spans)]


def _lines(text: str) -> list[Span]:
    return Doc(text).lines


def suppressions(text: str, tag: str = TAG) -> list[Span]:
    """Lines that a directive switches off (X10); an open block lasts to the end."""
    if f"{tag}:" not in text:
        return []
    follow, here = re.compile(rf"<!-- {tag}:(?:ignore|disable)-next-line -->"), re.compile(rf"// {tag}:(?:ignore|disable)")
    begin, end = re.compile(rf"<!-- {tag}:(?:ignore|disable)-block -->"), re.compile(rf"<!-- {tag}:end-(?:ignore|disable) -->")
    out: list[Span] = []
    start = None
    rows = [(s, min(e + 1, len(text))) for s, e in _lines(text)]
    for k, (s, e) in enumerate(rows):
        line = text[s:e]
        if start is not None:
            if end.search(line):
                out.append((start, e))
                start = None
        elif begin.search(line):
            start = s
        elif follow.search(line):
            out += rows[k + 1 : k + 2]
        elif here.search(line):
            out.append((s, e))
    return out if start is None else [*out, (start, len(text))]


def code(text: str, scan_code: bool = False, quotes: bool = False) -> list[Span]:
    """Fenced and indented code, inline code, HTML; block quotes where they are exempt."""
    blocks: list[Span] = []
    quoted: list[Span] = []
    fence, begun, blank, quote = "", 0, True, None
    for s, e in _lines(text):
        line = text[s:e]
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip("`~ \t\r"):
                blocks.append((begun, e))
                fence = ""
            continue
        if quotes:  # a quote goes on over lines that merely continue its paragraph
            if re.match(r" {0,3}>", line):
                quote = s if quote is None else quote
                quoted.append((quote, e))
            elif quote is not None and line.strip():
                quoted.append((quote, e))
            else:
                quote = None
        if m:
            fence, begun = m[1], s
        elif blank and re.match(r"(?: {4}|\t)\S", line):
            blocks.append((s, e))
            continue
        blank = not line.strip()
    if fence:
        blocks.append((begun, len(text)))
    blocks = merged(blocks)
    spans = Doc(text, blocks)
    inner = [m.span() for r in (_INLINE, _HTML) for m in r.finditer(text) if not spans.hidden(*m.span())]
    return [*([] if scan_code else blocks), *quoted, *inner]


def front_matter(text: str) -> Span | None:
    m = _FRONT.match(text)
    return m.span() if m else None


def yaml_keys(text: str, start: int = 0, end: int | None = None) -> list[Span]:
    """From a line's start through its first unquoted colon before a blank or the line's end."""
    end = len(text) if end is None else end
    return [(s, m.end()) for s, e in _lines(text) if start <= s < end and (m := _KEY.match(text, s, e))]


def markdown(text: str, scan_code: bool = False, quotes: bool = False) -> list[Span]:
    """Markdown structure: code, container fences, and of front matter the marks, keys and quotes."""
    out = code(text, scan_code, quotes) + [m.span() for m in _CONTAINER.finditer(text)]
    if head := front_matter(text):
        end = head[1]
        out += [(s, min(e + 1, end)) for s, e in _lines(text) if s < end and text[s:e].rstrip("\r") == "---"]
        out += yaml_keys(text, 0, end) + [(k, k + 1) for k in range(end) if text[k] in "\"'"]
    return out


def exclusions(text: str, content_type: str = "plain", tag: str = TAG, quotes: bool = False) -> list[Span]:
    """All excluded ranges of a text in code points, merged."""
    spans = links(text) + suppressions(text, tag)
    if content_type.startswith("markdown"):
        spans += markdown(text, content_type.endswith("scan_code"), quotes)
    elif content_type == "yaml":
        spans += yaml_keys(text)
    return merged(spans)


def headings(text: str) -> list[Span]:
    """Contents of ATX and setext headings outside code and front matter."""
    skip, out, rows = Doc(text, merged(code(text) + [h for h in [front_matter(text)] if h])), [], _lines(text)
    for k, (s, e) in enumerate(rows):
        line = text[s:e].rstrip("\r")
        if skip.hidden(s, e):
            continue
        if m := _HEADING.match(line):
            if m[1]:
                out.append((s + m.start(1), s + m.end(1)))
        elif line.strip() and not line.lstrip().startswith(("#", ">", "- ", "* ", "|")) and k + 1 < len(rows) and _UNDERLINE.fullmatch(text[slice(*rows[k + 1])].rstrip("\r")):
            left = len(line) - len(line.lstrip())
            out.append((s + left, s + len(line.rstrip())))
    return out


def table_cells(text: str) -> list[tuple[int, int, int, int]]:
    """(row, col, start, end) of pipe-table cells, header row 0."""
    out, rows = [], _lines(text)
    k = 0
    while k + 1 < len(rows):
        if "|" in text[slice(*rows[k])] and "|" in text[slice(*rows[k + 1])] and _RULE.fullmatch(text[slice(*rows[k + 1])]):
            row, at = 0, k
            while at < len(rows) and "|" in text[slice(*rows[at])]:
                if at != k + 1:
                    s, e = rows[at]
                    line = text[s:e].rstrip()
                    cells = list(re.finditer(r"(?:[^|\\]|\\.)+", line))
                    out += [(row, col, s + m.start(), s + m.end()) for col, m in enumerate(c for c in cells if c[0].strip())]
                    row += 1
                at += 1
            k = at
        else:
            k += 1
    return out
