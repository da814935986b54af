"""SQL that must give the same rows as the kernels, written from the rules.

``{corpus}`` is a ``SELECT doc_id, t``.  Places are code points until the last
step turns them into bytes.
"""

from __future__ import annotations

from .operators import style
from .operators.detectors import hits_sql
from .operators.doc import ABBREVIATIONS, CJK

# Unicode white space, and what opens a sentence, for RE2.
BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
OPENS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{2E80}-\x{2EFF}\x{3000}-\x{303F}\x{F900}-\x{FAFF}"
IDEOGRAPH = CJK.pattern


def texts(corpus: str) -> str:
    return f"d AS (SELECT doc_id, coalesce(t, '') AS t FROM ({corpus}) z)"


def pieces(name: str, source: str, column: str, separator: str, base: str = "0", keys: str = "doc_id", blank: bool = False) -> str:
    """CTE ``name``: the pieces ``u`` of a text between separators, with their number ``k`` and place ``s``; ``keys`` identify the text."""
    sep = separator.replace("'", "''")
    where = "" if blank else f" WHERE regexp_matches(u, '[^{BLANK}]')"
    return rf"""{name}_l AS (SELECT {keys}, {base} AS base, string_split_regex({column}, '{sep}') AS us, regexp_extract_all({column}, '{sep}') AS gs FROM {source}),
{name}_u AS (SELECT {keys}, base, unnest(range(1, len(us) + 1)) AS k, unnest(us) AS u, unnest(list_prepend('', gs)) AS g FROM {name}_l),
{name} AS (SELECT {keys}, k, u, s FROM (SELECT {keys}, k, u, CAST(base + sum(length(u) + length(g)) OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING) - length(u) AS BIGINT) AS s FROM {name}_u){where})"""


def paragraphs() -> str:
    return pieces("para", "d", "t", r"\r\n\r\n|\n\n")


def blocks() -> str:
    return pieces("block", "d", "t", r"\n\n")


def sentences() -> str:
    """Sentences: their ends are marked by chr(1), marks after an abbreviation hidden as chr(2) to chr(4) meanwhile."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    t = "t"
    for k, mark in enumerate((r"\.", r"\?", "!"), 2):
        t = rf"regexp_replace({t}, '((?:^|[^\pL\pN]|[{OPENS}])(?:{short})){mark}', '\1' || chr({k}), 'g')"
    t = rf"regexp_replace({t}, '([。！？；])', '\1' || chr(1), 'g')"
    t = rf"regexp_replace({t}, '([.?!])([{BLANK}]+[\p{{Lu}}{OPENS}])', '\1' || chr(1) || '\2', 'g')"
    t = rf"regexp_replace({t}, '(\r\n\r\n|\n\n)', chr(1) || '\1', 'g')"
    return rf"""sent_l AS (SELECT doc_id, string_split(translate({t}, chr(2) || chr(3) || chr(4), '.?!'), chr(1)) AS us FROM d),
sent_u AS (SELECT doc_id, unnest(range(1, len(us) + 1)) AS k, unnest(us) AS u FROM sent_l),
sent_s AS (SELECT doc_id, k, u, CAST(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(u) AS BIGINT) AS s FROM sent_u),
sent AS (SELECT doc_id, k, s + length(u) - length(regexp_replace(u, '^[{BLANK}]+', '')) AS s, regexp_replace(regexp_replace(u, '^[{BLANK}]+', ''), '[{BLANK}]+$', '') AS u FROM sent_s WHERE regexp_matches(u, '[^{BLANK}]'))"""


def issues(code: str, issue_type: str, severity: str, corpus: str, ctes: str, found: str) -> str:
    """The whole query: ``found`` selects doc_id, s, n (place and length), suggestion[, code]."""
    return rf"""
WITH {texts(corpus)}, {ctes}{',' if ctes else ''}
found_ AS ({found})
SELECT doc_id, {f"'{code}'" if code else 'code'} AS code, '{issue_type}' AS issue_type, '{severity}' AS severity, CAST(strlen(left(t, CAST(s AS BIGINT))) AS INTEGER) AS "offset",
CAST(strlen(substr(t, CAST(s AS BIGINT) + 1, CAST(n AS BIGINT))) AS INTEGER) AS length, substr(t, CAST(s AS BIGINT) + 1, CAST(n AS BIGINT)) AS found, CAST(suggestion AS VARCHAR) AS suggestion FROM found_ JOIN d USING (doc_id)
"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _count(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


def _alt(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _counted(cte: str, name: str, test: str, having: str) -> str:
    """One empty span at the first of the units that pass, if the document meets ``having``."""
    return f"SELECT doc_id, min(s) FILTER (WHERE {test}) AS s, 0 AS n, NULL AS suggestion FROM {name} JOIN d USING (doc_id) GROUP BY doc_id, t HAVING {having.format(hits=f'count_if({test})')}"


def _connective(opener: str, closer: str, chars: int) -> str:
    gap = chars - len(closer)
    return f"{opener}(?s:.{{0,{gap}}}?){closer}" if opener != "當" else f"當(?:|[^{style.NOT_WHEN}](?s:.{{0,{gap - 1}}}?)){closer}"


def _connectives(source: str, dropped: bool) -> str:
    """Every pattern's hits in the units of ``source`` (doc_id, k, s, u)."""
    parts = []
    for n, (opener, closer, chars, first) in enumerate(style.CONNECTIVES):
        q = _connective(opener, closer, chars)
        cut = f"substr(w, {len(opener) + 1})" if first else f"left(w, length(w) - {len(closer)})"
        parts.append(rf"""SELECT doc_id, CAST(s + sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w) AS BIGINT) AS s, length(w) AS n, {cut if dropped else 'NULL'} AS suggestion
FROM (SELECT doc_id, k, s, unnest(range(len(h))) AS i, unnest(h) AS w, unnest(string_split_regex(u, '{q}')[1:len(h)]) AS gap FROM (SELECT *, regexp_extract_all(u, '{q}') AS h FROM {source}) WHERE len(h) > 0) q{n}""")
    return " UNION ALL ".join(parts)


def style_oracles(corpus: str) -> dict[str, str]:
    """SQL of every rule of ``style``, by the rule's name."""
    ai, trans = ("ai_style",), ("translationese",)
    para, sent, block = paragraphs(), sentences(), blocks()
    out: dict[str, str] = {}

    senses = " ".join(f"WHEN {_any('w', clues)} THEN '{word}'" for word, clues in style.SENSES)
    out["meaning"] = f"""WITH {hits_sql(corpus, '意味著')},
v AS (SELECT x.*, regexp_extract(left(t, p), '[^。？！?!\\n]*$') || regexp_extract(substr(t, p + 1), '^[^。？！?!\\n]*') AS w FROM x JOIN c USING (doc_id))
SELECT doc_id, 'a1_meaning' AS code, 'ai_style' AS issue_type, 'info' AS severity, CAST(b AS INTEGER) AS "offset", 9 AS length, f AS found, CASE {senses} END AS suggestion FROM v"""

    side = "{f}({x}, coalesce(list_filter(range(0, 81), lambda n: strlen({f}({x}, n)) >= 80)[1], 80))"
    near = f"{side.format(f='right', x='pre')} || f || {side.format(f='left', x='post')}"
    out["copulas"] = f"""WITH {hits_sql(corpus, '|'.join(style.COPULAS))}
SELECT doc_id, 'a2_copula' AS code, 'ai_style' AS issue_type, 'info' AS severity, CAST(b AS INTEGER) AS "offset", CAST(strlen(f) AS INTEGER) AS length, f AS found, CAST(NULL AS VARCHAR) AS suggestion FROM x
WHERE NOT (f = '作為' AND regexp_matches(pre, '[所大]$')) AND NOT (f = '擁有' AND regexp_matches(post, '^[權者感量]')) AND {_any(f'({near})', style.TECHNICAL)}"""

    phrases = ", ".join(f"('{p}', {t})" for p, t in style.DENSITY)
    out["densities"] = issues("a6_density", *ai, "warning", corpus, "", f"""SELECT doc_id, instr(t, w) - 1 AS s, length(w) AS n, NULL AS suggestion FROM d, (VALUES {phrases}) v(w, most)
WHERE length(t) >= 500 AND ((length(t) - length(replace(t, w, ''))) / length(w)) * 1000.0 / length(t) > most""")

    groups = []
    for openers, turns in style.CONTRASTS:
        groups.append(f"SELECT doc_id, s + instr(u, o) - 1 AS s FROM (SELECT doc_id, s, u, list_filter({_list(openers)}, lambda o: contains(u, o))[1] AS o FROM stop) WHERE o IS NOT NULL AND {_any('substr(u, instr(u, o) + length(o))', turns)}")
    stops = pieces("stop", "block", "u", "[。！？]", "s", "doc_id, k", True).replace("PARTITION BY doc_id, k ORDER BY k", "PARTITION BY doc_id, k ORDER BY j")
    stops = f"""stop_l AS (SELECT doc_id, k, s AS base, string_split_regex(u, '[。！？]') AS us FROM block),
stop_u AS (SELECT doc_id, k, base, unnest(range(len(us))) AS j, unnest(us) AS u FROM stop_l),
stop AS (SELECT doc_id, u, CAST(base + sum(length(u) + 1) OVER (PARTITION BY doc_id, k ORDER BY j ROWS UNBOUNDED PRECEDING) - length(u) - 1 AS BIGINT) AS s FROM stop_u)"""
    out["binary_contrast"] = issues("a7_binary_contrast", *ai, "info", corpus, f"{block},\n{stops}, hit AS ({' UNION ALL '.join(groups)})", "SELECT doc_id, min(s) AS s, 0 AS n, NULL AS suggestion FROM hit JOIN d USING (doc_id) GROUP BY doc_id, t HAVING length(t) >= 500 AND count(*) >= 3 AND count(*) * 1000.0 / length(t) > 5")

    trimmed = f"regexp_replace(regexp_replace(u, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')"
    tail = f"(SELECT right(w, coalesce(list_filter(range(0, 91), lambda n: strlen(right(w, n)) >= 90)[1], 90)) FROM (SELECT {trimmed} AS w))"
    out["paragraph_endings"] = issues("a8_paragraph_endings", *ai, "info", corpus, f"{block}, tail AS (SELECT doc_id, s, {tail} AS u FROM block)", _counted("", "tail", _any("u", style.ENDINGS), "count(*) >= 5 AND {hits} >= 3"))
    out["dashes"] = issues("a9_dashes", *ai, "info", corpus, block, _counted("", "block", f"{_count('u', '—')} >= 3", "{hits} >= 3"))
    lines = pieces("line", "d", "t", r"\n", blank=True)
    out["formulaic_headings"] = issues("a10_formulaic_headings", *ai, "info", corpus, lines, _counted("", "line", f"regexp_matches(u, '^[{BLANK}]*#') AND {_any('u', style.HEADINGS)}", "{hits} >= 2"))
    listed = rf"len(list_filter(list_transform(string_split(u, chr(10)), lambda w: regexp_replace(regexp_replace(w, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')), lambda w: starts_with(w, '- ') OR starts_with(w, '* ') OR (strlen(w) > 2 AND regexp_matches(w, '^[0-9]') AND instr(w, '. ') > 0 AND strlen(left(w, instr(w, '. ') - 1)) < 4))) > 0"
    out["list_density"] = issues("a11_list_density", *ai, "info", corpus, block, _counted("", "block", listed, "count(*) >= 5 AND {hits} >= 3 AND {hits} / count(*) > 0.4"))

    out["tricolons"] = issues("a13_tricolon", *ai, "info", corpus, sent, f"""SELECT doc_id, s + a[j].b AS s, a[j + 2].b + a[j + 2].n - a[j].b AS n, NULL AS suggestion FROM (
SELECT *, list_filter(range(1, len(a) - 1), lambda i: a[i].n BETWEEN 1 AND 8 AND a[i].n = a[i + 1].n AND a[i].n = a[i + 2].n)[1] AS j FROM (
SELECT doc_id, s, list_transform(range(1, len(v) + 1), lambda i: {{'n': length(v[i]), 'b': length(array_to_string(v[1:i], '、')) - length(v[i])}}) AS a FROM (SELECT doc_id, s, string_split(regexp_replace(u, '[。！？；.!?]+$', ''), '、') AS v FROM sent WHERE contains(u, '、')))) WHERE j IS NOT NULL""")

    item = rf"regexp_extract(u, '^[{BLANK}]*(?:[-*] |[0-9]+[.)](?:[ \t]|\r?$))')"
    out["bullets"] = issues("a16_bullets", *ai, "info", corpus, lines, rf"""SELECT doc_id, min_by(s + length(regexp_extract(u, '^[{BLANK}]*')), k) AS s, 1 AS n, NULL AS suggestion FROM (
SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM line WHERE {item} <> '') GROUP BY doc_id, island
HAVING count(*) >= 3 AND bool_and(regexp_matches(u, '^[{BLANK}]*(?:[-*] |[0-9]+[.)][{BLANK}]*)\*\*'))""")

    runs = "(" + _count("u", "**") + " // 2)"
    out["bold"] = issues("", *ai, "info", corpus, f"{sent},\n{para}", f"""SELECT doc_id, s, least(2, length(u)) AS n, NULL AS suggestion, 'a17_bold_sentence' AS code FROM sent WHERE {runs} BETWEEN 2 AND 4
UNION ALL SELECT doc_id, s, least(2, length(u)), NULL, 'a17_bold_paragraph' FROM para WHERE length(u) >= 30 AND {runs} >= greatest(3, ceil(length(u) * 3 / 200))""")
    out["em_dashes"] = issues("a18_em_dash", *ai, "info", corpus, para, f"SELECT doc_id, s + instr(u, '——') - 1 AS s, 2 AS n, NULL AS suggestion FROM para WHERE {_count('u', '——')} >= 2")
    firsts = ", ".join(f"{{'p': instr(u, '{w}'), 'n': {len(w)}}}" for w in style.ABSTRACT_LINES)
    out["line_metaphor"] = issues("a22_line_metaphor", *ai, "info", corpus, para, f"""SELECT doc_id, s + w.p - 1 AS s, w.n AS n, NULL AS suggestion FROM (SELECT *, list_sort(list_filter([{firsts}], lambda q: q.p > 0))[1] AS w FROM para)
WHERE w IS NOT NULL AND {_count('u', '這條線')} + {_count('u', '這條路')} >= 2 AND {_any('u', style.GROWTH)}""")

    halves = "CASE WHEN contains(w, '；') THEN instr(w, '；') WHEN contains(w, '，') THEN instr(w, '，') WHEN contains(w, ',') THEN instr(w, ',') END"
    parallel = f"""length(w) BETWEEN 8 AND 80 AND ((contains(w, '不是') AND contains(w, '而是')) OR (contains(w, '不只') AND (contains(w, '更是') OR contains(w, '也是'))) OR {_count('w', '越')} >= 2
OR coalesce(h - 1 >= 3 AND length(w) - h >= 3 AND abs((h - 1) - (length(w) - h)) <= 8, FALSE))"""
    out["slogans"] = issues("a23_slogan", *ai, "info", corpus, f"{sent},\n{para}", f"""SELECT doc_id, min(s) AS s, least(8, max(length(t)) - min(s)) AS n, NULL AS suggestion FROM (
SELECT q.*, t FROM (SELECT *, {halves} AS h FROM (SELECT sent.doc_id, sent.s, sent.u, para.k AS pk, regexp_replace(regexp_replace(sent.u, '[。！？!?]+$', ''), '[{BLANK}]+$', '') AS w FROM sent JOIN para ON sent.doc_id = para.doc_id AND sent.s >= para.s AND sent.s + length(sent.u) <= para.s + length(para.u))) q JOIN d USING (doc_id) WHERE {parallel})
GROUP BY doc_id, u HAVING count(DISTINCT pk) > 1""")

    passive = f"({_count('u', '被')} - len(regexp_extract_all(u, '{'|'.join(style.PASSIVES_ALLOWED)}')))"
    out["passives"] = issues("t1_passive", *trans, "warning", corpus, para, f"SELECT doc_id, s, least(2, length(u)) AS n, NULL AS suggestion FROM para WHERE length(u) >= 20 AND {passive} > greatest(2, ceil(length(u) * 2 / 100))")
    out["abstract_subjects"] = issues("t2_abstract_subject", *trans, "info", corpus, sent, f"SELECT doc_id, s, length(u) AS n, NULL AS suggestion FROM sent WHERE {_any('left(u, 20)', style.ABSTRACT_NOUNS)} AND {_any('u', style.ABSTRACT_VERBS)}")
    out["late_conditions"] = issues("", *trans, "info", corpus, sent, f"""SELECT doc_id, s + length(u) // 2 + instr(v, w) - 1 AS s, length(w) AS n, NULL AS suggestion, CASE WHEN contains(substr(v, instr(v, w)), '的話') THEN 't3_late_condition_said' ELSE 't3_late_condition' END AS code
FROM (SELECT *, list_filter({_list(style.CONDITIONALS)}, lambda c: contains(v, c))[1] AS w FROM (SELECT *, substr(u, length(u) // 2 + 1) AS v FROM sent WHERE length(u) >= 6)) WHERE w IS NOT NULL""")
    out["pronoun_runs"] = issues("t4_pronoun_run", *trans, "info", corpus, f"{sent},\n{para}", """SELECT doc_id, min(s) AS s, 1 AS n, NULL AS suggestion FROM (
SELECT *, j - row_number() OVER (PARTITION BY doc_id, pk ORDER BY j) AS island FROM (SELECT sent.doc_id, sent.s, sent.u, para.k AS pk, row_number() OVER (PARTITION BY sent.doc_id, para.k ORDER BY sent.s) AS j
FROM sent JOIN para ON sent.doc_id = para.doc_id AND sent.s >= para.s AND sent.s + length(sent.u) <= para.s + length(para.u)) WHERE regexp_matches(u, '^[他她它]')) GROUP BY doc_id, pk, island HAVING count(*) >= 3""")
    clauses = """cl AS (SELECT doc_id, u, CAST(base + sum(length(u) + 1) OVER (PARTITION BY doc_id, k ORDER BY j ROWS UNBOUNDED PRECEDING) - length(u) - 1 AS BIGINT) AS s FROM (
SELECT doc_id, k, base, unnest(range(len(us))) AS j, unnest(us) AS u FROM (SELECT doc_id, k, s AS base, string_split_regex(u, '{sep}') AS us FROM sent)))"""
    out["de_chains"] = issues("t7_de_chain", *trans, "warning", corpus, f"{sent},\n{clauses.replace('{sep}', '[，,]')}", f"SELECT doc_id, s, length(u) AS n, NULL AS suggestion FROM cl WHERE {_count('u', '的')} >= 4")
    out["tenses"] = issues("t9_tense", *trans, "info", corpus, sent, "SELECT doc_id, s, length(u) AS n, NULL AS suggestion FROM sent WHERE regexp_matches(u, '[年月日0-9]') AND len(regexp_extract_all(u, '[曾已過了]')) >= 3")
    out["one_of_density"] = issues("t10_one_of_density", *trans, "info", corpus, para, f"SELECT doc_id, s + instr(u, '之一') - 1 AS s, 2 AS n, NULL AS suggestion FROM para WHERE length(u) >= 100 AND {_count('u', '之一')} >= 2 AND {_count('u', '之一')} * 200.0 / length(u) >= {style.DOMAINS['general'].one_of}")
    out["connectives_by_sentence"] = issues("t11_connective_pair", *trans, "info", corpus, sent, _connectives("sent", True))
    out["connectives"] = issues("t15_connectives", *trans, "info", corpus, f"whole AS (SELECT doc_id, 1 AS k, 0 AS s, t AS u FROM d WHERE NOT {_any('left(t, 100)', style.FORMAL)})", _connectives("whole", False))
    chain = f"{_alt(style.CHAIN_HEADS)}(?:的{_alt(style.CHAIN_HEADS)}){{{style.DOMAINS['general'].chain - 1},}}"
    out["nominal_chains"] = issues("t12_nominal_chain", *trans, "info", corpus, sent, f"""SELECT doc_id, CAST(s + sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w) AS BIGINT) AS s, length(w) AS n, NULL AS suggestion
FROM (SELECT doc_id, k, s, unnest(range(len(h))) AS i, unnest(h) AS w, unnest(string_split_regex(u, '{chain}')[1:len(h)]) AS gap FROM (SELECT *, regexp_extract_all(u, '{chain}') AS h FROM sent) WHERE len(h) > 0)""")
    limit = style.DOMAINS["general"]
    spans = clauses.replace("{sep}", "[，、。；：,;:]")
    out["premodifiers"] = issues("t13_premodifier", *trans, "warning", corpus, f"{sent},\n{spans}", f"""SELECT doc_id, s, max(k + length(noun)) AS n, NULL AS suggestion FROM (
SELECT *, regexp_extract(substr(u, k + 1), '^{IDEOGRAPH}+') AS noun FROM (SELECT doc_id, s, u, unnest(list_filter(range(1, length(u) + 1), lambda k: substr(u, k, 1) = '的')) AS k FROM cl WHERE contains(u, '的') AND NOT regexp_matches(u, '^[我你他她它咱您]')))
WHERE noun <> '' AND k + length(noun) >= {limit.modifier_chars} AND {_count('left(u, k + length(noun))', '的')} >= {limit.modifier_de} AND NOT {_any('left(u, k - 1)', style.SEEN_VERBS)} GROUP BY doc_id, s, u""")
    pairs = " OR ".join(f"(w IN ({', '.join(map(repr, left))}) AND nw IN ({', '.join(map(repr, right))}))" for left, right in style.PAIRS)
    heads = "|".join(style.PAIR_HEADS)
    out["nominal_pairs"] = issues("t16_nominal_pair", *trans, "info", corpus, pieces("cl", "d", "t", "[，。；,\n]"), f"""SELECT doc_id, min_by(b, i) AS s, min_by(nb + length(nw) - b, i) AS n, NULL AS suggestion FROM (
SELECT *, lead(w) OVER q AS nw, lead(gap) OVER q AS ng, lead(b) OVER q AS nb FROM (SELECT doc_id, k, i, w, gap, CAST(s + sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w) AS BIGINT) AS b
FROM (SELECT doc_id, k, s, unnest(range(len(h))) AS i, unnest(h) AS w, unnest(string_split_regex(u, '{heads}')[1:len(h)]) AS gap FROM (SELECT *, regexp_extract_all(u, '{heads}') AS h FROM cl) WHERE len(h) > 1)) WINDOW q AS (PARTITION BY doc_id, k ORDER BY i))
WHERE nw IS NOT NULL AND (ng = '' OR (NOT regexp_matches(ng, '[和與及並且或]') AND ({pairs}))) GROUP BY doc_id, k""")
    out["false_friends"] = f"""WITH {hits_sql(corpus, '|'.join(style.FALSE_FRIENDS))},
v AS (SELECT x.*, length(regexp_replace(left(t, p), '[^，。；,\\n]', '', 'g')) AS clause, t FROM x JOIN c USING (doc_id))
SELECT doc_id, 't17_false_friend' AS code, 'translationese' AS issue_type, 'info' AS severity, CAST(b AS INTEGER) AS "offset", CAST(strlen(f) AS INTEGER) AS length, f AS found, CAST(NULL AS VARCHAR) AS suggestion
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, clause) AS n FROM v) WHERE n > 1 OR regexp_matches(substr(t, p + length(f) + 1), '^[ \\t]{{0,2}}\\([^)]*[A-Za-z][^)]*\\)')"""
    return out
