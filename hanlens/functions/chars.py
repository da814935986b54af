"""Character classes and scalar text functions, all Catalyst expressions.

Classes are written as regular-expression ranges that Java and RE2 share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges.
IDEOGRAPH = r"\x{3100}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{2EBF0}-\x{2EE5F}\x{30000}-\x{3134F}\x{31350}-\x{323AF}"
CONTEXT = IDEOGRAPH + r"\x{3001}-\x{303F}\x{FF01}-\x{FF60}\x{FF61}-\x{FF65}\x{FE30}-\x{FE4F}"
NARROW = r"\x{4E00}-\x{9FFF}"
FULL_PUNCTUATION = r"\x{3001}-\x{3003}\x{3008}-\x{3011}\x{3014}-\x{301B}\x{FF01}\x{FF08}\x{FF09}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{2014}\x{2026}"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
CLAUSE_END = "，。；,\n"
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{200E}\x{200F}"


def count_of(text: Column, cls: str) -> Column:
    """How many characters of a class ``text`` holds."""
    return F.regexp_count(text, F.lit(f"[{cls}]"))


def fold_digits(text: Column) -> Column:
    return F.translate(text, FULL_DIGITS, DIGITS)


def script(text: Column, simplified: str, traditional: str) -> Column:
    """``traditional``, ``simplified`` or ``unknown``: which set's characters are strictly more."""
    s = F.length(text) - F.length(F.translate(text, simplified, ""))
    t = F.length(text) - F.length(F.translate(text, traditional, ""))
    return F.when(s > t, "simplified").when(t > s, "traditional").otherwise("unknown")


def effective_suggestions(to: Column, english: Column) -> Column:
    """Non-empty suggestions; ``[""]`` alone means delete; else the English gloss."""
    some = F.filter(to, lambda x: x != "")
    return F.when((F.size(to) == 1) & (F.element_at(to, 1) == ""), to).when(F.size(some) > 0, some).when(F.isnotnull(english), F.array(english)).otherwise(some)


def compact_suggestion(to: Column) -> Column:
    """``(delete)``, the only suggestion, or the first and how many more."""
    first = F.element_at(to, 1)
    return F.when(F.size(to) == 0, "").when(first == "", "(delete)").when(F.size(to) == 1, first).otherwise(F.concat(first, F.lit("+"), (F.size(to) - 1).cast("string")))


def suggested_rewrite(rule_type: Column, to: Column) -> Column:
    """The first non-empty suggestion, of translationese only."""
    return F.when(rule_type == "translationese", F.get(F.filter(to, lambda x: x != ""), F.lit(0)))


def escape_tsv(field: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        field = F.replace(field, F.lit(a), F.lit(b))
    return field


def cache_context(context: Column) -> Column:
    """Whitespace-free middle 80 characters, with the key's version."""
    bare = F.regexp_replace(context, r"\s+", "")
    low = F.greatest((F.length(bare) - 80) / 2, F.lit(0)).cast("int")
    return F.concat(F.lit("v1:"), F.substring(bare, low + 1, F.lit(80)))


def compressed_locations(locations: Column) -> Column:
    """``line:col`` pairs ``array<struct<line, col>>`` as text: lines first and the column once where all share it."""
    shared = F.forall(locations, lambda x: x["col"] == F.element_at(locations, 1)["col"])
    lines = F.array_join(F.transform(locations, lambda x: x["line"].cast("string")), ",")
    each = F.array_join(F.transform(locations, lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["col"].cast("string"))), ",")
    return F.when(F.size(locations) == 0, "").when((F.size(locations) > 1) & shared, F.concat(lines, F.lit(":"), F.element_at(locations, 1)["col"].cast("string"))).otherwise(each)


def identity(*parts: Column) -> Column:
    """Identity of a tuple: SHA-256 over its parts, each with its length."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


STOP_WORDS = ("a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is", "are", "with", "by")


def content_words(english: Column) -> Column:
    """Distinct lower-case ASCII words without stop words."""
    words = F.filter(F.split(F.lower(english), "[^a-z0-9]+"), lambda x: x != "")
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))
