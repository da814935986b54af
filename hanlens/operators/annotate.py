"""Joins of issues with side tables: glossary, suppressions, memory, baseline, judgements, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chars import content_words, identity
from ..functions.spans import matches
from ..rules import COLLOCATIONS, OTHER_SENSES, PRIORS
from .dictionary import alternation

IMMUNE = ("punctuation", "case", "variant", "grammar", "ai_style")


def glossary(issues: DataFrame, proper: list[str], banned: list[str], docs: DataFrame | None = None) -> DataFrame:
    """Proper nouns are no issues; banned terms are errors, and become issues where none covers them."""
    left = issues.where(~F.col("found").isin(proper)) if proper else issues
    if docs is None or not banned:
        return left.withColumn("glossary_banned", F.lit(False))
    spans = docs.select("doc_id", F.explode(matches("coalesce(text, '')", alternation(banned))).alias("s")).select("doc_id", "s.*")
    mine = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("banned"))  # a document's own places, no more than its text holds
    covered = F.exists("banned", lambda b: (F.col("offset") <= b["start"]) & (F.col("offset") + F.col("length") >= b["start"] + b["length"]))
    left = left.join(mine, "doc_id", "left").withColumn("glossary_banned", F.coalesce(covered, F.lit(False))).drop("banned")
    left = left.withColumn("severity", F.when(F.col("glossary_banned"), "error").otherwise(F.col("severity")))
    cover = (left["doc_id"] == spans["doc_id"]) & (left["offset"] <= spans["start"]) & (left["offset"] + left["length"] >= spans["start"] + spans["length"])
    extra = spans.join(left, cover, "left_anti").select("doc_id", F.lit("cross_strait").alias("issue_type"), F.lit("error").alias("severity"), F.col("start").alias("offset"), "length", "found", F.lit(True).alias("glossary_banned"))
    return left.unionByName(extra, allowMissingColumns=True)


def suppressed(issues: DataFrame, terms: DataFrame) -> DataFrame:
    """Issues whose found text is on the list (``term``) become info."""
    on = terms.select(F.col("term").alias("found"), F.lit(True).alias("listed")).distinct()
    return issues.join(on, "found", "left").withColumn("severity", F.when(F.col("listed"), "info").otherwise(F.col("severity"))).drop("listed")


def remembered(issues: DataFrame, memory: DataFrame) -> DataFrame:
    """Translation memory (found, user_chose, seq): terms the user kept last time become info."""
    last = memory.groupBy("found").agg(F.max_by("user_chose", "seq").alias("chose"))
    kept = last.where("chose = found").select("found", F.lit(True).alias("kept"))
    out = issues.join(kept, "found", "left")
    return out.withColumn("severity", F.when(F.col("kept") & ~F.col("issue_type").isin(*IMMUNE), "info").otherwise(F.col("severity"))).drop("kept")


def fingerprint() -> Column:
    return identity(F.col("issue_type"), F.col("found"), F.col("path"))


def baseline_filter(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues that the baseline (fingerprint) does not hold."""
    return issues.withColumn("fingerprint", fingerprint()).join(baseline, "fingerprint", "left_anti")


def baseline_update(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    return baseline.select("fingerprint").unionByName(issues.select(fingerprint().alias("fingerprint"))).distinct()


def consistency(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Terms of one English gloss in a document, and whether the preferred form stands there too."""
    i = issues.where((F.col("severity") != "info") & F.col("rule_type").isin("cross_strait", "confusable") & F.isnotnull("english"))
    g = i.groupBy("doc_id", "english").agg(F.array_sort(F.collect_set("found")).alias("terms"), F.min(F.element_at("suggestions", 1)).alias("preferred"), F.count("*").alias("n"))
    return g.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "english", F.array_join("terms", ",").alias("terms"), "preferred", F.contains("text", "preferred").alias("mixed"), "n")


def _anchor(issues: DataFrame) -> Column:
    """Whether a translation anchors the term; null where nobody looked."""
    return F.col("anchor_match") if "anchor_match" in issues.columns else F.lit(None).cast("boolean")


def eligible(anchor: Column | None = None) -> Column:
    """Tier 2 looks at ambiguous regional terms."""
    anchored_ = F.lit(False) if anchor is None else F.coalesce(anchor, F.lit(False))
    return F.col("rule_type").isin("cross_strait", "confusable") & (anchored_ | (F.size("suggestions") > 1) | (F.size("clues") > 0) | F.col("found").isin(*OTHER_SENSES))


def _said(words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("window"), w))


def tier2(issues: DataFrame, profile: str = "base") -> DataFrame:
    """``issues`` with ``tier2_score``, ``tier2_outcome`` and the term it settles on.

    A hard anchor or a collocation settles it, another sense of the word ends
    it; else clues, the profile's prior and a soft anchor add up.
    """
    anchor = _anchor(issues)
    collocated, prior, preferred = F.lit(None).cast("string"), F.lit(0.0), F.lit(None).cast("string")
    for term, near, to in reversed(COLLOCATIONS):  # the first one whose word is there counts
        collocated = F.when((F.col("found") == term) & F.contains("window", F.lit(near)), to).otherwise(collocated)
    for term, want, weight in PRIORS[profile]:
        prior, preferred = (F.when(F.col("found") == term, v).otherwise(old) for v, old in ((weight, prior), (want, preferred)))
    elsewhere = F.lit(False)
    for term, words in OTHER_SENSES.items():
        elsewhere = elsewhere | ((F.col("found") == term) & _said(words))
    n = F.size(F.filter("clues", lambda c: F.contains(F.col("window"), c)))
    clue = F.when(n > 0, F.least(F.lit(0.7), 0.3 + 0.4 * n / F.size("clues"))).otherwise(0.0)
    bonus = F.when(anchor & (F.size("suggestions") > 1), 0.2).when(~anchor, -0.2).otherwise(0.0)
    hard, fits = F.coalesce(anchor & (F.size("suggestions") == 1), F.lit(False)), F.coalesce(F.array_contains("suggestions", F.col("_collocated")), F.lit(False))
    rows = issues.withColumns({"_collocated": collocated, "_clue": clue, "_prior": prior, "_preferred": preferred})
    score = F.when(hard | fits, 1.0).when(elsewhere, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("_clue") + F.col("_prior") + bonus, 9))))
    first = F.get("suggestions", F.lit(0))
    term = F.when(hard, first).when(fits, F.col("_collocated")).when((F.col("_prior") > F.col("_clue")) & F.array_contains("suggestions", F.col("_preferred")), F.col("_preferred")).otherwise(first)
    rows = rows.withColumn("tier2_score", score).withColumn("tier2_outcome", tier2_outcome("tier2_score")).withColumn("tier2_term", F.when(F.col("tier2_outcome") == "resolved", term))
    return rows.drop("_collocated", "_clue", "_prior", "_preferred")


def tier2_outcome(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.6, "resolved").when(s < 0.3, "suppressed").otherwise("gray")


def promoted(term: Column) -> Column:
    """The suggestions with ``term`` and the first one changed places, if it is among them."""
    swap = F.transform("suggestions", lambda x, k: F.when(k == 0, term).when(x == term, F.get("suggestions", F.lit(0))).otherwise(x))
    return F.when(F.coalesce(F.array_contains("suggestions", term), F.lit(False)), swap).otherwise(F.col("suggestions"))


def tier2_apply(issues: DataFrame, profile: str = "base") -> DataFrame:
    """Eligible terms settled or suppressed: the settled suggestion first, suppressed ones info."""
    out = tier2(issues, profile)
    on = F.coalesce(eligible(_anchor(issues)), F.lit(False))
    out = out.withColumns({c: F.when(on, F.col(c)) for c in ("tier2_score", "tier2_outcome", "tier2_term")})
    out = out.withColumn("suggestions", F.when(F.isnotnull("tier2_term"), promoted(F.col("tier2_term"))).otherwise(F.col("suggestions")))
    return out.withColumn("severity", F.when(F.col("tier2_outcome") == "suppressed", "info").otherwise(F.col("severity")))


def confirmed(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of a bulk question (doc_id, offset, keep): what is not kept becomes info."""
    out = issues.join(answers, ["doc_id", "offset"], "left")
    return out.withColumn("severity", F.when(~F.col("keep"), "info").otherwise(F.col("severity"))).drop("keep")


def judged(issues: DataFrame, judgements: DataFrame) -> DataFrame:
    """Gray terms with a judgement (found, context_key, chosen): promoted, or info when rejected."""
    out = issues.join(judgements, ["found", "context_key"], "left")
    take = F.col("chosen").isNotNull() & F.array_contains("suggestions", F.col("chosen"))
    out = out.withColumn("llm_judged", F.col("confidence").isNotNull())
    out = out.withColumn("suggestions", F.when(take, promoted(F.col("chosen"))).otherwise(F.col("suggestions")))
    return out.withColumn("severity", F.when(F.col("llm_judged") & F.isnull("chosen"), "info").otherwise(F.col("severity"))).drop("chosen", "confidence")


def resolution_tier() -> Column:
    return F.when(F.col("llm_judged"), "llm").when(F.isnull("tier2_outcome"), "deterministic").when(F.col("tier2_outcome") == "gray", "unresolved").otherwise("heuristic")


def translation_requests(issues: DataFrame, most_bytes: int = 4096) -> DataFrame:
    """What a translator is asked (S10): each distinct window of a document once, numbered into payloads of about ``most_bytes``."""
    order = Window.partitionBy("doc_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    d = issues.where(F.isnotnull("english")).select("doc_id", "window").distinct()
    return d.withColumn("payload", F.floor(F.coalesce(F.sum(F.octet_length("window")).over(order), F.lit(0)) / most_bytes))


def judgement_requests(issues: DataFrame, most: int = 5) -> DataFrame:
    """What a judge is asked (S11): of each document the first ``most`` terms, those that tier 2 left gray before the others; a bound of the protocol."""
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("tier2_outcome") == "gray", 0).otherwise(1), "offset")
    asked = issues.where(F.col("tier2_outcome").isin("gray", "resolved"))
    return asked.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)


def anchored(issues: DataFrame, translations: DataFrame) -> DataFrame:
    """Whether the translated context (doc_id, words) holds a content word of the gloss; null without either."""
    out = issues.join(translations, "doc_id", "left")
    words = content_words(F.col("english"))
    return out.withColumn("anchor_match", F.when(F.isnull("english") | F.isnull("words") | (F.size(words) == 0), None).otherwise(F.arrays_overlap(words, F.col("words")))).drop("words")


def explained(issues: DataFrame) -> DataFrame:
    """Domain tag, confidence, whether a fix is safe and whether someone should look."""
    one = (F.size("suggestions") == 1) & (F.element_at("suggestions", 1) != "")
    confidence = F.when(F.col("severity") == "error", "high").when(one & (F.size("clues") == 0), "high").when(F.size("suggestions") > 1, "low").otherwise("medium")
    return issues.withColumns({"confidence": confidence, "auto_fix_safe": one & (F.size("clues") == 0), "needs_review": (F.size("suggestions") != 1) | (F.size("clues") > 0)})


def upsert(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those with their key."""
    return store.join(changes.select(key), key, "left_anti").unionByName(changes)


def remove(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def conflicts(rules: DataFrame) -> DataFrame:
    """Terms that two layers map to different suggestions."""
    return rules.groupBy("from").agg(F.count_distinct(F.array_join("to", ",")).alias("variants"), F.array_sort(F.collect_set("layer")).alias("layers")).where("variants > 1")


def fresh(cache: DataFrame, now: int, ttl: int, most: int, key: list[str]) -> DataFrame:
    """Cache rows (..., created_at) not older than ``ttl``, the newest ``most`` of them (O32); a top-k, so no task holds more."""
    return cache.where(F.col("created_at") >= now - ttl).orderBy(F.desc("created_at"), *key).limit(most)


def to_scan(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents whose content and parameters no cache row holds: the only ones to scan again."""
    return docs.join(cache.select("content_key"), "content_key", "left_anti")
