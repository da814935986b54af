"""Line dedup by site-relative frequency (operator 1), native.

Pages are grouped by host.  A line is boilerplate on a host when the pages that
hold it are more than ``RATIO`` of the host's pages; such lines are dropped from
every page of that host.  A ratio says nothing about a host of fewer than
``1 / RATIO`` pages, where being on a single page exceeds it; so a line must also
be on ``least_pages(RATIO)`` pages, the most that such a host can have.

Lines are counted once a page under a 128-bit key, partial counts first, so a
line on every page of a huge host costs a task one row.  On one host there are
at most ``lines a page / RATIO`` boilerplate lines, since each is on more than
``RATIO`` of its pages; that short list meets the pages by host.  Hosts with an
outsized share of pages (fewer than 1 / ``graph.HOT_SHARE``) get their list by
broadcast, so no reducer holds one host's pages.

Cases: null HTML has no line; a null or malformed URL belongs to the host ``''``;
blank lines are no lines; a line repeated on a page counts once for the page and
all its places are dropped; a very long line is one key like any other, and a
very long page is split in its own row; a line on exactly ``RATIO`` of the pages
(a tie) stays; repeated rows are pages of their own; hosts of fewer than
``least_pages`` pages lose nothing; an empty table gives an empty result.  Other
columns stay in ``drop_site_lines``, in a struct, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import skew_lookup

RATIO = 0.3
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BREAK = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|article|section|header|footer|nav|aside|main|title|head|body|html|blockquote|pre|form|figure|dl|dt|dd|br|hr)\b[^>]*>|[\r\n]+"
_TAG = r"<[^>]*>"
_BLANK = r"[ \t\x0B\f]+"
_LINE_END = r" ?\n[ \n]*"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def least_pages(ratio: float) -> int:
    """The most pages a host can have on which one page alone exceeds the ratio."""
    return math.ceil(1 / ratio) - 1


def host(url: str | Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def text_of(html: str | Column) -> Column:
    """Visible text, one block a line, blanks run together."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, "\n")
    t = F.regexp_replace(F.regexp_replace(t, _BREAK, "\n"), _TAG, "")
    for name, sign in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(t, _BLANK, " "), _LINE_END, "\n")


def lines_of(text: Column) -> Column:
    """The lines that are not blank; ``text`` has no blanks at line ends."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, lines) to (host, pages, common): the keys of each host's boilerplate lines."""
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    keys = pages.select("host", F.explode(F.transform(F.array_distinct("lines"), _key)).alias("key"))
    often = keys.groupBy("host", "key.h1", "key.h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages(ratio))
    often = skew_lookup(often, hosts.withColumn("weight", F.col("pages")), "host", "weight").where(F.col("n") > ratio * F.col("pages"))
    common = often.groupBy("host").agg(F.collect_set(F.struct("h1", "h2")).alias("common"))
    return hosts.join(common, "host", "left")


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``host``, ``n_lines``, ``n_dropped`` and ``kept_text`` in one struct column ``site_lines``."""
    read = pages.select(F.struct(*pages.columns).alias("page"), host(url_col).alias("host"), lines_of(text_of(F.col(html_col))).alias("lines"))
    return _dropped(written(read, "pages"), "page", ratio)


def _dropped(read: DataFrame, carried: str, ratio: float) -> DataFrame:
    lists = written(boilerplate(read.select("host", "lines"), ratio), "site-lines")
    met = skew_lookup(read, lists.withColumn("weight", F.col("pages")), "host", "weight")
    left = F.when(F.isnull("common"), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", _key(x))))
    n = F.size("lines").cast("long")
    met = met.withColumn("left", left)
    out = F.struct("host", n.alias("n_lines"), (n - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept_text"))
    return met.select(carried, out.alias("site_lines"))


def line_dedup_report(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, kept_sha256) for every page."""
    read = pages.select("page_id", host("url").alias("host"), lines_of(text_of(F.col("html"))).alias("lines"))
    out = _dropped(written(read, "pages"), "page_id", ratio)
    return out.select("page_id", "site_lines.host", "site_lines.n_lines", "site_lines.n_dropped", F.sha2(F.col("site_lines.kept_text").cast("binary"), 256).alias("kept_sha256"))


def _sql_text(column: str) -> str:
    t = f"regexp_replace(coalesce({column}, ''), '{_UNSEEN}', chr(10), 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{_BREAK}', chr(10), 'g'), '{_TAG}', '', 'g')"
    for name, sign in _ENTITIES:
        t = f"replace({t}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')".replace("'&#39;'", "'&#39;'")
    return f"regexp_replace(regexp_replace({t}, '{_BLANK}', ' ', 'g'), '{_LINE_END}', chr(10), 'g')"


ORACLE = rf"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, lower(coalesce(regexp_extract(url, '{_HOST}', 1), '')) AS host,
         list_filter(list_transform(string_split({_sql_text("html")}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
e AS (SELECT r, page_id, host, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM p),
b AS (SELECT host, line FROM (SELECT DISTINCT r, host, line FROM e) JOIN h USING (host) GROUP BY host, line, pages HAVING count(*) >= {least_pages(RATIO)} AND count(*) > {RATIO} * pages),
l AS (SELECT r, count(*) AS kept, string_agg(line, chr(10) ORDER BY k) AS t FROM e ANTI JOIN b USING (host, line) GROUP BY 1)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(kept, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM p LEFT JOIN l USING (r)
"""
