"""Every query with SQL against DuckDB, over the whole smallest tables; the others by what must hold of them."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hanlens import queries
from hanlens.plans import scan


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got = rows(queries.QUERIES[name](spark, sf_dir).toPandas())
    assert got == rows(duck.execute(queries.ORACLE_SQL[name]).df())
    assert got[1], "nothing found"


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_finds_something(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["doc_id", "n_error", "n_warning", "n_info", "accepted"]
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_queries_read_whole_texts(spark, sf_dir):
    """Every text ends as the driver's does, whatever sample stands before it."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("whole"))
    for source in (queries.short, queries.long):
        both = source(spark, sf_dir).join(given, "doc_id")
        assert both.where(~F.endswith("text", F.coalesce("whole", F.lit("")))).count() == 0


def test_names_are_documented_pairs():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) <= set(entry.queries())


def scanned(spark, sf_dir, profile):
    return {tuple(r) for r in queries._scan(queries.short(spark, sf_dir), profile).collect()}


def test_scan_holds_every_detector(spark, sf_dir):
    """What each rule finds alone, outside excluded ranges, is in the scan unless a longer issue took its place."""
    issues = scan.scan(queries.short(spark, sf_dir), "ai").collect()
    codes = {r.code for r in issues}
    assert {"dictionary", "case", "p6_ascii_quote", "p7_dunhao", "p11_spacing", "p13_repeated_mark", "p16_quote_hierarchy", "p17_cjk_repetition", "p18_latin_repetition", "p19_spaced_acronym"} <= codes
    assert {"a1_meaning", "a2_copula", "a12_zero_width", "a16_bullets", "t5_copula_classifier", "t13_premodifier", "t15_connectives", "t17_false_friend", "r1_a_not_a_ma"} <= codes
    spans = {}
    for r in issues:
        spans.setdefault(r.doc_id, []).append((r.offset, r.offset + r.length))
    for r in queries.QUERIES["dictionary_match"](spark, sf_dir).collect():
        if not any(s <= r.offset and r.offset + r.length <= e for s, e in spans.get(r.doc_id, ())):
            text = queries.short(spark, sf_dir).where(F.col("doc_id") == r.doc_id).first().text
            assert "hanlens:" in text or "://" in text or "/" in text  # it stood in an excluded range


def test_scan_does_not_depend_on_the_layout(spark, sf_dir):
    d = queries.short(spark, sf_dir)
    one = sorted(map(str, scan.scan(d).collect()))
    assert one == sorted(map(str, scan.scan(d.repartition(5)).collect()))


def test_scan_shuffles_nothing(spark, sf_dir):
    plan = scan.converge(queries.short(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1


def test_profiles(spark, sf_dir):
    base, strict, relaxed, ai = (scanned(spark, sf_dir, p) for p in ("base", "strict", "relaxed", "ai"))
    kinds = lambda s: {(r[5], r[6]) for r in s}
    assert any(k == "variant" for _, k in kinds(strict)) and not any(k == "variant" for _, k in kinds(base))
    assert "p5_colon" not in {c for c, _ in kinds(relaxed)} and "grammar" not in {k for _, k in kinds(relaxed)}
    assert {"a7_binary_contrast", "a16_bullets", "a1_meaning"} & {c for c, _ in kinds(ai)} and not {"a16_bullets", "a1_meaning"} & {c for c, _ in kinds(base)}


def test_tiers_fix_more_and_leave_less(spark, sf_dir):
    d = queries.short(spark, sf_dir)
    fixed, left = [], []
    for mode in ("orthographic", "lexical_safe", "lexical_contextual"):
        f = scan.fixed(d, mode).cache()
        fixed.append(f.agg(F.sum("n_edits")).first()[0])
        left.append(scan.scan(f.select("doc_id", F.col("fixed_text").alias("text"))).count())
    assert fixed[0] < fixed[1] < fixed[2] and left[0] > left[1] > left[2]


def test_converged_texts_stay(spark, sf_dir):
    """But for words said many times over, of which a round takes half."""
    few = queries.short(spark, sf_dir).where(~F.col("text").rlike(r"\b(\w{3,}) \1 \1"))
    once = scan.converge(few, rounds=4).cache()
    again = scan.converge(once, rounds=1)
    assert once.count() > 50
    assert once.join(again.withColumnRenamed("text", "more"), "doc_id").where("text <> more").count() == 0


def test_nfc_offsets_point_into_the_original(spark):
    text = "café 的內存"
    r = scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("found = '內存'").first()
    assert text.encode()[r.offset : r.offset + r.length].decode() == "內存"


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (None, ""), (3, "字" * 100_000), (3, "內存" * 20_000)], "doc_id long, text string")
    assert scan.scanned(d, "ai").count() == 4 and scan.fixed(d).count() == 4 and scan.converge(d).count() == 4
    assert scan.scan(d.limit(0)).count() == 0


def test_interval_union_nulls_and_ties(spark, duck, tmp_path):
    """Ranges with nulls against the SQL; a table of equal rows against brute force, since the SQL leaves their order open."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("""CREATE TABLE events AS SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 10.5::DOUBLE), (2, 1, NULL), (NULL, 1, 3.0), (3, NULL, 3.0), (4, NULL, 3.0), (5, 2, NULL), (6, 2, NULL),
        (NULL, 3, 3.0), (NULL, 3, 4.0), (-7, 4, -3.5), (-9, 4, -2.5), (-4, 4, -0.0), (NULL, 5, 3.0), (1, 5, 4.0), (1, 5, NULL), (NULL, 6, 3.0), (1, 6, 3.0)) t (event_id, user_id, value)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = queries.interval_union(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(queries.ORACLE_SQL["interval_union"]).fetchall()))
    con.execute(f"COPY (SELECT k * 10 + h % 3 AS event_id, h % 7 AS user_id, CAST(h % 400 AS DOUBLE) AS value FROM (SELECT i % 100 AS k, (i // 100) * 7919 AS h FROM range(20000) t (i))) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = {}
    for u, s, e in sorted(con.execute(f"SELECT DISTINCT user_id, CAST(value AS INTEGER) AS s, CAST(value AS INTEGER) + 1 + event_id % 5 AS e FROM '{tmp_path}/events.parquet'").fetchall()):
        own = want.setdefault(u, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    got = queries.interval_union(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((u, s, e) for u, own in want.items() for s, e in own)
    assert queries.interval_union(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
