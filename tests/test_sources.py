"""Files in, reports out, and the scan over arriving files."""

from pyspark.sql import functions as F

from hanlens.operators import dictionary
from hanlens.plans import report
from hanlens.plans.scan import exploded, fixed, scan, scanned
from hanlens.rules import Rule
from hanlens.sources import files, rpc
from hanlens.streaming.files import scan_stream, stream_documents


def tree(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("這個軟件很好,但是內存大。")
    (tmp_path / "docs" / "b.txt").write_text("沒有問題。")
    (tmp_path / "docs" / ".hidden.md").write_text("軟件")
    (tmp_path / "docs" / "c.py").write_text("軟件")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "d.yaml").write_text("名稱: 軟件")
    return str(tmp_path)


def test_directory_walk(spark, tmp_path):
    d = files.read_documents(spark, tree(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.content_type) for r in d.collect()) == [("a.md", "markdown"), ("b.txt", "plain"), ("d.yaml", "yaml")]
    assert files.read_documents(spark, str(tmp_path), ("skip/**", "*.txt")).count() == 1


def test_links_and_hidden_folders_are_left_out(spark, tmp_path):
    root = tmp_path / "r"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "x.md").write_text("軟件")
    (root / "a.md").write_text("軟件")
    (root / "b.md").symlink_to(root / "a.md")
    assert [r.path.rsplit("/", 1)[1] for r in files.read_documents(spark, str(root)).collect()] == ["a.md"]


def test_changed_files(spark, tmp_path):
    import subprocess

    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)

    git("init", "-b", "main")
    (tmp_path / "a.md").write_text("一")
    (tmp_path / "xa.md").write_text("一")
    git("add", ".")
    git("commit", "-m", "1")
    git("checkout", "-b", "w")
    (tmp_path / "a.md").write_text("軟件")
    git("commit", "-am", "2")
    d = files.read_documents(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.changed(d, str(tmp_path), "main").collect()] == ["a.md"]
    for bad in ("", "-x", "a b"):
        try:
            files.changed(d, str(tmp_path), bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_scan_and_sinks(spark, tmp_path):
    d = files.read_documents(spark, tree(tmp_path), ("skip/**",))
    issues = exploded(scanned(d, content_type=F.col("content_type"))).cache()
    assert {r.found for r in issues.collect()} == {"軟件", "內存", ","}
    counts = {r.n_warning: r.accepted for r in report.gate(report.severity_counts(issues, d), 0, 1).collect()}
    assert counts == {3: False, 0: True}
    for lines in (report.as_json(issues), report.as_tabular(issues), report.as_human(issues), report.as_sarif(issues, d)):
        out = str(tmp_path / "out")
        files.write_lines(lines, out)
        assert spark.read.text(out).count() == 3
    files.write_fixed(fixed(d).select("doc_id", "fixed_text"), str(tmp_path / "fixed"))
    assert any("軟體" in r.fixed_text for r in spark.read.parquet(str(tmp_path / "fixed")).collect())
    assert report.search_replace(issues).where(F.contains("block", F.lit("軟體"))).count() == 1


def test_config_and_stores(spark, tmp_path):
    (tmp_path / "hanlens.toml").write_text('profile = "strict"\nexclude = ["skip/**"]\n')
    (tmp_path / "x").mkdir()
    assert files.project_config(str(tmp_path / "x")) == {"profile": "strict", "exclude": ["skip/**"]}
    tree(tmp_path)
    (tmp_path / "docs" / "v.txt").write_text("着色的軟件")
    by_config = files.scan_project(spark, str(tmp_path)).collect()
    assert {r.found for r in by_config} >= {"着", "軟件"} and not any("/skip/" in r.path for r in by_config)
    files.write_store(spark.range(3), str(tmp_path / "store"))
    files.write_store(spark.range(5), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 5
    assert files.from_text(spark, "內存").count() == 1


def test_store_survives_a_bad_file(spark, tmp_path):
    path = tmp_path / "terms.json"
    files.write_json_store(str(path), {"軟件": 1})
    assert files.read_json_store(str(path)) == {"軟件": 1}
    path.write_text("{broken")
    assert files.read_json_store(str(path)) == {} and list(tmp_path.glob("terms.json.bad*"))
    path.write_text('{"schema_version": 99, "rows": {"a": 1}}')
    assert files.read_json_store(str(path)) == {}


def test_rule_tables_round_trip(spark, tmp_path):
    rules = [Rule(1, "甲", ("乙",), "typo", None, ("甲子",), ("x",), (), ("before:y",))]
    dictionary.rule_table(spark, rules).write.json(str(tmp_path / "pack"))
    assert dictionary.rules_of(files.read_rules(spark, str(tmp_path / "pack"))) == rules


def test_rpc(spark):
    asked = [
        '{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"jsonrpc":"2.0","id":"a","method":"ping"}', '{"jsonrpc":"2.0","method":"ping"}', "{broken", '{"jsonrpc":"2.0","id":2,"method":"nope"}',
        '{"jsonrpc":"2.0","id":3,"method":"tools/call","params":{"name":"lint","arguments":{"text":"軟件很好"}}}', '{"jsonrpc":"2.0","id":4,"method":"tools/call","params":{"name":"lint"}}',
    ]
    import json

    got = {json.dumps(m.get("id")): m for m in map(json.loads, (r.line for r in rpc.answers(spark.createDataFrame([(x,) for x in asked], "line string")).collect()))}
    assert len(got) == 6 and got["1"]["result"]["capabilities"] and got['"a"']["result"] == {}
    assert [got[k]["error"]["code"] for k in ("null", "2", "4")] == [rpc.PARSE_ERROR, rpc.NO_METHOD, rpc.BAD_PARAMETERS]
    assert "軟體" in got["3"]["result"]["content"][0]["text"]


def test_stream(spark, tmp_path):
    tree(tmp_path)
    query = scan_stream(stream_documents(spark, str(tmp_path / "docs")), str(tmp_path / "issues"), str(tmp_path / "at"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "issues")).where("found = '軟件'").count() >= 1
