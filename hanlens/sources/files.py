"""Documents, side tables and reports as files."""

from __future__ import annotations

import fcntl
import json
import os
import subprocess
import time
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "markdown", "yml", "yaml", "txt")
MOST_BYTES = 16 << 20


def content_type(path: str | Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.(md|markdown)$"), "markdown").when(p.rlike(r"\.(yml|yaml)$"), "yaml").otherwise("plain")


def _links(path: str) -> list[str]:
    """Symbolic links below a local folder; other stores have none."""
    if "://" in path and not path.startswith("file://"):
        return []
    root = Path(path.removeprefix("file://"))
    return [str(p.absolute()) for p in root.rglob("*") if p.is_symlink()] if root.is_dir() else []


def read_documents(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Text files below a path, hidden ones, links and those over 16 MiB left out: (doc_id, path, text, content_type)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(path)
    below = F.substring("path", F.instr("path", F.lit(path.removeprefix("file://"))) + len(path.removeprefix("file://")), F.length("path"))
    d = raw.where((F.col("length") <= MOST_BYTES) & ~below.rlike(r"(^|/)\.[^/]"))
    for link in _links(path):
        d = d.where(~(F.endswith("path", F.lit(link)) | F.contains("path", F.lit(link + "/"))))
    for glob in exclude:
        d = d.where(~excluded(F.col("path"), glob))
    return d.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").cast("string").alias("text"), content_type("path").alias("content_type"))


def excluded(path: Column, glob: str) -> Column:
    """``*.ext``, ``dir/**`` or a literal path component."""
    if glob.startswith("*."):
        return F.endswith(path, F.lit(glob[1:]))
    part = glob.removesuffix("/**").strip("/")
    return F.contains(F.concat(path, F.lit("/")), F.lit(f"/{part}/"))


def from_text(spark: SparkSession, text: str, path: str = "-") -> DataFrame:
    """One document that the caller holds, as from standard input, with the same bound as a file."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("text too long")
    return spark.createDataFrame([(0, path, text, "plain")], "doc_id long, path string, text string, content_type string")


def changed(docs: DataFrame, repository: str, ref: str) -> DataFrame:
    """Documents that differ from a git reference."""
    if not ref or ref.startswith("-") or any(c.isspace() for c in ref):
        raise ValueError("bad reference")
    names = subprocess.run(["git", "-C", repository, "diff", "--name-only", f"{ref}...HEAD"], check=True, capture_output=True, text=True).stdout.split("\n")
    paths = [("file:" + str(Path(repository, n).resolve()),) for n in names if n]
    wanted = docs.sparkSession.createDataFrame(paths, "path string")
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return docs.withColumn("_plain", plain).join(wanted.withColumnRenamed("path", "_plain"), "_plain", "left_semi").drop("_plain")


def project_config(start: str) -> dict:
    """The nearest ``hanlens.toml`` from a folder up to the repository's root; empty without one."""
    here = Path(start).resolve()
    for d in (here, *here.parents):
        if (d / "hanlens.toml").exists():
            return tomllib.loads((d / "hanlens.toml").read_text())
        if (d / ".git").exists():
            break
    return {}


def scan_project(spark: SparkSession, root: str) -> DataFrame:
    """The scan of a project's files as its configuration asks: ``profile``, ``exclude``, ``domain`` and ``stance``."""
    from ..plans.scan import PROFILES, exploded, scanned

    config = project_config(root)
    known = PROFILES[config.get("profile", "base")]._replace(**{k: config[k] for k in ("domain", "stance") if k in config})
    d = read_documents(spark, root, tuple(config.get("exclude", ())))
    issues = exploded(scanned(d, known, content_type=F.col("content_type")))
    return issues.join(d.select("doc_id", "path"), "doc_id")


RULE_SCHEMA = "rule_id int, `from` string, `to` array<string>, type string, english string, exceptions array<string>, clues array<string>, negative array<string>, positional array<string>, disabled boolean, context string, layer int"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table or pack, JSON lines with an explicit schema."""
    return spark.read.schema(RULE_SCHEMA).json(path)


STORE_VERSION = 1


def read_json_store(path: str) -> dict:
    """A small keyed store; what cannot be read, or has another version, is set aside and the store begins anew."""
    at = Path(path)
    if not at.exists():
        return {}
    try:
        found = json.loads(at.read_text())
        if found["schema_version"] == STORE_VERSION:
            return found["rows"]
    except (ValueError, KeyError, TypeError):
        pass
    at.rename(at.with_name(f"{at.name}.bad-{time.time_ns()}"))
    return {}


def write_json_store(path: str, rows: dict) -> None:
    """Replace a store in one step, one writer at a time."""
    at = Path(path)
    with open(at.with_name(at.name + ".lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        new = at.with_name(f"{at.name}.new-{os.getpid()}")
        new.write_text(json.dumps({"schema_version": STORE_VERSION, "rows": rows}, ensure_ascii=False))
        os.replace(new, at)


def write_store(store: DataFrame, path: str) -> None:
    """Replace a side table; the write is committed as a whole."""
    store.write.mode("overwrite").parquet(path)


def write_lines(report: DataFrame, path: str) -> None:
    report.select("line").write.mode("overwrite").text(path)


def write_fixed(fixed: DataFrame, path: str) -> None:
    fixed.write.mode("overwrite").parquet(path)
