"""Shared pieces of the training-data operators.

Everything here is independent of the rest of the library.  Conventions:

* a null text counts as an empty one;
* words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``, which is
  what ``bytes.split()`` yields, so no Unicode space ever separates words;
* intermediate tables are Parquet below ``spark.checkpoint.dir``: they cut
  lineage and survive the loss of an executor.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 both read this as "one word".
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str, str]] = []
_owner = ContextVar("owner", default="")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares; a temporary one only in local mode."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = "file://" + tempfile.mkdtemp(prefix="hanlens-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hanlens/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path, _owner.get()))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect plans that are done, so that executors drop their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables written meanwhile belong to ``owner``."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def drop_unread(owner: str, docs: DataFrame) -> None:
    """Remove the tables of ``owner`` that ``docs`` does not read."""
    mine = [t for t in _written if t[2] == owner]
    read = {p for f in docs.inputFiles() for p in f.split("/")} if mine else set()
    for t in mine:
        if t[1].rsplit("/", 1)[1] not in read:
            _remove(*t[:2])
            _written.remove(t)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _forget() -> None:
    """Remove what ``written`` left, as far as the session still lives."""
    for spark, path, _ in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone: the folder's owner clears it
            return


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of every text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def held_out(ids: Iterable[int | None], mod: int, rest: int) -> list[bool]:
    """Whether crc32 of the decimal id leaves ``rest``; a null id is ``''``."""
    return [zlib.crc32(b"" if i is None else b"%d" % i) % mod == rest for i in ids]


def held_out_col(doc_id: str | Column, mod: int, rest: int) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % mod == rest


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with ``_`` behind until no column has it in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string, as the kernels' output is declared."""
    kinds = {
        "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([pa.field(n, kinds[k]) for n, k in (f.strip().split(" ", 1) for f in ddl.split(","))])


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of one column (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = np.fromiter((len(x) if x else 0 for x in texts(b.column(b.schema.get_field_index(column)))), np.int64, n)
        ends, start = np.cumsum(sizes), 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield b.slice(start, stop - start)
            start = stop


def label_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``per_class`` labelled training rows of each class: (doc_id, text, y).

    The ids are those with the smallest keyed hash, so the sample is uniform and
    the same in every run; only that bounded id list is broadcast to the scan.
    Rows held out, unlabelled, or with a null id or label are never taken; a
    repeated id counts once a class.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out_col("doc_id", mod, rest))
    counts = dict(known.groupBy("y").agg(F.count_distinct("doc_id")).collect())
    place, picked = F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 40)), []
    for y in (0, 1):
        # A tenth more than needed, and never the order of a whole table: the hash is uniform.
        below = min(1.0, (1.1 * per_class + 100) / max(1, counts.get(y, 0)))
        ids = known.where((F.col("y") == y) & (place < int(below * (1 << 40)))).select(place.alias("at"), "doc_id").distinct().collect()
        picked += [(i, y) for _, i in sorted(map(tuple, ids))[:per_class]]
    ids = spark.createDataFrame(picked, "doc_id long, y int")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.join(F.broadcast(ids), "doc_id")
