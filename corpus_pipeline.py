"""Training-corpus pipeline over ``documents``.

Each stage reads what the one before it wrote and returns the columns of
``documents``; the last adds the piece ids.  Rejected, duplicate and unmixed
documents are gone for the stages that follow; a document that the mix takes
twice is two rows from there on.

Cases, for every stage: a null text counts as empty (the classifier scores its
bias; one empty text stays of all; it has no ids); a very long text is handled
whole; of ties and repeated rows exact and near dedup keep the row with the
smallest doc_id, null last, then the first read; an empty table gives an empty
one; columns beside ``doc_id``, ``text`` and ``source`` are carried whatever
their names, and the ids' names get ``_`` behind where they clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanlens.llm import exact_dedup, mixing, quality_classifier, sentencepiece_dropout, simhash
from hanlens.llm.common import drop_unread, free_name, owned, release, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_runs = 0


def _stage(f: Stage) -> Stage:
    """A stage that first drops the tables of the stages before it in its run, all that its input does not read.

    A run begins with the first stage; each stage's input has been written by then.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _runs
        _runs += f.__name__ == "quality"
        with owned(f"pipeline-{_runs}"):
            drop_unread(f"pipeline-{_runs}", docs)
            release(spark)
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, fitted on the labelled training rows, does not reject."""
    return quality_classifier.quality_filter(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of the documents with equal text."""
    return exact_dedup.exact_dedup(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash.near_dedup(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document none, one or two times, towards its source's target."""
    return mixing.mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of every text; the two rows of a document taken twice draw differently."""
    copy = free_name(docs.columns, "_copy")
    numbers = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("doc_id", "text")).orderBy(F.lit(0))) - 1
    return sentencepiece_dropout.encode_docs(docs.withColumn(copy, numbers), sentencepiece_dropout.Pieces(), copy_col=copy)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: Fitted weights, fingerprints and dropout have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with owned(f"pipeline-{_runs}"):
                docs = written(docs, f"stage-{k}")
    return docs
