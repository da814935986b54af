"""The stateless scan over files as they arrive.

The scan needs no state across documents and shuffles nothing, so a micro-batch
is one pass of row-local steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import scan


def stream_documents(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """New text files of a folder as (doc_id, path, text)."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return raw.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_stream(docs: DataFrame, out: str, checkpoint: str, profile: str = "base") -> StreamingQuery:
    """Scan every micro-batch and append its issues; a batch that is repeated replaces its own part."""
    def each(batch: DataFrame, batch_id: int) -> None:
        scan(batch, profile).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
