"""A stream of document files through the same conversion as a batch.

Every micro-batch is converted by itself: records never span documents, so no state is kept between batches. The sink is
keyed by batch id, so a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.plans.convert import Adapter, convert
from loomgraph.sources import documents as bytes_of


FILE = "path string, modificationTime timestamp, length long, content binary"


def documents(spark: SparkSession, folder: str, pattern: str = "*", syntax: str = "xml") -> DataFrame:
    """doc_id (the file's path) and text of files as they arrive. XML in the encoding that it tells, JSON in UTF-8 without a byte order
    mark; other bytes give a null text, which conversion reports as a document that can't be read."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)
    content = F.col("content")
    return files.select(F.col("path").alias("doc_id"), (bytes_of.decoded_json(content) if syntax == "json" else bytes_of.decoded(content)).alias("text"))


def start(stream: DataFrame, adapter: Adapter, out: str, checkpoint: str, trigger: dict | None = None, made: Callable[[DataFrame, Adapter], object] = convert) -> StreamingQuery:
    """Write graph and findings of every batch below ``out``, one folder a batch."""

    def each(batch: DataFrame, number: int) -> None:
        got = made(batch, adapter)
        got.graph.write.mode("overwrite").parquet(f"{out}/graph/batch={number}")
        got.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
