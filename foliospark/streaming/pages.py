"""Per-page operators over a stream of OCR lines: an extension beside the batch operators.

Pages arrive as batches of Parquet files; a page's lines must arrive in one file.  Each micro-batch
runs the batch operators, so results equal those of one pass over all files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import layout


def line_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def summaries(lines: DataFrame) -> DataFrame:
    return layout.page_summary(layout.line_roles(lines))


def start(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends operator's rows for each micro-batch to Parquet under out, one folder a batch so that retries replace it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
