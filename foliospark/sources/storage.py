"""Tables kept between steps, in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    A local session without that setting gets a temporary folder, which goes with the process; on a
    cluster the setting is required, since other machines do not see this one's folders.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        got = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, got, True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_staged(spark: SparkSession) -> None:
    """Deletes all tables that staged() wrote in this application.  Call it when no result that reads them is needed any more."""
    delete(spark, _root(spark))


def release(spark: SparkSession) -> None:
    """Has the driver drop what steps done no longer need: shuffle files stay until it collects the garbage that refers to them.

    Events not yet delivered refer to their plans, so these come first.
    """
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that only other staged tables were made from."""
    for df in tables:
        delete(df.sparkSession, df.staged_at)


def staged_path(spark: SparkSession, tag: str) -> str:
    return f"{_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "zstd", row_group_bytes: int | None = None) -> None:
    writer = df.write.option("compression", compression)
    if row_group_bytes:  # for rows so large that a reader should hold few of them
        writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size.row.check.min", 8)
    writer.parquet(path)


def staged(df: DataFrame, tag: str, compression: str = "zstd", row_group_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends, lost executors lose nothing.

    The tables stay until remove_staged(), since results are read from them lazily.
    """
    path = staged_path(df.sparkSession, tag)
    written(df, path, compression, row_group_bytes)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out
