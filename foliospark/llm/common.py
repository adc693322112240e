"""Shared helpers of the training-data operators: table access, Arrow row streams; shared storage is the library's."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import discard, remove_staged, shared_dir, staged, staged_path, written  # noqa: F401

#: Upper-case ASCII to lower case, every other ASCII character but digits and letters to a space.
#: Bytes from 0x80 up pass, so UTF-8 text splits into words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: The same words as a Java pattern of what separates them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space that splits plain tokens; Python's bytes.split() uses the same six characters.
SPACES = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only.  Text without a capital beyond ASCII takes the fast built-in."""
    return F.when(~col.rlike(r"[^\x00-\x7F]"), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def release_memory() -> None:
    """Gives memory that the process no longer uses back to the system; Python workers stay and serve other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str, max_chars: int = 8_000_000) -> DataFrame:
    """Applies fn to slices of each Arrow batch whose text columns hold about max_chars characters at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, slices(batch, max_chars))
        release_memory()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * min(1.0, max_bytes / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)
