"""Token ids as binary files: frequency-ranked codes in byte-aligned variable length.

Ids are replaced by their rank in the corpus (most frequent first), so most take one byte.  File
format, all little-endian: magic ``FTOK1``; then blocks, one per document: uint32 n (ids),
ceil(n / 4) control bytes with two bits per id (its bytes minus one, lowest bits first), then the
data bytes.  The table of ranks (id by rank) and the list of files are stored beside the files.  A numpy
table from control byte to lengths decodes whole blocks at once.

Cases: null text counts as empty (a block holding the end id alone); an empty table gives no rows;
repeated doc_ids keep one block each, in the order of their ids' crc, and may stand in several files;
null doc_ids come first; ties in frequency go by id; a very long text is one block in one segment.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, slices, staged, staged_path, written
from .tokens import encoder

MAGIC = b"FTOK1"
#: Byte lengths of the four ids of each control byte.
CONTROL_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


CONTROL_TOTALS = CONTROL_LENGTHS.sum(axis=1, dtype=np.int64)
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)


def encode_blocks(ranks: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Blocks of documents that stand one after another in ranks, sizes ids each."""
    width = 4 if len(ranks) and ranks.max() > 0xFFFF else 2  # of which bytes are taken
    ranks = ranks.astype(f"<u{width}")
    extra = (ranks > 0xFF).astype(np.uint8)
    if width == 4:
        extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    groups = -(-sizes // 4)
    group_ends, ends = np.cumsum(groups), np.cumsum(sizes)
    padded = np.zeros(4 * int(groups.sum()), np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(4 * (group_ends - groups) - (ends - sizes), sizes)] = extra
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFTS, axis=1).tobytes()
    data = ranks.view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) <= extra[:, None]].tobytes()
    data_ends = np.concatenate(([0], np.cumsum(extra, dtype=np.int64) + np.arange(1, len(extra) + 1)))
    heads = sizes.astype("<u4").tobytes()
    rows = zip((group_ends - groups).tolist(), group_ends.tolist(), data_ends[ends - sizes].tolist(), data_ends[ends].tolist())
    return [b"".join((heads[4 * i : 4 * i + 4], control[a:b], data[c:d])) for i, (a, b, c, d) in enumerate(rows)]


def decode_blocks(body: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All ranks of the blocks from a place to the end of body, and how many each document has."""
    controls, datas, sizes = [], [], []
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        control = np.frombuffer(body, np.uint8, -(-n // 4), at + 4)
        at += 4 + len(control)
        size = int(CONTROL_TOTALS[control].sum()) - (4 * len(control) - n)  # absent ids show as one byte each
        controls.append(control)
        datas.append(body[at : at + size])
        sizes.append(n)
        at += size
    sizes = np.array(sizes, np.int64)
    if not sizes.sum():
        return np.empty(0, np.uint32), sizes
    groups = -(-sizes // 4)
    there = np.arange(4 * int(groups.sum())) - np.repeat(4 * (np.cumsum(groups) - groups), 4 * groups) < np.repeat(sizes, 4 * groups)
    lengths = CONTROL_LENGTHS[np.concatenate(controls)].reshape(-1)[there]
    data = np.frombuffer(b"".join(datas) + bytes(3), np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[starts].astype(np.uint32)
    for k in range(1, int(lengths.max())):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, sizes


_SEGMENT = "file_no int, seq int, inner long, doc_ids array<long>, n_tokens long, body binary"
_SEGMENT_ARROW = pa.schema(
    [("file_no", pa.int32()), ("seq", pa.int32()), ("inner", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("body", pa.binary())]
)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column one after another, and how many each value has."""
    values = column.to_pylist()
    kind = np.dtype(kind)
    return np.frombuffer(b"".join(values), kind), np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids binary, counts binary): little-endian ids of the given numpy type, with the end id.

    The first row of each slice of documents has the slice's count of every id, as int64.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], kind).tobytes()
        ids = encoder(tokenizer_path, np.dtype(kind).char).encode(batch.column(1).to_pylist())
        column = pa.array([x + end for x in ids], pa.binary())
        counts = np.bincount(_flat(column, kind)[0], minlength=vocabulary).astype("<i8").tobytes()
        return pa.record_batch([batch.column(0), column, pa.array([counts] + [None] * (len(ids) - 1), pa.binary())], ["doc_id", "ids", "counts"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, run, "doc_id long, ids binary, counts binary", 4_000_000)


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Count of every id over all tokens; only the column of counts is read."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    summed = tokens.select("counts").where("counts is not null").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(vocabulary, np.int64)
    total[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return total


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, file_bytes: int = 32 << 20) -> str:
    """Writes the corpus in ascending doc_id order; returns the folder (path, or one of the staged tables).

    The folder holds three tables, and is all that reading needs:
    segments (file_no, seq, inner, doc_ids, n_tokens, body), one stretch of a file in the format above
    with the ids of its documents and the file's tokens in front of it, in doc_id order by (file_no, seq);
    files (file_no, n_tokens, front), with the tokens of all files in front; ranks (rank, id).
    Segments are binary values of a table because Spark's writers reach any store and commit atomically
    when executors are lost.  A file takes about file_bytes of plain ids.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or staged_path(spark, "token-files")
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = staged(tokenised(docs, tokenizer_path, end_id, vocabulary, kind), "tokens")
    counts = id_counts(tokens, vocabulary)
    by_rank = np.lexsort((np.arange(vocabulary), -counts)).astype(np.uint32)  # ties by id
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary
    ranks = spark.createDataFrame(pa.table([pa.array(np.arange(vocabulary)), pa.array(by_rank.astype(np.int64))], ["rank", "id"]))
    ranks.coalesce(1).write.parquet(f"{path}/ranks")

    files = max(1, -(-int(counts.sum()) * np.dtype(kind).itemsize // file_bytes))
    # the last key parts rows of one doc_id (or without any) that are equal
    key = [F.col("doc_id").asc_nulls_first(), F.crc32("ids"), F.col("place")]
    ordered = tokens.select("doc_id", "ids", F.xxhash64(F.monotonically_increasing_id()).alias("place"))
    ordered = ordered.repartitionByRange(files, *key).sortWithinPartitions(*key).select("doc_id", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, seq, inner = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch, 500_000):
                ids, sizes = _flat(part.column(1), kind)
                body = MAGIC + b"".join(encode_blocks(shared.value[ids], sizes))
                row = [file_no, seq, inner, part.column(0).to_pylist(), len(ids), body]
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _SEGMENT_ARROW)], _SEGMENT_ARROW)
                seq, inner = seq + 1, inner + len(ids)

    written(ordered.mapInArrow(encode, _SEGMENT), f"{path}/segments", "lz4", 8 << 20)
    # a row for each file, so one task orders them
    sizes = spark.read.parquet(f"{path}/segments").groupBy("file_no").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("front", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/files")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files in a folder: doc_id, start (ids before the document), n_tokens, ids_crc32."""
    ranks = spark.read.parquet(f"{path}/ranks").toArrow()  # as long as the vocabulary
    by_rank = np.empty(ranks.num_rows, np.uint32)
    by_rank[ranks.column("rank").to_numpy()] = ranks.column("id").to_numpy()
    table = spark.sparkContext.broadcast(by_rank)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, body, start in zip(*(batch.column(i) for i in range(3))):
                body, start = body.as_py(), start.as_py()
                if body[: len(MAGIC)] != MAGIC:
                    raise ValueError("not a token file")
                ranks, sizes = decode_blocks(body, len(MAGIC))
                ids = memoryview(table.value[ranks].astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                cols = [docs.values, pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    segments, files = spark.read.schema(_SEGMENT).parquet(f"{path}/segments"), spark.read.parquet(f"{path}/files").select("file_no", "front")
    joined = segments.join(files, "file_no").select("doc_ids", "body", (F.col("front") + F.col("inner")).alias("at"))
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
