"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens.  Pieces are dealt to partitions of a fixed
expected size; each packs its own by best-fit decreasing and certifies the bin count with lower
bounds from dual-feasible functions.  Partitions whose count exceeds their bound exchange what lies
in their bins that are not full, in pairs, and rerun best-fit decreasing, which certifies them anew; a
result is taken only where it needs fewer bins.  After `rounds` exchanges a gap may remain; it shows as
n_bins > bound in the rows of the group.

Cases: null text is an empty document (one piece holding only the end id); an empty table gives no
rows; repeated rows are packed each on its own; rows whose id is null are packed like others; ties in
size go by doc_id, start and crc; a very long text is cut into pieces of one sequence each.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(sizes: np.ndarray, capacity: int, ks: int = 24) -> int:
    """The largest bound on the bins for integer sizes in 1..capacity from three dual-feasible families.

    Identity: total over capacity.  Thresholds k <= capacity / 2: sizes above capacity - k count as a
    whole bin, sizes under k as nothing, others as themselves.  Roundings k = 1..ks: a size x counts
    floor((k + 1) x / capacity) / k of a bin unless (k + 1) x / capacity is whole, then x / capacity.
    """
    if len(sizes) == 0:
        return 0
    hist = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    count_from = np.cumsum(hist[::-1])[::-1]  # of sizes >= x
    mass_from = np.cumsum((hist * x)[::-1])[::-1]
    k = np.arange(0, capacity // 2 + 1)
    big_count = np.where(k > 0, count_from[np.minimum(capacity - k + 1, capacity)], 0)
    big_mass = np.where(k > 0, mass_from[np.minimum(capacity - k + 1, capacity)], 0)
    total = big_count * capacity + mass_from[k] - big_mass
    best = int(-(-total.max() // capacity))
    for k in range(1, ks + 1):
        q, r = np.divmod((k + 1) * x, capacity)
        # in units of 1 / (k * capacity) of a bin
        weight = np.where(r == 0, x * k, q * capacity)
        best = max(best, int(-(-int((weight * hist).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins.  Ties go to the bin opened last."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, used = 0, 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_mask &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            by_room[room - size].append(b)
            open_mask |= 1 << (room - size)
    return bins, offsets, used


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, memo_words: int) -> DataFrame:
    """Tokenises (doc_id, text) and cuts documents longer than capacity; one row per piece."""

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        for d, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path, memo_words=memo_words).encode(batch.column(1).to_pylist())):
            ids += end
            for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((d, p, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), pieces, PIECES)


_STATE = PIECES + ", part long, bin long, offset long, n_bins long, bound long"


def _packed(frame: pd.DataFrame, part: int, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
    sizes = frame["length"].to_numpy(np.int64)
    b, o, used = best_fit_decreasing(sizes, capacity)
    return frame.assign(part=part, bin=b, offset=o, n_bins=used, bound=lower_bound(sizes, capacity))


def pack_pieces(pieces: DataFrame, capacity: int, per_partition: int = 100_000, rounds: int = 2) -> DataFrame:
    """Adds sequence_id and offset, with n_bins and bound of the group that packed the piece last.

    `pieces` is read several times, so pass a stored table.  A partition holds about per_partition
    pieces whatever the input and however many rows are equal, so memory per task is bounded.

    Full bins leave their group when it is taken up in an exchange; what lies in its other bins is
    packed with that of another group and certified anew.  Rows with n_bins > bound after the last
    round are of groups whose gap remains: their packing is not proved to be the best.
    """
    n = pieces.count()
    parts = max(1, -(-n // per_partition))
    names = PIECES.replace(",", "").split()[::2]
    state_names = [x.split()[0] for x in _STATE.split(", ")]

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        return _packed(frame[names], int(key[0]), capacity)

    # dealt by place in the stored table, so equal rows do not meet in one partition
    dealt = pieces.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part"))
    state = staged(dealt.groupBy("part").applyInPandas(pack, _STATE), "packing")

    for r in range(1, rounds + 1):
        # one row per partition that does not meet its bound; there are n / per_partition at most
        gaps = [x.part for x in state.where("n_bins > bound").select("part").distinct().orderBy("part").collect()]
        if len(gaps) < 2:
            break
        gaps = gaps[r % 2 :] + gaps[: r % 2]  # groups that gained nothing meet others in the next round
        pair = pieces.sparkSession.createDataFrame([(g, (r << 40) + i // 2) for i, g in enumerate(gaps)], "part long, pair long")
        open_ = state.where("n_bins > bound").join(pair, "part")
        fill = open_.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
        marked = open_.join(fill, ["part", "bin"])
        closed = state.where("n_bins <= bound").unionByName(
            marked.where(F.col("fill") >= capacity).select(*state_names[:-2], F.lit(1).cast("long").alias("n_bins"), F.lit(1).cast("long").alias("bound"))
        )

        def exchange(key, frame: pd.DataFrame) -> pd.DataFrame:
            before = len(frame[["part", "bin"]].drop_duplicates())
            new = _packed(frame[names], int(key[0]), capacity)
            kept = new if int(new["n_bins"].iloc[0]) < before else frame
            return kept.assign(n_bins=min(before, int(new["n_bins"].iloc[0])), bound=int(new["bound"].iloc[0]))[state_names]

        moved = marked.where(F.col("fill") < capacity).groupBy("pair").applyInPandas(exchange, _STATE)
        state = staged(closed.select(*state_names).unionByName(moved), "packing")
    return state.select(*names, (F.col("part") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"), "offset", "n_bins", "bound")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, per_partition: int = 100_000, memo_words: int = 1_000_000
) -> DataFrame:
    """Tokenises, cuts and packs (doc_id, text): one row per piece with its sequence and place there.

    memo_words bounds the words whose ids a Python worker remembers; it changes time and memory, never results.
    """
    pieces = staged(token_pieces(docs, tokenizer_path, end_id, capacity, memo_words), "pieces")
    return pack_pieces(pieces, capacity, per_partition)
