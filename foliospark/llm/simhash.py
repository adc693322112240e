"""SimHash near-dedup by anchor-point covering.

Fingerprints: bit i of 64 is set if it is set in over half of the XXH64 hashes of the text's word
shingles.  Fingerprints link at `max_bits` = 4 or fewer differing bits.

Covering: the 64 bits are cut into three blocks of 21, 21 and 22 bits; fingerprints within 4 bits
agree up to 1 bit in some block.  A block's anchors are the words of a covering code of radius 1: a
perfect Hamming code on its first 15 bits and every value of the others.  A fingerprint is at home
at its nearest anchor and is replicated to every anchor within radius + 1 = 2.  If two fingerprints
agree up to 1 bit in a block, the second is within 2 of the first one's home anchor, so they meet
there; comparing homes with all that are present at an anchor finds every link.  (Codes on all 64
bits at once would need over a hundred copies of each fingerprint at a useful selectivity.)

Larger thresholds, such as a Jaccard similarity of shingles asks for, need longer fingerprints: further
64-bit words come from further hashes of the same shingles.  Their blocks are seeded choices of about
log2(n) of all bits, n being the number of distinct fingerprints, and the anchors are all words on a
block (covering radius 0).  There are as many blocks as let two fingerprints at the threshold meet with
probability `meeting`; nearer ones meet more surely.

Only distinct fingerprints take part.  An anchor with over `cell_rows` of them is dealt into a grid
of cells of bounded size that still confronts each home with each visitor.  A cell emits a star for
each of its groups, never all pairs.  Components follow by large and small stars.

Cases: null text counts as empty; an empty text has fingerprint zero, linked like any other;
repeated rows share a fingerprint; a null doc_id gets its group's component, links like others and never
names one (a group of null doc_ids alone has a null component); an empty table gives no rows.  Very long
texts are hashed and counted in slices.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, release_memory, staged
from .components import components

SEED = 42
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
#: Ids are below this; stand-ins of documents without one are not.
NO_ID = 1 << 62


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - k + 1)


def _rehashed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further hash of hashed shingles; h itself for 0."""
    if j:
        h = (h + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprint(text: str | None, k: int = 4, words: int = 1) -> list[int]:
    """The words of the fingerprint as signed integers."""
    hashes = shingle_hashes(text, k)
    n, out = len(hashes), []
    for j in range(words):
        h, counts = _rehashed(hashes, j), np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            m = len(bits) // 255
            counts += bits[: m * 255].reshape(m, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += bits[m * 255 :].sum(axis=0, dtype=np.uint8)
        out.append(int(np.packbits(counts * 2 > n).view(">i8")[0]) if n else 0)
    return out


def _names(words: int) -> list[str]:
    return [f"f{j}" for j in range(words)]


def fingerprints(docs: DataFrame, k: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, f0, ...)."""
    names = _names(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, k, words) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, words)
        return pa.record_batch([batch.column(0), *map(pa.array, found.T)], ["doc_id", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def _syndrome(block: np.ndarray) -> np.ndarray:
    """Of the Hamming code on bits 0..14: the xor of (place + 1) of the set bits."""
    s = np.zeros(len(block), np.int64)
    for i in range(15):
        s ^= ((block >> i) & 1) * (i + 1)
    return s


def _flips(bits: int) -> list[np.ndarray]:
    """By syndrome: the flips of weight 2 or less that lead to an anchor; the first leads home."""
    out = []
    free = [1 << i for i in range(15, bits)]
    for s in range(16):
        home = 1 << (s - 1) if s else 0
        got = [home] + [home | f for f in free]
        if s:
            got += [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 16) if i < (i ^ s)]
        else:
            got += [free[i] | free[j] for i in range(len(free)) for j in range(i)]
        out.append(np.array(got, np.int64))
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fp, anchor key, is home) for every anchor within radius + 1 of each block."""
    rows, keys, homes = [], [], []
    for b, (first, bits) in enumerate(BLOCKS):
        block = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        s = _syndrome(block)
        for value, flips in enumerate(_flips(bits)):
            at = np.flatnonzero(s == value)
            rows.append(np.repeat(at, len(flips)))
            keys.append(((block[at][:, None] ^ flips[None, :]) | (b << 22)).reshape(-1))
            homes.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def sampled_blocks(n: int, bits: int, max_bits: int, meeting: float) -> np.ndarray:
    """Chosen bits, one block a row, for n fingerprints of so many bits."""
    size = min(max(8, (n - 1).bit_length()), 40, bits - max_bits)
    agree = math.prod((bits - max_bits - i) / (bits - i) for i in range(size))
    blocks = max(1, math.ceil(math.log(1 - meeting) / math.log1p(-agree)))
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(bits, size, replace=False) for _ in range(blocks)])


def sampled_anchors(fp: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As anchors(), of fingerprints of several words at the blocks chosen: each is at home at one anchor a block."""
    bits = np.unpackbits(np.ascontiguousarray(fp.astype(">i8")).view(np.uint8).reshape(len(fp), -1), axis=1)
    place = np.int64(1) << np.arange(chosen.shape[1])
    keys = np.concatenate([(bits[:, c] * place).sum(axis=1) | (b << 40) for b, c in enumerate(chosen)])
    return np.tile(np.arange(len(fp)), len(chosen)), keys, np.ones(len(keys), bool)


def _near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether fingerprints, one a row, differ in few enough bits."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16) <= max_bits


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to stars: (node, smallest id that is joined to it by the links)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    move = label != np.arange(len(nodes))
    return nodes[move], nodes[label[move]]


def _cell_links(fp: np.ndarray, doc: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the links between the homes of a cell and all that are in it."""
    h, out_a, out_b = np.flatnonzero(home), [], []
    step = max(1, 2_000_000 // max(1, fp.size))
    for i in range(0, len(h), step):
        part = h[i : i + step]
        x, y = np.nonzero(_near(fp[part][:, None], fp[None, :], max_bits))
        a, b = doc[part[x]], doc[y]
        a, b = _stars(a[a != b], b[a != b])
        out_a.append(a)
        out_b.append(b)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (doc[:0], doc[:0])


def _many_cells(cell: np.ndarray, fp: np.ndarray, doc: np.ndarray, home: np.ndarray, max_bits: int):
    """Links of whole cells that stand one after another; small cells are compared together."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    n_home = np.add.reduceat(home.astype(np.int64), starts)
    big = sizes * n_home > 1_000_000 // fp.shape[1]
    for s, n in zip(starts[big], sizes[big]):
        yield _cell_links(fp[s : s + n], doc[s : s + n], home[s : s + n], max_bits)
    of_row = np.repeat(np.arange(len(starts)), sizes)
    h = np.flatnonzero(home & ~big[of_row])
    if not len(h):
        return
    work = np.cumsum(sizes[of_row[h]])
    most = 4_000_000 // fp.shape[1] ** 2  # pairs at once
    for part in np.split(h, np.searchsorted(work, np.arange(most, int(work[-1]) + 1, most))):
        if not len(part):
            continue
        n = sizes[of_row[part]]
        x = np.repeat(part, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of_row[part]], n)
        near = _near(fp[x], fp[y], max_bits) & (doc[x] != doc[y])
        yield _stars(doc[x[near]], doc[y[near]])


def links(distinct: DataFrame, max_bits: int = 4, cell_rows: int = 20_000, words: int = 1, meeting: float = 0.95) -> DataFrame:
    """(f0, ..., doc), one row per fingerprint, to links (u, v) of docs whose components are those of all pairs that meet within max_bits."""
    exact = words == 1 and max_bits // len(BLOCKS) <= 1
    chosen = None if exact else sampled_blocks(distinct.count(), 64 * words, max_bits, meeting)
    prints = _names(words)
    names = ["key", *prints, "doc", "home"]

    def cover(batch: pa.RecordBatch) -> pa.RecordBatch:
        *fp, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(words + 1))
        rows, keys, home = anchors(fp[0]) if exact else sampled_anchors(np.stack(fp, axis=1), chosen)
        return pa.record_batch([pa.array(keys.astype(np.int64)), *(pa.array(x[rows]) for x in fp), pa.array(doc[rows]), pa.array(home)], names)

    kinds = "".join(f", {c} long" for c in prints)
    covered = arrow_map(distinct.select(*prints, "doc"), cover, f"key long{kinds}, doc long, home boolean", 400_000 // words)
    # an anchor over the limit is one of total / cell_rows at most
    heavy = covered.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    heavy = staged(heavy.select("key", F.ceil(F.col("n") / cell_rows).cast("int").alias("side")), "heavy")
    if heavy.isEmpty():
        dealt = covered.withColumn("cell", F.lit(0))
    else:
        own = F.pmod(F.xxhash64(*prints), F.col("side")).cast("int")
        grid = F.sequence(F.lit(0), F.col("side") - 1)
        as_home = F.transform(grid, lambda j: F.struct((own * F.col("side") + j).alias("cell"), F.lit(True).alias("home")))
        as_visitor = F.transform(grid, lambda i: F.struct((i * F.col("side") + own).alias("cell"), F.lit(False).alias("home")))
        both = F.when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor)
        alone = F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home")))
        marked = covered.join(heavy, "key", "left").withColumn("e", F.explode(F.when(F.col("side").isNull(), alone).otherwise(both)))
        dealt = marked.select("key", *prints, "doc", F.col("e.home").alias("home"), F.col("e.cell").alias("cell"))
    ready = dealt.select(F.xxhash64("key", "cell").alias("cell"), *prints, "doc", "home").repartition("cell").sortWithinPartitions("cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(cols):
            for a, b in _many_cells(*cols, max_bits):
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], ["u", "v"])

        for batch in batches:
            cell, *fp, doc, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(words + 3))
            held.append([cell, np.stack(fp, axis=1).view(np.uint64), doc, home])  # bitwise_count is for unsigned values
            rows += batch.num_rows
            if rows >= 200_000:
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
                if cut:
                    yield from flush([c[:cut] for c in cols])
                held, rows = [[c[cut:] for c in cols]], rows - cut
        if rows:
            yield from flush([np.concatenate(x) for x in zip(*held)])
        release_memory()

    return ready.mapInArrow(compare, "u long, v long")


def bits_at(similarity: float, bits: int) -> int:
    """The differing bits to allow for a Jaccard similarity of shingles: what is expected there, and a standard deviation."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + math.sqrt(bits * p * (1 - p)))


def near_duplicates(docs: DataFrame, k: int = 4, max_bits: int = 4, words: int = 1, meeting: float = 0.95) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits a word), component_id."""
    names = _names(words)
    prints = staged(fingerprints(docs, k, words), "fingerprints")
    # stand-ins after all ids for fingerprints of null doc_ids alone; in one word, those that share one differ in two bits at most
    none = F.lit(NO_ID) + (F.col("f0") if words == 1 else F.xxhash64(*names)).bitwiseAND(F.lit(NO_ID - 1))
    distinct = staged(prints.groupBy(*names).agg(F.coalesce(F.min("doc_id"), none).alias("doc")), "distinct")
    found = components(links(distinct, max_bits, words=words, meeting=meeting))
    named = distinct.join(found, distinct.doc == found.node, "left").select(*names, F.coalesce("component", "doc").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    joined = prints.join(named.hint("merge"), names)
    return joined.select("doc_id", F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in names]).alias("fingerprint"), "component_id")
