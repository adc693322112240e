"""Cross-entropy difference: matched bigram models of target and background text.

Both models share one vocabulary, one order and one smoothing, so their losses compare token by
token.  Background counts come from all documents, target counts from those named as target.

Every word and every bigram counts: what is gathered grows with the input, and nothing of it is
collected or broadcast.  A caller may set floors: words under `word_share` of all tokens read as
unknown (the words kept, 1 / word_share at most, are then broadcast), and bigrams under
`bigram_share` of the tokens of both models back off.

1. Documents are read in blocks of a few megabytes.  A block counts its words and bigrams, each once
   whatever its frequency, so no word or pair is hot; it is stored as places in its own list of words.
2. Words and bigrams are known by 64-bit hashes.  Blocks deal sorted lists of them by the hashes'
   first bits into parts whose number grows with the input; a part sums the counts of all blocks
   and returns to each block the sums of its own entries.
3. A block takes the sums of its entries from all parts and scores its documents.

Probabilities: P(w | v) = (c(v w) + mu P(w)) / (c(v) + mu) with P(w) = (c(w) + 1) / (n + size), where
bigrams not kept have c(v w) = 0.  A document's losses are mean negative logs per token (its words
and an end mark); score is target loss less background loss, so lower is closer to the target.

Cases: a null or empty text has the end mark alone; without target documents the target model is
uniform; a null doc_id is never a target; repeated rows count each; repeated target ids count once;
an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, slices, staged

#: No words: white space and bytes under 0x30 only separate.
EDGE, UNKNOWN = b"\n", b"\t"
_BLOCK_CHARS, _PART_TOKENS = 16_000_000, 1_500_000
_RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def _marked(docs: DataFrame, targets: DataFrame, broadcast_ids: int) -> DataFrame:
    """(doc_id, text, target)."""
    ids = targets.select(F.col("doc_id").cast("long").alias("t")).where("t is not null").distinct()
    small = ids.count() <= broadcast_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = source.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("t"), "left")
    return joined.select("doc_id", "text", F.col("t").isNotNull().alias("target"))


def vocabulary(marked: DataFrame, word_share: float) -> list[bytes]:
    """Words of at least word_share of all tokens, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out():
            return pa.record_batch([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 8_000_000):
                for text in part.column(0).to_pylist():
                    total.update(words_of(text))
                if len(total) > 500_000:
                    yield out()
                    total.clear()
        if total:
            yield out()

    counted = marked.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        n = counted.agg(F.sum("n")).first()[0] or 0
        return sorted(bytes(r.word) for r in counted.where(F.col("n") >= max(1.0, word_share * n)).select("word").collect())
    finally:
        counted.unpersist()


def _packed(x: np.ndarray) -> bytes:
    """Integers byte by byte of their places, compressed; small ones come to little."""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8) + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8]), "zstd"), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def read_block(texts: list[str | None], vocabulary: set[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, the block's place of each token, and by place the words' hashes; the mark's place is 0."""
    ids: dict[bytes, int] = {EDGE: 0}
    places: list[np.ndarray] = []
    for text in texts:
        words = words_of(text)
        if vocabulary is not None:
            words = [w if w in vocabulary else UNKNOWN for w in words]
        places.append(np.array([*[ids.setdefault(w, len(ids)) for w in words], 0], np.int32))
    return np.array([len(x) for x in places], np.int64), np.concatenate(places), np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)


def entries(word: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """A block's words and bigrams by key: keys (odd for words), first and second word's entry; then of each token the
    entries of its bigram and of its word."""
    size = len(hashes)
    pairs, at = np.unique(np.concatenate(([0], word[:-1])) * np.int64(size) + word, return_inverse=True)
    a, b = pairs // size, pairs % size
    keys = np.concatenate((hashes | np.uint64(1), _pair_hashes(hashes[a], hashes[b]) & ~np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    entry = np.empty(len(order), np.int32)
    entry[order] = np.arange(len(order), dtype=np.int32)
    own = np.arange(size)
    firsts, seconds = (entry[np.concatenate((own, x))[order]] for x in (a, b))
    return keys[order], firsts, seconds, entry[at + size], entry[word]


def _local(codes: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(codes, minlength=size) + np.bincount(words, minlength=size)


def _counts(row: dict, found: tuple[np.ndarray, ...], n: np.ndarray) -> list[np.ndarray]:
    """Of each entry, how often target documents and all documents of the block have it."""
    keys, _, _, codes, words = found
    chosen = np.repeat(np.array(row["target"], bool), n)
    return [_local(codes[chosen], words[chosen], len(keys)), _local(codes, words, len(keys))]


def _opened(row: dict) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    return _unpacked(row["n"], np.int64), entries(_unpacked(row["words"], np.int32), _unpacked(row["hashes"], np.uint64))


def blocks(marked: DataFrame, vocabulary: list[bytes] | None) -> DataFrame:
    """One row for each block of documents: what read_block() tells of it, and its numbers of tokens."""
    shared = marked.sparkSession.sparkContext.broadcast(None if vocabulary is None else set(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, _BLOCK_CHARS):
                target = part.column(2).to_pylist()
                got = read_block(part.column(1).to_pylist(), shared.value)
                cols = [pa.array([block]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([target], pa.list_(pa.bool_()))]
                cols += [pa.array([_packed(x)], pa.binary()) for x in got]
                cols += [pa.array([int(got[0][np.array(target, bool)].sum())]), pa.array([int(got[0].sum())])]
                yield pa.record_batch(cols, ["block", "docs", "target", "n", "words", "hashes", "n_t", "n_b"])
                block += 1

    schema = "block long, docs array<long>, target array<boolean>, n binary, words binary, hashes binary, n_t long, n_b long"
    # a row has some megabytes
    return staged(marked.mapInArrow(run, schema), "blocks", row_group_bytes=32_000_000)


def sums(stored: DataFrame, n_tokens: int) -> DataFrame:
    """(block, part, t, b, n_words): of each block's entries in a part, by key, the counts in all other blocks; n_words
    adds up to the number of distinct words, the mark among them."""
    bits = max(4, (n_tokens // _PART_TOKENS).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, found = _opened(row)
                keys, (t, b) = found[0], _counts(row, found, n)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                ranges = [(p, x, y) for p, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                steps = np.concatenate((keys[:1], np.diff(keys)))
                for _, x, _ in ranges:
                    steps[x] = keys[x]
                cols = [pa.array([row["block"]] * len(ranges), pa.int64()), pa.array([p for p, _, _ in ranges], pa.int32())]
                cols += [pa.array([_packed(v[x:y]) for _, x, y in ranges], pa.binary()) for v in (steps, t, b)]
                yield pa.record_batch(cols, ["block", "part", "keys", "t", "b"])

    def total(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in group.column("keys").to_pylist()]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        cols = []
        for name in ("t", "b"):
            local = np.concatenate([_unpacked(x, np.int64) for x in group.column(name).to_pylist()])
            whole = np.bincount(at, local, len(found)).astype(np.int64)
            cols.append(pa.array([_packed(x) for x in np.split(whole[at] - local, ends)], pa.binary()))
        words = [int((found & np.uint64(1)).sum()), *[0] * len(ends)]
        return pa.table([group.column("block"), group.column("part"), *cols, pa.array(words)], ["block", "part", "t", "b", "n_words"])

    dealt = stored.select("block", "target", "n", "words", "hashes").mapInArrow(deal, "block long, part int, keys binary, t binary, b binary")
    return staged(dealt.groupBy("part").applyInArrow(total, "block long, part int, t binary, b binary, n_words long"), "sums")


def score(
    docs: DataFrame,
    targets: DataFrame,
    word_share: float = 0.0,
    bigram_share: float = 0.0,
    mu: float = 200.0,
    broadcast_ids: int = 2_000_000,
) -> DataFrame:
    """Per document: doc_id, n_tokens, target_loss, background_loss, score.  targets: a table with the doc_ids of target text."""
    marked = _marked(docs, targets, broadcast_ids)
    known = vocabulary(marked, word_share) if word_share > 0 else None
    stored = blocks(marked, known)
    n = [x or 0 for x in stored.agg(F.sum("n_t"), F.sum("n_b")).first()]
    totals = sums(stored, n[1])
    # all words, the mark and the unknown word
    size = len(known) + 2 if known is not None else (totals.agg(F.sum("n_words")).first()[0] or 0) + 1
    n_tokens, floor = np.array(n, float), np.maximum(1.0, bigram_share * np.array(n, float))

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        lengths, of_block = _opened(row)
        _, first, second, codes, _ = of_block
        order = np.argsort(found.column("part").to_numpy())
        count = np.stack(_counts(row, of_block, lengths), axis=1)
        for j, name in enumerate(("t", "b")):
            held = found.column(name).to_pylist()
            count[:, j] += np.concatenate([_unpacked(held[i], np.int64) for i in order])
        p = (count + 1) / (n_tokens + size)
        kept = (count >= floor).any(axis=1)[:, None]
        # a word is as often first as it is second, with the mark on either side
        loss = -np.log((np.where(kept, count, 0.0) + mu * p[second]) / (count[first] + mu))
        mean = np.add.reduceat(loss[codes], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        cols = [pa.array(row["docs"], pa.int64()), pa.array(lengths), pa.array(mean[:, 0]), pa.array(mean[:, 1]), pa.array(mean[:, 0] - mean[:, 1])]
        return pa.table(cols, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    mine = stored.select("block", "docs", "target", "n", "words", "hashes").groupBy("block")
    return mine.cogroup(totals.select("block", "part", "t", "b").groupBy("block")).applyInArrow(run, _RESULT)
