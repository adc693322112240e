"""Line dedup by winnowing: verbatim runs of words that stood earlier are deleted.

Lines of running text end anywhere: at line breaks, at sentence marks or nowhere, and a passage that is
copied may start and end within one.  So the lines that are hashed here are all stretches of words in a
row, white space aside: fingerprints of a third of `min_words` words, and whole stretches of min_words.

Documents are read once into blocks of a few megabytes, compressed rows of a stored table; later steps
take blocks, so texts are neither sorted nor joined row by row.

1. Winnowing: of the short stretches in any min_words words the one with the smallest hash is a
   fingerprint, so two texts that share min_words words share one at the same place there.
   Fingerprints are stored with their place and a hash of their surroundings, which reach to another
   fingerprint or the end of the text on either side and have min_words words or more in all.
2. One aggregate, combined before its shuffle, tells for each fingerprint its first document and whether
   its surroundings agree everywhere.  Positions are joined with that.  Where surroundings agree, the
   match extends over them, and all occurrences but the first are deleted.  Where they differ, runs may
   end nearby: all occurrences give the hashes of the whole stretches over the fingerprint, and again a
   pre-aggregated minimum finds the first document of each.  So matches extend both ways against all
   earlier documents, and no two occurrences are ever paired.
3. Words of a stretch met in an earlier document (smaller doc_id), or before it in its own, are deleted
   with the white space after them; so every run of min_words words or more goes, whole.

The first occurrence of any content always stays: a word is deleted only for an earlier one.  Stretches
that overlap their own first occurrence do not count.

Cases: null text stays null and empty text empty; documents of fewer than min_words words stay as they
are; documents without an id come after all others, in the order in which they are read; rows that share
a doc_id never delete words of one another; an empty table gives no rows; result columns replace those of
the same name, and any other column is passed on, whatever its name.
Lines, which end at line breaks and at sentence marks before white space, are only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, release_memory, slices, staged

_FACTOR = 0x9E3779B97F4A7C15
#: Ids of documents without one start here.
_AFTER = 1 << 62
_BLOCK_BYTES = 3_000_000
#: Rows of a block at most, and blocks of a partition at most; a row's key is partition, block, row.
_ROW_BITS = 20
_ROWS = 1 << _ROW_BITS
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARK = np.isin(np.arange(256), list(b".!?"))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG_WORD = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_known_powers: dict[int, np.ndarray] = {}


def _powers(of: int, n: int) -> np.ndarray:
    if len(_known_powers.get(of, ())) <= n:
        out = np.full(n + n // 2 + 1, of, np.uint64)
        out[:1] = 1
        _known_powers[of] = np.cumprod(out, dtype=np.uint64)
    return _known_powers[of][:n]


class Words:
    """The words of texts that stand one after another, by place in their UTF-8; null counts as empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        space = _SPACE[self.raw]
        first, last = np.ones(len(space) + 1, bool), np.ones(len(space) + 1, bool)
        first[1:], last[:-1] = space, space
        first[self.offsets] = last[self.offsets] = True
        word = ~space
        #: first byte of each word and the byte after its last
        self.begin = np.flatnonzero(word & first[:-1])
        self.end = np.flatnonzero(word & last[1:]) + 1
        bounds = np.searchsorted(self.begin, self.offsets)
        #: first word of each text, and how many it has
        self.start, self.lengths = bounds[:-1], np.diff(bounds)

    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def hashes(self) -> np.ndarray:
        size = self.end - self.begin
        padded = np.concatenate((self.raw, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.raw) + 1,), "<u8", padded, 0, (1,))
        h = size.astype(np.uint64) * np.uint64(_FACTOR)
        at, of = self.begin, slice(None)
        for c in range(0, _LONG_WORD, 8):
            if c:
                of = np.flatnonzero(size > c)
                at = self.begin[of] + c
            if not len(at):
                break
            x = (h[of] ^ (eight[at] & _MASKS[np.minimum(size[of] - c, 8)])) * np.uint64(0xD6E8FEB86659FD93)
            h[of] = x ^ (x >> np.uint64(32))
        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.raw[self.begin[i] : self.end[i]].tobytes())
        return _mixed(h)

    def line_starts(self) -> np.ndarray:
        """Whether a line starts at each word: behind a line break, or behind a sentence mark and white space."""
        before = np.concatenate(([0], self.end))[:-1]
        before[self.start[self.lengths > 0]] = self.offsets[:-1][self.lengths > 0]
        breaks = np.concatenate(([0], np.cumsum(self.raw == 10)))
        marked = np.zeros(len(before), bool)
        later = np.ones(len(before), bool)
        later[self.start[self.lengths > 0]] = False
        marked[later] = _MARK[self.raw[before[later] - 1]]
        return marked | (breaks[self.begin] > breaks[before])


class Stretches:
    """Hashes of stretches of words in texts that stand one after another."""

    def __init__(self, words: Words):
        h, self.starts, self.lengths = words.hashes(), words.start, words.lengths
        n = len(h)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_FACTOR, n), dtype=np.uint64)))
        self.inverse = _powers(pow(_FACTOR, -1, 1 << 64), n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words [a, b)."""
        return _mixed((self.total[b] - self.total[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def each(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and first word of every stretch of k words."""
        n = np.maximum(self.lengths - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, np.arange(len(doc)) + np.repeat(self.starts - np.cumsum(n) + n, n)


def _sliding(pick, x: np.ndarray, width: int) -> np.ndarray:
    """pick (minimum or maximum) of each width values in a row."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[:-rest], x[rest:]) if rest else x


def winnowed(doc: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Places in x of the minima of each `window` values in a row of one text; a text with fewer has the minima of all."""
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    edge = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [n]))
    sizes = np.diff(edge)
    short = np.repeat(sizes < window, sizes)
    chosen = short & (x == np.repeat(np.minimum.reduceat(x, edge[:-1]), sizes))
    if n >= window:
        low = _sliding(np.minimum, x, window)
        low[doc[: n - window + 1] != doc[window - 1 :]] = 0  # not within one text
        pad = np.zeros(window - 1, np.uint64)
        # a value is a minimum if that of some window over it is no less
        chosen |= ~short & (_sliding(np.maximum, np.concatenate((pad, low, pad)), window) == x)
    return np.flatnonzero(chosen)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _own_repeats(doc: np.ndarray, first: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Of values x at places `first` of texts: whether the same value stood k places or more before in the text."""
    own = np.zeros(len(doc), bool)
    if len(doc):
        order = np.lexsort((first, x, doc))
        d, h, f = doc[order], x[order], first[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
        own[order] = f >= f[np.flatnonzero(new)][np.cumsum(new) - 1] + k
    return own


def blocks(docs: DataFrame) -> DataFrame:
    """(block, body): documents as compressed Arrow data of the columns doc, text and row (all others)."""
    text = F.col("text").cast("string").alias("text")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), text, F.struct(*rest).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * _ROWS
        for batch in batches:
            for part in slices(batch, _BLOCK_BYTES):
                for at in range(0, part.num_rows, _ROWS):
                    sink = pa.BufferOutputStream()
                    some = part.slice(at, _ROWS)
                    with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(some)
                    yield pa.record_batch([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])
                    block += 1
        release_memory()

    return staged(source.mapInArrow(run, "block long, body binary"), "texts", "none", 16_000_000)


def _opened(block: int, body: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Ids, keys, texts and other columns of a block's documents."""
    with pa.ipc.open_stream(body) as stream:
        batch = stream.read_next_batch()
    key = block * _ROWS + np.arange(batch.num_rows)
    ids = batch.column(0)
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    return np.where(valid, ids.fill_null(0).to_numpy(), _AFTER + key), key, batch.column(1), batch.column(2)


def prints(stored: DataFrame, k: int, min_words: int) -> DataFrame:
    """(fp, doc, key, first, before, after, sides): fingerprints, the words of their surroundings on either side and a hash of
    those, which is another one where the fingerprint stood before in its own text."""
    reach = -(-(min_words - k) // 2)

    def each(block: int, body: bytes) -> pa.RecordBatch:
        ids, key, texts, _ = _opened(block, body)
        s = Stretches(Words(texts))
        doc, at = s.each(k)
        x = s.of(at, at + k)
        chosen = winnowed(doc, x, min_words - k + 1)
        doc, at, x = doc[chosen], at[chosen], x[chosen]
        start = s.starts[doc]
        end = start + s.lengths[doc]
        low, high = start, end
        if len(at):
            j = np.searchsorted(at, at - reach, "right") - 1
            low = np.where((j >= 0) & (at[j] >= start), at[j], start)
            j = np.minimum(np.searchsorted(at, at + reach), len(at) - 1)
            high = np.where((at[j] >= at + reach) & (at[j] < end), at[j] + k, end)
        first, before, after = at - start, at - low, high - at - k
        own = _own_repeats(doc, first, x, min_words)
        sides = _mixed(s.of(low, high) + (before * 2 + own * first * 2000 + 1).astype(np.uint64) * np.uint64(_FACTOR))
        cols = [_signed(x), pa.array(ids[doc]), pa.array(key[doc]), *(pa.array(v, pa.int32()) for v in (first, before, after)), _signed(sides)]
        return pa.record_batch(cols, ["fp", "doc", "key", "first", "before", "after", "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(*batch.columns):
                yield each(block.as_py(), body.as_py())
        release_memory()

    schema = "fp long, doc long, key long, first int, before int, after int, sides long"
    return stored.select("block", "body").mapInArrow(run, schema)


def spots(found: DataFrame, k: int, min_words: int) -> DataFrame:
    """(key, a, b, look): ranges of words to delete, and (with look) ranges of first words of stretches to look up.

    `found` is the staged table of prints, which goes once its positions are told.
    """
    each = found.groupBy("fp").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("sides").alias("low"), F.max("sides").alias("high"))
    # stored, so that the join below can split a fingerprint met in very many documents
    shared = staged(each.where("least < most or low < high").select("fp", "least", (F.col("low") < F.col("high")).alias("differ")), "shared")
    start, stop = F.col("first") - F.col("before"), F.col("first") + k + F.col("after")
    look = F.col("differ") | (stop - start < min_words)
    hit = found.drop("sides").join(shared, "fp").withColumn("look", look).where("look or doc > least")
    a = F.when(F.col("look"), F.col("first") - min_words + k).otherwise(start)
    b = F.when(F.col("look"), F.col("first") + 1).otherwise(stop)
    out = staged(hit.select("key", a.alias("a"), b.alias("b"), "look"), "spots")
    discard(found, shared)
    return out


def _covered(words: Words, ranges: pa.Table) -> np.ndarray:
    """Which words lie in one of the ranges (key, a, b) of their texts."""
    text, a, b = (ranges.column(c).to_numpy() for c in ("key", "a", "b"))
    text = text % _ROWS
    low, high = words.start[text], words.start[text] + words.lengths[text]
    n = len(words.begin) + 1
    cover = np.bincount(np.clip(low + a, low, high), minlength=n) - np.bincount(np.clip(low + b, low, high), minlength=n)
    return np.cumsum(cover[:-1]) > 0


def extensions(stored: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(key, a, b): stretches around differing fingerprints that have an earlier occurrence."""

    def run(block: pa.Table, looks: pa.Table) -> pa.Table:
        cols: list = [np.empty(0, np.int64)] * 5
        if block.num_rows and looks.num_rows:
            ids, key, texts, _ = _opened(*(block.column(c)[0].as_py() for c in ("block", "body")))
            words = Words(texts)
            s = Stretches(words)
            doc, at = s.each(min_words)
            live = _covered(words, looks)[at]
            doc, at = doc[live], at[live]
            x, first = s.of(at, at + min_words), at - s.starts[doc]
            cols = [x.view(np.int64), ids[doc], key[doc], first, _own_repeats(doc, first, x, min_words)]
        release_memory()
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["x", "doc", "key", "first", "own"])

    looks = found.where("look").select(F.shiftright("key", _ROW_BITS).alias("block"), "key", "a", "b")
    every = staged(stored.groupBy("block").cogroup(looks.groupBy("block")).applyInArrow(run, "x long, doc long, key long, first int, own boolean"), "stretches")
    firsts = every.groupBy("x").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    firsts = staged(firsts.where("least < most").drop("most"), "firsts")
    across = every.where("not own").join(firsts, "x").where("doc > least").select("key", "first")
    marks = across.unionByName(every.where("own").select("key", "first"))
    out = staged(marks.select("key", F.col("first").alias("a"), (F.col("first") + min_words).alias("b")), "marks")
    discard(every, firsts)
    return out


def _cut(texts: pa.Array, ranges: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
    """Texts less the words in the ranges, each with the white space after it; then n_lines, n_deleted, n_words, words_deleted."""
    words = Words(texts)
    gone, text, n = _covered(words, ranges), words.text(), len(texts)
    opens = words.line_starts()
    line = np.cumsum(opens | (np.concatenate(([-1], text[:-1])) != text)) - 1
    size, lost = np.bincount(line), np.bincount(line[gone], minlength=int(line[-1]) + 1 if len(line) else 0)
    of_line = text[np.flatnonzero(np.diff(np.concatenate(([-1], line))))]
    counts = [
        (np.diff(words.offsets) > 0) + np.bincount(text[opens], minlength=n),
        np.bincount(of_line[size == lost], minlength=n),
        words.lengths,
        np.bincount(text[gone], minlength=n),
    ]
    if gone.any():
        till = np.concatenate((words.begin[1:], [0]))
        last = (words.start + words.lengths - 1)[words.lengths > 0]
        till[last] = words.offsets[1:][words.lengths > 0]
        edge = np.zeros(len(words.raw) + 1, np.int8)
        edge[words.begin[gone]] += 1
        edge[till[gone]] -= 1  # a run of words ends where the next would start
        keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
        offsets = np.concatenate(([0], np.cumsum(keep)))[words.offsets].astype(np.int32)
        cut = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(words.raw[keep]))
        texts = pc.if_else(texts.is_valid(), cut, pa.scalar(None, pa.string()))
    return texts, counts


def dedup(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """The documents' columns with text less its repeated runs, n_lines, n_deleted (whole lines), n_words, words_deleted."""
    own = ["n_lines", "n_deleted", "n_words", "words_deleted"]
    docs = docs.drop(*own)
    k = max(1, min_words // 3)
    stored = blocks(docs)
    found = spots(staged(prints(stored, k, min_words), "prints"), k, min_words)
    marks = found.where("not look").select("key", "a", "b").unionByName(extensions(stored, found, min_words))
    marks = marks.select(F.shiftright("key", _ROW_BITS).alias("block"), "key", "a", "b")
    kinds = [T.StructField("row", T.StructType([f for f in docs.schema.fields if f.name != "text"])), T.StructField("text", T.StringType())]
    kinds += [T.StructField(c, T.LongType()) for c in own]

    def run(block: pa.Table, ranges: pa.Table) -> pa.Table:
        _, _, texts, row = _opened(*(block.column(c)[0].as_py() for c in ("block", "body")))
        texts, counts = _cut(texts, ranges)
        release_memory()
        return pa.table([row, texts, *(pa.array(c, pa.int64()) for c in counts)], ["row", "text", *own])

    cut = stored.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, T.StructType(kinds))
    return cut.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], *own)
