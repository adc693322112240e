"""Benchmark decontamination with a generalised suffix automaton.

The automaton accepts every run of words of every benchmark item.  A document's words are streamed
through it; the state and the length of the longest suffix that is part of some item tell at each
word which item windows end there.  A window is `window` consecutive item words, or a whole shorter
item.  Words outside the benchmark's vocabulary reset the automaton, so only stretches of known
words are walked.

Benchmark items are indexed in blocks of at most `block_words` words (by item_id); each block is
one pass over the documents, so neither the driver nor an executor holds more than a block, about a
hundred megabytes for as many words as the default.

Cases: null or empty texts and items have no words; an item without words has no window; an empty
benchmark hits nothing; repeated items and item_ids count once by item_id; a null item_id reads as
the empty string; repeated documents repeat; a very long text is streamed like any other.  Result
columns replace document columns of the same name.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEPARATORS, WORD_BYTES, arrow_map, staged

_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the word sequences of items, with the items of each window.

    States are places in flat arrays, with their first transition; only states with more have a table of
    their own.  So a word of an item takes some tens of bytes.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to, self.link, self.length = (array("i") for _ in range(4))
        self.more: dict[int, dict[int, int]] = {}
        self._state(-1, 0)
        self.names = sorted({name for name, words in items if words})
        number = {name: i for i, name in enumerate(self.names)}
        known = [(number[name], array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])) for name, words in items if words]
        for _, ids in known:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: by state: its suffix of exactly window length
        self.window_state = array("i", [self._ancestor(s, window) for s in range(len(self.to))])
        #: states of exactly window length in order, and beside each the number of an item with that window
        windows: set[tuple[int, int]] = set()
        #: by state: (words, number) of short items that end wherever this state's strings end
        ends: dict[int, list[tuple[int, int]]] = {}
        for item, ids in known:
            state = 0
            for i, c in enumerate(ids, 1):
                state = self._next(state, c)
                if i >= window:
                    windows.add((self._ancestor(state, window), item))
            if len(ids) < window:
                ends.setdefault(self._ancestor(state, len(ids)), []).append((len(ids), item))
        ordered = sorted(windows)
        self.window_states, self.window_items = array("i", [s for s, _ in ordered]), array("i", [i for _, i in ordered])
        self.short: dict[int, list[tuple[int, int]]] = {}
        if ends:
            for s in range(len(self.to)):
                at, found = s, []
                while at > 0:
                    found += ends.get(at, [])
                    at = self.link[at]
                if found:
                    self.short[s] = found
        self.least = min([min(len(ids), window) for _, ids in known], default=0)

    def _state(self, link: int, length: int) -> int:
        for kept, value in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            kept.append(value)
        return len(self.to) - 1

    def _next(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        return self.more.get(state, {}).get(c, -1)

    def _set(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _ancestor(self, state: int, length: int) -> int:
        """The state on the suffix path that holds the suffix of this length, or -1 if all are shorter."""
        if self.length[state] < length:
            return -1
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _copy(self, p: int, c: int, q: int) -> int:
        """Splits q so that strings up to length[p] + 1 have a state of their own."""
        new = self._state(self.link[q], self.length[p] + 1)
        self.word[new], self.to[new] = self.word[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._next(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self._next(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new = self._state(0, self.length[last] + 1)
        p = last
        while p >= 0 and self._next(p, c) < 0:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items hit."""
        n = len(words)
        if not self.least or n < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        items: set[int] = set()
        word, to, more, link, length, short, window = self.word, self.to, self.more, self.link, self.length, self.short, self.window
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while True:
                    if word[state] == c:
                        goes = to[state]
                    else:
                        goes = more[state].get(c, -1) if state in more else -1
                    if goes >= 0 or not state:
                        break
                    state = link[state]
                    matched = length[state]
                if goes < 0:
                    continue
                state, matched = goes, matched + 1
                reach = 0
                if matched >= window:
                    reach = window
                    found.add(state)
                if short and state in short:
                    for k, item in short[state]:
                        if k <= matched:
                            items.add(item)
                            reach = max(reach, k)
                if reach:
                    start = i - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        for state in {self.window_state[s] for s in found}:
            items.update(self.window_items[bisect_left(self.window_states, state) : bisect_right(self.window_states, state)])
        return spans, {self.names[i] for i in items}


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """Automata over blocks of items; usually one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), SEPARATORS)))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield ItemAutomaton([(r.name, words_of(r.text)) for r in part.collect()], window)


def _without(text: str, words: list[bytes], spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, clean: bool = False, block_words: int = 500_000) -> DataFrame:
    """The documents' columns with n_words, spans (list of start and end, in words) and item_ids (sorted).

    With clean, clean_text is the text without the hit spans.
    """
    own = ["n_words", "spans", "item_ids"] + ["clean_text"] * clean
    df = docs.drop(*own)
    kinds = {"n_words": "long", "spans": "array<array<int>>", "item_ids": "array<string>", "clean_text": "string"}
    arrow = {"n_words": pa.int64(), "spans": pa.list_(pa.list_(pa.int32())), "item_ids": pa.list_(pa.string()), "clean_text": pa.string()}
    before = df.columns
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(", ".join(f"{c} {kinds[c]}" for c in own)).fields)
    first = True
    for automaton in _blocks(benchmark, window, block_words):
        if not first:
            df = staged(df, "decontamination")
            shared.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(automaton)  # of block_words words at most

        def run(batch: pa.RecordBatch, shared=shared, first=first) -> pa.RecordBatch:
            index = shared.value
            at = batch.schema.get_field_index
            texts = batch.column(at("text")).to_pylist()
            old = [([], [])] * len(texts) if first else zip(batch.column(at("spans")).to_pylist(), batch.column(at("item_ids")).to_pylist())
            cols: dict[str, list] = {c: [] for c in own}
            for text, (spans, names) in zip(texts, old):
                words = words_of(text)
                got, items = index.match(words)
                merged: list[list[int]] = []
                for a, b in sorted([*map(tuple, spans), *got]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cols["n_words"].append(len(words))
                cols["spans"].append(merged)
                cols["item_ids"].append(sorted({*names, *items}))
                if clean:
                    cols["clean_text"].append(_without(text, words, merged) if merged else text)
            return pa.record_batch(
                [batch.column(at(c)) for c in before] + [pa.array(cols[c], arrow[c]) for c in own], before + own
            )

        df = arrow_map(df, run, schema)
        first = False
    return df


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents with the columns given: hit spans are cut out of text; those with more than max_coverage of their words hit go."""
    out = scan(docs, benchmark, window, clean=True)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    kept = out.where(hit <= F.lit(max_coverage) * F.col("n_words"))
    return kept.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
