import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm import packing, queries, token_files
from foliospark.llm.tokens import PieceEncoder

DOCS = "doc_id long, text string, piece string, ids string"
EDGE = [(5, None), (0, ""), (3, "Hello   world's\n\n end "), (3, "Hello   world's\n\n end "), (None, "İstanbul Σας \x1f 中文字 <|endoftext|>"), (9, "ab1 " * 9000), (10, "hello <|endoftext|> x <|startoftext|>y <|EndOfText|>")]


def plain(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def encoder(request):
    return request.param, PieceEncoder(public_tokenizers.path(request.param), 50, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from([*" \n'sStT1²é…“Σ中", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]))).map("".join), max_size=4))
def test_piece_encoder_equals_library(encoder, texts):
    name, e = encoder
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == plain(name, texts)


def check_pieces(docs, got, name="word_bpe_49k.json", end=1, capacity=4096):
    want = []
    for (d, _), ids in zip(docs, plain(name, [t for _, t in docs])):
        ids = ids + [end]
        want += [(d, i // capacity, i, len(ids[i : i + capacity]), crc(ids[i : i + capacity])) for i in range(0, len(ids), capacity)]
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_edges(spark):
    got = packing.pack_documents(spark.createDataFrame([(*r, "p", "i") for r in EDGE], DOCS), public_tokenizers.path("word_bpe_49k.json")).collect()
    check_pieces(EDGE, got)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5_best_fit_packing(spark, sf_dir).collect()
    used = check_pieces(docs, got)
    assert used <= packing.lower_bound(np.array([r.length for r in got]), 4096) + 1


def test_packing_exchange_closes_gaps(spark):
    rng = np.random.default_rng(2)
    data = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(900, 2500, 600))]
    pieces = spark.createDataFrame(data, packing.PIECES)
    used = {}
    for rounds in (0, 3):
        got = packing.pack_pieces(pieces, 4096, per_partition=30, rounds=rounds).collect()
        assert sorted((r.doc_id, r.length) for r in got) == [(x[0], x[3]) for x in data]
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 4096
        used[rounds] = len(bins)
    assert used[3] < used[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bounds_hold(sizes):
    from functools import lru_cache

    @lru_cache(None)
    def best(rest, rooms):
        if not rest:
            return len(rooms)
        x, options = rest[0], []
        for i, r in enumerate(rooms):
            if r >= x and r not in rooms[:i]:
                options.append(best(rest[1:], tuple(sorted(rooms[:i] + (r - x,) + rooms[i + 1 :]))))
        options.append(best(rest[1:], tuple(sorted(rooms + (12 - x,)))))
        return min(options)

    s = np.array(sizes)
    opt = best(tuple(sorted(sizes, reverse=True)), ())
    assert packing.lower_bound(s, 12) <= opt <= packing.best_fit_decreasing(s, 12)[2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=20), max_size=5))
def test_block_round_trip(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    sizes = np.array([len(d) for d in docs], np.int64)
    got, n = token_files.decode_blocks(b"xx" + b"".join(token_files.encode_blocks(flat, sizes)), 2)
    assert got.tolist() == flat.tolist() and n.tolist() == sizes.tolist()


def file_rows(docs):
    order = sorted(zip([d for d, _ in docs], plain("byte_bpe_50k.json", [t for _, t in docs])), key=lambda x: (x[0] is not None, x[0] or 0))
    out, at = [], 0
    for d, ids in order:
        out.append((d, at, len(ids) + 1, crc([*ids, 0])))
        at += len(ids) + 1
    return sorted(out, key=str)


def test_token_files_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for size in (64 << 20, 20_000):
        got = token_files.read_token_files(spark, token_files.write_token_files(spark.createDataFrame([(*r, "p", "i") for r in EDGE], DOCS), path, file_bytes=size))
        assert sorted(map(tuple, got.collect()), key=str) == file_rows(EDGE)
    empty = token_files.read_token_files(spark, token_files.write_token_files(spark.createDataFrame([], DOCS), path))
    assert empty.count() == 0


def test_token_files_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op6_token_files(spark, sf_dir).collect()), key=str) == file_rows(docs)


def test_token_files_of_one_id(spark):
    """Equal rows of one doc_id spread over files; each keeps a place of its own."""
    df = spark.createDataFrame([(7, "some words of a text")] * 400 + [(None, "x")] * 50 + [(1, "y")], "doc_id long, text string").repartition(4)
    path = token_files.write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"), file_bytes=500)
    files = spark.read.parquet(f"{path}/segments").select("file_no").distinct().count()
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert files > 4 and [r.doc_id for r in got] == [None] * 50 + [1] + [7] * 400
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_packing_of_equal_rows_and_gaps(spark):
    """Equal rows spread over partitions, and rows of groups that meet their bound say so."""
    rows = [(1, 0, 0, 2000, 5)] * 4000 + [(2, 0, 0, 96, 6)] * 2000
    got = packing.pack_pieces(spark.createDataFrame(rows, packing.PIECES), 4096, per_partition=600).collect()
    assert len(got) == 6000 and len({r.sequence_id >> 20 for r in got}) >= 10
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 2000 * 1.05 and all(r.n_bins >= r.bound for r in got)
