import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import decontamination, exact_dedup, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in texts], DOCS)


EDGE = [(0, None), (1, ""), (2, "   "), (3, "a b  c"), (4, "a\tb\nc"), (5, "x" * 30_000), (6, "x" * 30_000), (None, "a b c"), (7, "One. Two " * 3000), (3, "a b c")]


def dedup_brute(docs):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in docs]
    groups = defaultdict(list)
    for d, n in norm:
        groups[n].append(d)
    keep = {n: min((d for d in ds if d is not None), default=None) for n, ds in groups.items()}
    return Counter((d, keep[n], len(groups[n]), d == keep[n], hashlib.sha256(n.encode()).hexdigest()) for d, n in norm)


def test_exact_dedup_edges(spark):
    got = exact_dedup.dedup(rows(spark, EDGE)).drop("n_chunks")
    assert Counter(map(tuple, got.collect())) == dedup_brute(EDGE)
    assert exact_dedup.dedup(rows(spark, [])).count() == 0


def test_exact_dedup_unverified_identifiers(spark, monkeypatch):
    """With a hash that collides all the time, results stay exact."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 3)
    got = exact_dedup.dedup(rows(spark, EDGE), 3, 6).drop("n_chunks")
    assert Counter(map(tuple, got.collect())) == dedup_brute(EDGE)


def test_exact_dedup_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op2_exact_dedup(spark, sf_dir).collect())) == dedup_brute(docs)


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def contamination_brute(docs, items, k=10):
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        if w:
            for i in range(max(1, len(w) - k + 1)):
                windows[tuple(w[i : i + k])].add(str(name))
    lengths = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    names |= got
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_edges(spark):
    items = [(1, "a b c d e f g h i j k l"), (2, "x y"), (3, "b c"), (4, None), (5, ""), (11, "c d e f g h i j k l m n"), (2, "x y"), (6, "Z é9")]
    docs = [(0, None), (1, ""), (2, "A b c, d e f g h i J k"), (3, "x y x y x"), (4, "c d e f g h i j k l m q x b c z É9 z é9"), (5, "a b " * 2000), (5, "b-c")]
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 5):
        got = decontamination.scan(rows(spark, docs), b, block_words=block)
        assert "kept" in got.columns
    got = decontamination.report(rows(spark, docs), b)
    assert Counter(map(tuple, got.collect())) == contamination_brute(docs, items)
    spans = decontamination.scan(rows(spark, docs), b, block_words=5)
    n = {tuple(r) for r in spans.select("doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0]), F.size("item_ids")).collect()}
    assert n == {x[:4] for x in contamination_brute(docs, items)}
    assert decontamination.report(rows(spark, []), b).count() == 0
    assert decontamination.report(rows(spark, docs), b.limit(0)).where("contaminated").count() == 0


def test_decontamination_cuts(spark):
    b = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = [(0, "Keep this. A b c d e f g h i j! And this, and more words of it here too."), (1, "a b c d e f g h i j k l"), (2, None), (3, "")]
    got = {r.doc_id: r.text for r in decontamination.decontaminate(rows(spark, docs), b).collect()}
    assert got == {0: "Keep this. ! And this, and more words of it here too.", 2: None, 3: ""}


def test_decontamination_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = Counter(map(tuple, queries.op3_benchmark_decontamination(spark, sf_dir).collect()))
    assert got == contamination_brute(docs, items)
    assert any(x[-1] for x in got)


def print_brute(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def wide_print(t, k=5, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    out = []
    for j in range(words):
        h = simhash._rehashed(np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64), j).tolist()
        out.append(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)))
    return out


def component_brute_wide(fps, max_bits):
    """Of {doc: words of its fingerprint}: the smallest doc of each one's group."""
    f = np.array(list(fps.values()), np.uint64)
    label = np.array(list(fps))
    near = [np.flatnonzero(np.bitwise_count(f ^ x).sum(axis=1) <= max_bits) for x in f]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(fps, label.tolist()))
        label = new


def component_brute(fps, max_bits=4):
    f = np.array([x for _, x in fps], np.uint64)
    label = np.array([d for d, _ in fps])
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= max_bits) for x in f]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip((d for d, _ in fps), label.tolist()))
        label = new


def test_simhash_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(d, print_brute(t)) for d, t in docs]
    got = queries.op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{x:016x}" for d, x in fps}
    assert {r.doc_id: r.component_id for r in got} == component_brute(fps)


@pytest.mark.parametrize("cell_rows", [20_000, 40])
def test_simhash_links_are_complete(spark, cell_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:60]:  # chains of neighbours at up to 6 bits, and a dense ball
        for n in (1, 2, 3, 4, 4, 5, 6):
            fps.append(int(x) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    for _ in range(300):
        fps.append(int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps = list(dict.fromkeys(fps))
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(fps)], "f0 long, doc long").repartition(4)
    found = {r.node: r.component for r in simhash.components(simhash.links(frame, 4, cell_rows)).collect()}
    want = component_brute(list(enumerate(fps)))
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_edges(spark):
    got = simhash.near_duplicates(rows(spark, EDGE)).collect()
    want = Counter((d, f"{print_brute(t):016x}") for d, t in EDGE)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == want
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == 5 and by[None] == 3
    assert simhash.near_duplicates(rows(spark, [])).count() == 0


def test_simhash_links_through_a_document_without_an_id(spark, monkeypatch):
    """A chain whose middle has no id joins its ends; a group without any id has no component."""
    frame = spark.createDataFrame([(5, 0), (None, 0b1111), (9, 0b11111111), (None, 1 << 40 | 0xFFFF0000), (None, 1 << 41 | 0xFFFF0000)], "doc_id long, f0 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: frame)
    got = {(r.doc_id, r.fingerprint[-4:]): r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == {(5, "0000"): 5, (None, "000f"): 5, (9, "00ff"): 5, (None, "0000"): None}


def test_components_of_hubs_and_chains(spark):
    links = [(i, 7) for i in range(1000, 4000)] + [(i, i + 1) for i in range(5000, 5150)] + [(5075, 2000), (9000, 9001), (9000, 9001), (4, 4), (None, 3)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(links, "u long, v long").repartition(8)).collect()}
    want = dict.fromkeys([7, *range(1000, 4000), *range(5000, 5151)], 7) | {9000: 9000, 9001: 9000}
    assert got == want


def test_wide_fingerprints(spark):
    docs = [(0, "a b c d e f g h"), (1, ""), (None, "a b"), (2, "a b c d e f g h")]
    got = simhash.near_duplicates(rows(spark, docs), k=5, max_bits=simhash.bits_at(0.8, 256), words=4).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(d, "".join(f"{x:016x}" for x in wide_print(t))) for d, t in docs}
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[2] == 0 and by[1] == 1 and by[None] is None


def test_automaton_is_small():
    import random
    import tracemalloc

    rng = random.Random(1)
    items = [(str(i), [b"w%d" % rng.randint(0, 20_000) for _ in range(100)]) for i in range(1000)]
    tracemalloc.start()
    index = decontamination.ItemAutomaton(items, 10)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(index.to) > 100_000 and size < 300 * 100_000
