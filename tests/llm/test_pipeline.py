"""Each stage of the pipeline against a brute-force version on what the stage before kept."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup_decontamination import component_brute_wide, contamination_brute, wide_print
from test_scans import run_brute
from test_token_outputs import check_pieces

import corpus_pipeline as cp
from foliospark.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """The documents before the first stage and after each."""
    root = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{root}/{i}")
        out.append(spark.read.parquet(f"{root}/{i}"))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_columns(kept):
    assert len(cp.STAGES) == 5
    for df in kept[:-1]:
        assert df.columns == COLUMNS


def test_language_stage(kept):
    want = {d: t for d, t in texts(kept[0]) if t and any(c.isalpha() for c in t)}
    assert dict(texts(kept[1])) == want


def test_line_stage(kept):
    before = texts(kept[1])
    want = {d: text for d, text, n, gone, *_ in run_brute(before, 30) if not n or gone < n}
    assert {d: " ".join(t.split()) for d, t in texts(kept[2])} == want
    assert len(want) < len(before)


def test_line_stage_keeps_what_is_not_repeated(spark, sf_dir):
    run, own = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(20))
    rows = [(1, run), (2, f"{run} {own}"), (3, run), (4, " ".join([own[:2], *[f"u{i}" for i in range(40)]] * 5))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(texts(cp.dedup_lines(spark, df, sf_dir)))
    assert set(got) == {1, 2, 4} and got[1] == run and got[2] == own and got[4].split() == rows[3][1].split()[:41]


def test_near_stage(kept):
    before = texts(kept[2])
    limit = simhash.bits_at(0.8, 256)
    fps = {d: wide_print(t) for d, t in before}
    groups = component_brute_wide(fps, limit)
    after = dict(texts(kept[3]))
    assert after == {d: t for d, t in before if d in after}
    # whoever goes has a near copy before it, and nearly all who have one go
    assert all(d in after for d in fps if groups[d] == d)
    rest = [d for d in fps if groups[d] != d]
    assert sum(d not in after for d in rest) >= 0.95 * len(rest)


def test_near_stage_takes_what_is_similar(spark, sf_dir):
    """Documents with some words changed, at known five-word Jaccard similarities."""
    rng = np.random.default_rng(3)
    rows, similar = [], {}
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows.append((1000 * g, " ".join(words)))
        for i, changes in enumerate((1, 4, 6, 60), 1):
            w = list(words)
            for at in rng.choice(400, changes, replace=False):
                w[at] = f"v{rng.integers(0, 5000)}"
            rows.append((1000 * g + i, " ".join(w)))
            a, b = ({tuple(x[j : j + 5]) for j in range(396)} for x in (words, w))
            similar[1000 * g + i] = len(a & b) / len(a | b)
    df = spark.createDataFrame([(d, t, "en", "s", len(t), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    got = dict(texts(cp.dedup_near(spark, df, sf_dir)))
    close, far = [d for d, j in similar.items() if j >= 0.85], [d for d, j in similar.items() if j < 0.5]
    assert len(close) > 80 and sum(d not in got for d in close) >= 0.97 * len(close)
    assert len(far) == 60 and all(d in got for d in far) and all(1000 * g in got for g in range(60))


def test_decontamination_stage(spark, sf_dir, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = texts(kept[3])
    rows = {x[0]: x for x in contamination_brute(before, items)}
    after = dict(texts(kept[4]))
    assert set(after) == {d for d, r in rows.items() if r[2] <= 0.5 * r[1]}
    for d, t in before:
        if d in after and not rows[d][2]:
            assert after[d] == t
    left = {x[0]: x[1] - 0 for x in contamination_brute([(d, t) for d, t in after.items() if rows[d][2]], items)}
    assert all(left[d] == rows[d][1] - rows[d][2] for d in left)
    assert left


def test_packing_stage_and_run(spark, sf_dir, kept):
    docs = texts(kept[4])
    check_pieces(docs, kept[5].collect())
    again = cp.run(spark, sf_dir)
    assert again.columns == kept[5].columns
    assert again.select("doc_id", "piece", "ids_crc32").exceptAll(kept[5].select("doc_id", "piece", "ids_crc32")).count() == 0
    assert again.count() == kept[5].count()


def test_stages_on_edges(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "", None, None, 0), (2, "Some words here. " * 2000, "en", "s", 1), (2, "Some words here. " * 2000, "en", "s", 1), (3, "!!", "en", "s", 2)])):
        df = spark.createDataFrame(rows, schema)
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{name}{i}")
            df = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert df.where(F.col("offset") < 0).count() == 0


def test_stages_with_clashing_columns(spark, sf_dir):
    """Columns with the names of an operator's results pass all stages but the last unchanged."""
    names = ["lang_pred", "score", "n_words", "words_deleted", "spans", "item_ids", "row", "rest", "component_id", "key"]
    rows = [(i, f"Some words of text number {i} stand here. " * (1 + i % 3), "en", *[f"{c}{i}" for c in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in names))
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, sf_dir)
        assert df.columns == ["doc_id", "text", "lang", *names]
        got = df.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert cp.STAGES[-1][1](spark, df, sf_dir).count() == len(got)


def test_library_works_with_a_broken_subpackage(tmp_path):
    """A leftover folder, or a package that a dependency of the subpackage is missing from, does not take the library along."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    for name, spoil in (("empty", "rm -r foliospark/llm && mkdir foliospark/llm"), ("missing", "echo raise ImportError > xxhash.py")):
        os.mkdir(tmp_path / name)
        subprocess.run(f"cp -r {root}/foliospark {root}/__spark_entry__.py {root}/corpus_pipeline.py . && {spoil}", shell=True, check=True, cwd=tmp_path / name)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_library_works_without_the_subpackage(tmp_path):
    """The entry module imports and lists the library's queries where the subpackage is gone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(f"cp -r {root}/foliospark {root}/__spark_entry__.py {tmp_path} && rm -r {tmp_path}/foliospark/llm", shell=True, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
