from foliospark import cli
from foliospark.sources import lines as src
from foliospark.streaming import pages


def test_parse():
    c = cli.parse(["a", "b", "--lang", "de-DE,en", "--fix-diacritics", "--dpi", "200", "--unknown"])
    assert c.languages == ["de-DE", "en"] and c.fix_diacritics and c.images["dpi"] == 200 and not c.split_merged_words


def test_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Kant read a book (Kant, 1999). " * 40), (3, "Words of two columns. " * 60)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    cli.run(spark, cli.parse([f"{tmp_path}/docs", f"{tmp_path}/out", "--lang", "en", "--sidecar", f"{tmp_path}/text", "--customwords", "book, Moss", "--names", f"{tmp_path}/names", "--fix-diacritics", "--split-merged-words"]))
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 2
    assert {r.value for r in spark.read.text(f"{tmp_path}/names").collect()} == {"Kant", "Moss", "book"}
    assert not (tmp_path / "out.work").exists()
    assert "--- page 1 (source page 1) ---" in {r.value for r in spark.read.text(f"{tmp_path}/text").collect()}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    lines = src.laid_out(docs)
    lines.repartition(5, "doc_id", "page_idx").write.parquet(f"{tmp_path}/in")
    stream = pages.line_stream(spark, f"{tmp_path}/in", lines.schema, 2)
    pages.start(stream, pages.summaries, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = pages.summaries(spark.read.parquet(f"{tmp_path}/in"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
