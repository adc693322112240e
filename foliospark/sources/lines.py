"""Sources: OCR lines from a table, or laid out from plain documents; word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TUNING, Tuning
from ..functions import geometry as geo
from ..functions import strings


def laid_out(docs: DataFrame, *keep: str) -> DataFrame:
    """Lines of eight words from documents, set on pages by integer arithmetic on thousandths.

    Documents whose id is a multiple of three have two columns of 40 lines a page, others one.
    keep: columns of the documents that their lines have as well.  Geometry: top edge, tilt, indent and right end follow from the line's number and the document's id.
    """
    t = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    d = docs.select("doc_id", *keep, t.alias("t")).where(F.size("t") > 0)
    n = F.floor((F.size("t") - 1) / 8).cast("int")
    g = d.select("doc_id", *keep, "t", F.explode(F.sequence(F.lit(0), n)).alias("g"))
    g = g.withColumn("two", F.col("doc_id") % 3 == 0).withColumn("per", F.when(F.col("two"), 80).otherwise(40))
    g = g.withColumn("page_idx", F.floor(F.col("g") / F.col("per")).cast("int")).withColumn("r", F.col("g") % F.col("per"))
    g = g.withColumn("col", F.floor(F.col("r") / 40).cast("int")).withColumn("rr", F.col("r") % 40)
    seven = (F.col("g") + F.col("doc_id")) % 7
    h = F.when(seven == 0, 11).when((F.col("rr") >= 33) & (F.col("doc_id") % 2 == 0), 14).otherwise(18)
    g = g.withColumn("h", h).withColumn("top", 980 - 24 * F.col("rr")).withColumn("tilt", 2 * (F.col("doc_id") % 3 - 1))
    g = g.withColumn("x0", F.when(F.col("col") == 1, 530).otherwise(60) + F.when(seven == 1, 20).otherwise(0))
    g = g.withColumn("x1", F.when(F.col("two") & (F.col("col") == 0), 470).otherwise(940) - 10 * ((F.col("g") + F.col("doc_id")) % 5))
    thousandth = lambda c: c / F.lit(1000.0)
    x0, x1, top, tilt, h = (F.col(c) for c in ("x0", "x1", "top", "tilt", "h"))
    return g.select(
        *keep,
        "doc_id",
        "page_idx",
        F.col("r").cast("int").alias("line_no"),
        F.array_join(F.slice("t", F.col("g") * 8 + 1, F.lit(8)), " ").alias("text"),
        ((50 + (7 * F.col("g") + 13 * F.col("doc_id")) % 50) / F.lit(100.0)).cast("float").alias("confidence"),
        thousandth(x0).alias("tl_x"),
        thousandth(top).alias("tl_y"),
        thousandth(x1).alias("tr_x"),
        thousandth(top + tilt).alias("tr_y"),
        thousandth(x0).alias("bl_x"),
        thousandth(top - h).alias("bl_y"),
        thousandth(x1).alias("br_x"),
        thousandth(top - h + tilt).alias("br_y"),
    )


def recognised(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Lines of a raw table that are large enough to be text."""
    return lines.where((geo.width() > tuning.min_line_width) & (geo.height() > tuning.min_line_height))


def top_candidate(candidates: DataFrame) -> DataFrame:
    """The most confident text of each line; ties go to the first text."""
    best = F.min_by(F.struct("text", "confidence"), F.struct(-F.col("confidence"), F.col("text")))
    return candidates.groupBy("doc_id", "page_idx", "line_no").agg(best.alias("b")).select("doc_id", "page_idx", "line_no", "b.text", "b.confidence")


def document_lines(spark: SparkSession, sf_dir: str, *keep: str, together: bool = False) -> DataFrame:
    """together: documents are dealt out by their id before they are laid out, so that their pages' lines lie together and
    need no shuffle by page, which would take several times the documents' room."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if together:
        docs = docs.select("doc_id", "text", *keep).where("doc_id is not null").repartition("doc_id")
    return recognised(laid_out(docs, *keep))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Custom words of text files, one entry a row."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(strings.custom_words(F.col("value"))).alias("word")).distinct()
