"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text (white-space runs as one space) is cut into chunks at content-defined places: the first
sentence mark at or after `min_chars` ends a chunk, `max_chars` ends it at the latest.  A chunk's
64-bit hash becomes its identifier once verified: chunk texts are deduplicated in each task before
one shuffle, and a hash met with two different texts is set aside.  A document is then the ordered
list of its chunk identifiers, and only those lists are compared.  Documents with a chunk whose
hash could not be verified are compared by their text, so results are exact.

Cases: null text counts as empty; an empty document's recipe is empty, and all of them form one
group; an empty table gives no rows; rows sharing a doc_id are rows of their own (each is kept if
its id is the group's smallest); a null doc_id stays only if its group has no other id.  Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def normalised(text):
    """Null as empty and each run of white space as one space; lone spaces are left as they are."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def chunks(text, min_chars: int, max_chars: int):
    """The chunks of a text, in order; joined they give the text."""
    mark = r"[.!?;:。！？।؟]"
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{min_chars - 1},{max_chars - 1}}}?{mark}|.{{1,{max_chars}}}"), F.lit(0))


def dedup(docs: DataFrame, min_chars: int = 1000, max_chars: int = 4000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    cut = source.select("doc_id", "norm", chunks(F.col("norm"), min_chars, max_chars).alias("chunks"))

    # (identifier, text) once per task, then once for all
    seen = cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("id"), "chunk").distinct()
    unverified = staged(seen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "unverified")

    recipes = staged(
        cut.select(
            "doc_id",
            F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"),
            F.sha2("norm", 256).alias("text_sha256"),
        ),
        "recipes",
    )
    named = recipes.withColumn("exact", F.lit(None).cast("string"))
    if not unverified.isEmpty():
        # rare: only the recipes with such a chunk, and the texts of their documents, go on to be compared by text
        bad = recipes.select("ids").distinct().select("ids", F.explode("ids").alias("id")).join(unverified, "id", "left_semi")
        bad = staged(bad.select("ids").distinct(), "bad")
        texts = cut.select("doc_id", F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"), F.sha2("norm", 256).alias("text_sha256"), F.col("norm").alias("exact"))
        named = named.join(bad, "ids", "left_anti").unionByName(texts.join(bad, "ids", "left_semi"))
    groups = named.groupBy("ids", "exact").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    a, g = named.alias("a"), groups.alias("g")
    # a sort-merge join: adaptive execution splits the partition of a hot group
    joined = a.join(g.hint("merge"), (F.col("a.ids") == F.col("g.ids")) & F.col("a.exact").eqNullSafe(F.col("g.exact")))
    return joined.select(
        "a.doc_id",
        "keep_id",
        "group_size",
        F.col("a.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("a.ids").alias("n_chunks"),
    )
