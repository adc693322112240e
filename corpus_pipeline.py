"""The corpus pipeline: each stage takes the documents that the one before kept and returns documents.

1. language ID: documents without any language (null text, no letters) go.
2. line dedup: repeated runs of 30 words or more are cut out; a document goes only if nothing but runs
   that stood earlier was in it.
3. SimHash near-dedup: fingerprints of 256 bits over shingles of five words link documents whose Jaccard
   similarity is 0.8 or more, as far as fingerprints tell; of linked documents the one with the smallest
   doc_id stays.
4. benchmark decontamination: words of benchmark windows are cut out; a document of which they make
   up over half goes.
5. best-fit packing: one row per piece with its sequence and place.

Cases, in every stage: a null text counts as empty; language ID drops both, and other stages keep them.
Texts are taken whole, however long; documents equal in all columns are treated alike.  Documents without
an id come after all others in line dedup and always stay in near-dedup.  Ties between documents go to the
smaller doc_id.  An empty table gives no rows.  Further columns are passed on, also with names that an
operator gives to its results, up to the last stage, which returns its own columns alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontamination, language_id, line_dedup, packing, simhash
from foliospark.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = language_id.fit(docs)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return language_id.identify(row, models, ["doc"]).where("lang_pred <> 'und'").select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # other columns in one, so that they may have the names of results
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = line_dedup.dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in rest]).alias("rest")))
    kept = cut.where("n_words = 0 or words_deleted < n_words")
    return kept.select(*[F.col(c) if c not in rest else F.col("rest").getField(c).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(docs, k=5, max_bits=simhash.bits_at(0.8, 256), words=4)
    stays = groups.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    d, s = docs.alias("d"), stays.alias("s")
    return d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    kept = decontamination.decontaminate(row, table(spark, sf_dir, "benchmark"))
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers that served the other stages have less room for a memo
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=240_000)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Mixture inference and fingerprints are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "pipeline")
    return docs
