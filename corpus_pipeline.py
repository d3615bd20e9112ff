"""A corpus pipeline: documents in, packed sequences of token ids out.

Each stage takes what the one before has kept, and all but the last return the columns of documents. The driver writes the
result of each stage as Parquet and reads it again for the next one; :func:`run` does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispan.llm import jaccard, langid, linededup, packing, toxicity
from lumispan.llm.common import materialize, table

LEAST_SHARE = 0.4  # of a text's letters in its main language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a main language; the model learns from their own labels but for a held-out third."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def toxic_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier not toxic than toxic, by a model of the labels of those that are left."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).where(~F.col("toxic")).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document goes if it loses lines and none but blank ones is left."""
    done = linededup.dedup_lines(docs)
    left = F.exists(F.split("text", "\n", -1), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))  # what str.split() takes for blank
    return done.where((F.col("n_dropped") == 0) | left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    kept = jaccard.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = docs.doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs.text.cast("string")) == F.col("__hash"))
    return docs.join(kept, same, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("language ID", language_id), ("toxicity", toxic_language), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_copies), ("packing", pack)]

#: No stage can be stated in SQL: models, signatures and tokenizers decide. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
