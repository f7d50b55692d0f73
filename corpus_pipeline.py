"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, whatever others the table has beside its own;
``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import linededup, packing, secrets, simhash, toxicity
from ledgerline.llm.common import checkpoint, discard, fresh, scratch, table

TOXIC = 0.7
MIN_WORDS = 50
#: Differing bits of near copies: what the anchors cover at no more cost than the two bits of op9.
NEAR_BITS = 3


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is; null texts keep what they had."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; the model learns from labelled ones among ``docs`` that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    score = fresh(docs, "score")
    return toxicity.score(docs, model, into=score).where(F.col(score) < TOXIC).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; those that lose all their text go."""
    removed = fresh(docs, "removed_lines")
    deduped = linededup.dedup_lines(docs, MIN_WORDS, into=removed)
    return _counted(deduped.where((F.col(removed) == 0) | (F.col("text") != "")).drop(removed))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 3 bits or fewer: the row of the smallest doc_id and text hash."""
    fps = checkpoint(simhash.fingerprints(docs, hashed=True))
    return simhash.representatives(docs, fps, NEAR_BITS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan finds replaced by a mark."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Models, fixpoints and tokenizers: SQL can't express these rows; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            discard(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
