"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
all but the last return the columns of ``docs``. ``run`` writes what a stage returns as Parquet in the
folder that the cluster shares and reads it again, so that no stage is computed twice and a lost
executor costs tasks, not stages.

Every stage takes null texts as empty and null ids as ids of their own, passes other columns on whatever their names, and
gives an empty table for an empty one. What it does with repeated rows and ties is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from aforo.llm import decontaminate, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from aforo.llm.common import drop_rows, keep_rows, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity reaches the threshold.

    Repeated rows are judged alike, empty texts by the score of no text; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest id.

    A null id comes last; of rows with the same id and text one stays. Null and empty texts are equal.
    """
    return keep_rows(docs, exact_dedup.exact_dedup(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by 0.8 of their five-word shingles.

    The smallest id stays, of rows with the same id the one with the least text hash; texts without words are linked with nothing
    and all stay; a null id stays only where its group has no other.
    """
    return keep_rows(docs, near_dedup.near_dedup(docs, shingle=5).filter("stays"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Decisions go by id and text, so that repeated rows go or stay together; empty texts hold nothing.
    """
    return drop_rows(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document: a row for each row, an empty text has begin and end only."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(), extra=("ids",), cached=150_000)  # workers hold other stages' tables too


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", tokenise),
]

#: Trained scores, signatures and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{top}/{i}")
            docs = spark.read.parquet(f"{top}/{i}")
    return docs
