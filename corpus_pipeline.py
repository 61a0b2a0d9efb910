"""A corpus pipeline of five stages; each writes Parquet that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents, whatever columns there
are besides. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, linededup, mixing, simhash, toxicity
from tessera.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from labelled rows of ``docs``.

    Null texts score as empty ones; rows without an id are scored but not learnt from;
    repeated rows share their score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_table(docs, labels, ~toxicity.held_out())
    scored = toxicity.score(docs, model, columns=docs.columns)
    return scored.where(F.col("score") < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line, exactly or within the edit bound.

    Rows stay, if with an empty text; null texts and rows without an id stay as they are.
    """
    return linededup.dedup_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group with near fingerprints.

    Null and empty texts are one group; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate asks for.

    A null source is a source of its own; rows without an id draw by their text.
    """
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each emitted document.

    Null texts encode as empty ones; repeated rows repeat their results.
    """
    return bpe.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_each_group),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

#: SQL can express neither the string-kernel SVM nor XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's Parquet being the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
