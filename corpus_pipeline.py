"""From raw documents to token ids: good texts, new lines, one of each group of near copies, no benchmark passages, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
docs, whatever their names. A null text counts as empty everywhere; an empty table stays
empty. A document whose lines all go has an empty text then, and of all texts without
words near dedup keeps the one with the least id. Rows with a null id are judged by the
classifier and searched for passages like others, but neither lose lines nor count as
copies. Repeated rows are one document: they lose the same lines and stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from histframe.llm import bpe, decontam, linededup, probminhash, quality_model
from histframe.llm.common import release, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    return quality_model.keep_good(docs, _table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that an earlier one holds; n_chars follows the text."""
    release(spark, "pipeline")
    return linededup.without_lines(docs, length="n_chars", scope="pipeline")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id."""
    release(spark, "pipeline")
    return probminhash.dedup(docs, scope="pipeline")


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    release(spark, "pipeline")
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"), scope="pipeline")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the hashes of ids and decoded bytes."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id",))


STAGES = [("quality", good_texts), ("line_dedup", new_lines), ("near_dedup", one_of_each), ("decontamination", unseen), ("byte_bpe", encoded)]

#: Hash-seeded word vectors and a trained network aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/histframe/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    release(spark, "pipeline")
    return docs
