"""The corpus pipeline: documents to encoded training text in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.files import Files, shared_folder
from tidelake.llm.bpe import encode_documents
from tidelake.llm.common import documents
from tidelake.llm.mixing import mix_documents
from tidelake.llm.secrets import redact
from tidelake.llm.similar import keep_one_alike
from tidelake.llm.toxicity import drop_toxic, train_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go, all others stay; texts that are null or have no words score 0. Without labels of both kinds none goes."""
    return drop_toxic(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; texts without words are one group."""
    return keep_one_alike(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind and verdict; all documents stay."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come at their target weights."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a proof that they decode to its text; a null or empty text has no tokens."""
    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the network nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the session's shared folder and read again.

    A stage's output goes as soon as the next one's is written; the last one's,
    which the result reads, goes when the driver ends.
    """
    files = Files(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    atexit.register(_drop, spark, files)
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(files.path(name))
        docs = spark.read.parquet(files.path(name))
        if before:
            files.delete(before)
        before = name
    return docs


def _drop(spark: SparkSession, files: Files) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped
        with contextlib.suppress(Exception):  # the session may be gone, and with it the way to its files
            files.delete()
