"""Corpus preparation: language ID, near-dedup, decontamination, secrets, packing.

Each stage works on all that its predecessor kept, written as Parquet and read
again.  All but the last return the columns of ``documents``, whatever these are.

Odd input, for every stage: rows that repeat are decided alike, but for near_dedup, which
keeps one of them; an empty table gives an empty table; extra columns are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, packing, secrets, simhash
from quern.llm.common import discard, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models can tell; rejected ones go, as do null texts and texts without a letter."""
    model = langid.train(docs.where(~langid.held_out("doc_id") & F.col("doc_id").isNotNull()))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate group; null and empty texts are one group, rows without an id stay."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars brought up to date; a null text stays null."""
    return secrets.redact(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 1024, a row for each piece; a null text is an empty one."""
    return packing.pack(docs, packing.byte_bpe_path(), keep_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("pack_sequences", pack_sequences),
]

#: Language models, XXH64 fingerprints and byte-level BPE are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again; what the next has read is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = False
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if own:
            discard(docs)
        docs, own = spark.read.parquet(path), True
    return STAGES[-1][1](spark, docs, sf_dir)
