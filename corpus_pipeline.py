"""The corpus pipeline: every stage works on all that the one before it kept, written as Parquet and read again.

All stages but the last return the columns of documents, whatever they are called besides doc_id and text; rows with
null ids or texts, repeated rows and empty tables pass through as the stages' modules say:

1. toxicity: documents that the ordinal regression rejects go.
2. near_dedup: of each group of near-duplicates the document of smallest id stays.
3. decontaminate: documents that a benchmark window occurs in go.
4. secrets: secrets in the texts are masked; no document goes.
5. bpe: each remaining text's token ids, digested, and the digest of what they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evspark.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from evspark.llm.common import cut_lineage, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut_lineage(secrets.candidates(docs))  # learnt from and scored
    return secrets.redact(docs, secrets.fit_for(found), found=found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The stages learn models and encode: SQL can't express them, and the tests compare with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of sf_dir.

    The others are written to the shared checkpoint folder; a stage's output goes when the next one is written, and the
    last of them (folder corpus-*) is what the result is read from.
    """
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _delete(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
