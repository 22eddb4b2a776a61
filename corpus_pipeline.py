"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to the shared folder
and reads it back as the next stage's input, and keeps the last stage's result only. All stages but the last return the columns they got, whatever others there
are and whatever their names. Empty tables give empty tables. Defined results of each stage for nulls, long and repeated
texts and ties are in its docstring and in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import bpe, mixing, near_dedup, quality_classifier, secret_scan
from cartolith.llm.shared import documents, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are scored as texts without words; equal texts stay or go together, repeated rows too; a score of
    exactly the threshold stays; labels of ids that are null or have no document are not used.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.accepted(docs, quality_classifier.trained(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the least id, null last; of repeated rows one.

    Null texts count as empty, and empty ones are one class; texts of white space only are duplicates of equal ones only.
    """
    return near_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay, repeated ones too. Null texts stay null; n_chars follows the text."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents of each source to its target weight, some of them twice.

    Documents without a word (null, empty, blank) are not taken; null is a source like others, last; rows that share an id
    are taken or left together; ties in virtual finish go by source, epoch, shuffle and id.
    """
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids of each document, a row for each row.

    Null and empty texts have no ids; null ids stay null.
    """
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.coded(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: Trained models, hashed signatures and regular expressions with state have no SQL form.
ORACLE_SQL = None


@settled
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. The result is a table of its own; all that was written on the way is removed."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settled(stage)(spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
