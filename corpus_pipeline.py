"""From raw documents to token ids: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns documents again; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import byte_bpe, language_id, mixing, private_data, simhash
from tracewell.runtime import free_names, materialize, read_table, ship

VOCABULARY = "byte_bpe_50k.tiktoken"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship(spark)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject, columns as they are.

    Null texts and texts without a letter are rejected; rows that repeat are judged
    each; very long texts are judged whole, in slices; an empty table gives no rows;
    where no label can be learned everything is rejected.
    """
    _small_batches(spark)
    *_, rejected = free_names(docs, "lang_pred", "lang_score", "lang_rejected")
    return language_id.identify(docs).where(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard from 0.8), that of the smallest id.

    Null texts count as empty ones, which are one group; of rows that repeat, of any id
    or none, one stays; very long texts are compared whole; an empty table gives no rows.
    """
    _small_batches(spark)
    return simhash.keep_first(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data; n_chars, where there is one, follows the text.

    Null and empty texts stay as they are, all rows stay, and an empty table gives no rows.
    """
    clean = private_data.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their sources' target weights, one row for each time taken, in the order of their shards.

    Documents without a word, null texts among them, have nothing to take and stay out;
    null sources are a source; rows that repeat an id within a source are taken together; an
    empty table gives no rows. Columns are those of docs, whatever their names.
    """
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text.

    Null and empty texts have no ids; rows that repeat are encoded each, very long texts
    whole; an empty table gives no rows.
    """
    _small_batches(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identified),
    ("simhash", deduplicated),
    ("private_data", sanitised),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: XXH64, minima of hashes, Kneser-Ney models and byte-pair merges are not SQL's; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
