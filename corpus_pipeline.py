"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
applies them in order and writes what a stage returns as Parquet in the shared folder before the next one reads it.

Nulls, empty and very long texts, repeated rows and empty tables are handled as the operators' docstrings say; rows
without a doc_id and rows that share one are documents like any other. Columns beyond those of documents pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, langid, mixing, simhash, tokens
from quillspark.llm.common import read, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter or with a posterior below one half go."""
    found = langid.predict(docs, langid.fit_documents(docs), out_col="_language")
    return found.where((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, of equal ids that of the smallest hash of its text.

    Rows are numbered, and the numbers written, as ids may be null or repeated."""
    row = next(name for name in ("_row" + "_" * k for k in range(len(docs.columns) + 1)) if name not in docs.columns)
    rows = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(rows, id_col=row).select(row, "component_id")
    order = rows.select(row, F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("text"), F.col(row).alias("row")).alias("order"))
    kept = found.join(order, row).groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item."""
    judged = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return judged.where("not contamination.contaminated").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.repeat_rows(mixing.mix(docs)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and what a reader finds in them: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: SQL can express neither language models nor tokenizers: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"pipeline-{name}")
    return docs
