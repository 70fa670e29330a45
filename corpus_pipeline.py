"""A corpus pipeline of five stages, each of which works on all documents that the one before kept.

All stages take documents with any further columns, null or repeated ids, null, empty and very long texts, and an empty
table. All but the last keep the columns of documents as they are, names that clash with results included.

language: documents whose language is unknown go. quality: documents scored below the threshold go. near_duplicates: one
document of each group stays. benchmark: documents with a hit window go. tokens: the token ids of what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, language_id, near_dedup, quality
from lodestone.llm.common import shared_dir, table


def _judged(docs: DataFrame, results: list[str], judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of docs that the results of judge(docs) let through, with the columns of docs: those named as a result stand aside meanwhile."""
    aside, taken = {}, {c.lower() for c in docs.columns} | set(results)
    for c in docs.columns:
        if c.lower() in results:
            aside[c] = f"own_{c}"
            while aside[c].lower() in taken:
                aside[c] += "_"
            taken.add(aside[c].lower())
    kept = judge(docs.withColumnsRenamed(aside)).where(keep)
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that labelled documents have. Null texts and those without letters go; without any labelled text all go; equal texts share their fate."""
    return _judged(docs, ["lang_pred", "score", "cross_entropy", "rejected"], lambda d: language_id.identify(d, language_id.train(d)), "NOT rejected")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above. Without labels of both kinds every score is 0.5, and all go; a null or empty text is scored by its statistics like any other."""
    return _judged(docs, ["score", "predicted"], lambda d: quality.score_quality(d, table(spark, sf_dir, "labels")), "predicted = 1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, null last, of rows equal in id and text one. Null texts count as empty ones, which are one group; texts without words are near equal ones only."""
    return near_dedup.one_of_each_group(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and wordless texts hold none and stay; with an empty benchmark all stay."""
    return _judged(docs, ["n_words", "n_hit", "spans", "items", "contaminated"], lambda d: decontaminate.benchmark_hits(d, table(spark, sf_dir, "benchmark")), "NOT contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, ids_sha256 and decoded_sha256 of each document; a null text has no tokens; repeated rows are encoded each."""
    return bpe.bpe_round_trip(docs.select("doc_id", "text"), keep_text=False).select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: The stages' models and signatures are not expressible in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
