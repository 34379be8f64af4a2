"""A training corpus from raw documents: toxicity, quality, near copies, benchmark leaks, and encoding.

Each stage works on the rows that the one before kept. All but the last return the columns of documents.

Null, empty and wordless texts: scored like texts without any matching word, copies of nothing, no leak, no ids. Very long texts
are read whole by every stage. Repeated rows: one stays, unless they have no words. Null doc_id: such rows are judged by their texts
like all others, and are the last choice of a group of copies. Ties between copies: the smallest doc_id stays, then the least hash
of the text. No labels, or labels of one kind only: nothing to learn, so that stage keeps everything. An empty benchmark: no leaks. An
empty table gives no rows. Extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm import bpe, decontaminate, jaccard, quality, toxicity
from routelens.llm.common import saved, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), ("n_chars",))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(docs, TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: Models, alignment and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
