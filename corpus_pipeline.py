"""A corpus from raw documents to token ids: five stages, each over all that the one before has kept.

1. toxicity (op 8): documents whose deobfuscated text scores as toxic go.
2. line_dedup (op 6): lines that resemble an earlier line go from the texts.
3. near_duplicates (op 5): of each component of linked fingerprints the document with the smallest id stays.
4. decontamination (op 1): documents that hold a benchmark item go.
5. tokens (op 2): texts become ids; n_tokens, ids (little-endian unsigned 32-bit integers) and round_trip, which says
   whether the ids decode to the text, follow the columns of documents.

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents. Rows with null,
empty or repeated values pass through the operators as these define; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import catalog, decontamination, golay_dedup, line_dedup, noisy_toxicity, piece_codec
from seqlake.llm.common import held_out, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = noisy_toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return noisy_toxicity.reject(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(docs, catalog.tokenizer())


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("tokens", tokens)]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
