"""Queries opN_<name> over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import compression_language, decontamination, feistel_pseudonyms, golay_dedup, line_dedup, noisy_toxicity, piece_codec, pivot_search, recurrent_lm, resharding
from seqlake.llm.common import held_out, table


def tokenizer(name: str = "piece_bpe_32k.model") -> bytes:
    """A public tokenizer's model file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.digests(piece_codec.decode_documents(piece_codec.encode_documents(docs, model), model))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 10, 0))


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From eight shards by source to eight of near equal bytes."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(8))
    placed = resharding.reshard(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), old, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op5_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_removed")


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "demonstration key")


def op8_noisy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = noisy_toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    scored = noisy_toxicity.score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= noisy_toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = compression_language.learn(docs, ~held_out("doc_id", 4, 2))
    found = compression_language.predict(docs, dictionaries)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivot_search.top_k(rows, F.col("vec_id") % 20 == 0)


OP10_SQL = """
with sound as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
    from sound q join sound c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
) where rank <= 20
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_piece_codec, op3_recurrent_lm, op4_resharding, op5_golay_dedup, op6_line_dedup, op7_feistel_pseudonyms, op8_noisy_toxicity, op9_compression_language, op10_pivot_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op10_pivot_search": OP10_SQL}
