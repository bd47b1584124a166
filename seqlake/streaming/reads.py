"""Streams of reads: the stateless operators as they are, and de-duplication under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.sequence import collapse_runs, encode_lengths, reverse_complement, run_lengths, sequence_key
from seqlake.operators.alignments import read_statistics


def stream_tables(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of reads as they come in."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def encoded(reads: DataFrame) -> DataFrame:
    """reads with collapsed sequence, run lengths and reverse complement; a stream stays a stream."""
    return reads.withColumns({"collapsed": collapse_runs(F.col("seq")), "lengths": encode_lengths(run_lengths(F.col("seq"))), "rc": reverse_complement(F.col("seq"))})


def statistics(reads: DataFrame) -> DataFrame:
    return read_statistics(reads)


def distinct_sequences(reads: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """The first read of each sequence, as far as the watermark remembers; state is bounded by it."""
    return reads.withWatermark(time, late).withColumn("key", sequence_key(F.col("seq"))).dropDuplicatesWithinWatermark(["key"])


def counts_by_window(reads: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, reads, bases for each window of time."""
    return reads.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))
