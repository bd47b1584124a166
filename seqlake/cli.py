"""Command line over the operators: `python -m seqlake.cli COMMAND INPUT... --out FOLDER [options]`. Outputs are folders of part files."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions import sequence as sq
from seqlake.functions.text import parse_pairs, parse_split
from seqlake.operators import alignments as ao
from seqlake.operators import clusters as cl
from seqlake.operators import tables as tb
from seqlake.operators import taxonomy as tx
from seqlake.plans import classifier as cf
from seqlake.sources import sinks
from seqlake.sources import text_formats as src

COMMANDS: dict[str, Callable] = {}


def command(f):
    COMMANDS[f.__name__] = f
    return f


def plain(df: DataFrame) -> DataFrame:
    return df.drop("_ord")


def csv(spark, path, **more) -> DataFrame:
    return plain(src.read_table(spark, path, **more))


@command
def fasta2csv(spark, a):
    sinks.write_table(tb.project(plain(src.read_fasta(spark, a.input, a.limit)), a.on or ["id", "description", "seq"]), a.out)


@command
def csv2fasta(spark, a):
    sinks.write_fasta(tb.two_columns(csv(spark, a.input), ",".join(a.on) if a.on else "1,2"), a.out)


@command
def rlencode(spark, a):
    s = src.read_fasta(spark, a.input, a.limit).withColumn("seq", sq.without_gap(F.col("seq")))
    sinks.write_table(s.select("id", "description", sq.collapse_runs(F.col("seq")).alias("seq"), sq.encode_lengths(sq.run_lengths(F.col("seq"))).alias("rle")), a.out)


@command
def rldecode(spark, a):
    t = csv(spark, a.input)
    sinks.write_fasta(t.select("description", sq.expand_runs(F.col("seq"), sq.decode_lengths(F.col("rle"))).alias("seq")), a.out)


@command
def reverse_complement(spark, a):
    sinks.write_fasta(src.read_fasta(spark, a.input, a.limit).select("description", sq.reverse_complement(F.col("seq")).alias("seq")), a.out)


@command
def fastq_stats(spark, a):
    sinks.write_table(tb.add_constants(ao.read_statistics(src.read_fastq(spark, a.input, a.limit)), parse_pairs(a.add)), a.out)


@command
def dedup(spark, a):
    kept, mapped, weights = cl.dedup_sequences(src.read_fasta(spark, a.input, a.limit))
    sinks.write_fasta(kept, f"{a.out}/kept")
    sinks.write_table(mapped, f"{a.out}/map")
    sinks.write_table(weights, f"{a.out}/weights")


@command
def map_clusters(spark, a):
    reads, specimens, weights = cl.map_clusters(src.read_clusters(spark, a.input), least=a.least or 1)
    for name, df in (("reads", reads), ("specimens", specimens), ("weights", weights)):
        sinks.write_table(df, f"{a.out}/{name}")


@command
def csvjoin(spark, a):
    sinks.write_table(tb.join_tables([csv(spark, p) for p in a.input], a.how, a.on), a.out)


@command
def csvdeduplicate(spark, a):
    sinks.write_table(plain(tb.deduplicate(src.read_table(spark, a.input), a.on, ["_ord"] if a.on else None, a.last) if a.on else tb.deduplicate(csv(spark, a.input))), a.out)


@command
def csvconvert(spark, a):
    sinks.write_table(tb.concatenate([csv(spark, p, sep=a.sep) for p in a.input]), a.out)


@command
def csvmod(spark, a):
    sinks.write_table(tb.add_constants(csv(spark, a.input), parse_pairs(a.add)), a.out)


@command
def tsv2csv(spark, a):
    df = csv(spark, a.input, sep="\t")
    sinks.write_table(tb.split_column(df, *parse_split(a.split)) if a.split else df, a.out)


@command
def reshape(spark, a):
    sinks.write_table(tb.pivot_sum(csv(spark, a.input).withColumn(a.value, F.col(a.value).cast("double")), a.on, a.column, a.value), a.out)


@command
def children(spark, a):
    t = csv(spark, a.input, null_value="")
    sinks.write_table(tx.children(t, a.ids, tx.rank_columns(t)), a.out)


@command
def classifier(spark, a):
    """INPUT: hits with a header; --tables: seq_info, taxonomy, thresholds."""
    info, taxonomy, thresholds = (csv(spark, p, null_value="") for p in a.tables)
    hits = csv(spark, a.input, null_value="").withColumns({"pident": F.col("pident").cast("double")})
    hits = hits.withColumn("mismatch", F.col("mismatch").cast("int") if "mismatch" in hits.columns else F.lit(None).cast("int"))
    summary, details = cf.classify(hits, info, taxonomy, thresholds, specimen=a.specimen, best_n=a.best)
    sinks.write_table(summary, f"{a.out}/summary", decimals=2)
    sinks.write_table(details, f"{a.out}/details", decimals=2)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqlake", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("input", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--on", nargs="+", help="columns")
    p.add_argument("--limit", type=int)
    p.add_argument("--least", type=int, help="smallest cluster")
    p.add_argument("--how", default="inner", choices=["inner", "outer", "left", "right"])
    p.add_argument("--last", action="store_true", help="keep the last row instead of the first")
    p.add_argument("--sep", default=",")
    p.add_argument("--add", default="", help="constants, name:value,...")
    p.add_argument("--split", help="column:delimiter:new,...")
    p.add_argument("--column", help="column whose values become columns")
    p.add_argument("--value", help="column that is summed")
    p.add_argument("--ids", nargs="+", help="taxa")
    p.add_argument("--tables", nargs=3, metavar=("SEQ_INFO", "TAXONOMY", "THRESHOLDS"))
    p.add_argument("--specimen")
    p.add_argument("--best", type=int, help="hits of so many smallest mismatches")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("seqlake").getOrCreate(), a)


if __name__ == "__main__":
    main()
